"""The registered queries on the small tables, against DuckDB or by their contracts."""

import glob
import os

import duckdb
import pytest

from millrace.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    1: ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    2: ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    3: ["doc_id", "start", "n_tokens", "ids_crc32"],
    4: ["doc_id", "size", "source_size", "target", "taken"],
    5: ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
    6: ["doc_id", "held_out", "lang_pred", "score"],
    7: ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    8: ["query_id", "rank", "vec_id", "score"],
    9: ["doc_id", "n_shingles", "component_id"],
    10: ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    11: ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"],
    12: ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    13: ["doc_id", "n_features", "weight", "score", "rank"],
}
INTS = {"piece", "rank"}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_columns(spark, name):
    df = queries.QUERIES[name](spark, SF)
    kinds = dict(df.dtypes)
    for c in COLUMNS[int(name[2:].split("_")[0])]:
        want = "boolean" if c in ("over_limit", "held_out", "kept", "base_failed", "contaminated") else "string" if "label" in c or c in ("lang_pred", "form") or c.endswith("sha256") else "double" if c in ("target", "base_score") or (c == "score" and not name.startswith(("op8", "op13"))) else "int" if c in INTS and not name.startswith("op13") else "bigint"
        assert kinds[c] == want, (name, c, kinds[c])


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want, got = c.sql(queries.ORACLES[name]).df(), queries.QUERIES[name](spark, SF).toPandas()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    plain = lambda x: None if x != x else int(x) if isinstance(x, float) and x == int(x) else x  # noqa: E731  (nulls make whole numbers doubles)
    rows = lambda df: sorted(map(str, (tuple(map(plain, r)) for r in df[cols].astype(object).where(df[cols].notna(), None).to_numpy().tolist())))
    assert rows(got) == rows(want)
