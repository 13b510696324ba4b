"""The queries and SQL of the numbered operators, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import common, decontaminate, infill, jaccard, language, license, lm, mixing, packing, quality, resample, tokens, topk


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(common.tables(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.tables(spark, sf_dir, "documents")
    counts = tokens.token_counts(docs, tokens.tokenizer_path("word_bpe_49k.json"))
    return counts.selectExpr("doc_id", "n_bytes", "n_tokens", "n_tokens > 2048 AS over_limit")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = common.tables(spark, sf_dir, "documents"), common.new_path(spark, "tokens")
    manifest = tokens.write_token_files(docs, out, tokens.tokenizer_path("byte_bpe_50k.json"), end_id=2)
    return tokens.read_token_files(manifest, out)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(common.tables(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(common.tables(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(common.tables(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.tables(spark, sf_dir, "documents"), tokens.tokenizer_path("word_bpe_49k.json"), end_id=0, capacity=2048)


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(common.tables(spark, sf_dir, "embeddings"), topk.every_nth(50))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(common.tables(spark, sf_dir, "documents"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(common.tables(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digests(common.tables(spark, sf_dir, "documents"))


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digests(common.tables(spark, sf_dir, "documents"), common.tables(spark, sf_dir, "benchmark"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(common.tables(spark, sf_dir, "documents"), common.tables(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_token_counts, op3_token_files, op4_mix_sources, op5_license_scan, op6_language_id, op7_best_fit_packing, op8_exact_top_k, op9_jaccard_join, op10_lm_scoring, op11_fill_in_middle, op12_decontaminate, op13_importance_resampling)}
TOP_K_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 5
"""

JACCARD_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{common.UPPER}', '{common.LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y, i = a.n AND i = b.n AS same FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 85 * (a.n + b.n - i)),
e AS (SELECT x, y, same FROM l UNION ALL SELECT y, x, same FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.y FROM r JOIN e ON e.x = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, least(d.doc_id, coalesce(k.class_id, d.doc_id)) AS class_id, coalesce(k.links, 0) AS n_links FROM d LEFT JOIN n USING (doc_id)
JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY 1) c ON c.a = d.doc_id
LEFT JOIN (SELECT x, count(*) AS links, min(CASE WHEN same THEN y END) AS class_id FROM e GROUP BY 1) k ON k.x = d.doc_id
"""

ORACLES: dict[str, str] = {"op1_quality_rules": quality.duckdb_sql(), "op8_exact_top_k": TOP_K_SQL, "op9_jaccard_join": JACCARD_SQL, "op11_fill_in_middle": infill.SQL, "op12_decontaminate": decontaminate.SQL, "op13_importance_resampling": resample.SQL}
