"""Fill-in-middle cuts against a scan of the text."""

import hashlib
from collections import Counter

import pytest
import regex
from pyspark.sql import functions as F

from millrace.llm import infill

TEXTS = [None, "", "a", "ab", "a\U0001f600b\U00020000é́", "x" * 50_000 + "\n", " \n two  words\r\nand 12,5 € ", "has <S> inside", "<P", "a<S" * 9, "<<P", "\n\n\n", "ünï cödé 東京 ½", "S>", "tail<"]
#: The same units as patterns that are looked for from left to right.
SCANS = {"code_points": r"[\s\S]", "words": r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", "lines": r"[^\n]*\n|[^\n]+", "tokens": r"\p{L}+|\p{N}+|[\x20\x09-\x0D]+|[\s\S]"}


def wanted(doc_id, text, units="code_points"):
    text = text or ""
    us = regex.findall(SCANS[units], text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    draws = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    lo, hi = sorted(d % (len(us) + 1) for d in draws[:2])
    a, m, z = "".join(us[:lo]), "".join(us[lo:hi]), "".join(us[hi:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or draws[2] % 100 >= 90:
        return doc_id, len(us), "plain", None, None, text
    if draws[3] % 100 < 20:
        return doc_id, len(us), "spm", len(a), len(m), f"<S>{z}<P>{a}<M>{m}"
    return doc_id, len(us), "psm", len(a), len(m), f"<P>{a}<S>{z}<M>{m}"


@pytest.fixture(scope="module")
def hard(spark):
    rows = [(None if i % 41 == 40 else i, TEXTS[i % len(TEXTS)]) for i in range(10 * len(TEXTS))]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("form", F.lit("mine")).withColumn("units", F.lit(3)).repartition(3)


@pytest.mark.parametrize("units", sorted(SCANS))
def test_cuts(hard, units):
    got = infill.cut_texts(hard, infill.GRAMMARS[units]).select("__row.doc_id", "n", "form", F.length("prefix").alias("a"), F.length("middle").alias("m"), "output")
    assert Counter(map(tuple, got.collect())) == Counter(wanted(r.doc_id, r.text, units) for r in hard.collect())


def test_digests(hard, edge, empty):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for df in (hard, edge):
        rows = df.select("doc_id", "text").collect()
        want = Counter((*wanted(i, t)[:5], sha(wanted(i, t)[5]), sha(t or "")) for i, t in rows)
        assert Counter(map(tuple, infill.digests(df).collect())) == want
    assert infill.digests(empty).count() == 0


def test_infill_keeps_columns(edge):
    out = infill.infill(edge)
    assert out.columns == edge.columns
    assert Counter((r.doc_id, r.text, r.rank) for r in out.collect()) == Counter((r.doc_id, wanted(r.doc_id, r.text)[5], r.rank) for r in edge.collect())


def test_boundaries_have_no_width(spark):
    """Units joined are the text, whatever the grammar; none is empty."""
    df = spark.createDataFrame([(t,) for t in TEXTS if t is not None], "text string")
    for g in infill.GRAMMARS.values():
        got = df.select("text", infill.units(F.col("text"), g).alias("u")).collect()
        assert all("".join(r.u) == r.text and "" not in r.u for r in got)


def test_other_marks(spark):
    s = infill.Settings(seed=7, plain_from=100, spm_below=50, prefix="[[a]]", suffix="[[b]]", middle="[[c]]")
    df = spark.range(60).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"))
    got = infill.cut_texts(df, infill.GRAMMARS["words"], s)
    assert {r.form for r in got.collect()} == {"psm", "spm"}
    assert got.filter(infill.restored(F.col("output"), F.col("form"), s) != F.col("text")).count() == 0


def test_nothing_is_shuffled(docs):
    plan = infill.digests(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
