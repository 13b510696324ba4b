"""Importance resampling against plain arithmetic."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.llm import resample
from millrace.llm.resample import Settings

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, s):
    ws = WORD.findall((text or "").translate(FOLD))
    return len(ws), [zlib.crc32(" ".join(ws[i : i + k]).encode()) % s.buckets for k in range(1, s.longest + 1) for i in range(len(ws) - k + 1)]


def wanted(docs, target, s):
    own = [(i, *features(t, s)) for i, t in docs]
    a, b = Counter(x for _, _, f in own for x in f), Counter(x for t in target for x in features(t, s)[1])
    n_a, n_b = sum(a.values()) + s.buckets, sum(b.values()) + s.buckets
    gain = [math.floor(s.scale * math.log((b[i] + 1) * n_a / ((a[i] + 1) * n_b))) for i in range(s.buckets)]
    rows = []
    for i, n, f in own:
        h = int(hashlib.sha256(f"{s.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[x] for x in f)
        rows.append([i, len(f), w, w + math.floor(-s.scale * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= s.least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: s.percent * len(able) // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in rows]


SETTINGS = [Settings(), Settings(longest=3, buckets=97, percent=50, least_words=1, seed=5), Settings(percent=100, least_words=0)]


@pytest.mark.parametrize("s", SETTINGS)
def test_table(spark, docs, edge, s):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    target = [r.text for r in bench.collect()]
    for df in (docs, edge):
        want = wanted([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()], target, s)
        got = [tuple(r) for r in resample.resample(df, bench, s).collect()]
        assert Counter(got) == Counter(want)


@pytest.mark.parametrize("s", SETTINGS)
def test_drawn(spark, docs, edge, s):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    for df in (docs, edge):
        kept = resample.drawn(df, bench, s)
        assert kept.columns == df.columns
        ranked = resample.resample(df, bench, s).filter("rank IS NOT NULL").collect()
        assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in ranked)


def test_draws_follow_the_target(spark):
    """Texts like the target are drawn far more often than others."""
    r = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, F.lit("alpha beta gamma " * 8)).otherwise(F.lit("one two three " * 8)).alias("text"))
    target = spark.createDataFrame([("alpha beta gamma",)] * 50, "text string")
    got = resample.resample(r, target).filter("rank IS NOT NULL").collect()
    assert len(got) == 200 and sum(x.doc_id % 10 == 0 for x in got) > 190


def test_empty(spark, edge, empty):
    bench = spark.createDataFrame([("a b c",)], "text string")
    assert resample.resample(empty, bench).count() == 0 and resample.drawn(empty, bench).count() == 0
    nothing = resample.resample(edge, bench.limit(0))
    want = wanted([(r.doc_id, r.text) for r in edge.select("doc_id", "text").collect()], [], Settings())
    assert Counter(map(tuple, nothing.collect())) == Counter(want)


def test_plans(docs):
    """Scores take no exploded row and no Python; totals are counted before they are shuffled."""
    s = Settings()
    scored = resample._scored(resample.bucketed(docs, s), list(range(s.buckets)), s)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Python" not in plan and "HashAggregate" not in plan
    plan = resample.totals(resample.bucketed(docs, s))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange hashpartitioning") < plan.index("partial_count")
