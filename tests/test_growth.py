"""What grows with the rows: tasks, batches and joined rows of the framing queries."""

import numpy as np
from pyspark.sql import functions as F

from millrace import lineage, queries
from millrace.operators import framing
from millrace.sources import files, ranges


def test_blobs_are_joined_and_not_their_records(spark):
    rows = spark.range(200).select((F.col("id") % 3).alias("key"), F.col("id").alias("sequence"), F.concat(F.lit("p"), "id").alias("payload"))
    out = queries._framed_by_key(rows, 20)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Join")  # the join is below
    got = {(r.path, r.record_index): r.record for r in out.collect()}
    assert got == {(str(k), i): f"p{3 * i + k}" for k in range(3) for i in range(len(range(k, 200, 3)))}


def test_small_prefixed_files_share_batches(spark):
    """Files with tails, without a record and null ones, against a walk through each; a batch holds the records of many files."""
    r = np.random.default_rng(1)
    contents = [b"".join(bytes([n]) + r.bytes(n) for n in r.integers(0, 30, r.integers(0, 6)).tolist()) + r.choice([b"", b"\x09abc"]) for _ in range(500)]
    df = spark.createDataFrame([*((str(i), bytearray(c)) for i, c in enumerate(contents)), ("null", None)], "path string, content binary").coalesce(1)
    want = []
    for i, c in enumerate(contents):
        at = n = 0
        while at < len(c) and at + 1 + c[at] <= len(c):
            want.append((str(i), n, at, c[at : at + 1 + c[at]]))
            at, n = at + 1 + c[at], n + 1
    framed = framing.length_prefixed(df, 1, 255)
    assert sorted((x.path, x.record_index, x.file_offset, bytes(x.record)) for x in framed.collect()) == sorted(want)
    batches = framed.mapInArrow(lambda bs: (b.slice(0, 1).select(["path"]) for b in bs if b.num_rows), "path string").count()
    assert batches < 20


def test_short_ranges_share_tasks(spark):
    """As many tasks as the bytes need and not one a range."""
    folder = lineage.new_path(spark, "shared")
    files.file_sink(spark.createDataFrame([("a", bytearray(b"some words\n" * 20_000))], "path string, content binary"), folder)
    cut = ranges.ranges(spark, folder, 1000)
    assert cut.count() == 220
    assert ranges._dealt(cut).rdd.getNumPartitions() == ranges.FEW
    got = files.read(spark, folder, split=1000)
    assert got.select(F.count("*"), F.max("record_index"), F.countDistinct("file_offset")).first()[:] == (20_000, 19_999, 20_000)
