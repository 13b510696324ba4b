"""Operators over rows of which one key has most: no task or value holds a whole key."""

import pytest
from pyspark.sql import functions as F

from millrace import queries
from millrace.operators import faults


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def folded(rows, f):
    """Brute force: one generator a source, a draw after another."""
    out = {}
    for source in {r[0] for r in rows}:
        x = f.seed

        def draw():
            nonlocal x
            x = (x * 6364136223846793005 + 1) % 2**64
            return (x >> 32) / (2**32 - 1)

        for _, sequence, payload in sorted((r for r in rows if r[0] == source), key=lambda r: r[1]):
            dropped = corrupted = False
            spike = 0
            if draw() < f.drop_rate:
                dropped = True
            else:
                if draw() < f.corrupt_rate and payload:
                    draw()
                    at, corrupted = x % len(payload), True
                    payload = bytes(b ^ 0xFF if i == at else b for i, b in enumerate(payload))
                spike = f.spike_ns if draw() < f.spike_rate else 0
            out[source, sequence] = (payload, dropped, corrupted, spike)
    return out


def test_mixed_faults_go_on_from_batch_to_batch(spark, small_batches):
    f = faults.Faults(drop_rate=0.3, corrupt_rate=0.4, spike_rate=0.2, spike_ns=9, seed=5)
    rows = [(1 if i % 3 else i % 5 or None, (i * 37) % 211, b"abc%d" % i if i % 7 else b"") for i in range(200)]
    got = faults.mixed(spark.createDataFrame(rows, "source long, sequence long, payload binary").repartition(3), f)
    assert "FlatMapGroups" not in got._jdf.queryExecution().toString()
    assert {(r.source, r.sequence): (bytes(r.payload), r.dropped, r.corrupted, r.spike_ns) for r in got.collect()} == folded(rows, f)


def test_a_file_is_framed_from_bounded_blobs(spark, monkeypatch):
    rows = spark.range(100).select((F.col("id") * 3).alias("sequence"), F.when(F.col("id") % 10 > 0, 1).when(F.col("id") > 50, 2).alias("key"), F.concat(F.lit("é"), F.col("id").cast("string")).alias("payload"))
    longest, framed = [], queries.framing.length_prefixed

    def look(blobs, *args):
        longest.append(blobs.agg(F.max(F.length("content"))).first()[0])
        return framed(blobs, *args)

    monkeypatch.setattr(queries.framing, "length_prefixed", look)
    monkeypatch.setattr(queries, "events", lambda *_: rows)
    got = {(r.path, r.record_index): (r.file_offset, r.record) for r in queries._framed_by_key(rows, 30).collect()}
    whole = {(r.path, r.record_index): (r.file_offset, r.record) for r in queries.frame_len_prefixed(spark, "").collect()}
    want, at = {}, {}
    for r in rows.orderBy("sequence").collect():
        path = None if r.key is None else str(r.key)
        i, offset = at.get(path, (0, 0))
        want[path, i] = (offset, r.payload)
        at[path] = (i + 1, offset + 1 + len(r.payload.encode()))
    assert got == whole == want
    assert longest[0] <= 10 * 5 < longest[1]
