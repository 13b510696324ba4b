"""Ranks, running maxima and back-pressure by ranges; bytes of slots; files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.envelope import ConfigError, PlacementError
from millrace.operators import batches, framing, metrics, queueing, replay, routing, timeline
from millrace.plans.pipeline import Pipeline, RuntimeConfig
from millrace.sources import files, pcap


@pytest.fixture(scope="module")
def hot():
    """(source, sequence, ts): one source has most rows, one is null, time goes back now and then."""
    r = np.random.default_rng(2)
    out = []
    for i in r.permutation(400).tolist():
        source = None if i % 17 == 0 else "a" if i % 3 else "b"
        out.append((source, i, 1000 + 10 * i + int(r.integers(-200, 200))))
    return out


def test_slots_cut_bytes(spark):
    rows = [("ab", None), ("éé", None), (None, None), ("x" * 9, None)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, payload string")
    got = {r.i: r for r in batches.truncated(df, 3).collect()}
    assert [got[i].payload and bytes(got[i].payload) for i in range(4)] == [b"ab", "éé".encode()[:3], None, b"xxx"]
    assert [got[i].original_len for i in range(4)] == [2, 4, None, 9] and [got[i].truncated for i in range(4)] == [False, True, None, True]
    binary = batches.truncated(df.select("i", F.encode("payload", "utf-8").alias("payload")), 3)
    assert {r.i: r.payload and bytes(r.payload) for r in binary.collect()} == {i: got[i].payload and bytes(got[i].payload) for i in range(4)}


def test_ranks_by_ranges(spark, hot):
    df = spark.createDataFrame(hot, "tick string, sequence long, ts_ns long").repartition(5)
    want = {}
    for source in {s for s, _, _ in hot}:
        for k, (_, i, _) in enumerate(sorted(r for r in hot if r[0] == source)):
            want[i] = k + 1
    got = routing.ranked(df, "tick", per_range=16)
    assert {r.sequence: r[routing.RANK] for r in got.collect()} == want
    assert {r.sequence: r.accepted for r in batches.capped(df, 40).collect()} == {i: k <= 40 for i, k in want.items()}
    over = queueing.overflow(df, 40, 1, 9, 20)
    assert {r.sequence: r.sink_id for r in over.collect()} == {i: 1 if k <= 40 else 9 if k <= 60 else 0 for i, k in want.items()}


@pytest.mark.parametrize("factor", [1.0, 0.5])
def test_replay_by_ranges(spark, hot, factor):
    df = spark.createDataFrame(hot, "source string, sequence long, ts_ns long").repartition(5)
    want = {}
    for source in {s for s, _, _ in hot}:
        own, due = sorted((r for r in hot if r[0] == source), key=lambda r: r[1]), 0
        for _, i, ts in own:
            due = max(due, int(max(0, ts - own[0][2]) * factor))
            want[i] = due
    got = replay.original_timing(df, factor=factor, per_range=16)
    assert got.columns == ["source", "sequence", "ts_ns", "release_ns"]
    assert {r.sequence: r.release_ns for r in got.collect()} == want


def test_delimiters(spark):
    df = spark.createDataFrame([("a", bytearray(b"one\n\nthree\xff\nrest")), ("b", bytearray(b"")), ("c", None), ("d", bytearray(b"x" * 20 + b"\ny\n"))], "path string, content binary")
    got = sorted((r.path, r.record_index, r.file_offset, r.record and bytes(r.record)) for r in framing.delimited(df, max_len=10, permissive=True).collect() if r.record is not None)
    assert got == [("a", 0, 0, b"one\n"), ("a", 1, 4, b"\n"), ("a", 2, 5, b"three\xff\n"), ("d", 1, 21, b"y\n")]
    assert [(r.record_index, r.file_offset) for r in framing.delimited(df, max_len=10, permissive=True).collect() if r.record is None] == [(0, 0)]
    with pytest.raises(Exception, match="no delimiter within"):
        framing.delimited(df, max_len=10).collect()


def test_files_and_captures(spark, tmp_path):
    out = f"file://{tmp_path}/files"
    df = spark.createDataFrame([("one.bin", bytearray(b"aabb")), ("two.bin", bytearray(b"cc"))], "path string, content binary")
    assert files.file_sink(df, out) == 2 == files.file_sink(df, out)
    got = files.read(spark, out, "fixed", size=2).collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.record_index, bytes(r.record)) for r in got) == [("one.bin", 0, b"aa"), ("one.bin", 1, b"bb"), ("two.bin", 0, b"cc")]
    packets = spark.createDataFrame([("p", i, 5_000_000_000 - i, bytearray(b"x" * i)) for i in range(50)], "path string, pkt_index long, ts_ns long, data binary")
    there = f"file://{tmp_path}/captures"
    pcap.write(pcap.blobs(packets, nanoseconds=True), there)
    back = sorted((r.pkt_index, r.ts_ns, bytes(r.data)) for r in pcap.read(spark, there).collect())
    assert back == [(k, 5_000_000_000 - i, b"x" * i) for k, i in enumerate(range(49, -1, -1))]


def routed(df):
    return df.withColumn("sink_id", (F.col("sequence") % 2 + 1).cast("long"))


@pytest.mark.parametrize("policy,overflow,want", [("block", None, {1: 50, 2: 50}), ("drop_newest", None, {0: 60, 1: 20, 2: 20}), ("overflow", 9, {0: 40, 1: 20, 2: 20, 9: 20}), ("overflow", None, {0: 60, 1: 20, 2: 20})])
def test_back_pressure_of_a_pipeline(spark, policy, overflow, want):
    """Batches of 25 rows in order; a sink takes five of each."""
    config = RuntimeConfig(batch_size=25, capacity=5, backpressure=policy, overflow_sink=overflow)
    got = Pipeline().read(spark.range(100).select(F.col("id").alias("sequence"))).route(routed).configured(config).routed()
    assert got.columns == ["sequence", "sink_id"]
    assert {r.sink_id: r["count"] for r in got.groupBy("sink_id").count().collect()} == want


def test_strange_sinks_stop_a_run_before_it_writes(spark):
    written = []
    rows = spark.range(10).select(F.col("id").alias("sequence"))
    made = Pipeline().read(rows).route(routed).sink(1, lambda df: written.append(df.count()))
    with pytest.raises(PlacementError):
        made.run()
    assert not written
    whole = made.sink(2, lambda df: written.append(df.count()))
    assert whole.run() == {"dropped": 0, "sink_1": 5, "sink_2": 5} and written == [5, 5]
    assert whole.configured(RuntimeConfig(metrics=False)).run() == {}
    with pytest.raises(ConfigError):
        RuntimeConfig(capacity=0)


def test_decoding_drops_or_fails(spark):
    rows = spark.createDataFrame([("1",), ("x",)], "data string")
    number = lambda c: F.when(c.rlike("^[0-9]+$"), F.struct(c.cast("long").alias("n")))
    assert [r.n for r in Pipeline().read(rows).decode("data", number).route(lambda df: routing.fixed(df, 1)).routed().collect()] == [1]
    with pytest.raises(Exception, match="can't be read"):
        Pipeline().read(rows).decode("data", number, failfast=True).route(lambda df: routing.fixed(df, 1)).routed().collect()


# ---------------------------------------------------------------- ranges by quantiles


STAMP = 1_700_000_000_000_000_000


@pytest.fixture(scope="module")
def sparse(spark):
    """(source, sequence, n): nanosecond stamps far apart, most of them of one source; a null stamp."""
    r = np.random.default_rng(7)
    at = np.cumsum(r.integers(1, 9_000_000_000, 300)) + STAMP
    rows = [("a" if i % 4 else "b", int(t), int(r.integers(0, 9))) for i, t in enumerate(at.tolist())]
    r.shuffle(rows)
    return [(s, int(t), int(n)) for s, t, n in rows]


def frame(spark, sparse):
    return spark.createDataFrame(sparse, "source string, sequence long, n long").repartition(4)


def test_sparse_stamps_give_even_ranges(spark, sparse):
    sizes = [r["count"] for r in routing.ranged(frame(spark, sparse), "sequence", 30).groupBy("__range").count().collect()]
    assert len(sizes) == 10 and max(sizes) <= 60
    dense = spark.range(1000).select(F.col("id").alias("sequence"))
    assert sorted(r["count"] for r in routing.ranged(dense, "sequence", 250).groupBy("__range").count().collect()) in ([250] * 4, [249, 250, 250, 251])
    assert routing.ranged(dense.limit(0), "sequence").count() == 0
    nulls = spark.createDataFrame([(None,), (3,), (1,), (2,)], "sequence long")
    assert {r.sequence: r["index"] for r in routing.numbered(nulls, per_range=1).collect()} == {None: 0, 1: 1, 2: 2, 3: 3}


def test_plans_hold_no_single_partition(spark, sparse):
    """Rows go by range; what lies in one partition is a row a range."""
    df = frame(spark, sparse)
    df.write.mode("overwrite").parquet(spark.conf.get("spark.checkpoint.dir") + "/sparse")
    df = spark.read.parquet(spark.conf.get("spark.checkpoint.dir") + "/sparse")
    plan = routing.numbered(df, per_range=30)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(__range" in plan and plan.count("SinglePartition") == 1  # the prefix sums over ranges
    assert plan.index("BroadcastExchange") < plan.index("SinglePartition")
    plan = metrics.history(df, "sequence", "n", per_range=30)._jdf.queryExecution().executedPlan().toString()
    assert "__range" in plan.split("hashpartitioning(", 1)[1].split(")")[0]


def test_places_of_sparse_stamps(spark, sparse):
    want = {t: k for k, t in enumerate(sorted(t for _, t, _ in sparse))}
    df = frame(spark, sparse)
    assert {r.sequence: r["index"] for r in routing.numbered(df, per_range=30).collect()} == want
    got = routing.round_robin(df, [5, 6, 7], per_range=30).collect()
    assert {r.sequence: r.sink_id for r in got} == {t: [5, 6, 7][k % 3] for t, k in want.items()}
    burst = replay.burst(df.select("sequence"), 4, 10)
    assert {r.sequence: r.release_ns for r in burst.collect()} == {t: k // 4 * 10 for t, k in want.items()}


@pytest.mark.parametrize("per_range", [7, 40, 1 << 20])
def test_carried_over_ranges(spark, sparse, per_range):
    """A hot key's settings, queue and history run on from range to range."""
    df = frame(spark, sparse)
    changes = [(s, t - 3, n) for s, t, n in sparse if n < 2] + [("b", STAMP * 2, 8), ("z", 0, 1), (None, 0, 1)]
    got = timeline.as_of(df, spark.createDataFrame(changes, "source string, sequence long, rate long"), "source", "sequence", ["rate"], per_range)
    last = lambda s, t: max(((c, v) for k, c, v in changes if k == s and c <= t), default=(0, None))[1]
    assert {r.sequence: r.rate for r in got.collect()} == {t: last(s, t) for s, t, _ in sparse}
    x, queue, history, before = {}, {}, {}, {}
    for s, t, n in sorted(sparse, key=lambda r: r[1]):
        x[s] = max(x.get(s, 0) + n - 4, 0)
        queue[t] = x[s]
        history[t], before[s] = n - before.get(s, 0), n
    got = queueing.unbounded(df, 4, "source", "sequence", "n", per_range)
    assert {r.sequence: r.occupancy for r in got.collect()} == queue
    got = metrics.history(df, "sequence", "n", "source", per_range)
    assert {r.sequence: r.delta for r in got.collect()} == history
    ordered = sorted(sparse, key=lambda r: r[1])
    want = {t: n - p for (_, t, n), p in zip(ordered, [0, *(n for _, _, n in ordered)], strict=False)}
    assert {r.sequence: r.delta for r in metrics.history(df, "sequence", "n", None, per_range).collect()} == want


def test_overflow_sink_has_places_of_its_own(spark):
    """Against a fold of the rows: each sink and the overflow sink take so many a batch, in order; own rows of the overflow sink count."""
    r = np.random.default_rng(3)
    rows = [(i, int(s)) for i, s in enumerate(r.choice([0, 1, 2, 9], 200, p=[0.1, 0.5, 0.2, 0.2]).tolist())]
    want = {}
    for start in range(0, 200, 40):
        taken = {}
        for i, s in rows[start : start + 40]:
            want[i] = 0
            for to in dict.fromkeys((s, 9)) if s else ():
                if taken.get(to, 0) < 6:
                    taken[to] = taken.get(to, 0) + 1
                    want[i] = to
                    break
    config = RuntimeConfig(batch_size=40, capacity=6, backpressure="overflow", overflow_sink=9)
    df = spark.createDataFrame(rows, "sequence long, sink_id long").repartition(3)
    got = Pipeline().read(df).route(lambda d: d).configured(config).routed()
    assert {x.sequence: x.sink_id for x in got.collect()} == want
    assert set(want.values()) == {0, 1, 2, 9}
