import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.envelope import ConfigError, NotImplementedBackend, backend
from millrace.functions import codecs, payload, rng
from millrace.operators import faults, pacing, queueing, replay, routing, timeline
from millrace.plans import scenario
from millrace.plans.pipeline import Pipeline, RuntimeConfig
from millrace.sources import pcap, synthetic


def test_codec_bounds(spark):
    values = [0, 1, 255, 2**31, 2**53 + 1, 2**63 - 1, -1, -(2**63)]
    df = spark.createDataFrame([(v,) for v in values], "x long")
    got = df.select("x", codecs.read_uint_be(codecs.uint_be(F.col("x"), 8), 0, 8).alias("be"), codecs.read_uint_le(codecs.uint_le(F.col("x"), 8), 0, 8).alias("le"), F.hex(codecs.uint_be(F.col("x"), 2)).alias("h")).collect()
    assert all(r.x == r.be == r.le for r in got)
    assert [r.h for r in got[:3]] == ["0000", "0001", "00FF"]
    short = spark.range(1).select(codecs.tick_decode(F.unhex(F.lit("00"))).alias("m"), codecs.slot_decode(F.unhex(F.lit("00"))).alias("s")).first()
    assert short.m is None and short.s.error == "short slot"


def test_slot_sizes(spark):
    got = spark.createDataFrame([(n,) for n in (0, 32, 33, 96, 97)], "n long").select(codecs.slot_size(F.col("n")).alias("s")).collect()
    assert [r.s for r in got] == [64, 64, 128, 128, 192]


def test_quotes(spark):
    r = spark.range(1, 2).select(payload.market_quote_decode(payload.market_quote(F.col("id"))).alias("q"), F.decode(F.substring(payload.fix_quote(F.col("id")), 3, 99), "utf-8").alias("f"), F.hex(payload.fixed_seq(F.lit(258), 10)).alias("s")).first()
    assert (r.q.bid, r.q.ask, r.f, r.s) == (100001, 100002, "35=Q|55=AAPL|44=101|34=1|", "00000000000001020000")


def test_generator_vectors():
    assert rng.states(0, np.arange(1, 6)).tolist() == [1, 6364136223846793006, 13885033948157127959, 14678909342070756876, 14340359694176818205]
    assert rng.states(42, np.arange(1, 3)).tolist() == [9039304369631583587, 8647191391818483560]
    assert int((rng.uniforms(rng.states(0, np.arange(1, 100_001))) < 0.05).sum()) == 5062


def test_random_payload(spark):
    data = [bytes(r.p) for r in spark.range(3).select(rng.random_bytes(0, F.col("id"), 4).alias("p")).collect()]
    x, want = 0, b""
    for _ in range(12):
        x = (x * rng.MULTIPLIER + 1) % 2**64
        want += bytes([x & 255])
    assert b"".join(data) == want


def test_pacing(spark):
    got = lambda p, n: [r.arrivals for r in pacing.arrivals(spark, n, p, 1_000_000).orderBy("tick").collect()]
    assert got(pacing.Pattern("burst", size=10, gap_ns=2_000_000, batch=4), 6) == [4, 4, 2, 0, 0, 4]
    assert sum(got(pacing.Pattern("fixed_rate", pps=500), 10)) == 5
    assert got(pacing.Pattern("fixed_rate", pps=1_000_000, batch=64), 2) == [64, 64]
    assert got(pacing.Pattern("fixed_rate", pps=0), 2) == [0, 0]
    with pytest.raises(ConfigError):
        pacing.Pattern("odd")


def test_bounded_queue_is_the_recurrence(spark):
    r = random.Random(3)
    rows = [(run, t, r.choice([0, 0, 3, 9, 20])) for run in "ab" for t in range(300)]
    df = spark.createDataFrame(rows, "run string, tick long, arrivals long")
    got = {(x.run, x.tick): (x.written, x.overflow, x.consumed, x.occupancy) for x in queueing.bounded(df, 11, 4, block=16).collect()}
    o = {"a": 0, "b": 0}
    for run, t, a in rows:
        w = min(a, 11 - o[run])
        c = min(o[run] + w, 4)
        o[run] += w - c
        assert got[run, t] == (w, a - w, c, o[run])


def test_routing(spark):
    rows = spark.range(1, 5).select(F.col("id").alias("sequence"))
    rr = routing.round_robin(rows, [1, 2], per_range=2).groupBy("sink_id").count().orderBy("sink_id").collect()
    assert [(r.sink_id, r["count"]) for r in rr] == [(1, 2), (2, 2)]
    even = routing.by_callback(rows, lambda df: F.when(F.col("sequence") % 2 == 0, 1))
    assert sorted(r.sequence for r in routing.split(even, [1])[1].collect()) == [2, 4]
    with pytest.raises(Exception, match="no sink 9"):
        routing.split(routing.fixed(rows, 9), [1])[1].collect()
    for bad in ([], [0]):
        with pytest.raises(ConfigError):
            routing.round_robin(rows, bad)


def test_replay(spark):
    df = spark.createDataFrame([("p", 1, 1000), ("p", 2, 5000), ("p", 3, 2000), ("p", 4, 900)], "source string, sequence long, ts_ns long")
    out = lambda d: [r.release_ns for r in d.orderBy("sequence").collect()]
    assert out(replay.original_timing(df)) == [0, 4000, 4000, 4000]
    assert out(replay.original_timing(df, factor=0.5)) == [0, 2000, 2000, 2000]
    assert out(replay.burst(df, 3, 1500, 1000)) == [0, 0, 0, 2000]
    with pytest.raises(ConfigError):
        replay.original_timing(df, factor=0.0)


def test_timeline(spark):
    rows = spark.createDataFrame([("n", 0), ("n", 5), ("n", 10), ("m", 7)], "nic string, at long")
    changes = spark.createDataFrame([("n", 5, 0, 100), ("n", 5, 1, 200), ("n", 8, 0, 300)], "nic string, at long, place int, pps int")
    got = {(r.nic, r.at): r.pps for r in timeline.as_of(rows, changes, "nic", "at", ["pps"]).collect()}
    assert got == {("n", 0): None, ("n", 5): 200, ("n", 10): 300, ("m", 7): None}


def test_mixed_faults_follow_the_draws(spark):
    f = faults.Faults(drop_rate=0.3, corrupt_rate=0.4, spike_rate=0.2, spike_ns=9, seed=5)
    df = spark.createDataFrame([("s", i, bytearray(b"abcdef")) for i in range(1, 200)], "source string, sequence long, payload binary")
    got = {r.sequence: r for r in faults.mixed(df, f).collect()}
    x = 5

    def draw():
        nonlocal x
        x = (x * rng.MULTIPLIER + 1) % 2**64
        return (x >> 32) / (2**32 - 1)

    for i in range(1, 200):
        if draw() < 0.3:
            assert got[i].dropped
            continue
        data, corrupted = bytearray(b"abcdef"), False
        if draw() < 0.4:
            draw()
            data[x % 6] ^= 0xFF
            corrupted = True
        spike = 9 if draw() < 0.2 else 0
        assert (got[i].dropped, got[i].corrupted, got[i].spike_ns, bytes(got[i].payload)) == (False, corrupted, spike, bytes(data))


def test_pcap_round_trip(spark):
    packets = spark.createDataFrame([("a", 0, 0, bytearray(b"one")), ("a", 1, 1_000_000, bytearray(b"")), ("a", 2, 5_000_001_000, bytearray(b"three")), ("b", 0, 250, bytearray(b"x"))], "path string, pkt_index long, ts_ns long, data binary")
    for ns in (False, True):
        back = pcap.parse(pcap.blobs(packets, nanoseconds=ns)).orderBy("path", "pkt_index").collect()
        assert [(r.path, r.ts_ns, bytes(r.data)) for r in back] == [("a", 0, b"one"), ("a", 1_000_000, b""), ("a", 5_000_001_000, b"three"), ("b", 250 if ns else 0, b"x")]
    bad = spark.createDataFrame([("c", bytearray(b"\x0a\x0d\x0d\x0a" + b"\0" * 40))], "path string, content binary")
    with pytest.raises(Exception, match="not a classic pcap"):
        pcap.parse(bad).collect()


def test_synthetic_conserves(spark):
    made = synthetic.packets(spark, 100, pacing.Pattern("fixed_rate", pps=5000), faults=faults.Faults(drop_rate=0.1, seed=1))
    n, dropped, length = made.agg(F.count("*"), F.sum(F.col("dropped").cast("int")), F.max(F.length("data"))).first()
    assert n == 500 and 20 < dropped < 90 and length == 50


def test_pipeline(spark):
    got = {}
    p = Pipeline().read(spark.range(10).select(F.col("id").alias("sequence"))).filter("sequence > 1").route(lambda df: routing.by_callback(df, lambda d: F.when(F.col("sequence") % 2 == 0, 1)))
    counts = p.sink(1, lambda df: got.update(a=sorted(r.sequence for r in df.collect()))).configured(RuntimeConfig(workers=2)).run()
    assert got == {"a": [2, 4, 6, 8]} and counts == {"dropped": 4, "sink_1": 4}
    assert RuntimeConfig.from_toml("[runtime]\nworkers = 3\nbackpressure = 'drop_newest'").workers == 3
    for bad in ("[runtime]\nworkers = 0", "[runtime]\nodd = 1", "[runtime]\nbackpressure = 'x'"):
        with pytest.raises(ConfigError):
            RuntimeConfig.from_toml(bad)
    with pytest.raises(NotImplementedBackend):
        backend("io_uring")


def test_scenario_document(spark):
    s = scenario.from_toml('[scenario]\nname="x"\nduration="100ms"\ntick="1ms"\n[[nic]]\nbatch_size=8\n[nic.traffic]\npattern="fixed"\npps=5_000\n[nic.fault]\ndrop_rate=0.2\n[[consumer]]\nmax_per_drain=3\n[[fabric.ring]]\nslots=16\n')
    r = scenario.stats(spark, s).first()
    last = scenario.queue(spark, s).orderBy(F.desc("tick")).first()
    assert (r.ticks, r.generated) == (100, 500)
    assert r.generated - r.dropped == r.written + r.overflow
    assert r.written == r.consumed + last.occupancy
    assert scenario.duration("1_000us") == 1_000_000 and scenario.duration(5) == 5


def test_stream_equals_batch(spark, tmp_path):
    from millrace.streaming import pipelines

    rows = spark.createDataFrame([("r", t, (t * 7) % 5) for t in range(60)], "run string, tick long, arrivals long")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = pipelines.bounded_queue(pipelines.follow(spark, str(tmp_path / "in"), rows.schema), 4, 2)
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("tick").collect()
    want = queueing.bounded(rows, 4, 2).orderBy("tick").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]


def test_routed_stream(spark, tmp_path):
    from millrace.streaming import pipelines

    spark.range(20).write.parquet(str(tmp_path / "in"))
    got = {1: [], 2: []}
    rows = pipelines.follow(spark, str(tmp_path / "in"), spark.range(1).schema)
    routed = routing.by_key(rows, F.col("id"), [1, 2])
    sinks = {s: (lambda df, epoch, s=s: got[s].extend(r.id for r in df.collect())) for s in got}
    pipelines.write_routed(routed, sinks, str(tmp_path / "c")).awaitTermination(120)
    assert sorted(got[1]) == list(range(0, 20, 2)) and sorted(got[2]) == list(range(1, 20, 2))
