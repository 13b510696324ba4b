"""Pauses of a replay, and the queue over a stream."""

import random
from collections import Counter, deque

import pytest
from pyspark.sql import functions as F

from millrace.envelope import ConfigError
from millrace.operators import queueing, replay
from millrace.streaming import stateful


def clocked(due, controls, keep):
    """Brute force: the clock goes on by one at a time; ``due`` in order."""
    out, paused, shift, waiting = {}, False, 0, deque(due)
    for now in range(200):
        for _, _, on in (c for c in controls if c[1] == now):
            paused = on
        if paused:
            shift += keep
            continue
        while waiting and waiting[0][1] <= now - shift:
            out[waiting.popleft()[0]] = now
    return {**{i: None for i, _ in waiting}, **out}


@pytest.mark.parametrize("keep", [False, True])
@pytest.mark.parametrize("per_range", [5, 1 << 20])
def test_paused(spark, keep, per_range):
    r = random.Random(11)
    rows, controls, want = [], [], {}
    for s in ("a", "b", "c", None):
        due = sorted(r.randrange(80) for _ in range(30))
        own = [(len(rows) + i, d) for i, d in enumerate(due)]
        rows += [(s, i, d) for i, d in own]
        told = sorted((s, t, bool(r.getrandbits(1)), k) for k, t in enumerate(r.choices(range(90), k=8))) if s != "b" else []
        told = sorted(told, key=lambda c: (c[1], c[3]))
        controls += told
        want.update(clocked(own, [c[:3] for c in told], keep))
    df = spark.createDataFrame(rows, "source string, sequence long, release_ns long").repartition(3)
    tell = spark.createDataFrame(controls, "source string, at_ns long, paused boolean, place long")
    got = replay.paused(df, tell, keep_distances=keep, per_range=per_range)
    assert got.columns == ["source", "sequence", "release_ns"]
    # A null source has rows, and controls of its own.
    assert {x.sequence: x.release_ns for x in got.collect()} == want


ROWS = "run string, ts timestamp, sequence long"


def folded(arrivals, capacity, drain, policy):
    """(sequence, outcome, tick) of one run, tick by tick until all have left."""
    ring, second, out, tick = deque(), deque(), [], 0
    while tick < len(arrivals) or ring or second:
        for s in arrivals[tick] if tick < len(arrivals) else ():
            if len(ring) < capacity and not (policy == "block" and second):
                ring.append(s)
            elif policy == "evict":
                out.append((ring.popleft(), "evicted", tick))
                ring.append(s)
            elif policy == "block" or (policy == "overflow" and len(second) < capacity):
                second.append(s)
            else:
                out.append((s, "dropped", tick))
        for _ in range(min(drain, len(ring))):
            out.append((ring.popleft(), "drained", tick))
        if policy == "block":
            while second and len(ring) < capacity:
                ring.append(second.popleft())
        else:
            for _ in range(min(drain, len(second))):
                out.append((second.popleft(), "drained_overflow", tick))
        tick += 1
    return out


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.PROVIDER)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


@pytest.mark.parametrize("policy", ["drop_newest", "evict", "overflow", "block"])
def test_queue_over_a_restart(spark, tmp_path, rocks, policy):
    """Random arrivals in three parts, a query each from one checkpoint: as a fold, and as the batch queue."""
    r = random.Random(5)
    runs, n = {}, 0
    for run in ("a", "b"):
        runs[run] = []
        for _ in range(24):
            k = r.choice([0, 0, 1, 3, 7])
            runs[run].append(list(range(n, n + k)))
            n += k
    for part in range(3):
        rows = [(run, tick, s) for run, ticks in runs.items() for tick in range(8 * part, 8 * part + 8) for s in ticks[tick]]
        if part == 2:
            rows.append(("end", 1000, -1))  # moves the watermark, so timers fire
        df = spark.createDataFrame(rows, "run string, tick long, sequence long").select("run", F.timestamp_seconds(F.col("tick") + 1).alias("ts"), "sequence")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = stateful.queue(spark.readStream.schema(ROWS).parquet(str(tmp_path / "in")), 5, 2, policy)
        q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination(120)
    got = Counter((x.run, x.sequence, x.outcome, x.tick - 1) for x in spark.read.schema(stateful.OUT).parquet(str(tmp_path / "out")).filter("run <> 'end'").collect())
    assert got == Counter((run, *o) for run, ticks in runs.items() for o in folded(ticks, 5, 2, policy))
    if policy == "drop_newest":
        ticks = spark.createDataFrame([(run, t, len(a)) for run, arrived in runs.items() for t, a in enumerate([*arrived, [], [], []])], "run string, tick long, arrivals long")
        want = {(x.run, x.tick): (x.overflow, x.consumed) for x in queueing.bounded(ticks, 5, 2).collect()}
        by = Counter((run, tick, outcome) for run, _, outcome, tick in got.elements())
        assert {k: (by[*k, "dropped"], by[*k, "drained"]) for k in want} == want


def test_queue_settings(spark):
    for bad in ((0, 1, "evict"), (1, 0, "evict"), (1, 1, "lose")):
        with pytest.raises(ConfigError):
            stateful.queue(spark.createDataFrame([], ROWS), *bad)
