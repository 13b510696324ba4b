"""Traffic scenarios as batch plans: ticks, arrivals, drops, a bounded queue and its counters.

A scenario is settings; running it builds DataFrames from the operators. There
is no clock or event loop: ticks are rows, and what depends on the tick before is
either a closed form or composes over blocks (see queueing.bounded).
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..envelope import ConfigError, NotImplementedBackend
from ..operators import faults as faulty
from ..operators import pacing, queueing


@dataclass(frozen=True)
class Scenario:
    name: str
    duration_ns: int = 1_000_000_000
    tick_ns: int = 1_000_000
    pattern: pacing.Pattern = field(default_factory=pacing.Pattern)
    faults: faulty.Faults = faulty.Faults()
    capacity: int = 4096
    drain: int | None = None

    @property
    def n_ticks(self) -> int:
        if self.tick_ns < 1:
            raise ConfigError("a tick is 1 ns or more")
        return -(-self.duration_ns // self.tick_ns)


def _p(**k) -> pacing.Pattern:
    return pacing.Pattern(**k)


#: Settings of the built-in scenarios; latency spikes change the clock and are not among them.
BUILTINS = {
    s.name: s
    for s in (
        Scenario("constant_rate", 1_000_000_000, 1_000_000, _p(kind="fixed_rate", pps=100_000, batch=128)),
        Scenario("packet_loss", 10_000_000_000, 1_000_000, _p(kind="fixed_rate", pps=10_000, batch=64), faulty.Faults(drop_rate=0.05)),
        Scenario("queue_overflow", 100_000_000, 100_000, _p(kind="full_speed", batch=256), capacity=16),
        Scenario("market_open_burst", 5_000_000_000, 1_000_000, _p(kind="burst", size=10_000, gap_ns=1_000_000, batch=256)),
        Scenario("gaussian_rate", 1_000_000_000, 1_000_000, _p(kind="gaussian", mean=50_000.0, std=10_000.0, seed=42, batch=128)),
        Scenario("protocol_quotes", 1_000_000_000, 1_000_000, _p(kind="fixed_rate", pps=10_000, batch=64)),
    )
}


def from_toml(text: str) -> Scenario:
    """A scenario from a document with tables scenario, nic (one), fabric and consumer. Durations: ns, us, ms, s."""
    import tomllib

    doc = tomllib.loads(text)
    head = doc.get("scenario", {})
    if head.get("simulated", True) is not True:
        raise NotImplementedBackend("only simulated scenarios run")
    nics = doc.get("nic", [{}])
    if len(nics) != 1:
        raise ConfigError("one nic a scenario; run several and merge their rows")
    traffic, fault = dict(nics[0].get("traffic", {})), dict(nics[0].get("fault", {}))
    kind = {"fixed": "fixed_rate", "full": "full_speed"}.get(traffic.get("pattern", "fixed"), traffic.get("pattern", "fixed"))
    settings = {"kind": kind, "batch": int(nics[0].get("batch_size", 64))}
    settings |= {k: traffic[k] for k in ("pps", "mean", "std", "seed") if k in traffic}
    settings |= {"size": traffic["burst_size"]} if "burst_size" in traffic else {}
    settings |= {"gap_ns": duration(traffic["gap"])} if "gap" in traffic else {}
    rings, consumers = doc.get("fabric", {}).get("ring", [{}]), doc.get("consumer", [{}])
    drain = consumers[0].get("max_per_drain") if consumers else None
    return Scenario(head.get("name", "scenario"), duration(head.get("duration", "1s")), duration(head.get("tick", "1ms")), pacing.Pattern(**settings), faulty.Faults(drop_rate=float(fault.get("drop_rate", 0.0)), seed=int(fault.get("seed", 0))), int(rings[0].get("slots", 4096)), drain)


def duration(text: str | int) -> int:
    """Nanoseconds: a number with ns, us, ms or s; bare numbers are ns, `_` is ignored."""
    import re

    found = re.fullmatch(r"\s*([0-9_.]+)\s*(ns|us|ms|s)?\s*", str(text))
    if not found or not found[1].strip("_."):
        raise ConfigError(f"no duration: {text!r}")
    return round(float(found[1].replace("_", "")) * {"ns": 1, "us": 1_000, "ms": 1_000_000, "s": 1_000_000_000}[found[2] or "ns"])


def per_tick(spark: SparkSession, s: Scenario) -> DataFrame:
    """tick, generated, dropped, arrivals (what reaches the queue)."""
    made = pacing.arrivals(spark, s.n_ticks, s.pattern, s.tick_ns).withColumnRenamed("arrivals", "generated")
    if s.faults.corrupt_rate or s.faults.spike_rate:
        raise ConfigError("a scenario plan takes drops only; use faults.mixed on its packets")
    if not s.faults.drop_rate:
        return made.withColumn("dropped", F.lit(0).cast("long")).withColumn("arrivals", F.col("generated"))
    packets = pacing.packets(made.withColumnRenamed("generated", "arrivals"), s.tick_ns)
    lost = faulty.drops(packets, s.faults).groupBy("tick").agg(F.sum(F.col("dropped").cast("long")).alias("dropped"))
    return made.join(lost, "tick", "left").withColumn("dropped", F.coalesce("dropped", F.lit(0))).withColumn("arrivals", F.col("generated") - F.col("dropped"))


def queue(spark: SparkSession, s: Scenario) -> DataFrame:
    """Each tick through the queue. Without a drain limit the queue is empty at every tick's start: a closed form."""
    ticks = per_tick(spark, s)
    if s.drain is None:
        written = F.least(F.col("arrivals"), F.lit(s.capacity))
        return ticks.select("tick", "generated", "dropped", "arrivals", written.alias("written"), (F.col("arrivals") - written).alias("overflow"), written.alias("consumed"), F.lit(0).cast("long").alias("occupancy"))
    through = queueing.bounded(ticks.withColumn("run", F.lit(s.name)), s.capacity, s.drain).drop("run", "arrivals")
    return ticks.join(through, "tick")


def stats(spark: SparkSession, s: Scenario) -> DataFrame:
    """One row of counters."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    counted = queue(spark, s).agg(F.count("*").alias("ticks"), *map(total, ("generated", "dropped", "written", "consumed", "overflow")))
    return counted.select(F.lit(s.name).alias("scenario"), "ticks", "generated", "dropped", "written", "consumed", "overflow", F.lit(s.n_ticks * s.tick_ns).cast("long").alias("clock_ns"))
