"""Traffic pacing: packets per tick, in closed form where there is one."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..envelope import ConfigError
from ..functions import rng


@dataclass(frozen=True)
class Pattern:
    """kind: full_speed, fixed_rate (pps), burst (size, gap_ns) or gaussian (mean, std, seed); ``batch`` bounds a tick."""

    kind: str = "fixed_rate"
    pps: int = 1000
    size: int = 1000
    gap_ns: int = 1_000_000
    mean: float = 50_000.0
    std: float = 10_000.0
    seed: int = 0
    batch: int = 64

    def __post_init__(self) -> None:
        if self.kind not in ("full_speed", "fixed_rate", "burst", "gaussian") or self.batch < 1:
            raise ConfigError(f"unknown pattern {self.kind!r} or a batch below 1")


@dataclass(frozen=True)
class Traffic:
    pattern: Pattern = field(default_factory=Pattern)
    tick_ns: int = 1_000_000


def ticks(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", "tick")


def fixed_rate(tick: Column, pps: int, tick_ns: int, batch: int) -> Column:
    """A packet each whole ``1e9 div pps`` ns, at most a batch a tick; what is above the batch is lost."""
    if pps <= 0:
        return F.lit(0).cast("long")
    if pps > 1_000_000_000:
        return F.lit(batch).cast("long")
    period = 1_000_000_000 // pps
    return F.least(_div((tick + 1) * tick_ns, period) - _div(tick * tick_ns, period), F.lit(batch)).cast("long")


def _div(x: Column, by: int) -> Column:
    """Whole division in integers: doubles would round above 2^53."""
    return ((x - F.pmod(x, F.lit(by))) / by).cast("long")


def burst(tick: Column, size: int, gap_ns: int, tick_ns: int, batch: int) -> Column:
    """``size`` packets as fast as the batch lets them, then ceil(gap / tick) idle ticks."""
    busy, idle = -(-size // batch), -(-gap_ns // tick_ns)
    if size <= 0:
        return F.lit(0).cast("long")
    at = F.pmod(tick, F.lit(busy + idle))
    return F.when(at < busy, F.least(F.lit(batch), F.lit(size) - at * batch)).otherwise(0).cast("long")


def gaussian(spark: SparkSession, n_ticks: int, mean_pps: float, std_pps: float, seed: int, tick_ns: int, batch: int) -> DataFrame:
    """(tick, arrivals) by Box-Muller over the congruential generator: two draws give the counts of two ticks.

    Draws are found by their number, so ticks are independent of each other.
    """
    scale = tick_ns / 1e9

    def draw(tick: pd.Series) -> pd.Series:
        t = tick.to_numpy()
        pair = t // 2
        u1 = np.maximum(rng.uniforms(rng.states(seed, pair * 2 + 1)), 1e-12)
        u2 = rng.uniforms(rng.states(seed, pair * 2 + 2))
        r, angle = np.sqrt(-2 * np.log(u1)), 2 * np.pi * u2
        z = np.where(t % 2 == 0, r * np.cos(angle), r * np.sin(angle))
        x = (mean_pps + std_pps * z) * scale
        return pd.Series(np.clip(np.floor(np.abs(x) + 0.5) * np.sign(x), 0, batch).astype(np.int64))

    return ticks(spark, n_ticks).withColumn("arrivals", F.pandas_udf(draw, "long")("tick"))


def arrivals(spark: SparkSession, n_ticks: int, pattern: Pattern, tick_ns: int) -> DataFrame:
    """(tick, arrivals) of a pattern."""
    t, p = F.col("tick"), pattern
    if p.kind == "gaussian":
        return gaussian(spark, n_ticks, p.mean, p.std, p.seed, tick_ns, p.batch)
    count = {"full_speed": lambda: F.lit(p.batch).cast("long"), "fixed_rate": lambda: fixed_rate(t, p.pps, tick_ns, p.batch), "burst": lambda: burst(t, p.size, p.gap_ns, tick_ns, p.batch)}[p.kind]()
    return ticks(spark, n_ticks).withColumn("arrivals", count)


def packets(per_tick: DataFrame, tick_ns: int) -> DataFrame:
    """A row per packet: sequence (from 1, over all ticks), tick, ts_ns = tick start + place in the tick.

    Ticks are one row each; the running sum over them is by blocks, packets are
    generated in place.
    """
    block = F.floor(F.col("tick") / 65_536)
    blocks = per_tick.groupBy(block.alias("block")).agg(F.sum("arrivals").alias("n"))
    base = blocks.select("block", F.coalesce(F.sum("n").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    within = per_tick.withColumn("block", block).withColumn("before", F.coalesce(F.sum("arrivals").over(W.partitionBy("block").orderBy("tick").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    placed = within.filter("arrivals > 0").join(base, "block")
    rows = placed.select("tick", (F.col("base") + F.col("before")).alias("first"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("arrivals") - 1)).alias("i"))
    return rows.select((F.col("first") + F.col("i") + 1).alias("sequence"), "tick", (F.col("tick") * tick_ns + F.col("i")).alias("ts_ns"))
