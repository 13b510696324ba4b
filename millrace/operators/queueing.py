"""Bounded queues and what happens to rows that find them full.

Each tick the arrivals are pushed first, then up to ``drain`` rows leave:
w = min(a, C - o), o' = max(o + w - D, 0).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..envelope import ConfigError
from . import routing

POLICIES = ("block", "spin", "drop_newest", "drop_oldest", "overflow", "adaptive_batching")


def _first(rows: DataFrame, capacity: int, batch: str, order: Column) -> DataFrame:
    """The first rows of each batch: a batch's rows are cut to ``capacity`` in the tasks that have them, before they meet."""
    rank = F.row_number().over(W.partitionBy(batch).orderBy(order))
    return rows.withColumn("__rank", rank).filter(F.col("__rank") <= capacity).drop("__rank")


def drop_newest(rows: DataFrame, capacity: int, batch: str = "tick", order: str = "sequence") -> DataFrame:
    """The first ``capacity`` rows of each batch."""
    return _first(rows, capacity, batch, F.col(order))


def drop_oldest(rows: DataFrame, capacity: int, batch: str = "tick", order: str = "sequence", evict: bool = False) -> DataFrame:
    """As drop_newest(), which is how the policy of this name behaves; with ``evict`` the last ``capacity`` rows stay instead."""
    if not evict:
        return drop_newest(rows, capacity, batch, order)
    return _first(rows, capacity, batch, F.col(order).desc())


def overflow(rows: DataFrame, capacity: int, sink: int, overflow_sink: int | None, overflow_capacity: int, batch: str = "tick", order: str = "sequence") -> DataFrame:
    """sink_id by place in the batch: the sink, then the overflow sink, then dropped. An overflow sink equal to the sink counts as none."""
    rank = F.col(routing.RANK)
    place = F.when(rank <= capacity, sink)
    if overflow_sink is not None and overflow_sink != sink:
        place = place.when(rank <= capacity + overflow_capacity, overflow_sink)
    return routing.ranked(rows, batch, order).withColumn("sink_id", place.otherwise(routing.DROP).cast("long")).drop(routing.RANK)


def unbounded(ticks: DataFrame, drain: int, run: str = "run", tick: str = "tick", arrivals: str = "arrivals", per_range: int = routing.PER_RANGE) -> DataFrame:
    """Occupancy after each tick of a queue without a limit: X_t - min(0, least X so far), X the running sum of a - D.

    X runs within ranges of ticks; a range gives its sum and its least X, and
    over the ranges of a run, a row each, these add up to where each range starts.
    """
    own = routing.ranged(ticks, tick, per_range)
    w = W.partitionBy(run, "__range").orderBy(tick).rowsBetween(W.unboundedPreceding, 0)
    x = own.withColumn("__x", F.sum(F.col(arrivals) - drain).over(w)).withColumn("__least", F.min("__x").over(w))
    ranges = own.groupBy(F.col(run).alias("__of"), F.col("__range").alias("__part")).agg(F.sum(F.col(arrivals) - drain).alias("__sum"))
    least = x.groupBy(F.col(run).alias("__of"), F.col("__range").alias("__part")).agg(F.min("__x").alias("__low"))
    before = W.partitionBy("__of").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    starts = ranges.select("__of", "__part", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    lows = least.withColumnsRenamed({"__of": "__of2", "__part": "__part2"}).join(starts, F.col("__of2").eqNullSafe(F.col("__of")) & (F.col("__part2") == F.col("__part")))
    starts = lows.select("__of", "__part", "__base", F.coalesce(F.min(F.col("__base") + F.col("__low")).over(before), F.lit(0)).alias("__lower"))
    met = x.join(starts, F.col(run).eqNullSafe(F.col("__of")) & (F.col("__range") == F.col("__part")))
    occupancy = F.col("__base") + F.col("__x") - F.least(F.lit(0), F.col("__lower"), F.col("__base") + F.col("__least"))
    return met.withColumn("occupancy", occupancy.cast("long")).drop("__range", "__x", "__least", "__of", "__part", "__base", "__lower")


@dataclass(frozen=True)
class Clamp:
    """o -> min(max(o + s, low), high); clamps compose to clamps, so blocks of ticks do too."""

    s: int
    low: int
    high: int

    def then(self, s: int, low: int, high: int) -> Clamp:
        f = lambda x: min(max(x + s, low), high)
        return Clamp(self.s + s, f(self.low), f(self.high))


def bounded(ticks: DataFrame, capacity: int, drain: int | str, run: str = "run", tick: str = "tick", arrivals: str = "arrivals", block: int = 4096) -> DataFrame:
    """Each tick with written, overflow, consumed and occupancy of a queue of ``capacity`` slots.

    ``drain`` is a number or a column. A tick maps the occupancy before to the
    one after by a clamp, and clamps compose, so no run is folded in one task:
    blocks of ticks give their composed clamp, the clamps of a run (one row a
    block) give each block's start, and every block then replays its own ticks.
    """
    if capacity < 1:
        raise ConfigError("capacity must be 1 or more")
    d = F.col(drain) if isinstance(drain, str) else F.lit(drain)
    given = ticks.select(F.col(run).alias("run"), F.col(tick).cast("long").alias("tick"), F.col(arrivals).cast("long").alias("arrivals"), d.cast("long").alias("drain")).withColumn("block", F.floor(F.col("tick") / block))

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("tick")
        f = Clamp(0, 0, capacity)
        for a, n in zip(pdf["arrivals"].tolist(), pdf["drain"].tolist(), strict=True):
            f = f.then(a, 0, capacity).then(-n, 0, capacity)
        return pd.DataFrame({"run": pdf["run"].iloc[:1], "block": pdf["block"].iloc[:1], "s": f.s, "low": f.low, "high": f.high})

    def starts(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        o, out = 0, []
        for s, low, high in zip(pdf["s"].tolist(), pdf["low"].tolist(), pdf["high"].tolist(), strict=True):
            out.append(o)
            o = min(max(o + s, low), high)
        return pd.DataFrame({"run": pdf["run"], "block": pdf["block"], "start": out})

    run_type = given.schema["run"].dataType.simpleString()
    blocks = given.groupBy("run", "block").applyInPandas(compose, f"run {run_type}, block long, s long, low long, high long")
    opened = blocks.groupBy("run").applyInPandas(starts, f"run {run_type}, block long, start long")

    def replay(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("tick")
        o = int(right["start"].iloc[0]) if len(right) else 0
        a, n = left["arrivals"].to_numpy(), left["drain"].to_numpy()
        written, consumed, after = (np.zeros(len(left), np.int64) for _ in range(3))
        for i in range(len(left)):
            written[i] = min(a[i], capacity - o)
            consumed[i] = min(o + written[i], n[i])
            o = after[i] = o + written[i] - consumed[i]
        return pd.DataFrame({"run": left["run"], "tick": left["tick"], "arrivals": a, "written": written, "overflow": a - written, "consumed": consumed, "occupancy": after})

    return given.groupBy("run", "block").cogroup(opened.groupBy("run", "block")).applyInPandas(replay, f"run {run_type}, tick long, arrivals long, written long, overflow long, consumed long, occupancy long")
