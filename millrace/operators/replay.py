"""Replay timing: when each recorded row is let go, in ns after the first."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..envelope import ConfigError
from . import routing


def full_speed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("release_ns", F.lit(0).cast("long"))


def original_timing(rows: DataFrame, source: str = "source", ts: str = "ts_ns", order: str = "sequence", factor: float = 1.0, per_range: int = routing.PER_RANGE) -> DataFrame:
    """Distances as recorded, times ``factor`` (over 1 is slower), cut to whole ns.

    A row that goes back in time is due at once, but never before a row ahead of
    it: a running maximum, taken within ranges of the order (see
    routing.ranged()), and over the ranges before, of which a source has a row
    each. So a source that holds most rows is replayed by many tasks.
    """
    if not (math.isfinite(factor) and factor > 0):
        raise ConfigError("a time scale is finite and above 0")
    begun = rows.groupBy(F.col(source).alias("__of")).agg(F.min_by(ts, order).alias("__first"))
    delta = F.greatest(F.col(ts) - F.col("__first"), F.lit(0))
    due = delta if factor == 1.0 else (delta * F.lit(factor)).cast("long")
    timed = routing.ranged(rows, order, per_range).join(begun, F.col(source).eqNullSafe(F.col("__of"))).withColumn("__due", due).drop("__of", "__first")
    before = W.partitionBy("__of").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    ranges = timed.groupBy(F.col(source).alias("__of"), F.col("__range").alias("__part")).agg(F.max("__due").alias("__last"))
    ranges = ranges.select("__of", "__part", F.max("__last").over(before).alias("__ahead"))
    own = timed.withColumn("__run", F.max("__due").over(W.partitionBy(source, "__range").orderBy(order).rowsBetween(W.unboundedPreceding, 0)))
    met = own.join(ranges, F.col(source).eqNullSafe(F.col("__of")) & (F.col("__range") == F.col("__part")))
    return met.withColumn("release_ns", F.greatest("__run", "__ahead").cast("long")).drop("__due", "__range", "__of", "__part", "__ahead", "__run")


def burst(rows: DataFrame, count: int, gap_ns: int, tick_ns: int = 1, order: str = "sequence") -> DataFrame:
    """``count`` rows at once, then ``gap_ns`` of rest, rounded up to whole ticks."""
    if count < 1 or tick_ns < 1:
        raise ConfigError("count and tick must be 1 or more")
    gap = -(-gap_ns // tick_ns) * tick_ns
    return routing.numbered(rows, order, name="__place").withColumn("release_ns", (F.floor(F.col("__place") / count) * gap).cast("long")).drop("__place")


def single_step(rows: DataFrame, advances: int, order: str = "sequence") -> DataFrame:
    """The rows that ``advances`` steps let go: one more than there are steps."""
    return rows.orderBy(order).limit(advances + 1)


def release_tick(tick_ns: int) -> Column:
    return F.ceil(F.col("release_ns") / tick_ns).cast("long")


def paused(released: DataFrame, controls: DataFrame, source: str = "source", keep_distances: bool = False, per_range: int = routing.PER_RANGE) -> DataFrame:
    """``released`` (with release_ns) under pauses of its source's clock: when each row is really let go; null if its pause never ends.

    ``controls`` has the source, ``at_ns`` and ``paused`` (true to pause, false to
    resume); of several at one time the last by ``place`` counts, if they have
    that column; a second pause changes nothing. Nothing is let go from a pause on
    until the source is resumed. By default the clock runs on, as a paused replay
    does: what fell due meanwhile goes at once, in its order. With
    ``keep_distances`` the clock stands still, and distances stay as they were.
    Controls join by time, as settings do (see timeline.as_of()): a key's rows
    are dealt over tasks, and no pairs are made.
    """
    from . import timeline

    place = F.col("place") if "place" in controls.columns else F.lit(0)
    by_time = W.partitionBy("__src").orderBy("at_ns", "__place")
    told = controls.select(F.col(source).alias("__src"), F.col("at_ns").cast("long").alias("at_ns"), F.col("paused").alias("__on"), place.cast("long").alias("__place"))
    # Only controls that change something, in turn: pause, resume, pause; of those at one time the last.
    told = told.withColumn("__next", F.lead("at_ns").over(by_time)).filter(F.col("__next").isNull() | (F.col("__next") > F.col("at_ns"))).drop("__next")
    told = told.withColumn("__was", F.coalesce(F.lag("__on").over(by_time), F.lit(False))).filter(F.col("__on") != F.col("__was"))
    pauses = told.withColumn("__until", F.lead("at_ns").over(by_time)).filter("__on")
    if not keep_distances:
        stops = pauses.select("__src", "at_ns", F.col("__until"), F.lit(True).alias("__stopped"))
        met = timeline.as_of(released.withColumn("__src", F.col(source)), stops.withColumnRenamed("at_ns", "release_ns"), "__src", "release_ns", ["__until", "__stopped"], per_range)
        held = F.col("__stopped") & (F.col("__until").isNull() | (F.col("release_ns") < F.col("__until")))
        now = F.when(F.coalesce(held, F.lit(False)), F.col("__until")).otherwise(F.col("release_ns"))
        return met.withColumn("release_ns", now).drop("__src", "__until", "__stopped")
    before = by_time.rowsBetween(W.unboundedPreceding, -1)
    lasted = F.col("__until") - F.col("at_ns")
    # By the source's own clock a pause has no length: it stands where the clock stood, and moves all that is due from there on.
    stood = pauses.withColumn("__moved", F.coalesce(F.sum(lasted).over(before), F.lit(0)))
    stops = stood.select("__src", (F.col("at_ns") - F.col("__moved")).alias("release_ns"), (F.col("__moved") + lasted).alias("__by"), F.lit(True).alias("__stopped"), F.col("at_ns").alias("place"))
    met = timeline.as_of(released.withColumn("__src", F.col(source)), stops, "__src", "release_ns", ["__by", "__stopped"], per_range)
    now = F.when(F.col("__stopped"), F.col("release_ns") + F.col("__by")).otherwise(F.col("release_ns"))
    return met.withColumn("release_ns", now).drop("__src", "__by", "__stopped")
