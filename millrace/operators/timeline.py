"""Settings that change along a timeline: each row takes the last change at or before its time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .routing import PER_RANGE, ranged


def as_of(rows: DataFrame, changes: DataFrame, by: str, at: str, values: list[str], per_range: int = PER_RANGE) -> DataFrame:
    """``rows`` with ``values`` of the latest row of ``changes`` whose ``at`` is not after the row's; null before the first.

    Both have the key column ``by``. Of changes at the same time the one with
    the larger ``place`` counts, if they have that column. Rows and changes lie
    in ranges of time (see routing.ranged()); in a range and key the last value
    runs on from row to row, and into it goes what the ranges before end with, a
    row a key and range. No pairs are made, and no task holds a whole key.
    """
    struct = F.struct(*[F.col(v) for v in values])
    place = F.col("place") if "place" in changes.columns else F.lit(0)
    left = rows.select(F.col(by).alias("__by"), F.col(at).alias("__at"), F.lit(1).alias("__kind"), F.lit(0).cast("long").alias("__place"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("__row"), F.lit(None).alias("__set"))
    right = changes.select(F.col(by).alias("__by"), F.col(at).alias("__at"), F.lit(0).alias("__kind"), place.cast("long").alias("__place"), F.lit(None).alias("__row"), struct.alias("__set"))
    both = ranged(left.unionByName(right), "__at", per_range)
    ends = both.groupBy(F.col("__by").alias("__of"), F.col("__range").alias("__part")).agg(F.max_by("__set", F.when(F.col("__kind") == 0, F.struct("__at", "__place"))).alias("__last"))
    before = W.partitionBy("__of").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select("__of", "__part", F.last("__last", ignorenulls=True).over(before).alias("__before"))
    w = W.partitionBy("__by", "__range").orderBy("__at", "__kind", "__place").rowsBetween(W.unboundedPreceding, 0)
    placed = both.withColumn("__now", F.last("__set", ignorenulls=True).over(w)).filter("__kind = 1")
    met = placed.join(carried, F.col("__by").eqNullSafe(F.col("__of")) & (F.col("__range") == F.col("__part")))
    now = F.coalesce("__now", "__before")
    return met.select("__row.*", *[now[v].alias(v) for v in values])
