"""Routing: a sink_id for each row, 0 to drop it; then a DataFrame per sink."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..envelope import ConfigError, PlacementError

DROP = 0


def _sinks(sinks: list[int]) -> Column:
    if not sinks or any(s <= DROP for s in sinks):
        raise ConfigError("sinks are one or more positive ids")
    return F.array(*[F.lit(s).cast("long") for s in sinks])


def fixed(rows: DataFrame, sink: int) -> DataFrame:
    return rows.withColumn("sink_id", _sinks([sink])[0])


def drop_all(rows: DataFrame) -> DataFrame:
    return rows.withColumn("sink_id", F.lit(DROP).cast("long"))


def by_key(rows: DataFrame, key: Column, sinks: list[int]) -> DataFrame:
    """sinks[key modulo their number]: the key itself, not a hash of it."""
    return rows.withColumn("sink_id", _sinks(sinks)[F.pmod(key.cast("long"), F.lit(len(sinks))).cast("int")])


def by_schema(rows: DataFrame, sinks: list[int]) -> DataFrame:
    return by_key(rows, F.col("schema_id"), sinks)


def by_callback(rows: DataFrame, route: Callable[[DataFrame], Column]) -> DataFrame:
    """``route`` gives a Column of sink ids; null counts as dropped."""
    return rows.withColumn("sink_id", F.coalesce(route(rows).cast("long"), F.lit(DROP)))


#: Rows of a range, about, and ranges at most: what ranks and running values are computed by.
PER_RANGE, MOST_RANGES = 1 << 20, 4096


def ranged(rows: DataFrame, order: str, per_range: int = PER_RANGE, name: str = "__range") -> DataFrame:
    """``rows`` with the number of their range, rising with a numeric column and about even in rows; nulls are in the first one.

    Ranges end at quantiles of the column, not at steps of its values: stamps in
    nanoseconds or other sparse keys give as many ranges as dense ones. One job
    counts, one more finds the quantiles where there are rows for several ranges;
    a range is then found by binary search, in the JVM.
    """
    if per_range < 1:
        raise ConfigError("a range has 1 row or more")
    ranges = min(-(-rows.agg(F.count(order)).first()[0] // per_range), MOST_RANGES)
    ends: list[float] = []
    if ranges > 1:
        shares = ", ".join(f"{i / ranges}D" for i in range(1, ranges))
        ends = sorted({float(x) for x in rows.agg(F.expr(f"percentile_approx(`{order}`, array({shares}), {max(10_000, 20 * ranges)})")).first()[0]})
    if not ends:
        return rows.withColumn(name, F.lit(0))
    from pyspark.ml.feature import Bucketizer

    # As doubles, large numbers may agree that differ: they then share a range, in which the column itself orders them.
    low = float("-inf")
    keyed = rows.withColumn("__double", F.coalesce(F.col(order).cast("double"), F.lit(low)))
    found = Bucketizer(splits=[low, *ends, float("inf")], inputCol="__double", outputCol=name).transform(keyed)
    return found.withColumn(name, F.col(name).cast("int")).drop("__double")


def numbered(rows: DataFrame, order: str = "sequence", per_range: int = PER_RANGE, name: str = "index") -> DataFrame:
    """``rows`` with their place, 0 first, in the order of a numeric column without repeats.

    Places are the rows in the ranges before (see ranged()) and the row's rank in
    its own. So no task sorts more than a range, and the window over ranges sees
    one row each.
    """
    own = ranged(rows, order, per_range)
    counts = own.groupBy(F.col("__range").alias("__of")).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(W.orderBy("__of").rowsBetween(W.unboundedPreceding, -1))
    bases = F.broadcast(counts.select("__of", F.coalesce(before, F.lit(0)).alias("__base")))  # MOST_RANGES rows at most
    placed = own.withColumn("__rank", F.row_number().over(W.partitionBy("__range").orderBy(order)))
    return placed.join(bases, F.col("__range") == F.col("__of")).withColumn(name, (F.col("__base") + F.col("__rank") - 1).cast("long")).drop("__range", "__of", "__base", "__rank")


#: Name of the place that ranked() gives.
RANK = "__rank_in_batch"


def ranked(rows: DataFrame, batch: str, order: str = "sequence", per_range: int = PER_RANGE) -> DataFrame:
    """``rows`` with RANK, their place in their batch, 1 first, in the order of a numeric column (nulls first).

    Counted by ranges within a batch, so a batch that holds most rows is still
    ranked by many tasks; a range's first place is the prefix sum of the ranges
    before it, a row a range.
    """
    own = ranged(rows, order, per_range)
    counts = own.groupBy(F.col(batch).alias("__of"), F.col("__range").alias("__part")).agg(F.count("*").alias("__n"))
    before = W.partitionBy("__of").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select("__of", "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    placed = own.withColumn(RANK, F.row_number().over(W.partitionBy(batch, "__range").orderBy(order)))
    met = placed.join(bases, F.col(batch).eqNullSafe(F.col("__of")) & (F.col("__range") == F.col("__part")))
    return met.withColumn(RANK, F.col(RANK) + F.col("__base")).drop("__range", "__of", "__part", "__base")


def round_robin(rows: DataFrame, sinks: list[int], order: str = "sequence", per_range: int = PER_RANGE) -> DataFrame:
    """Sinks in turn, in arrival order."""
    placed = numbered(rows, order, per_range, "__place")
    return placed.withColumn("sink_id", _sinks(sinks)[F.pmod("__place", F.lit(len(sinks))).cast("int")]).drop("__place")


def unregistered(routed: DataFrame, sinks: list[int]) -> DataFrame:
    """Rows whose sink nobody registered."""
    return routed.filter((F.col("sink_id") != DROP) & ~F.col("sink_id").isin([int(s) for s in sinks]))


def split(routed: DataFrame, sinks: list[int], strict: bool = True) -> dict[int, DataFrame]:
    """A DataFrame per sink; with ``strict`` an unregistered sink id fails the rows' own job."""
    if strict:
        known = (F.col("sink_id") == DROP) | F.col("sink_id").isin([int(s) for s in sinks])
        routed = routed.withColumn("sink_id", F.when(known, F.col("sink_id")).otherwise(F.raise_error(F.concat(F.lit(f"{PlacementError.kind}: no sink "), F.col("sink_id").cast("string"))).cast("long")))
    return {s: routed.filter(F.col("sink_id") == s) for s in sinks}
