"""Operator 4: mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common

#: Weights of the sources by their place in code point order, repeating.
WEIGHTS = (3, 1, 2)
#: Share of all sizes that the mix comes to, and times that a source may be taken.
SHARE, MOST = 1.5, 2.0


def sizes(text: str = "text") -> F.Column:
    """Words of a text: runs without blanks; 0 for null."""
    return F.expr(f"CAST(size(filter(split(coalesce({text}, ''), r'{common.BLANKS}', -1), w -> w <> '')) AS LONG)")


def targets(by_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Targets are proportional to the weights, up to ``most`` times a source's
    size; what is cut off is shared again by weight among the others, until no
    target is above. The level (target per unit of weight) is found by repeated
    sums over the sources table, of which one row each time reaches the driver.
    """
    # One row a source. In this order nulls come last; strings compare by code point.
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    given = common.cut(by_source.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))), "sources")
    total = given.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, None
    while True:
        capped = F.col("weight") * level >= most * F.col("source_size")
        row = given.agg(F.sum(F.when(capped, most * F.col("source_size"))).alias("cut"), F.sum(F.when(~capped, F.col("weight"))).alias("weight"), F.count(F.when(capped, 1)).alias("n")).first()
        if row.n == full or not row.weight:
            break
        full = row.n
        level = (share * total - (row.cut or 0.0)) / row.weight
    return given.select("source", "source_size", F.when(F.col("weight") * level >= most * F.col("source_size"), most * F.col("source_size")).otherwise(F.col("weight") * F.lit(level)).cast("double").alias("target"))


def copies(rate: F.Column, key: F.Column) -> F.Column:
    """floor(rate) copies and one more with the probability of the fraction, by a 53-bit hash of ``key``."""
    draw = F.shiftrightunsigned(key, 11) / F.lit(float(1 << 53))
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def _rated(docs: DataFrame, seed: int) -> DataFrame:
    """``docs`` as ``__row`` with __size, __source_size, __target and __copies."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col("source").alias("__source"), sizes().alias("__size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("__key"))
    by_source = rows.groupBy("__source").agg(F.sum("__size").alias("__source_size")).select(F.col("__source").alias("source"), F.col("__source_size").alias("source_size"))
    # A row a source, its text bounded by the name: broadcast while that is few, else joined by a shuffle.
    goal = common.small(targets(by_source))
    joined = rows.join(goal.select(F.col("source").alias("__s"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target")), F.col("__source").eqNullSafe(F.col("__s")), "left")
    rate = F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size")).otherwise(F.lit(0.0))
    return joined.withColumn("__copies", copies(rate, F.col("__key")))


def mix(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted): a row per row of ``docs``.

    Method: sizes are summed by source (combined before the shuffle, so one hot
    source is no matter), targets give a rate of repetition per source, and each
    document is taken floor(rate) times and once more with the fraction's
    probability, drawn from a hash of seed, doc_id and text: reruns agree, and no
    order or partitioning matters. Rates end at 2, so no document is taken more
    than twice. What a source's taken words come to spreads about its target by
    sqrt(f (1 - f) sum of squared sizes), f the fraction of its rate: some percent
    for fifty documents, less than one in a thousand for a million. Null text has size 0; a null source is a source of its own, the
    last. A source of size 0 has target and rate 0. Equal rows draw alike.
    """
    return _rated(docs, seed).select(F.col("__row.doc_id").alias("doc_id"), F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__size") * F.col("__copies")).alias("taken"))


def mixed(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The rows of ``docs``, each as often as mix() takes it, with all their columns."""
    taken = _rated(docs, seed).filter("__copies > 0")
    return taken.select("__row", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select("__row.*")
