"""Operator 13: importance resampling towards a target by hashed word features, scored without taking rows apart."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common
from .license import SEPARATORS


@dataclass(frozen=True)
class Settings:
    """longest: words of the longest features; buckets: of the hash; scale: gains and draws are whole ``scale``-ths;
    seed: begins what is hashed for a document's draw; least_words: of a document that can be drawn; percent: of these that are.
    """

    longest: int = 1
    buckets: int = 10_000
    scale: int = 1000
    seed: int = 2024
    least_words: int = 20
    percent: int = 10


def bucketed(docs: DataFrame, settings: Settings = Settings(), text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id (null where ``docs`` has none), n_words and ``features``, the bucket of each feature: a row per row of ``docs``, by higher-order functions alone."""
    doc_id = (F.col("doc_id") if "doc_id" in docs.columns else F.lit(None)).cast("long").alias("doc_id")
    words = docs.select(*keep, doc_id, F.expr(f"filter(split(translate(coalesce({text}, ''), '{common.UPPER}', '{common.LOWER}'), r'{SEPARATORS}', -1), w -> w <> '')").alias("words"))
    hashed = lambda x: f"CAST(crc32(CAST({x} AS BINARY)) % {settings.buckets} AS INT)"
    runs = ["transform(words, w -> {})".format(hashed("w"))]
    for k in range(2, settings.longest + 1):
        runs.append("CASE WHEN size(words) >= {0} THEN transform(sequence(1, size(words) - {1}), i -> {2}) ELSE array() END".format(k, k - 1, hashed(f"array_join(slice(words, i, {k}), ' ')")))
    return words.selectExpr(*keep, "doc_id", "CAST(size(words) AS LONG) AS n_words", f"concat({', '.join(runs)}) AS features")


def totals(features: DataFrame) -> DataFrame:
    """(bucket, n): how many features each bucket holds. Counted in the tasks first, so a row a task and bucket is shuffled."""
    return features.select(F.explode("features").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def gains(source: DataFrame, target: DataFrame, settings: Settings = Settings()) -> list[int]:
    """The gain of each bucket, from the totals of the source and of the target: ``buckets`` numbers, whatever the input's size.

    floor(scale * ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))), in doubles;
    an empty table counts as no features.
    """
    s, t = ({r.bucket: r.n for r in side.collect()} for side in (source, target))  # a row a bucket
    s_all, t_all = float(sum(s.values()) + settings.buckets), float(sum(t.values()) + settings.buckets)
    return [math.floor(settings.scale * math.log((t.get(i, 0) + 1) * s_all / ((s.get(i, 0) + 1) * t_all))) for i in range(settings.buckets)]


def weight(features: Column | str, gain: list[int]) -> Column:
    """The sum of the gains of a row's features, looked up in a literal array."""
    table = F.expr(f"CAST(split('{','.join(map(str, gain))}', ',') AS ARRAY<BIGINT>)")  # folded to one constant
    return F.aggregate(features, F.lit(0).cast("long"), lambda a, x: a + F.element_at(table, x + 1))


def noise(doc_id: Column, settings: Settings = Settings()) -> Column:
    """floor(-scale * ln(-ln(u))), u from the hash of doc_id (null: of no digits): with it, the highest scores are a draw by weight."""
    digest = F.sha2(F.concat(F.lit(f"{settings.seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(F.lit(-float(settings.scale)) * F.ln(-F.ln(u))).cast("long")


def _scored(docs: DataFrame, gain: list[int], settings: Settings) -> DataFrame:
    """``docs`` (with features) and their weight and score."""
    weighed = docs.withColumn("n_features", F.size("features").cast("long")).withColumn("weight", weight("features", gain)).drop("features")
    return weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), settings))


def _ranked(able: DataFrame, settings: Settings) -> DataFrame:
    """``able`` (doc_id, score and others), written, with rank from 1 in the order of the draw, and ``most``, how many are drawn."""
    n = int(able.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("tie")]
    ranged = able.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(n, *order).sortWithinPartitions(*order)
    # Written once: a row's range and its place there belong together, however often tasks are run.
    kept = common.cut(ranged.withColumn("range", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "scores")
    sizes = kept.groupBy("range").agg(F.count("*").alias("n"))  # a row a range
    before = F.coalesce(F.sum("n").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    most = F.floor(F.sum("n").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) * settings.percent / 100)
    bases = sizes.select("range", before.alias("base"), most.cast("long").alias("most"))
    return kept.join(F.broadcast(bases), "range").withColumn("rank", F.col("base") + F.col("place") + 1).drop("tie", "range", "place", "base")


def resample(docs: DataFrame, target: DataFrame, settings: Settings = Settings(), text: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score and rank: a row per row of ``docs``; rank is null where it was not drawn.

    Buckets of all texts are computed once and written; to find the gains only
    count totals are shuffled, and weights are sums inside a row. Of the N rows
    with at least ``least_words`` words, floor(percent N / 100) are drawn: the
    highest scores, ties to the smaller doc_id (null last). Ranks come from rows
    ranged by score, so no task holds or sorts them all.

    Null and empty texts have no features and weigh 0. Equal rows are drawn each
    for itself. A text of any length is one row's own matter. Other columns,
    whatever their names, are ignored; an empty table gives no rows, an empty
    target counts as no features.
    """
    own = common.cut(bucketed(docs, settings, text), "features")
    scored = _scored(own, gains(totals(own), totals(bucketed(target, settings, text)), settings), settings)
    able = F.col("n_words") >= settings.least_words
    columns = ("doc_id", "n_features", "weight", "score")
    ranked = _ranked(scored.filter(able).select(*columns), settings)
    taken = ranked.select(*columns, F.when(F.col("rank") <= F.col("most"), F.col("rank")).alias("rank"))
    return taken.unionByName(scored.filter(~able).select(*columns, F.lit(None).cast("long").alias("rank")))


def drawn(docs: DataFrame, target: DataFrame, settings: Settings = Settings(), text: str = "text") -> DataFrame:
    """The rows of ``docs`` that resample() draws, with all their columns.

    Rows are taken by the score and doc_id of the last one drawn. Of rows that
    agree with it in both, as many as are left are taken, any of them. Nulls,
    repeated rows and empty tables are as in resample().
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col("doc_id"), F.col(text).alias(text))
    own = common.cut(bucketed(docs, settings, text), "features")
    gain = gains(totals(own), totals(bucketed(target, settings, text)), settings)
    able = F.col("n_words") >= settings.least_words
    ranked = _ranked(_scored(own, gain, settings).filter(able).select("doc_id", "score"), settings)
    last = ranked.filter("rank = most").select("score", "doc_id", "most").first()  # one row
    if last is None:
        return docs.limit(0)
    # A generator ends the chain: a filter on the score would be pushed below the projections, and the words split anew for every feature.
    scored = _scored(bucketed(rows, settings, text, keep=("__row",)), gain, settings).selectExpr("__row", "inline(array(struct(doc_id, n_words, score)))").filter(able)
    same = (F.col("score") == last.score) & F.col("doc_id").eqNullSafe(F.lit(last.doc_id).cast("long"))
    later = F.lit(False) if last.doc_id is None else F.col("doc_id").isNull() | (F.col("doc_id") > last.doc_id)
    first = (F.col("score") > last.score) | ((F.col("score") == last.score) & ~same & ~later)
    left = last.most - ranked.filter((F.col("score") > last.score) | ((F.col("score") == last.score) & ~same & ~later)).count()
    return scored.filter(first).select("__row.*").unionByName(scored.filter(same).limit(int(left)).select("__row.*"))


#: resample() over tables ``documents`` and ``benchmark``, for DuckDB, which has no crc32: it is taken bit by bit, of each distinct word.
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{common.UPPER}', '{common.LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dw AS (SELECT r, unnest(w) AS word FROM d),
bw AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), '{common.UPPER}', '{common.LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
x AS (SELECT word, hex(word) AS x FROM (SELECT word FROM dw UNION SELECT word FROM bw)),
y AS (SELECT word, list_transform(range(1, length(x), 2), lambda i: CAST('0x' || x[i:i + 1] AS BIGINT)) AS y FROM x),
c AS (SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, y), lambda a, e: list_reduce([xor(a, e), 0, 0, 0, 0, 0, 0, 0, 0], lambda p, q: xor(p >> 1, (p & 1) * 3988292384))), 4294967295::BIGINT) % 10000 AS bucket FROM y),
s AS (SELECT bucket, CAST(count(*) AS DOUBLE) AS n FROM dw JOIN c USING (word) GROUP BY 1),
t AS (SELECT bucket, CAST(count(*) AS DOUBLE) AS n FROM bw JOIN c USING (word) GROUP BY 1),
n AS (SELECT (SELECT CAST(count(*) AS DOUBLE) FROM dw) + 10000 AS s_all, (SELECT CAST(count(*) AS DOUBLE) FROM bw) + 10000 AS t_all),
g AS (SELECT s.bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1) * s_all / ((s.n + 1) * t_all))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket), n),
m AS (SELECT r, CAST(sum(gain) AS BIGINT) AS weight FROM dw JOIN c USING (word) JOIN g USING (bucket) GROUP BY 1),
z AS (SELECT r, doc_id, len(w) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN m USING (r)),
k AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS k, count(*) OVER () AS n FROM z WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN k <= 10 * n // 100 THEN k END AS rank FROM z LEFT JOIN k USING (r)
"""
