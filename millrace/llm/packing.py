"""Operator 7: best-fit packing of token pieces into sequences of a fixed length."""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common
from .tokens import encoder

#: Bytes of text that a task encodes at once.
SLICE = 8 << 20


@dataclass(frozen=True)
class Run:
    """Pieces of one length with ranks first .. first + n - 1: ``per`` to each sequence from ``sequence`` on, from ``offset`` on."""

    length: int
    first: int
    n: int
    per: int
    sequence: int
    offset: int


def best_fit(counts: dict[int, int], capacity: int) -> list[Run]:
    """Best-fit decreasing over sorted runs of equal pieces and equal gaps.

    Rounds go down the lengths. In a round all pieces of one length look for
    their successor among the sorted gaps, the smallest that holds them; where
    more pieces than gaps of that size want the same, the pieces of lower rank
    get them and the rest go to the next gap size; what finds no gap opens new
    sequences; then the gaps are updated. A gap takes as many pieces of the
    length as it holds, as best fit does one by one (what is left is the tightest
    gap again). Works on lengths and counts alone: ``capacity`` lengths at most,
    whatever the number of documents; a run of gaps is split once a round and
    visited again only when its gap is at most half, so runs stay below
    ``2 * capacity * log2(capacity)``.
    """
    gaps: list[tuple[int, int, int]] = []  # (gap, first sequence, number), sorted
    runs: list[Run] = []
    sequences = 0
    for length in sorted(counts, reverse=True):
        first, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(gaps, (length, -1, -1))
            if at == len(gaps):
                per = capacity // length
                gap, start, n = capacity, sequences, -(-left // per)
                sequences += n
            else:
                gap, start, n = gaps.pop(at)
                per = gap // length
            whole = min(n, left // per)
            # Sequences that take the full number, one that takes the last few, and those left as they are.
            for use, take in ((whole, per), (int(whole < n and left - whole * per > 0), left - whole * per)):
                if use and take:
                    runs.append(Run(length, first, use * take, take, start, capacity - gap))
                    first, left = first + use * take, left - use * take
                    if gap - take * length:
                        bisect.insort(gaps, (gap - take * length, start, use))
                    start, n = start + use, n - use
            if n:
                bisect.insort(gaps, (gap, start, n))
    return runs


def pieces(docs: DataFrame, path: str, end_id: int = 0, capacity: int = 2048, text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece, and its task and rank among the task's pieces of its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task = encoder(path), common.partition_id()
        seen = np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], enc.wide).tobytes()
        for batch in (part for b in batches for part in common.slices(b, SLICE)):
            at, piece, start, length, crc, rank = [], [], [], [], [], []
            for i, got in enumerate(enc.encode([t or "" for t in batch.column("text").to_pylist()], SLICE // 4)):
                ids = np.frombuffer(got + end, enc.wide).astype("<u4")
                for p, s in enumerate(range(0, len(ids), capacity)):
                    part = ids[s : s + capacity]
                    at.append(i), piece.append(p), start.append(s), length.append(len(part))
                    crc.append(zlib.crc32(part.data))
                    rank.append(int(seen[len(part)]))
                    seen[len(part)] += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([task] * len(at), pa.int64()), pa.array(rank, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, task long, rank long")


def place(parts: DataFrame, capacity: int) -> DataFrame:
    """``parts`` (length, task, rank, ...) with sequence_id and offset.

    A piece's rank among all pieces of its length is its rank in its task plus
    the pieces of that length in the tasks before: prefix sums over (task,
    length) counts. Packing is then decided for whole runs of ranks by
    best_fit() and looked up by a broadcast of the runs, whose number is bounded
    by the capacity. Documents are never sorted, moved or gathered.
    """
    spark = parts.sparkSession
    counts = parts.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    bases = common.cut(counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "bases")
    total = {r.length: r.n for r in bases.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = [(r.length, r.first, r.first + r.n, r.per, r.sequence, r.offset) for r in best_fit(total, capacity)]
    table = spark.createDataFrame(runs, "r_length long, first long, stop long, per long, sequence long, at long")
    ranked = parts.join(common.small(bases.select("task", "length", "base")), ["task", "length"]).withColumn("rank", F.col("rank") + F.col("base"))
    fits = (F.col("length") == F.col("r_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("stop"))
    placed = ranked.join(F.broadcast(table), fits)
    back = F.col("rank") - F.col("first")
    return placed.withColumn("sequence_id", F.col("sequence") + F.expr("(rank - first) div per")).withColumn("offset", F.col("at") + F.pmod(back, F.col("per")) * F.col("length"))


def pack(docs: DataFrame, path: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row per piece of each row of ``docs``.

    A document is its ids and the end id; only one longer than ``capacity`` is
    cut, into whole pieces and a last one. Null and empty texts are the end id
    alone. Repeated rows are packed each for itself, equal lengths by rank; other
    columns, whatever their names, are ignored; an empty table gives no rows.
    """
    parts = common.cut(pieces(docs, path, end_id, capacity), "pieces")
    return place(parts, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
