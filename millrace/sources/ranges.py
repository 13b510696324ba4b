"""Framed files read by byte ranges: one file of any size by many tasks, with the same records as read from its start.

Ranges come from the listing alone, in the executors; a task opens its file and
reads its own range and as much more as its last record needs. Where a record's
index depends on what lies before, a first pass gives a row a range, which are
added up, and a second one frames: records themselves are never shuffled.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import lineage
from ..envelope import ConfigError, DecodeError
from ..operators.framing import FRAMED

#: Bytes of a range, of a block of a length-prefixed file, and of the short ranges of a task; tasks that ranges are dealt to where there are as many, and at most.
SPLIT, BLOCK, SHARE, FEW, TASKS = 64 << 20, 4 << 20, 16 << 20, 64, 4096
_RECORDS = pa.schema([("path", pa.string()), ("record_index", pa.int64()), ("file_offset", pa.int64()), ("record", pa.binary())])


def store_of(path: str):
    """(file system, path in it) of a path as Spark gives it."""
    from pyarrow import fs

    if path.startswith("/") or path.startswith("file:/"):
        return fs.LocalFileSystem(), path.removeprefix("file://").removeprefix("file:")
    return fs.FileSystem.from_uri(path)


def stretch(path: str, start: int, stop: int) -> pa.Buffer:
    """The bytes of a file from ``start`` up to ``stop``, or its end."""
    store, at = store_of(path)
    with store.open_input_file(at) as f:
        f.seek(start)
        return f.read_buffer(stop - start)


def ranges(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """(path, size, nth, start, stop): the ranges of all files of a path, by its listing; no content is read."""
    if split < 1:
        raise ConfigError("a range has 1 byte or more")
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size")).filter("size > 0")
    cut = files.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / split))).alias("nth"))
    return cut.select("path", "size", "nth", (F.col("nth") * split).alias("start"), F.least((F.col("nth") + 1) * split, F.col("size")).alias("stop"))


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows that stand for ranges, one by one over tasks: they are few bytes, so what they stand for decides, not their size.

    Beyond ``FEW`` tasks, or one a partition, short ranges share a task, up to ``SHARE`` bytes of the files.
    """
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("stop") - F.col("start")), F.lit(0))).first()
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(1, min(n, TASKS, max(parts, FEW, -(-size // SHARE)))))


def _batches(path: str, index: int, starts: np.ndarray, ends: np.ndarray, null: np.ndarray, data: np.ndarray, base: int) -> Iterator[pa.RecordBatch]:
    """Records that lie one after the other in ``data``, whose first byte is byte ``base`` of the file."""
    for k in range(0, len(starts), 65_536):
        a, z, hole = starts[k : k + 65_536], ends[k : k + 65_536], null[k : k + 65_536]
        offsets = np.append(a, z[-1]) - a[0]
        held = pa.py_buffer(np.ascontiguousarray(data[a[0] - base : z[-1] - base]))
        mask = pa.array(~hole).buffers()[1] if hole.any() else None
        records = pa.Array.from_buffers(pa.binary(), len(a), [mask, pa.py_buffer(offsets.astype(np.int32)), held])
        yield pa.RecordBatch.from_arrays([pa.array([path] * len(a), pa.string()), pa.array(np.arange(index + k, index + k + len(a))), pa.array(a), records], schema=_RECORDS)


# ---------------------------------------------------------------- fixed


def fixed(spark: SparkSession, path: str, size: int, split: int = SPLIT) -> DataFrame:
    """Records of exactly ``size`` bytes; ranges end between two of them, so a record's index follows from its offset. A tail is dropped."""
    if size < 1:
        raise ConfigError("record size must be 1 or more")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in (r for b in batches for r in b.to_pylist()):
            n = (r["stop"] - r["start"]) // size
            if n:
                data = np.frombuffer(stretch(r["path"], r["start"], r["start"] + n * size), np.uint8)
                starts = r["start"] + size * np.arange(len(data) // size)
                yield from _batches(r["path"], r["start"] // size, starts, starts + size, np.zeros(len(starts), bool), data, r["start"])

    return _dealt(ranges(spark, path, -(-split // size) * size)).mapInArrow(run, FRAMED)


# ---------------------------------------------------------------- delimited


def to_record_end(path: str, base: int, stop: int, size: int, delimiter: int, max_len: int) -> np.ndarray:
    """The bytes of a file from ``base`` up to ``stop``, and on to the first delimiter, but no more than a record may have."""
    store, at = store_of(path)
    with store.open_input_file(at) as f:
        f.seek(base)
        parts = [f.read(stop - base)]
        most, step, mark = min(size, stop + max_len), 1 << 16, bytes([delimiter])
        if not parts[0].endswith(mark):
            while stop < most and mark not in (more := f.read(min(step, most - stop))):
                parts.append(more)
                stop, step = stop + len(more), 2 * step
                if not more:
                    break
            else:
                parts += [more] if stop < most else []
    return np.frombuffer(b"".join(parts), np.uint8)


def delimited_range(data: np.ndarray, base: int, start: int, stop: int, size: int, delimiter: int, max_len: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, over) of the records that start in a range; ``data`` is the file from byte ``base``, the one before the range.

    A record starts at the file's start or after a delimiter. What runs on to
    the end of the file without one is its tail, and no record, unless it is
    already longer than allowed; a record that is over has no known end.
    """
    ends = np.flatnonzero(data == delimiter) + base + 1
    starts = ends[(ends >= start) & (ends < stop)]
    if start == 0:
        starts = np.concatenate([[0], starts])
    at = np.searchsorted(ends, starts, "right")
    end = np.append(ends, -1)[at]
    over = (end - starts > max_len) | ((end < 0) & (starts + max_len <= size))
    kept = (end >= 0) | over
    # An end that lies past what was read is over as well: it is not looked for.
    return starts[kept], np.where(end < 0, starts, end)[kept], over[kept]


def delimited(spark: SparkSession, path: str, delimiter: int = 10, max_len: int = 4096, permissive: bool = False, split: int = SPLIT) -> DataFrame:
    """As framing.delimited() over whole files, at every ``split``: a range starts after its first delimiter and reads on to the end of its last record.

    Records are counted by range first, and the counts added up along each file;
    then every range is framed with its first index. A record of more than
    ``max_len`` bytes is an error, or with ``permissive`` a null record.
    """
    if not 0 <= delimiter < 256 or max_len < 1:
        raise ConfigError("a delimiter is one byte, max_len 1 or more")

    def framed(r: dict) -> tuple:
        base = max(r["start"] - 1, 0)
        data = to_record_end(r["path"], base, r["stop"], r["size"], delimiter, max_len)
        return data, base, *delimited_range(data, base, r["start"], r["stop"], r["size"], delimiter, max_len)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                n = [len(framed(r)[2]) for r in b.to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64())], [*b.schema.names, "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in (r for b in batches for r in b.to_pylist()):
            data, base, starts, ends, over = framed(r)
            if over.any() and not permissive:
                raise DecodeError(f"decode: no delimiter within {max_len} bytes")
            yield from _batches(r["path"], r["first"], starts, ends, over, data, base)

    counted = lineage.cut(_dealt(ranges(spark, path, split)).mapInArrow(count, "path string, size long, nth long, start long, stop long, n long"), "ranges")
    before = W.partitionBy("path").orderBy("nth").rowsBetween(W.unboundedPreceding, -1)  # a row a range
    placed = counted.filter("n > 0").withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return _dealt(placed).mapInArrow(run, FRAMED)


# ---------------------------------------------------------------- length-prefixed

#: What a way through a block ends with, if not with a place in the next one: the file's last record; a length that is not allowed.
_END, _BAD = -1, -2


def ways(data: bytes, length: int, left: int, prefix: int, max_payload: int) -> tuple[np.ndarray, np.ndarray]:
    """(exits, counts) for each place that a block of ``length`` bytes may be entered at; ``left`` bytes of the file are left from its start.

    A length can be anything until it is known where records start. So the block
    is followed from every place that a record of the block before can end at:
    the exit is where the first record of the next block starts. Ways that meet
    go on as one, so every byte is a start once at most, however many ways there are.
    """
    places = prefix + max_payload
    exits, counts = np.full(places, _END, np.int32), np.zeros(places, np.int64)
    way, nth = array("i", bytes(4 * length)), array("i", bytes(4 * length))
    ended: list[tuple[int, int]] = [(0, 0)]  # exit and number of records of each way
    for entry in range(min(places, length)):
        at, steps = entry, 0
        while True:
            if at >= length:
                out = (_END if at == left else at - length, steps)
            elif way[at]:
                exit_, n = ended[way[at]]
                out = (exit_, steps + n - nth[at])
            else:
                way[at], nth[at] = len(ended), steps
                if at + prefix > left:
                    out = (_END, steps)
                elif (n := data[at] if prefix == 1 else int.from_bytes(data[at : at + prefix], "big")) > max_payload:
                    out = (_BAD, steps)
                elif at + prefix + n > left:
                    out = (_END, steps)
                else:
                    at += prefix + n
                    steps += 1
                    continue
            break
        ended.append(out)
        exits[entry], counts[entry] = out
    return exits, counts


def _joined(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The ways through blocks that follow each other, as through one."""
    exits = counts = None
    for e, c in zip(pdf["exits"], pdf["counts"], strict=True):
        e, c = np.frombuffer(e, np.int32), np.frombuffer(c, np.int64)
        if exits is None:
            exits, counts = e, c
        else:
            on = np.maximum(exits, 0)
            exits, counts = np.where(exits >= 0, e[on], exits), counts + np.where(exits >= 0, c[on], 0)
    return exits, counts


def _walked(pdf: pd.DataFrame, entry: int, first: int) -> pd.DataFrame:
    """Where each of some blocks in their order is entered, and the index of its first record."""
    entries, firsts = [], []
    for e, c in zip(pdf["exits"], pdf["counts"], strict=True):
        entries.append(entry)
        firsts.append(first)
        if entry >= 0:
            first += int(np.frombuffer(c, np.int64)[entry])
            entry = int(np.frombuffer(e, np.int32)[entry])
    return pd.DataFrame({"path": pdf["path"], "nth": pdf["nth"], "entry": entries, "first": firsts})


_WAYS = "path string, nth long, exits binary, counts binary"
_ENTERED = "path string, nth long, entry long, first long"


def entered(maps: DataFrame, fan: int) -> DataFrame:
    """(path, nth, entry, first) of every block, from the ways through the blocks.

    ``fan`` blocks that follow each other are joined to one, these again, until a
    file has ``fan`` at most; then entries are handed down the same levels. So
    no task follows more than ``fan`` blocks, however large a file is.
    """
    levels, most = [maps], maps.agg(F.max("nth")).first()[0] or 0
    group = F.floor(F.col("nth") / fan).alias("up")
    while most >= fan:

        def join(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("nth")
            exits, counts = _joined(pdf)
            return pd.DataFrame({"path": pdf["path"].iloc[:1], "nth": pdf["nth"].iloc[:1] // fan, "exits": [exits.astype(np.int32).tobytes()], "counts": [counts.astype(np.int64).tobytes()]})

        levels.append(lineage.cut(levels[-1].groupBy("path", group).applyInPandas(join, _WAYS), "ways"))
        most //= fan
    found = levels[-1].groupBy("path").applyInPandas(lambda pdf: _walked(pdf.sort_values("nth"), 0, 0), _ENTERED)
    for below in reversed(levels[:-1]):

        def hand_down(own: pd.DataFrame, up: pd.DataFrame) -> pd.DataFrame:
            return _walked(own.sort_values("nth"), int(up["entry"].iloc[0]), int(up["first"].iloc[0]))

        found = below.groupBy("path", group).cogroup(found.groupBy("path", F.col("nth").alias("up"))).applyInPandas(hand_down, _ENTERED)
    return found


def length_prefixed(spark: SparkSession, path: str, prefix: int = 1, max_payload: int = 4096, block: int = BLOCK, fan: int = 64) -> DataFrame:
    """As framing.length_prefixed() over whole files, but one file by many tasks.

    A record can only be found from the one before. So each block of a file first
    gives the way through it from any place that it may be entered at (see
    ways()); the ways of blocks are joined (see entered()), which tells where the
    first record of each block starts and which index it has; then all blocks
    are framed in parallel. A block has at least as many bytes as a record may
    have, and the way through it has an entry a byte of these: ``max_payload`` should be near what records have.
    A payload over ``max_payload`` bytes is an error where the file really has it.
    """
    if prefix not in (1, 2, 4):
        raise ConfigError("a prefix has 1, 2 or 4 bytes")
    if max_payload < 0:
        raise ConfigError("max_payload is 0 or more")
    max_payload = min(max_payload, (1 << 8 * prefix) - 1) if prefix < 4 else max_payload
    bad = prefix == 4 or max_payload < (1 << 8 * prefix) - 1
    block = max(block, prefix + max_payload)

    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in (r for b in batches for r in b.to_pylist()):
            length, left = r["stop"] - r["start"], r["size"] - r["start"]
            data = stretch(r["path"], r["start"], min(r["size"], r["stop"] + prefix - 1)).to_pybytes()
            exits, counts = ways(data, length, left, prefix, max_payload)
            yield pa.RecordBatch.from_pylist([{"path": r["path"], "nth": r["nth"], "exits": exits.tobytes(), "counts": counts.tobytes()}], schema=pa.schema([("path", pa.string()), ("nth", pa.int64()), ("exits", pa.binary()), ("counts", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in (r for b in batches for r in b.to_pylist()):
            base, left = r["start"] + r["entry"], r["size"] - r["start"] - r["entry"]
            data = stretch(r["path"], base, min(r["size"], r["stop"] + prefix + max_payload)).to_pybytes()
            at, length, starts = 0, r["stop"] - base, []
            while at < length and at + prefix <= left:
                n = data[at] if prefix == 1 else int.from_bytes(data[at : at + prefix], "big")
                if bad and n > max_payload:
                    raise DecodeError(f"payload of {n} bytes is over {max_payload}")
                if at + prefix + n > left:
                    break
                starts.append(at)
                at += prefix + n
            if starts:
                edges = np.array([*starts, at], np.int64) + base
                yield from _batches(r["path"], r["first"], edges[:-1], edges[1:], np.zeros(len(starts), bool), np.frombuffer(data, np.uint8), base)

    blocks = ranges(spark, path, block)
    maps = lineage.cut(_dealt(blocks).mapInArrow(through, _WAYS), "ways")
    known = entered(maps, fan).filter("entry >= 0")
    placed = lineage.cut(blocks.join(known, ["path", "nth"]), "entries")  # a row a block
    return _dealt(placed).mapInArrow(run, FRAMED)


READERS: dict[str, Callable[..., DataFrame]] = {"fixed": fixed, "delimiter": delimited, "length_prefixed": length_prefixed}
