"""Framing: byte blobs to records. Input rows are (path, content); output (path, record_index, file_offset, record).

Fixed framing is an expression, delimiters are found in a file's bytes at once. A
length prefix can only be followed from record to record, so it runs a file at a
time, files in parallel. An unfinished tail is dropped in all of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..envelope import ConfigError, DecodeError

FRAMED = "path string, record_index long, file_offset long, record binary"


def fixed(blobs: DataFrame, size: int) -> DataFrame:
    """Records of exactly ``size`` bytes."""
    if size < 1:
        raise ConfigError("record size must be 1 or more")
    n = F.floor(F.length("content") / size)
    index = blobs.select("path", "content", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1))).alias("record_index"))
    return index.select("path", F.col("record_index").cast("long").alias("record_index"), (F.col("record_index") * size).cast("long").alias("file_offset"), F.expr(f"substring(content, CAST(record_index * {size} + 1 AS INT), {size})").alias("record"))


def delimited(blobs: DataFrame, delimiter: int = 10, max_len: int = 4096, permissive: bool = False) -> DataFrame:
    """Records that end with the byte ``delimiter``, which they keep.

    A record of more than ``max_len`` bytes is an error; with ``permissive`` its
    row has a null record instead. Offsets are those of the delimiters in the
    file's bytes, so nothing is dealt out.
    """
    if not 0 <= delimiter < 256 or max_len < 1:
        raise ConfigError("a delimiter is one byte, max_len 1 or more")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, content in ((p, c) for b in batches for p, c in zip(b.column("path").to_pylist(), b.column("content"), strict=True)):
            if not content.is_valid:
                continue
            data = np.frombuffer(content.as_buffer(), np.uint8)
            ends = np.flatnonzero(data == delimiter) + 1  # what follows the last delimiter is the tail
            starts = np.concatenate([[0], ends[:-1]])[: len(ends)]
            over = ends - starts > max_len
            last = int(ends[-1]) if len(ends) else 0
            if len(data) - last >= max_len:  # a tail that is already longer than a record may be
                starts, ends, over = np.append(starts, last), np.append(ends, last), np.append(over, True)
            if over.any() and not permissive:
                raise DecodeError(f"decode: no delimiter within {max_len} bytes")
            for k in range(0, len(ends), 65_536):
                a, z = starts[k : k + 65_536], ends[k : k + 65_536]
                offsets = np.append(a, z[-1]) - a[0]
                records = pa.Array.from_buffers(pa.large_binary(), len(a), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[a[0] : z[-1]])])
                records = pc.if_else(pa.array(over[k : k + 65_536]), pa.scalar(None, pa.large_binary()), records).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(a), pa.string()), pa.array(np.arange(k, k + len(a))), pa.array(a), records], ["path", "record_index", "file_offset", "record"])

    return blobs.select("path", "content").mapInArrow(run, FRAMED)


Framer = Callable[[memoryview], int | None]


def custom(blobs: DataFrame, framer: Callable[[], Framer]) -> DataFrame:
    """Records by a framer: given the rest of a file it returns the next record's length, or None for too few bytes.

    ``framer`` makes a fresh one for each file, so it may keep state.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                next_len, view, at, rows = framer(), memoryview(content.as_buffer()) if content.is_valid else memoryview(b""), 0, []
                while at < len(view) and (n := next_len(view[at:])) is not None:
                    if n < 1:
                        raise DecodeError("a record of no bytes")
                    rows.append({"path": path, "record_index": len(rows), "file_offset": at, "record": bytes(view[at : at + n])})
                    at += n
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("path", pa.string()), ("record_index", pa.int64()), ("file_offset", pa.int64()), ("record", pa.binary())]))

    return blobs.select("path", "content").mapInArrow(run, FRAMED)


def length_prefixed(blobs: DataFrame, prefix: int = 1, max_payload: int = 4096) -> DataFrame:
    """Records after a big-endian length of 1, 2 or 4 bytes, which they keep; a longer payload than ``max_payload`` is an error."""
    if prefix not in (1, 2, 4):
        raise ConfigError("a prefix has 1, 2 or 4 bytes")

    def ends_of(data: bytes) -> list[int]:
        """Where the records of a file end, after 0."""
        at, ends = 0, [0]
        while at + prefix <= len(data):
            n = data[at] if prefix == 1 else int.from_bytes(data[at : at + prefix], "big")
            if n > max_payload:
                raise DecodeError(f"payload of {n} bytes is over {max_payload}")
            at += prefix + n
            if at > len(data):
                break
            ends.append(at)
        return ends

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Files are many and may be small: what is handed on are batches of records and not of files.
        held: list[tuple[str, list[int], bytes]] = []
        n = size = 0
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                data = content.as_py() if content.is_valid else b""
                ends = ends_of(data)
                if len(ends) > 1:
                    held.append((path, ends, data))
                    n, size = n + len(ends) - 1, size + len(data)
                if n >= 65_536 or size >= 16 << 20:
                    yield from _records(held)
                    held, n, size = [], 0, 0
        yield from _records(held)

    return blobs.select("path", "content").mapInArrow(run, FRAMED)


def _records(held: list[tuple[str, list[int], bytes]]) -> Iterator[pa.RecordBatch]:
    """Records of files, each a path, where its records end (after 0), and its bytes."""
    if not held:
        return
    counts = np.array([len(ends) - 1 for _, ends, _ in held])
    starts = np.concatenate([ends[:-1] for _, ends, _ in held]).astype(np.int64)
    lengths = np.concatenate([np.diff(ends) for _, ends, _ in held])
    index = np.arange(len(starts)) - np.repeat(np.cumsum(counts) - counts, counts)
    data = np.frombuffer(b"".join(memoryview(d)[: ends[-1]] for _, ends, d in held), np.uint8)
    edges = np.concatenate([[0], np.cumsum(lengths)])
    paths = pa.array([path for path, _, _ in held], pa.string()).take(pa.array(np.repeat(np.arange(len(held)), counts)))
    for k in range(0, len(starts), 65_536):
        at = edges[k : k + 65_537]
        record = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at - at[0]).astype(np.int32)), pa.py_buffer(data[at[0] : at[-1]])])
        cut = slice(k, k + len(at) - 1)
        yield pa.RecordBatch.from_arrays([paths[cut], pa.array(index[cut]), pa.array(starts[cut]), record], ["path", "record_index", "file_offset", "record"])


def looped(records: DataFrame, loops: int) -> DataFrame:
    """The records of each file ``loops`` times over, with loop_index; a file that frames nothing can't loop."""
    if loops < 1:
        raise ConfigError("loops must be 1 or more")
    return records.select("*", F.explode(F.sequence(F.lit(0), F.lit(loops - 1))).alias("loop_index"))
