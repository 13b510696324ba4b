"""Growing files as a stream: appended bytes become records, a record that is not yet whole waits for its rest.

An offset is a byte position for each file. A record belongs to the batch in
which its last byte lies, wherever it began: so the unfinished tail needs no
state, and a batch that is run again after a restart gives the same records.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..envelope import ConfigError, DecodeError
from .ranges import SPLIT, store_of

SCHEMA = "path string, file_offset long, record binary"


def load(path: str) -> dict:
    """A small JSON file of a shared folder; empty where there is none."""
    from pyarrow import fs

    store, at = store_of(path)
    if store.get_file_info(at).type != fs.FileType.File:
        return {}
    with store.open_input_stream(at) as f:
        return json.loads(f.read())


def save(path: str, value: dict) -> None:
    """Written under another name and moved, so a reader sees the old one or the new one."""
    store, at = store_of(path)
    store.create_dir(at.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(f"{at}.tmp") as f:
        f.write(json.dumps(value).encode())
    store.move(f"{at}.tmp", at)


def listed(path: str) -> dict[str, int]:
    """Sizes of a file, or of the files of a folder; names that begin with a dot or an underscore are not read."""
    from pyarrow import fs

    store, at = store_of(path)
    info = store.get_file_info(at)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(at, allow_not_found=True)) if info.type == fs.FileType.Directory else []
    prefix = path[: len(path) - len(at)] if path.endswith(at) else ""
    return {prefix + f.path: f.size for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and f.base_name[:1] not in "._"}


@dataclass(frozen=True)
class Stretch(InputPartition):
    """Records that end in (start, stop] of a file."""

    path: str
    start: int
    stop: int


class Frames:
    """Records of files by a delimiter or of a fixed size, found in a stretch of a file alone."""

    def __init__(self, options: dict) -> None:
        self.path, self.frame = options.get("path"), options.get("frame", "delimiter")
        if not self.path or self.frame not in ("delimiter", "fixed"):
            raise ConfigError("a growing file needs a path, and a delimiter or a fixed size")
        self.delimiter, self.max_len, self.size = (int(options.get(k, d)) for k, d in (("delimiter", 10), ("max_len", 4096), ("size", 0)))
        if self.frame == "fixed" and self.size < 1 or self.max_len < 1 or not 0 <= self.delimiter < 256:
            raise ConfigError("a size has 1 byte or more, a delimiter is one byte")
        self.split = max(int(options.get("split", SPLIT)), 1)

    def stretches(self, path: str, start: int, stop: int) -> list[Stretch]:
        if self.frame == "fixed":
            step = -(-self.split // self.size) * self.size
            start, stop = start // self.size * self.size, stop // self.size * self.size
        else:
            step = self.split
        return [Stretch(path, a, min(a + step, stop)) for a in range(start, stop, step)]

    def after(self, path: str, start: int, size: int, records: int) -> tuple[int, int]:
        """(position after so many more records, how many of them there are): what is read for it is bounded by the number asked for."""
        if self.frame == "fixed":
            n = min(records, (size - start) // self.size)
            return start + n * self.size, n
        store, at = store_of(path)
        found = 0
        with store.open_input_file(at) as f:
            f.seek(start)
            while found < records and start < size:
                data = np.frombuffer(f.read(min(1 << 16, size - start)), np.uint8)
                if not len(data):
                    break
                ends = np.flatnonzero(data == self.delimiter) + 1
                if found + len(ends) >= records:
                    return start + int(ends[records - found - 1]), records
                found, start = found + len(ends), start + len(data)
        return start, found

    def read(self, part: Stretch) -> Iterator[pa.RecordBatch]:
        store, at = store_of(part.path)
        back = part.start if self.frame == "fixed" else max(0, part.start - self.max_len)
        with store.open_input_file(at) as f:
            f.seek(back)
            data = np.frombuffer(f.read(part.stop - back), np.uint8)
        if self.frame == "fixed":
            starts = np.arange(0, len(data) // self.size * self.size, self.size)
            ends = starts + self.size
        else:
            all_ends = np.flatnonzero(data == self.delimiter) + 1
            ends = all_ends[all_ends + back > part.start]
            before = np.concatenate([[0], all_ends])[np.searchsorted(all_ends, ends, "left")] if len(ends) else ends
            starts = before
            last = int(all_ends[-1]) if len(all_ends) else 0
            if (ends - starts > self.max_len).any() or len(data) - last >= self.max_len:
                raise DecodeError(f"decode: no delimiter within {self.max_len} bytes")
        for k in range(0, len(starts), 65_536):
            a, z = starts[k : k + 65_536], ends[k : k + 65_536]
            offsets = (np.append(a, z[-1]) - a[0]).astype(np.int32)
            records = pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[a[0] : z[-1]]))])
            yield pa.RecordBatch.from_arrays([pa.array([part.path] * len(a), pa.string()), pa.array(a + back), records], ["path", "file_offset", "record"])


class Batch(DataSourceReader):
    """What is there now, by stretches."""

    def __init__(self, options: dict) -> None:
        self.frames = Frames(options)

    def partitions(self) -> list[Stretch]:
        return [s for path, size in listed(self.frames.path).items() for s in self.frames.stretches(path, 0, size)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        return self.frames.read(partition)


class Follower(DataSourceStreamReader):
    """Options ``max_records`` (of a batch) and ``credit`` (a file in which a sink says how many it can take) admit no more than that.

    With either, ``ledger`` names a folder in which the reader keeps how far
    batches were planned: after a restart, admission goes on from there.
    """

    def __init__(self, options: dict) -> None:
        self.frames = Frames(options)
        self.most = int(options["max_records"]) if "max_records" in options else None
        self.credit, self.ledger = options.get("credit"), options.get("ledger")
        if (self.most is not None or self.credit) and not self.ledger:
            raise ConfigError("admission needs a ledger")
        if self.most is not None and self.most < 1:
            raise ConfigError("max_records is 1 or more")
        self.planned = load(f"{self.ledger}/planned.json") if self.ledger else {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        left = self.most
        if self.credit:
            free = load(self.credit).get("free")
            left = left if free is None else free if left is None else min(left, free)
        out = dict(self.planned)
        for path, size in listed(self.frames.path).items():
            at = out.get(path, 0)
            if left is None:
                out[path] = max(at, size)
            elif left > 0 and size > at:
                out[path], n = self.frames.after(path, at, size, left)
                left -= n
        return out

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        # Planned before it is read: a batch whose plan is known is run again as it was.
        if self.ledger and end != self.planned:
            save(f"{self.ledger}/planned.json", end)
        self.planned = end
        return [s for path, stop in sorted(end.items()) if stop > start.get(path, 0) for s in self.frames.stretches(path, start.get(path, 0), stop)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        return self.frames.read(partition)


class FollowedFiles(DataSource):
    """Format ``followed_files``: options path, frame (delimiter, fixed), delimiter, max_len, size, split and those of Follower."""

    @classmethod
    def name(cls) -> str:
        return "followed_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Batch:
        return Batch(self.options)

    def streamReader(self, schema: StructType) -> Follower:
        return Follower(self.options)


def follow(spark: SparkSession, path: str, **options) -> DataFrame:
    """(path, file_offset, record) of a growing file, or of the growing files of a folder, as a stream."""
    spark.dataSource.register(FollowedFiles)
    return spark.readStream.format("followed_files").options(path=path, **options).load()
