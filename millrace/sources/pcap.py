"""Classic packet captures: four magics, micro- or nanoseconds, either byte order."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..envelope import ConfigError, DecodeError
from .files import file_sink
from .ranges import store_of

#: Fixed values of the format: magic as read little-endian -> (byte order, ns per unit of the fraction).
MAGICS = {0xA1B2C3D4: ("<", 1000), 0xD4C3B2A1: (">", 1000), 0xA1B23C4D: ("<", 1), 0x4D3CB2A1: (">", 1)}
_PACKETS = pa.schema([("path", pa.string()), ("pkt_index", pa.int64()), ("ts_ns", pa.int64()), ("data", pa.binary())])


def packets_of(data: memoryview) -> Iterator[tuple[int, bytes]]:
    """(ts_ns, bytes) of each packet. Fewer than 16 bytes at the end are ignored, a packet cut short is an error."""
    if len(data) < 24:
        raise DecodeError("no pcap header")
    (magic,) = struct.unpack_from("<I", data)
    if magic not in MAGICS:
        raise DecodeError(f"not a classic pcap: magic {magic:#x}")
    order, unit = MAGICS[magic]
    at = 24
    while len(data) - at >= 16:
        seconds, fraction, n, _ = struct.unpack_from(f"{order}IIII", data, at)
        at += 16
        if at + n > len(data):
            raise DecodeError(f"packet of {n} bytes is cut short")
        yield seconds * 1_000_000_000 + fraction * unit, bytes(data[at : at + n])
        at += n


def parse(blobs: DataFrame) -> DataFrame:
    """(path, pkt_index, ts_ns, data) from (path, content); files in parallel, packets of one in batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows, done = [], 0
                for ts, data in packets_of(memoryview(content.as_buffer())):
                    rows.append({"path": path, "pkt_index": done + len(rows), "ts_ns": ts, "data": data})
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_pylist(rows, schema=_PACKETS)
                        done, rows = done + len(rows), []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_PACKETS)

    return blobs.select("path", "content").mapInArrow(run, "path string, pkt_index long, ts_ns long, data binary")


def read(spark: SparkSession, path: str) -> DataFrame:
    return parse(spark.read.format("binaryFile").load(path))


def blobs(packets: DataFrame, by: str = "path", nanoseconds: bool = False) -> DataFrame:
    """(path, content): each group's packets as one capture file, in order of time and index.

    The record bytes are expressions; a group becomes one file, so groups
    should be of a file's size.
    """
    unit = 1 if nanoseconds else 1000
    le = lambda x: F.unhex(F.concat(*[F.substring(F.lpad(F.hex(x.cast("long")), 8, "0"), 7 - 2 * i, 2) for i in range(4)]))
    second = F.lit(1_000_000_000)
    n = F.length("data")
    record = F.concat(le((F.col("ts_ns") - F.pmod("ts_ns", second)) / second), le(F.floor(F.pmod("ts_ns", second) / unit)), le(n), le(n), F.col("data"))
    head = struct.pack("<IHHiIII", 0xA1B23C4D if nanoseconds else 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    ordered = F.array_sort(F.collect_list(F.struct("ts_ns", "pkt_index", record.alias("r"))))
    joined = F.concat(F.lit(head), F.unhex(F.array_join(F.transform(ordered, lambda x: F.hex(x["r"])), "")))
    return packets.groupBy(by).agg(joined.alias("content"))


def write(files: DataFrame, folder: str, name: str = "path") -> int:
    """(path, content) rows as files of a folder on any file system that Arrow knows; returns how many there are.

    A task writes under a name of its own and renames when done, so a repeated
    task does no harm.
    """
    return file_sink(files.select(F.col(name).cast("string").alias("path"), "content"), folder)


# ---------------------------------------------------------------- a data source with a commit

#: Bytes from which on a capture is closed and the next one begun.
ROLL = 128 << 20


@dataclass(frozen=True)
class Written(WriterCommitMessage):
    """Files of one task: names while they are staged, and the names that they get."""

    files: tuple[tuple[str, str], ...]


class CaptureWriter(DataSourceArrowWriter):
    """Captures of rows (path, ts_ns, data) that come in order: a capture is closed where the path changes or ``roll`` bytes are reached.

    Tasks write below a staging folder of this job. commit() moves the files of
    the tasks that counted to their names, and says so by a ``_SUCCESS`` file;
    abort() leaves nothing. A capture's name is its path, the task's number and a
    running number, so captures of a path follow each other by name. What a task
    holds is one batch of rows.
    """

    def __init__(self, options: dict, overwrite: bool) -> None:
        if "path" not in options:
            raise ConfigError("captures need a path")
        self.folder, self.overwrite = options["path"].rstrip("/"), overwrite
        self.nanoseconds, self.roll = options.get("nanoseconds", "false").lower() == "true", int(options.get("roll", ROLL))
        if self.roll < 1:
            raise ConfigError("a capture has 1 byte or more")
        self.staging = f"{self.folder}/_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        store, base = store_of(self.staging)
        store.create_dir(base, recursive=True)
        context = TaskContext.get()
        task, attempt = (context.partitionId() if context else 0), uuid.uuid4().hex
        unit = 1 if self.nanoseconds else 1000
        head = struct.pack("<IHHiIII", 0xA1B23C4D if self.nanoseconds else 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
        files, out, size, now, nth = [], None, 0, None, 0
        try:
            for batch in iterator:
                paths, stamps, data = (batch.column(c) for c in ("path", "ts_ns", "data"))
                for path, ts, d in zip(paths.to_pylist(), stamps.to_pylist(), data, strict=True):
                    if ts is None or not d.is_valid or path is None:
                        raise DecodeError("a packet needs a path, a time and data")
                    body = d.as_buffer()
                    if out is None or path != now or size + 16 + body.size > self.roll:
                        if out is not None:
                            out.close()
                        nth, now = (nth + 1 if path == now else 0), path
                        staged = f"{base}/{attempt}-{len(files):06d}"
                        files.append((staged, f"{path}/{task:06d}-{nth:06d}.pcap"))
                        out, size = store.open_output_stream(staged), len(head)
                        out.write(head)
                    seconds, rest = divmod(ts, 1_000_000_000)
                    out.write(struct.pack("<IIII", seconds, rest // unit, body.size, body.size))
                    out.write(body)
                    size += 16 + body.size
        finally:
            if out is not None:
                out.close()
        return Written(tuple(files))

    def commit(self, messages: list[Written | None]) -> None:
        store, base = store_of(self.folder)
        if self.overwrite:
            self._clear(store, base)
        folders = set()
        for staged, name in (f for m in messages if m is not None for f in m.files):
            into = f"{base}/{name}".rsplit("/", 1)[0]
            if into not in folders:
                store.create_dir(into, recursive=True)
                folders.add(into)
            store.move(staged, f"{base}/{name}" if self.overwrite else _free(store, f"{base}/{name}"))
        self.abort(messages)  # what tasks that did not count have left
        store.create_dir(base, recursive=True)
        with store.open_output_stream(f"{base}/_SUCCESS"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        store, base = store_of(self.staging)
        if store.get_file_info(base).type == fs.FileType.Directory:
            store.delete_dir(base)

    @staticmethod
    def _clear(store, base: str) -> None:
        """Captures that stood there before; other files stay."""
        from pyarrow import fs

        for f in store.get_file_info(fs.FileSelector(base, allow_not_found=True, recursive=True)):
            if f.type == fs.FileType.File and f.path.endswith(".pcap") and "/_staging-" not in f.path:
                store.delete_file(f.path)


def _free(store, name: str) -> str:
    """The name, or with a number that no file has yet: rows that are appended do not replace captures."""
    from pyarrow import fs

    stem, n = name.removesuffix(".pcap"), 0
    while store.get_file_info(name).type != fs.FileType.NotFound:
        n += 1
        name = f"{stem}+{n:06d}.pcap"
    return name


class CaptureReader(DataSourceReader):
    """All captures below a path, a partition each: as many tasks as there are captures."""

    def __init__(self, options: dict) -> None:
        if "path" not in options:
            raise ConfigError("captures need a path")
        self.folder = options["path"].rstrip("/")

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, base = store_of(self.folder)
        found = store.get_file_info(fs.FileSelector(base, allow_not_found=True, recursive=True))
        return [InputPartition(f.path) for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and f.path.endswith(".pcap") and "/_staging-" not in f.path]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a folder without captures
            return
        store, base = store_of(self.folder)
        with store.open_input_file(partition.value) as f:
            content = f.read_buffer()
        rows, done, name = [], 0, partition.value.removeprefix(base + "/")
        for ts, data in packets_of(memoryview(content)):
            rows.append({"path": name, "pkt_index": done + len(rows), "ts_ns": ts, "data": data})
            if len(rows) == 10_000:
                yield pa.RecordBatch.from_pylist(rows, schema=_PACKETS)
                done, rows = done + len(rows), []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_PACKETS)


class Captures(DataSource):
    """Format ``captures``: options path, and for writing nanoseconds and roll."""

    @classmethod
    def name(cls) -> str:
        return "captures"

    def schema(self) -> str:
        return "path string, pkt_index long, ts_ns long, data binary"

    def reader(self, schema: StructType) -> CaptureReader:
        return CaptureReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> CaptureWriter:
        return CaptureWriter(self.options, overwrite)


def save(packets: DataFrame, folder: str, by: str = "path", nanoseconds: bool = False, roll: int = ROLL, mode: str = "append") -> None:
    """Packets (``by``, ts_ns, pkt_index, data) as captures below ``folder``, several of one group where it has many.

    Rows are ranged by group, time and index, so tasks take even shares, however
    many packets one group has, and a group's captures follow each other by name.
    """
    packets.sparkSession.dataSource.register(Captures)
    n = int(packets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["path", "ts_ns", "pkt_index"]
    rows = packets.select(F.col(by).cast("string").alias("path"), F.col("pkt_index").cast("long").alias("pkt_index"), F.col("ts_ns").cast("long").alias("ts_ns"), "data")
    rows.repartitionByRange(n, *order).sortWithinPartitions(*order).write.format("captures").mode(mode).options(path=folder, nanoseconds=str(nanoseconds), roll=str(roll)).save()


def load(spark: SparkSession, folder: str) -> DataFrame:
    """(path, pkt_index, ts_ns, data) of the captures that save() wrote, each group's as one: indices go on from capture to capture."""
    spark.dataSource.register(Captures)
    rows = spark.read.format("captures").load(folder).withColumn("file", F.col("path")).withColumn("path", F.regexp_extract("path", "^(.*)/[^/]*$", 1))
    sizes = rows.groupBy("path", "file").agg(F.count("*").alias("n"))  # a row a capture
    before = W.partitionBy("path").orderBy("file").rowsBetween(W.unboundedPreceding, -1)
    bases = sizes.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.join(bases, "file").select("path", (F.col("pkt_index") + F.col("base")).alias("pkt_index"), "ts_ns", "data")
