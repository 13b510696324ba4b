"""Framed files."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..envelope import ConfigError
from ..operators import framing
from . import ranges


def blobs(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read(spark: SparkSession, path: str, frame: str = "delimiter", eof: str = "stop", loops: int = 1, whole: bool = False, **options) -> DataFrame:
    """Records of files: ``frame`` is fixed, delimiter, length_prefixed or custom.

    Files are read by byte ranges (see sources.ranges), so one of any size is
    shared by many tasks; with ``whole``, and by custom framers, which only know
    their way from a file's start, a file is one value of one task.

    eof ``stop`` reads once; ``loop`` goes over the records ``loops`` times;
    following a growing folder is in millrace.streaming.
    """
    frames = {"fixed": framing.fixed, "delimiter": framing.delimited, "length_prefixed": framing.length_prefixed, "custom": framing.custom}
    if frame not in frames or eof not in ("stop", "loop"):
        raise ConfigError(f"unknown frame {frame!r} or end-of-file rule {eof!r}")
    if whole or frame not in ranges.READERS:
        records = frames[frame](blobs(spark, path), **options)
    else:
        records = ranges.READERS[frame](spark, path, **options)
    return framing.looped(records, loops) if eof == "loop" else records


def file_sink(files: DataFrame, folder: str) -> int:
    """Write (path, content) rows as files below ``folder``; returns how many there are.

    A file is written under another name and then moved to its own, so a task that
    is run again leaves the same files.
    """
    uri = folder if "://" in folder or folder.startswith("/") else folder.replace("file:", "file://", 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(uri)
        store.create_dir(base, recursive=True)
        n = 0
        for path, content in ((p, c) for b in batches for p, c in zip(b.column("path").to_pylist(), b.column("content"), strict=True)):
            part = f"{base}/.{uuid.uuid4().hex}"
            with store.open_output_stream(part) as f:
                f.write(content.as_buffer() if content.is_valid else b"")
            store.move(part, f"{base}/{path}")
            n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return files.select("path", "content").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def ordered_files(rows: DataFrame, by: str, order: str, data: str, folder: str) -> str:
    """``data`` of the rows of each value of ``by``, in the order of a column, as the bytes of one file of that name; returns the folder.

    A task writes its files one after the other, a row at a time, under other
    names, and moves each to its own when it is whole: a file may be of any size,
    and a task that is run again leaves the same files. Null data has no bytes.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = rows.select(F.col(by).cast("string").alias("name"), F.col(order).alias("o"), F.col(data).alias("data")).repartition(n, "name").sortWithinPartitions("name", "o")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = ranges.store_of(folder)
        store.create_dir(base, recursive=True)
        name, part, out, done = None, "", None, 0
        for b in batches:
            for now, d in zip(b.column("name").to_pylist(), b.column("data"), strict=True):
                if out is None or now != name:
                    if out is not None:
                        out.close()
                        store.move(part, f"{base}/{name}")
                    name, part, done = now, f"{base}/.{uuid.uuid4().hex}", done + 1
                    out = store.open_output_stream(part)
                if d.is_valid:
                    out.write(d.as_buffer())
        if out is not None:
            out.close()
            store.move(part, f"{base}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], ["n"])

    sorted_.mapInArrow(run, "n long").agg(F.sum("n")).first()
    return folder
