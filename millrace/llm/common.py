"""Helpers shared by the operators: shared folder, lineage cuts, word splitting, Arrow batches."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut, new_path, shared_dir

__all__ = ["bounded", "claim", "cut", "frequent", "give_back", "map_arrow", "new_path", "shared_dir", "small", "tables"]

#: Deletes nothing but A-Z -> a-z: the case folding that the word operators use.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Java and RE2 spelling of the blanks between words.
BLANKS = r"[\x20\x09-\x0D]+"

#: Rows up to which a side of fixed-width rows (about 50 bytes each) is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 500_000


def small(df: DataFrame, rows: int | None = None, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, marked for broadcast if it has at most ``most`` rows (counted, unless ``rows`` tells)."""
    n = df.limit(most + 1).count() if rows is None else rows
    return F.broadcast(df) if n <= most else df


#: Bytes of an Arrow batch for Python, where the session has Spark's own bound; a batch of texts is ten times that else, in the JVM and in Python.
BATCH = 7 << 20
_BOUND, _UNSET = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def bounded(df: DataFrame) -> DataFrame:
    """``df``, whose session from here on makes Arrow batches of about BATCH bytes (a larger row alone); a bound that the user set stays."""
    conf = df.sparkSession.conf
    if conf.get(_BOUND, _UNSET) == _UNSET:
        conf.set(_BOUND, f"{BATCH}b")
    return df


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, most: int | None = None) -> DataFrame:
    """``f`` over each Arrow batch, or slices of it of about ``most`` bytes (a larger row alone); where it returns None there are no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, most) if most else (b,):
                if part.num_rows and (out := f(part)) is not None:
                    yield out
        give_back()

    return bounded(df).mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``most`` bytes, halved until they fit; what is made of a slice is then bounded as well."""
    if batch.num_rows > 1 and batch.nbytes > most:
        half = batch.num_rows // 2
        yield from slices(batch.slice(0, half), most)
        yield from slices(batch.slice(half), most)
    else:
        yield batch


def frequent(df: DataFrame, n: str, most: int) -> DataFrame:
    """The rows of ``df`` with the largest ``n``, ``most`` at most: all above a bound found from counts by size.

    The sizes are a few hundred (eighths of powers of two), so no task sorts or holds the candidates.
    """
    size = F.floor(F.log2(n) * 8)
    total, least = 0, None
    for r in sorted(df.groupBy(size.alias("size")).agg(F.count("*").alias("n")).collect(), reverse=True):
        if total + r.n > most:
            break
        total, least = total + r.n, r["size"]
    return df.filter(size >= least) if least is not None else df.limit(0)


_holder: list = [None, None]


def claim(name: str, forget: Callable[[], None]) -> None:
    """Called by a task whose operator remembers things in its worker process: what another operator remembered is forgotten.

    Workers outlive stages; so the memory of a run of several operators is that of the largest, not their sum.
    """
    if _holder[0] != name:
        if _holder[1] is not None:
            _holder[1]()
            gc.collect()
            give_back()
        _holder[:] = [name, forget]


def give_back() -> None:
    """Hand memory that is free to the system, where the C library can: else an idle worker keeps it beside the JVM's own stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partition_id() -> int:
    from pyspark import TaskContext

    context = TaskContext.get()
    return context.partitionId() if context else 0


class RowIds:
    """Unique 64-bit ids of the rows that a task reads: the partition above, a running number below."""

    def __init__(self) -> None:
        self.next = partition_id() << 33

    def take(self, n: int) -> range:
        first, self.next = self.next, self.next + n
        return range(first, first + n)
