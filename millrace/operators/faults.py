"""Fault injection: seeded drops, corrupted bytes and latency spikes.

Drops alone use one draw a row, so every row finds its own draw by its number.
Mixed faults draw as many numbers as the faults before them happened to need;
they are folded in order, a batch of a source at a time, sources in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..envelope import ConfigError
from ..functions import rng


@dataclass(frozen=True)
class Faults:
    drop_rate: float = 0.0
    corrupt_rate: float = 0.0
    spike_rate: float = 0.0
    spike_ns: int = 0
    seed: int = 0

    def __post_init__(self) -> None:
        if not all(0 <= r <= 1 for r in (self.drop_rate, self.corrupt_rate, self.spike_rate)):
            raise ConfigError("fault rates lie between 0 and 1")

    @property
    def clean(self) -> bool:
        return not (self.drop_rate or self.corrupt_rate or self.spike_rate)


def drops(rows: DataFrame, faults: Faults, sequence: str = "sequence") -> DataFrame:
    """``rows`` with ``dropped``: draw number ``sequence`` (1 first) lies under the rate."""
    if not faults.drop_rate:
        return rows.withColumn("dropped", F.lit(False))
    return rows.withColumn("dropped", rng.uniform(faults.seed, F.col(sequence)) < faults.drop_rate)


def mixed(rows: DataFrame, faults: Faults, source: str = "source", sequence: str = "sequence", payload: str = "payload") -> DataFrame:
    """``rows`` with dropped, corrupted, spike_ns, and the payload with one byte inverted where corrupted.

    Per row, in order: a draw for the drop; for what stays a draw for corruption
    and, if it comes true, one for the byte; then a draw for the spike. A rate of
    0 draws nothing, a dropped row nothing more.

    Sources are sorted by Spark and read batch by batch; from a batch to the next
    only the source and the number of its draws so far are kept.
    """
    fields = [*rows.schema.fields, T.StructField("dropped", T.BooleanType()), T.StructField("corrupted", T.BooleanType()), T.StructField("spike_ns", T.LongType())]

    def fold(at: int, data: list[bytes | None], dropped: np.ndarray, corrupted: np.ndarray, spike: np.ndarray) -> int:
        """Fill in the rows of one source that follow draw ``at``; the number of the last draw taken."""
        state = rng.states(faults.seed, np.arange(at + 1, at + 4 * len(data) + 1))  # four draws a row at most
        u, first, at = rng.uniforms(state), at, 0
        for i in range(len(data)):
            if faults.drop_rate:
                at += 1
                if u[at - 1] < faults.drop_rate:
                    dropped[i] = True
                    continue
            if faults.corrupt_rate:
                at += 1
                if u[at - 1] < faults.corrupt_rate and data[i] is not None and len(data[i]):
                    at += 1
                    place = int(state[at - 1] % np.uint64(len(data[i])))
                    data[i] = data[i][:place] + bytes([data[i][place] ^ 0xFF]) + data[i][place + 1 :]
                    corrupted[i] = True
            if faults.spike_rate:
                at += 1
                if u[at - 1] < faults.spike_rate:
                    spike[i] = faults.spike_ns
        return first + at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at = object(), 0
        for batch in batches:
            n = batch.num_rows
            sources, data = batch.column(source).to_pylist(), batch.column(payload).to_pylist()
            dropped, corrupted, spike = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, np.int64)
            same = lambda a, b: a == b or (a != a and b != b)
            cuts = [i for i in range(1, n) if not same(sources[i - 1], sources[i])]
            for a, b in zip([0, *cuts], [*cuts, n], strict=True):
                if a == b:
                    continue
                if not same(last, sources[a]):
                    last, at = sources[a], 0
                part = data[a:b]
                at = fold(at, part, dropped[a:b], corrupted[a:b], spike[a:b])
                data[a:b] = part
            columns = [pa.array(data, c.type) if name == payload else c for name, c in zip(batch.schema.names, batch.columns, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(dropped), pa.array(corrupted), pa.array(spike)], [f.name for f in fields])

    ordered = rows.repartition(source).sortWithinPartitions(F.col(source), F.col(sequence).asc_nulls_last())
    return ordered.mapInArrow(run, T.StructType(fields))
