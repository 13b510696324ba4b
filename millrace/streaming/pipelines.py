"""Streams: the stages of the batch operators over micro-batches, and a stateful bounded queue."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..operators import routing


def follow(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1000, format: str = "parquet") -> DataFrame:
    """New files of a landing folder as a stream; admission by files a trigger is its back-pressure."""
    return spark.readStream.format(format).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(path)


def write_routed(routed: DataFrame, sinks: dict[int, Callable[[DataFrame, int], None]], checkpoint: str) -> StreamingQuery:
    """Each micro-batch once, then a filtered write per sink; sink_id 0 goes nowhere. Runs what is there and ends."""

    def each(df: DataFrame, epoch: int) -> None:
        df.persist()
        try:
            for sink_id, part in routing.split(df, list(sinks)).items():
                sinks[sink_id](part, epoch)
        finally:
            df.unpersist()

    return routed.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(rows: DataFrame, ts: str, window: str, late: str, by: list[str]) -> DataFrame:
    """Counts by event-time window and key; rows later than ``late`` are dropped. A zoneless stamp is taken as UTC's."""
    stamped = rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return stamped.groupBy(F.window(ts, window), *by).agg(F.count("*").alias("n"))


QUEUE_STATE = "occupancy long, tick long"
QUEUE_OUT = "run string, tick long, arrivals long, written long, overflow long, consumed long, occupancy long"


def bounded_queue(ticks: DataFrame, capacity: int, drain: int) -> DataFrame:
    """The bounded queue of (run, tick, arrivals) rows, occupancy kept as state by run. Ticks of a run come in order, a row each."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        occupancy, last = state.get if state.exists else (0, -1)
        rows = []
        for part in sorted((r for p in parts for r in zip(p["tick"], p["arrivals"], strict=True))):
            tick, arrivals = int(part[0]), int(part[1])
            written = min(arrivals, capacity - occupancy)
            consumed = min(occupancy + written, drain)
            occupancy += written - consumed
            rows.append((key[0], tick, arrivals, written, arrivals - written, consumed, occupancy))
            last = tick
        state.update((occupancy, last))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in QUEUE_OUT.split(", ")])

    return ticks.groupBy("run").applyInPandasWithState(step, QUEUE_OUT, QUEUE_STATE, "append", GroupStateTimeout.NoTimeout)
