"""Counters, ratios and histories over event and traffic tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..envelope import ConfigError
from . import batches, routing

#: Names and kinds of the metrics that sources and sinks report.
NET = {
    "net.packets_received": "counter",
    "net.packets_dropped": "counter",
    "net.bytes_received": "counter",
    "net.batches_polled": "counter",
    "net.batch_size": "histogram",
    "net.rx_ring_occupancy": "gauge",
    "net.parse_failures": "counter",
    "net.sink_write_failures": "counter",
}
STORAGE = {
    "storage.bytes_read": "counter",
    "storage.records_read": "counter",
    "storage.parse_errors": "counter",
    "storage.eof_reached": "counter",
    "storage.loop_count": "counter",
    "storage.replay_lag_ns": "gauge",
    "storage.read_latency_ns": "histogram",
}
RUNTIME = {
    "runtime.steps": "counter",
    "runtime.messages_out": "counter",
    "runtime.messages_dropped": "counter",
    "runtime.backpressure_events": "counter",
    "runtime.idle_skips": "counter",
    "runtime.step_duration_ns": "histogram",
    "runtime.phase": "gauge",
    "runtime.workers": "gauge",
}
MEMORY = {
    "memory.messages_written": "counter",
    "memory.ring_full": "counter",
    "memory.oversized": "counter",
}


def report(rows: DataFrame, kinds: dict[str, str], values: dict[str, Column]) -> DataFrame:
    """(metric, kind, value): aggregates of ``rows`` under the names of a set; a name without a value is not reported."""
    if unknown := set(values) - set(kinds):
        raise ConfigError(f"no metrics of this set: {', '.join(sorted(unknown))}")
    one = F.array(*[F.struct(F.lit(name).alias("metric"), F.lit(kinds[name]).alias("kind"), F.coalesce(v, F.lit(0)).cast("double").alias("value")) for name, v in values.items()])
    return rows.agg(one.alias("all")).select(F.inline("all"))


def net(packets: DataFrame, batch_size: int, failed: Column, refused: Column, data: str = "data", order: str = "sequence") -> DataFrame:
    """What a packet source reports of packets polled in batches in their order: ``failed`` to parse, ``refused`` by a full sink.

    Batches are added up first, so the whole is one row a batch. A histogram's value is its median; the ring's
    occupancy, a gauge, is that of the last batch.
    """
    batched = routing.numbered(packets, order, name="__place").groupBy(F.floor(F.col("__place") / batch_size).alias("__batch"))
    by_batch = batched.agg(F.count("*").alias("n"), F.sum(F.octet_length(data)).alias("bytes"), F.count(F.when(failed, 1)).alias("failed"), F.count(F.when(refused, 1)).alias("refused"))
    values = {
        "net.packets_received": F.sum("n"),
        "net.packets_dropped": F.sum("refused"),
        "net.bytes_received": F.sum("bytes"),
        "net.batches_polled": F.count("*"),
        "net.batch_size": F.median("n"),
        "net.rx_ring_occupancy": F.max_by("n", "__batch") / batch_size,
        "net.parse_failures": F.sum("failed"),
        "net.sink_write_failures": F.sum("refused"),
    }
    return report(by_batch, NET, values)


def storage(blobs: DataFrame, records: DataFrame, loops: int = 1) -> DataFrame:
    """What a file source reports: ``blobs`` (content) read and framed to ``records``, where a null record is a parse error."""
    read = blobs.agg(F.sum(F.length("content")).alias("bytes"), F.count("content").alias("files"))
    framed = records.agg(F.count("record").alias("records"), F.count(F.when(F.col("record").isNull(), 1)).alias("errors"))
    one = report(read, STORAGE, {"storage.bytes_read": F.sum("bytes") * loops, "storage.eof_reached": F.sum("files") * loops, "storage.loop_count": F.lit(loops - 1)})
    return one.unionByName(report(framed, STORAGE, {"storage.records_read": F.sum("records") * loops, "storage.parse_errors": F.sum("errors") * loops}))


def memory(rows: DataFrame, slots: int, max_bytes: int, payload: str = "payload", batch: str = "tick", order: str = "sequence") -> DataFrame:
    """What a ring of ``slots`` slots reports that is emptied after each batch: too large payloads are refused first, then what finds it full."""
    large = F.octet_length(payload) > max_bytes
    offered = rows.withColumn("__large", F.coalesce(large, F.lit(False)))
    taken = batches.capped(offered.filter("NOT __large"), slots, batch, order)
    counted = taken.agg(F.count(F.when(F.col("accepted"), 1)).alias("written"), F.count(F.when(~F.col("accepted"), 1)).alias("full"))
    one = report(counted, MEMORY, {"memory.messages_written": F.sum("written"), "memory.ring_full": F.sum("full")})
    return one.unionByName(report(offered, MEMORY, {"memory.oversized": F.count(F.when(F.col("__large"), 1))}))


def runtime(routed: DataFrame, batch_size: int, refused: Column, workers: int = 1, order: str = "sequence") -> DataFrame:
    """What a run reports that takes rows (sink_id 0: dropped) in batches in their order, a step a batch; ``refused``: a full sink was met.

    Durations and phases are those of a running query, see streaming.telemetry.
    """
    batched = routing.numbered(routed, order, name="__place").groupBy(F.floor(F.col("__place") / batch_size).alias("__batch"))
    by_batch = batched.agg(F.count(F.when(F.col("sink_id") != routing.DROP, 1)).alias("out"), F.count(F.when(F.col("sink_id") == routing.DROP, 1)).alias("dropped"), F.count(F.when(refused, 1)).alias("refused"))
    values = {
        "runtime.steps": F.count("*"),
        "runtime.messages_out": F.sum("out"),
        "runtime.messages_dropped": F.sum("dropped"),
        "runtime.backpressure_events": F.sum("refused"),
        "runtime.workers": F.lit(workers),
    }
    return report(by_batch, RUNTIME, values)


def storage_replay(released: DataFrame, clock_ns: int) -> DataFrame:
    """The lag of a replay that stands at ``clock_ns``: behind the latest row that it has let go (release_ns)."""
    return report(released.filter(F.col("release_ns") <= clock_ns), STORAGE, {"storage.replay_lag_ns": clock_ns - F.max("release_ns")})


def counters(events: DataFrame, kind: str = "kind", weight: Column | None = None) -> DataFrame:
    """(metric, kind, value): how often each kind came, or the sum of ``weight``."""
    value = F.count("*") if weight is None else F.sum(weight)
    return events.groupBy(F.col(kind).alias("metric")).agg(value.cast("double").alias("value")).select("metric", F.lit("counter").alias("kind"), "value")


def ratio(part: Column, whole: Column) -> Column:
    """A ratio that is 0 where the whole is."""
    return F.when(whole != 0, part / whole).otherwise(F.lit(0.0))


def per_tick(rows: DataFrame, ts: str, tick_ns: int) -> DataFrame:
    """(tick, n): rows of each tumbling tick."""
    return rows.groupBy(F.floor(F.col(ts) / tick_ns).alias("tick")).agg(F.count("*").alias("n"))


def history(cumulative: DataFrame, tick: str = "tick", total: str = "total", by: str | None = None, per_range: int = routing.PER_RANGE) -> DataFrame:
    """The growth of a running total from tick to tick, within ranges of ticks; a range starts from the last total of the one before."""
    own = routing.ranged(cumulative, tick, per_range)
    key = F.col(by) if by else F.lit(0)
    ends = own.groupBy(key.alias("__of"), F.col("__range").alias("__part")).agg(F.max_by(total, tick).alias("__end"))
    before = ends.select("__of", "__part", F.lag("__end").over(W.partitionBy("__of").orderBy("__part")).alias("__before"))
    met = own.join(before, key.eqNullSafe(F.col("__of")) & (F.col("__range") == F.col("__part")))
    w = W.partitionBy("__of", "__range").orderBy(tick)
    last = F.when(F.row_number().over(w) == 1, F.col("__before")).otherwise(F.lag(total).over(w))
    return met.withColumn("delta", (F.col(total) - F.coalesce(last, F.lit(0))).cast("long")).drop("__range", "__of", "__part", "__before")


def tail(events: DataFrame, n: int, order: str) -> DataFrame:
    """The last ``n`` events: a top-k, never a full sort."""
    return events.orderBy(F.col(order).desc()).limit(n)
