"""The record envelope and the kinds of errors.

Nanosecond stamps stay BIGINT, for Spark's timestamps end at microseconds;
unsigned 64-bit fields are BIGINT of the same bits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENVELOPE = T.StructType(
    [
        T.StructField("sequence", T.LongType()),
        T.StructField("ts_ns", T.LongType()),
        T.StructField("schema_id", T.IntegerType()),
        T.StructField("suspect", T.BooleanType()),
        T.StructField("key", T.LongType()),
        T.StructField("price", T.LongType()),
        T.StructField("payload", T.StringType()),
    ]
)


class MillraceError(Exception):
    """An error with a stable kind."""

    kind = "other"


class ConfigError(MillraceError):
    kind = "config"


class DecodeError(MillraceError):
    kind = "decode"


class PlacementError(MillraceError):
    kind = "placement"


class NotImplementedBackend(MillraceError):
    kind = "not_implemented"


def backend(name: str) -> None:
    """Kernel-bypass backends (af_xdp, dpdk, io_uring, spdk) hold a place only; they have no data path."""
    raise NotImplementedBackend(f"backend {name!r} has no data path")


#: Schema ids of the event types, in alphabetical order from 1; 0 stands for unknown.
EVENT_SCHEMAS = ("click", "error", "purchase", "signup", "view")


def from_events(events: DataFrame) -> DataFrame:
    """``events`` as envelope rows: price in cents, errors suspect."""
    schema_id = F.coalesce(F.array_position(F.array(*map(F.lit, EVENT_SCHEMAS)), F.col("event_type")), F.lit(0)).cast("int")
    return events.select(
        F.col("event_id").alias("sequence"),
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts_ns"),
        schema_id.alias("schema_id"),
        (F.col("event_type") == "error").alias("suspect"),
        F.col("user_id").alias("key"),
        F.round(F.col("value") * 100).cast("long").alias("price"),
        F.col("props").alias("payload"),
    )
