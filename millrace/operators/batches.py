"""Batch rules: slots of bounded size and batches of bounded length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .routing import RANK, ranked


def truncated(rows: DataFrame, max_bytes: int, payload: str = "payload") -> DataFrame:
    """Packets cut to a slot of ``max_bytes`` bytes, with ``truncated`` and the length they had.

    Bytes are cut, not characters: a text payload becomes its UTF-8 bytes, which
    may end inside a character.
    """
    text = dict(rows.dtypes)[payload] == "string"
    data = F.encode(F.col(payload), "utf-8") if text else F.col(payload)
    n = F.octet_length(payload)
    return rows.withColumn("original_len", n.cast("long")).withColumn("truncated", n > max_bytes).withColumn(payload, F.substring(data, 1, max_bytes))


def sized(rows: DataFrame, max_bytes: int, payload: str = "payload") -> DataFrame:
    """Records with ``oversized``: these are refused whole and counted as parse errors, not cut."""
    return rows.withColumn("oversized", F.octet_length(payload) > max_bytes)


def capped(rows: DataFrame, capacity: int, batch: str = "tick", order: str = "sequence") -> DataFrame:
    """Rows with ``accepted``: the first ``capacity`` of each batch."""
    return ranked(rows, batch, order).withColumn("accepted", F.col(RANK) <= capacity).drop(RANK)
