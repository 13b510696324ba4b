"""Generated network traffic: UDP frames at a pattern's pace, with seeded drops."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs, payload
from ..operators import faults as faulty
from ..operators import pacing


def packets(
    spark: SparkSession,
    n_ticks: int,
    pattern: pacing.Pattern,
    tick_ns: int = 1_000_000,
    body: Callable[[Column], Column] | None = None,
    faults: faulty.Faults = faulty.Faults(),
    port: int = 9000,
    name: str = "nic0",
) -> DataFrame:
    """source, sequence, tick, ts_ns, data (the frame), dropped. Nothing is gathered: ticks are a range, packets its explosion."""
    body = body or (lambda sequence: payload.fixed_seq(sequence, 8))
    made = pacing.packets(pacing.arrivals(spark, n_ticks, pattern, tick_ns), tick_ns)
    framed = made.select(F.lit(name).alias("source"), "sequence", "tick", "ts_ns", codecs.udp_frame(body(F.col("sequence")), F.lit(port)).alias("data"))
    return faulty.drops(framed, faults)
