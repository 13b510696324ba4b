"""Metrics of a running stream against those of the same rows as a batch."""

import time

import pytest
from pyspark.sql import functions as F

from millrace.operators import metrics
from millrace.streaming import telemetry

ROWS = "sequence long, payload string"


def routed(df):
    return df.withColumn("sink_id", (F.col("sequence") % 3).cast("long"))


def test_a_stream_and_its_batch(spark, tmp_path):
    collector = telemetry.Collector(workers=2)
    spark.streams.addListener(collector)
    try:
        for part in range(3):
            spark.range(part * 100, part * 100 + 100).select(F.col("id").alias("sequence"), F.repeat(F.lit("x"), (F.col("id") % 7).cast("int")).alias("payload")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = routed(spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
        more = {"net.bytes_received": F.sum(F.octet_length("payload")), "net.packets_received": F.count("*"), "runtime.backpressure_events": F.count(F.when(F.col("sequence") >= 250, 1))}
        q = telemetry.observed(stream, more).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination(120)
        for _ in range(100):  # the listener hears of it a little later
            if telemetry.EXHAUSTED in collector.outcomes:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(collector)
    got = {n: v for n, _, v in collector.samples()}
    rows = spark.read.schema(ROWS).parquet(str(tmp_path / "in"))
    batch = {r.metric: r.value for r in metrics.runtime(routed(rows), 100, F.col("sequence") >= 250, workers=2).collect()}
    assert {n: got[n] for n in batch} == batch
    assert got["net.packets_received"] == 300 and got["net.bytes_received"] == sum(i % 7 for i in range(300))
    assert got["runtime.step_duration_ns"] > 0 and got["runtime.phase"] == 5
    assert [o for o in collector.outcomes if o != telemetry.IDLE] == [telemetry.PROGRESS, telemetry.PROGRESS, telemetry.BACK_PRESSURED, telemetry.EXHAUSTED]
    assert {r.metric for r in collector.table(spark).collect()} == set(got)


def test_unknown_names(spark):
    with pytest.raises(ValueError, match="no metrics of these names"):
        telemetry.observed(routed(spark.range(3).select(F.col("id").alias("sequence"))), {"net.typo": F.count("*")})
