"""Capture files as a data source: rolled, committed together or not at all."""

import os

import pytest
from pyspark.sql import functions as F

from millrace.envelope import ConfigError
from millrace.sources import pcap


def there(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, names in os.walk(folder) for f in names if not f.startswith((".", "_")))


def packets(spark, n=200):
    """Nine in ten packets belong to one group."""
    data = F.encode(F.concat(F.lit("p"), F.col("id").cast("string")), "utf-8")
    return spark.range(n).select(F.when(F.col("id") % 10 == 3, "b").otherwise("a").alias("path"), (F.lit(n) - F.col("id")).alias("pkt_index"), (F.lit(1_700_000_000_123_456_789) + F.col("id") * 1_000_000_007).alias("ts_ns"), data.alias("data"))


@pytest.mark.parametrize("nanoseconds", [True, False])
def test_a_hot_group_becomes_several_captures(spark, tmp_path, nanoseconds):
    out = str(tmp_path / "out")
    pcap.save(packets(spark), out, nanoseconds=nanoseconds, roll=500)
    files = there(out)
    assert sum(f.startswith("a/") for f in files) >= 8 and all(os.path.getsize(f"{out}/{f}") <= 500 for f in files)
    got = sorted((r.path, r.pkt_index, r.ts_ns, bytes(r.data)) for r in pcap.load(spark, out).collect())
    want = []
    for g in "ab":
        own = sorted((r.ts_ns, r.pkt_index, bytes(r.data)) for r in packets(spark).filter(F.col("path") == g).collect())
        want += [(g, k, ts if nanoseconds else ts // 1000 * 1000, d) for k, (ts, _, d) in enumerate(own)]
    assert got == want
    assert {bytes(r.data) for r in pcap.read(spark, f"{out}/*/*.pcap").collect()} == {d for *_, d in want}


def test_all_or_nothing(spark, tmp_path):
    out = str(tmp_path / "out")
    bad = packets(spark).withColumn("data", F.when(F.col("pkt_index") != 5, F.col("data")))
    with pytest.raises(Exception, match="a packet needs"):
        pcap.save(bad, out, roll=500)
    assert there(out) == [] and not os.path.exists(f"{out}/_SUCCESS") and not [d for d in os.listdir(out) if d.startswith("_staging")]
    pcap.save(packets(spark, 20), out)
    first = there(out)
    pcap.save(packets(spark, 20), out)
    assert set(first) < set(there(out)) and pcap.load(spark, out).count() == 40
    pcap.save(packets(spark, 10), out, mode="overwrite")
    assert pcap.load(spark, out).count() == 10 and os.path.exists(f"{out}/_SUCCESS")
    assert not [d for d in os.listdir(out) if d.startswith("_staging")]


def test_empty_and_settings(spark, tmp_path):
    out = str(tmp_path / "out")
    pcap.save(packets(spark, 0), out)
    assert there(out) == [] and pcap.load(spark, out).count() == 0
    for options in ({}, {"path": out, "roll": "0"}):
        with pytest.raises(ConfigError):
            pcap.CaptureWriter(options, False)
