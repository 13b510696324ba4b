"""Appended bytes as a stream, restarts between; admission by what the sink took."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.envelope import ConfigError
from millrace.sources import followed
from millrace.streaming import admission


def run(spark, folder, out, checkpoint, **options):
    q = followed.follow(spark, str(folder), **options).writeStream.format("parquet").option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start(str(out))
    q.awaitTermination(120)
    assert not q.isActive


def got(spark, out):
    return sorted((r.path.rsplit("/", 1)[-1], r.file_offset, bytes(r.record)) for r in spark.read.schema(followed.SCHEMA).parquet(str(out)).collect())


def append(path, data):
    with open(path, "ab") as f:
        f.write(data)


@pytest.mark.parametrize("split", [3, 1 << 20])
def test_half_a_record(spark, tmp_path, split):
    """Half a record, then the rest: seen once, after the restart; a tail waits; a second file joins in."""
    src, out, cp = tmp_path / "in", tmp_path / "out", tmp_path / "cp"
    src.mkdir()
    append(src / "a", b"one\ntw")
    run(spark, src, out, cp, split=split)
    assert got(spark, out) == [("a", 0, b"one\n")]
    append(src / "a", b"o")
    run(spark, src, out, cp, split=split)
    append(src / "a", b"\nthree\nfo")
    append(src / "b", b"\n")
    run(spark, src, out, cp, split=split)
    run(spark, src, out, cp, split=split)
    assert got(spark, out) == [("a", 0, b"one\n"), ("a", 4, b"two\n"), ("a", 8, b"three\n"), ("b", 0, b"\n")]


def test_fixed_and_batch(spark, tmp_path):
    src, out, cp = tmp_path / "in", tmp_path / "out", tmp_path / "cp"
    src.mkdir()
    append(src / "a", b"AAAABB")
    run(spark, src, out, cp, frame="fixed", size=4, split=1)
    append(src / "a", b"BBCCCCD")
    run(spark, src, out, cp, frame="fixed", size=4, split=1)
    want = [("a", 0, b"AAAA"), ("a", 4, b"BBBB"), ("a", 8, b"CCCC")]
    assert got(spark, out) == want
    now = spark.read.format("followed_files").options(path=str(src), frame="fixed", size=4).load()
    assert sorted(bytes(r.record) for r in now.collect()) == [r for _, _, r in want]


def test_stretches_in_any_cut(tmp_path):
    """However bytes are appended and stretches are cut, each record comes once and whole."""
    r = random.Random(4)
    for _ in range(300):
        body = bytes(r.choice(b"ab\n") for _ in range(r.randrange(60)))
        (tmp_path / "f").write_bytes(body)
        frames = followed.Frames({"path": str(tmp_path), "max_len": 70, "split": r.randrange(1, 30)})
        cuts = sorted({0, len(body), *(r.randrange(len(body) + 1) for _ in range(3))})
        records = [bytes(x) for a, z in zip(cuts, cuts[1:], strict=False) for s in frames.stretches(str(tmp_path / "f"), a, z) for b in frames.read(s) for x in b.column("record").to_pylist()]
        assert records == [x + b"\n" for x in body.split(b"\n")[:-1]]
        n = r.randrange(1, 9)
        at, found = frames.after(str(tmp_path / "f"), 0, len(body), n)
        assert found == min(n, len(records)) and (at == sum(map(len, records[:n])) if found == n else at == len(body))


def bounded(spark, tmp_path, policy, **options):
    src, ledger = tmp_path / "in", str(tmp_path / "ledger")
    rows = followed.follow(spark, str(src), **options)
    write = lambda df, epoch: df.write.mode("overwrite").parquet(f"{tmp_path}/out/epoch={epoch}")
    q = admission.write_bounded(rows, write, 10, 4, ledger, str(tmp_path / "cp"), policy)
    q.awaitTermination(120)
    return admission.state(ledger, q.lastProgress["batchId"] if q.lastProgress else -1)


def test_block_loses_nothing(spark, tmp_path):
    """A query a run, so every batch is after a restart: no more is admitted than fits, and all comes in the end."""
    (tmp_path / "in").mkdir()
    lines = [b"line %d\n" % i for i in range(25)]
    append(tmp_path / "in" / "a", b"".join(lines) + b"tail")
    ledger = str(tmp_path / "ledger")
    credit = admission.opened(ledger, 10)
    for _ in range(6):
        bounded(spark, tmp_path, "block", credit=credit, ledger=ledger)
    assert got(spark, tmp_path / "out") == [("a", sum(map(len, lines[:i])), x) for i, x in enumerate(lines)]
    sizes = [r.n for r in spark.read.parquet(f"{tmp_path}/out").groupBy("epoch").agg(F.count("*").alias("n")).orderBy("epoch").collect()]
    assert sizes == [10, 4, 4, 4, 3]


def test_drop_newest_counts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    append(tmp_path / "in" / "a", b"x\n" * 25)
    assert bounded(spark, tmp_path, "drop_newest") == {"occupancy": 6, "written": 10, "dropped": 15}
    append(tmp_path / "in" / "a", b"y\n" * 8)
    assert bounded(spark, tmp_path, "drop_newest") == {"occupancy": 6, "written": 14, "dropped": 19}
    assert [r[2] for r in got(spark, tmp_path / "out")] == [b"x\n"] * 10 + [b"y\n"] * 4


def test_settings(tmp_path):
    for options in ({}, {"path": "x", "frame": "custom"}, {"path": "x", "frame": "fixed"}, {"path": "x", "max_records": "3"}, {"path": "x", "max_records": "0", "ledger": "y"}):
        with pytest.raises(ConfigError):
            followed.Follower(options)
