"""Drops over all events against a fold of the generator."""

from millrace import queries

SF = "/root/testdata/sf0.001"


def test_every_event_takes_its_draw(spark):
    got = {r.sequence: r.dropped for r in queries.QUERIES["fault_drop_events"](spark, SF).collect()}
    x, want = 0, {}
    for r in spark.read.parquet(f"{SF}/events.parquet").select("event_id").orderBy("event_id").collect():
        x = (x * 6364136223846793005 + 1) % 2**64
        want[r.event_id] = (x >> 32) / (2**32 - 1) < 0.05
    assert got == want and 0 < sum(want.values()) < len(want)
