"""A bounded sink behind a stream, and what its source admits: block loses nothing, the dropping policies count what they drop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..envelope import ConfigError, MillraceError
from ..operators import routing
from ..sources.followed import load, save

Write = Callable[[DataFrame, int], None]


def credit(ledger: str) -> str:
    """The file in which the sink of a ledger says how many rows it can take; a source's option of this name."""
    return f"{ledger}/credit.json"


def opened(ledger: str, capacity: int) -> str:
    """As credit(), and a first credit of ``capacity`` rows where the sink has not yet said anything."""
    if not load(credit(ledger)):
        save(credit(ledger), {"free": capacity})
    return credit(ledger)


def state(ledger: str, epoch: int) -> dict:
    """occupancy, written and dropped after a batch."""
    return load(f"{ledger}/after-{epoch}.json") or {"occupancy": 0, "written": 0, "dropped": 0}


def write_bounded(rows: DataFrame, write: Write, capacity: int, drain: int, ledger: str, checkpoint: str, policy: str = "block", order: str = "file_offset", overflow: Write | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Each batch into a queue of ``capacity`` rows, of which ``drain`` leave after it.

    ``block``: the source takes its credit from credit(ledger) and so admits what
    fits; nothing is lost. ``drop_newest`` and ``drop_oldest`` (the same, as that
    policy behaves): rows that find the queue full are dropped and counted;
    ``overflow``: they go to ``overflow``. The state is kept by batch in the
    ledger: a batch that is run again starts from the one before, so neither
    rows nor counts come twice, if ``write`` replaces what the same batch wrote.
    """
    if capacity < 1 or drain < 1:
        raise ConfigError("capacity and drain are 1 or more")
    if policy not in ("block", "drop_newest", "drop_oldest", "overflow") or (policy == "overflow") != (overflow is not None):
        raise ConfigError(f"unknown policy {policy!r}, or an overflow without a place")

    def each(df: DataFrame, epoch: int) -> None:
        before = state(ledger, epoch - 1)
        df = df.persist()
        try:
            n, free = df.count(), capacity - before["occupancy"]
            if n > free and policy == "block":
                raise MillraceError(f"{n} rows for {free} places: the source does not follow the credit")
            if n <= free:
                write(df, epoch)
            else:
                placed = routing.numbered(df, order, name="__place")
                write(placed.filter(F.col("__place") < free).drop("__place"), epoch)
                if overflow is not None:
                    overflow(placed.filter(F.col("__place") >= free).drop("__place"), epoch)
        finally:
            df.unpersist()
        taken = min(n, free)
        after = {"occupancy": max(before["occupancy"] + taken - drain, 0), "written": before["written"] + taken, "dropped": before["dropped"] + n - taken}
        save(f"{ledger}/after-{epoch}.json", after)
        save(credit(ledger), {"free": capacity - after["occupancy"]})

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
