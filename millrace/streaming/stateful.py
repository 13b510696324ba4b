"""The bounded queue over a stream: rows wait in state, timers drain it, and what finds it full goes by policy."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..envelope import ConfigError

POLICIES = ("block", "drop_newest", "drop_oldest", "evict", "overflow")
OUT = "run string, sequence long, outcome string, tick long"
#: Needed by the state of this queue.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Queue(StatefulProcessor):
    """One queue a run. A list state is its ring, in order of arrival; a value state the tick that is open.

    Rows of a tick are pushed as they come; when it closes, by a row of a later
    tick or by the watermark, up to ``drain`` rows leave, and so for the empty
    ticks that follow. A second list holds what waits (``block``) or what went to
    the overflow place, which has ``capacity`` rows of its own and the same drain.
    """

    def __init__(self, capacity: int, drain: int, policy: str, tick_ms: int) -> None:
        self.capacity, self.drain, self.policy, self.tick_ms = capacity, drain, policy, tick_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ring_state = handle.getListState("ring", "sequence long")
        self.second_state = handle.getListState("second", "sequence long")
        self.open_state = handle.getValueState("open", "tick long")

    def _load(self) -> int | None:
        self.ring = deque(s for (s,) in self.ring_state.get()) if self.ring_state.exists() else deque()
        self.second = deque(s for (s,) in self.second_state.get()) if self.second_state.exists() else deque()
        self.out: list[tuple] = []
        return self.open_state.get()[0] if self.open_state.exists() else None

    def _store(self, key: tuple, tick: int) -> Iterator[pd.DataFrame]:
        for state, rows in ((self.ring_state, self.ring), (self.second_state, self.second)):
            if rows:
                state.put([(s,) for s in rows])
            else:
                state.clear()
        self.open_state.update((tick,))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if self.ring or self.second:
            self.handle.registerTimer((tick + 1) * self.tick_ms)  # when the open tick has passed
        if self.out:
            yield pd.DataFrame([(key[0], *o) for o in self.out], columns=["run", "sequence", "outcome", "tick"])

    def _close(self, tick: int, upto: int) -> None:
        """Drain at the end of the ticks from ``tick`` up to ``upto``, which is not closed."""
        while tick < upto and (self.ring or self.second):
            for _ in range(min(self.drain, len(self.ring))):
                self.out.append((self.ring.popleft(), "drained", tick))
            if self.policy == "block":
                while self.second and len(self.ring) < self.capacity:
                    self.ring.append(self.second.popleft())
            else:
                for _ in range(min(self.drain, len(self.second))):
                    self.out.append((self.second.popleft(), "drained_overflow", tick))
            tick += 1

    def _push(self, sequence: int, tick: int) -> None:
        if len(self.ring) < self.capacity and not (self.policy == "block" and self.second):
            self.ring.append(sequence)
        elif self.policy == "block":
            self.second.append(sequence)
        elif self.policy == "evict":
            self.out.append((self.ring.popleft(), "evicted", tick))
            self.ring.append(sequence)
        elif self.policy == "overflow" and len(self.second) < self.capacity:
            self.second.append(sequence)
        else:
            self.out.append((sequence, "dropped", tick))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        open_ = self._load()
        for tick, sequence in sorted(r for p in rows for r in zip(p["tick"].tolist(), p["sequence"].tolist(), strict=True)):
            if open_ is None:
                open_ = tick
            if tick > open_:  # a row of a tick that is closed already comes in the open one
                self._close(open_, tick)
                open_ = tick
            self._push(sequence, open_)
        yield from self._store(key, open_)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        open_ = self._load()
        if open_ is None:
            return
        upto = max(open_, timerValues.getCurrentWatermarkInMs() // self.tick_ms)
        self._close(open_, upto)
        yield from self._store(key, upto)

    def close(self) -> None:
        pass


def queue(rows: DataFrame, capacity: int, drain: int, policy: str = "drop_newest", tick_ms: int = 1000, late: str = "0 seconds") -> DataFrame:
    """(run, sequence, outcome, tick) of a stream of (run, ts, sequence), ``ts`` a timestamp of whole ticks of ``tick_ms``.

    outcome: drained, drained_overflow, evicted or dropped, and the tick in which
    it came to that. ``drop_oldest`` drops the newest, as the policy of that name
    does; ``evict`` makes room by letting the oldest go; ``block`` lets rows wait
    and loses nothing; ``overflow`` has a second place, then drops. Rows of a run
    meet in one state, which is as large as the queue (and what waits). Rows that
    come ``late`` or more behind the latest one are not taken (the watermark).
    """
    if capacity < 1 or drain < 1 or tick_ms < 1 or policy not in POLICIES:
        raise ConfigError("capacity, drain and tick are 1 or more, a policy is one of " + ", ".join(POLICIES))
    given = rows.withWatermark("ts", late).selectExpr("CAST(run AS STRING) AS run", "ts", f"unix_millis(ts) div {tick_ms} AS tick", "CAST(sequence AS LONG) AS sequence")
    return given.groupBy("run").transformWithStateInPandas(Queue(capacity, drain, policy, tick_ms), OUT, "Append", "EventTime")
