"""Metrics of a running stream: observed while rows pass, collected from the query's progress, without a second pass."""

from __future__ import annotations

import statistics
import threading
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..operators import routing
from ..operators.metrics import NET, RUNTIME, STORAGE

#: Under this name rows are observed; its fields are metric names with `__` for the dot.
OBSERVED = "millrace"
_KINDS = {**RUNTIME, **NET, **STORAGE}
#: What a step came to, by name.
PROGRESS, IDLE, BACK_PRESSURED, EXHAUSTED = "progress", "idle", "back_pressured", "exhausted"


def observed(routed: DataFrame, more: dict[str, Column] | None = None) -> DataFrame:
    """``routed`` (sink_id 0: dropped), counted by each micro-batch as its rows pass.

    ``more`` names further metrics of the known sets with an aggregate for each,
    such as net.bytes_received or storage.parse_errors.
    """
    values = {
        "runtime.messages_out": F.count(F.when(F.col("sink_id") != routing.DROP, 1)),
        "runtime.messages_dropped": F.count(F.when(F.col("sink_id") == routing.DROP, 1)),
        **(more or {}),
    }
    if unknown := set(values) - set(_KINDS):
        raise ValueError(f"no metrics of these names: {', '.join(sorted(unknown))}")
    return routed.observe(OBSERVED, *[F.coalesce(v, F.lit(0)).cast("double").alias(name.replace(".", "__")) for name, v in values.items()])


class Collector(StreamingQueryListener):
    """Adds counters up, keeps the last gauge and all values of a histogram; and the outcome of each step.

    A step is a micro-batch. ``back_pressured`` is one in which rows were dropped
    or held back: with the metric runtime.backpressure_events above 0.
    """

    def __init__(self, workers: int = 1) -> None:
        self.lock, self.workers = threading.Lock(), workers
        self.counters: dict[str, float] = defaultdict(float)
        self.gauges: dict[str, float] = {}
        self.histograms: dict[str, list[float]] = defaultdict(list)
        self.outcomes: list[str] = []

    def record(self, name: str, value: float) -> None:
        kind = _KINDS[name]
        with self.lock:
            if kind == "counter":
                self.counters[name] += value
            elif kind == "gauge":
                self.gauges[name] = float(value)
            else:
                self.histograms[name].append(float(value))

    def onQueryStarted(self, event) -> None:
        self.record("runtime.phase", 3)
        self.record("runtime.workers", self.workers)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if not p.numInputRows:  # a batch without rows, for a watermark that moved
            self._idle()
            return
        self.record("runtime.steps", 1)
        self.record("runtime.step_duration_ns", p.batchDuration * 1e6)
        seen = p.observedMetrics.get(OBSERVED)
        values = {k.replace("__", "."): v for k, v in seen.asDict().items()} if seen is not None else {}
        for name, v in values.items():
            self.record(name, v or 0.0)
        with self.lock:
            self.outcomes.append(BACK_PRESSURED if values.get("runtime.backpressure_events") else PROGRESS)

    def onQueryIdle(self, event) -> None:
        self._idle()

    def _idle(self) -> None:
        self.record("runtime.idle_skips", 1)
        with self.lock:
            self.outcomes.append(IDLE)

    def onQueryTerminated(self, event) -> None:
        self.record("runtime.phase", 5)
        with self.lock:
            self.outcomes.append(EXHAUSTED)

    def samples(self) -> list[tuple[str, str, float]]:
        """(metric, kind, value): a histogram's value is its median, as in operators.metrics."""
        with self.lock:
            out = [(n, "counter", v) for n, v in self.counters.items()] + [(n, "gauge", v) for n, v in self.gauges.items()]
            return sorted(out + [(n, "histogram", float(statistics.median(v))) for n, v in self.histograms.items()])

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.samples(), "metric string, kind string, value double")
