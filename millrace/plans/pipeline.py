"""Pipelines: source, decode, transform, route, sinks, as one lazy plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..envelope import ConfigError, NotImplementedBackend, backend
from ..operators import batches, queueing, routing

Stage = Callable[[DataFrame], DataFrame]
Sink = Callable[[DataFrame], None]


@dataclass(frozen=True)
class RuntimeConfig:
    """workers: partitions of the run; batch_size: rows a batch; capacity: rows of a batch that a sink takes (None: all);
    backpressure: what becomes of the others, a policy of queueing.POLICIES; overflow_sink: where they go with
    ``overflow`` while it has places of its own, as many a batch; order: the integer column that rows come in; metrics: whether run() counts.
    """

    workers: int = 1
    batch_size: int = 512
    capacity: int | None = None
    backpressure: str = "block"
    overflow_sink: int | None = None
    order: str = "sequence"
    metrics: bool = True
    affinity: str = "none"
    strict_affinity: bool = False

    def __post_init__(self) -> None:
        if self.workers < 1 or self.batch_size < 1:
            raise ConfigError("workers and batch_size must be 1 or more")
        if self.backpressure not in queueing.POLICIES:
            raise ConfigError(f"unknown back-pressure policy {self.backpressure!r}")
        if self.capacity is not None and self.capacity < 1:
            raise ConfigError("capacity must be 1 or more")
        if self.strict_affinity and self.affinity != "none":
            raise NotImplementedBackend("Spark places tasks; processors can't be pinned")

    @classmethod
    def from_toml(cls, text: str) -> RuntimeConfig:
        import tomllib

        table = tomllib.loads(text).get("runtime", {})
        known = {k: v for k, v in table.items() if k in cls.__dataclass_fields__}
        if unknown := set(table) - set(known):
            raise ConfigError(f"unknown runtime settings: {', '.join(sorted(unknown))}")
        return cls(**known)


@dataclass(frozen=True)
class Pipeline:
    """A fluent builder; every step gives a new one. Nothing runs before run() or routed()."""

    source: DataFrame | None = None
    stages: tuple[Stage, ...] = ()
    router: Stage | None = None
    sinks: dict[int, Sink] = field(default_factory=dict)
    config: RuntimeConfig = RuntimeConfig()

    def read(self, rows: DataFrame | str) -> Pipeline:
        if isinstance(rows, str):
            backend(rows)
        return replace(self, source=rows)

    def decode(self, column: str, decoder: Callable[[Column], Column], failfast: bool = False) -> Pipeline:
        """Fields of ``decoder`` in place of ``column``; records it gives null for are dropped, or fail the job with ``failfast``."""

        def step(df: DataFrame) -> DataFrame:
            m = decoder(F.col(column))
            if failfast:
                m = F.coalesce(m, F.raise_error(F.lit("decode: a record can't be read")))
            return df.withColumn("__m", m).filter(F.col("__m").isNotNull()).select("*", "__m.*").drop("__m", column)

        return self.transform(step)

    def transform(self, stage: Stage) -> Pipeline:
        return replace(self, stages=(*self.stages, stage))

    def filter(self, condition: Column | str) -> Pipeline:
        return self.transform(lambda df: df.filter(condition))

    def route(self, router: Stage) -> Pipeline:
        return replace(self, router=router)

    def sink(self, sink_id: int, write: Sink) -> Pipeline:
        if sink_id <= routing.DROP or sink_id in self.sinks:
            raise ConfigError(f"sink {sink_id} is 0, negative or taken")
        return replace(self, sinks={**self.sinks, sink_id: write})

    def configured(self, config: RuntimeConfig) -> Pipeline:
        return replace(self, config=config)

    def routed(self) -> DataFrame:
        if self.source is None:
            raise ConfigError("a pipeline needs a source")
        rows = self.source
        for stage in self.stages:
            rows = rows.transform(stage)
        rows = rows.transform(self.router) if self.router else routing.fixed(rows, next(iter(self.sinks), 1))
        return self._pressed(rows)

    def _pressed(self, rows: DataFrame) -> DataFrame:
        """Rows that find their sink full, by policy: ``block``, ``spin`` and ``adaptive_batching`` make the source wait, so nothing is lost."""
        c = self.config
        if c.capacity is None or c.backpressure in ("block", "spin", "adaptive_batching"):
            return rows
        # A batch is ``batch_size`` rows in their order; each sink takes its own part of it.
        batched = routing.numbered(rows, c.order, name="__place").withColumn("__batch", F.floor(F.col("__place") / c.batch_size)).drop("__place")
        own = batches.capped(batched.withColumn("__group", F.struct("__batch", "sink_id")), c.capacity, "__group", c.order).drop("__group")
        drop = F.lit(routing.DROP).cast("long")
        if c.backpressure != "overflow" or c.overflow_sink is None:
            return own.withColumn("sink_id", F.when(F.col("accepted"), F.col("sink_id")).otherwise(drop)).drop("__batch", "accepted")
        # What overflows and what is routed to the overflow sink share its places, in their order; then rows drop.
        over = F.lit(c.overflow_sink).cast("long")
        target = F.when(F.col("accepted") | (F.col("sink_id") == drop), F.col("sink_id")).otherwise(over)
        moved = own.withColumn("sink_id", target).drop("accepted")
        rest = moved.filter(~F.col("sink_id").eqNullSafe(over)).drop("__batch")
        shared = batches.capped(moved.filter(F.col("sink_id").eqNullSafe(over)), c.capacity, "__batch", c.order)
        return rest.unionByName(shared.withColumn("sink_id", F.when(F.col("accepted"), over).otherwise(drop)).drop("__batch", "accepted"))

    def run(self) -> dict[str, int]:
        """Write each sink's rows; returns messages written per sink and dropped (``sink_id`` 0), or nothing without metrics.

        With metrics, rows for a sink that nobody registered fail the run before
        anything is written; without, they fail the job that meets them.
        """
        if not self.sinks:
            raise ConfigError("a pipeline needs a sink")
        rows = self.routed()
        if self.config.workers > 1:
            rows = rows.repartition(self.config.workers)
        rows = rows.persist()
        try:
            by_sink = {r.sink_id: r.n for r in rows.groupBy("sink_id").agg(F.count("*").alias("n")).collect()} if self.config.metrics else {}  # a row a sink
            if strange := set(by_sink) - {routing.DROP, *self.sinks}:
                raise routing.PlacementError(f"no sink {sorted(strange, key=str)}")
            for sink_id, df in routing.split(rows, list(self.sinks)).items():
                self.sinks[sink_id](df.drop("sink_id"))
        finally:
            rows.unpersist()
        if not self.config.metrics:
            return {}
        return {"dropped": by_sink.get(routing.DROP, 0), **{f"sink_{s}": by_sink.get(s, 0) for s in self.sinks}}
