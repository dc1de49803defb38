"""Metrics of each micro-batch to several sinks at once, and counters observed on the way."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

Sink = Callable[[DataFrame, int], None]


def table_sink(path: str) -> Sink:
    """Parquet, a folder for each step; a step that comes again takes the place of its own."""
    return lambda metrics, step: metrics.write.mode("overwrite").parquet(f"{path}/step={step}")


def lines_sink(path: str) -> Sink:
    """JSON Lines, a folder for each step."""
    return lambda metrics, step: metrics.write.mode("overwrite").json(f"{path}/step={step}")


def console_sink(rows: int = 20) -> Sink:
    return lambda metrics, step: metrics.show(rows, truncate=False)


def log(metrics: DataFrame, step: int, sinks: dict[str, Sink], backend: list[str] | None = None) -> None:
    """metrics to the sinks named by backend, or to all; they are worked out once."""
    chosen = [sinks[name] for name in (backend or sinks)]
    kept = metrics.persist() if len(chosen) > 1 else metrics
    try:
        for sink in chosen:
            sink(kept, step)
    finally:
        if len(chosen) > 1:
            kept.unpersist()


def observed(df: DataFrame, name: str, **counters: Column) -> tuple[DataFrame, Observation]:
    """df, and an observation of the counters, filled by the first action on it."""
    seen = Observation(name)
    return df.observe(seen, *(c.alias(n) for n, c in counters.items())), seen


def fan_out(stream: DataFrame, aggregate: Callable[[DataFrame], DataFrame], sinks: dict[str, Sink], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Starts a query that puts each micro-batch's metrics into all sinks, by the batch's number: a batch that is run again after a failure overwrites its own."""
    writer = stream.writeStream.foreachBatch(lambda batch, step: log(aggregate(batch), step, sinks)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def logged(spark, path: str, kind: str = "parquet", schema: str | None = None) -> DataFrame:
    """What a sink has: the metrics of all steps, with step."""
    reader = spark.read.schema(schema) if schema else spark.read
    return getattr(reader, kind)(path).withColumn("step", F.col("step").cast("long"))
