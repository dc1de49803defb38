"""Evaluation samples with their attempts: what is left to run, how long it took, how well boxes lie."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import geometry, images, text


def to_run(samples: DataFrame, done: DataFrame, key: str, status: str = "status", error: str = "error") -> DataFrame:
    """The samples that have no result yet, or one whose attempts all failed. done: key and the array of its attempts' status; a result without attempts counts as failed."""
    fine = done.where(F.exists(status, lambda s: ~s.eqNullSafe(F.lit(error)))).select(key)
    return samples.join(fine, key, "left_anti")


def batch_stats(times: Column, wall: Column) -> Column:
    """(sample_n, total, mean, most, least, speedup) of the attempts of one sample that ran beside each other for wall seconds."""
    total = F.aggregate(times, F.lit(0.0), lambda s, x: s + x)
    n = F.size(times)
    return F.when(n > 0, F.struct(n.cast("long").alias("sample_n"), total.alias("total"), (total / n).alias("mean"), F.array_max(times).alias("most"), F.array_min(times).alias("least"), F.when(wall > 0, total / wall).otherwise(0.0).alias("speedup")))


def performance(samples: DataFrame) -> DataFrame:
    """One row of averages and totals over all samples' attempts.

    samples: attempts (array of structs with image_load_time, overview_process_time,
    total_time, api_call_times, tool_call_times) and batch (batch_total_time, sample_n,
    parallelization_speedup, max_individual_time; null where attempts ran alone). Lists
    are summed in their rows, so no task sees all times. Averages of nothing are 0.
    """
    each = samples.select(F.explode("attempts").alias("a"), F.lit(None).alias("b")).where("a is not null")
    of = lambda c: F.aggregate(f"a.{c}", F.lit(0.0), lambda s, x: s + x)
    mean = lambda total, n: F.coalesce(F.try_divide(total, n), F.lit(0.0))
    attempts = each.agg(
        F.count("*").alias("total_samples"),
        *(F.coalesce(F.avg(f"a.{c}"), F.lit(0.0)).alias(f"avg_{c}") for c in ("image_load_time", "overview_process_time", "total_time")),
        *(mean(F.sum(of(f"{c}_call_times")), F.sum(F.size(f"a.{c}_call_times"))).alias(f"avg_{c}_call_time") for c in ("api", "tool")),
        *(F.coalesce(F.avg(F.size(f"a.{c}_call_times")), F.lit(0.0)).alias(f"avg_num_{c}_calls") for c in ("api", "tool")),
        *(F.coalesce(F.sum(F.size(f"a.{c}_call_times")), F.lit(0)).alias(f"total_{c}_calls") for c in ("api", "tool")),
    )
    share = F.when(F.col("batch.max_individual_time") > 0, F.col("batch.batch_total_time") / F.col("batch.max_individual_time") * 100)
    batches = samples.where("batch is not null").agg(F.count("*").alias("total_batches"), *(F.coalesce(F.avg(f"batch.{c}"), F.lit(0.0)).alias(f"avg_{c}") for c in ("batch_total_time", "sample_n", "parallelization_speedup")), F.coalesce(F.avg(share), F.lit(0.0)).alias("avg_efficiency"))
    return attempts.crossJoin(F.broadcast(batches))


def reply_iou(reply: Column, turns: Column, scale: Column, targets: Column) -> Column:
    """Mean best overlap of a reply's boxes with the targets: boxes in its text, or without any those of its turns over their scale."""
    said = text.boxes(reply)
    found = F.when(F.size(said) > 0, said).otherwise(geometry.boxes_to_original(turns, scale))
    return geometry.best_iou(found, F.filter(targets, lambda t: F.size(t) >= 4))


def mean_iou(attempts: DataFrame, right: Column, iou: Column, n_boxes: Column, *by: str) -> DataFrame:
    """Mean overlap over the right attempts that have a box; 0 when there are none."""
    return attempts.groupBy(*by).agg(F.coalesce(F.avg(F.when(right & (n_boxes > 0), iou)), F.lit(0.0)).alias("mean_iou"))


def within_pixels(df: DataFrame, data: Column, least: int = 0, most: int | None = None) -> DataFrame:
    """The rows whose image has more than least pixels and most at most; an image that can't be read goes."""
    area = F.col("__size.width") * F.col("__size.height")
    return df.withColumn("__size", images.image_size(data)).where((area > least) & ((area <= most) if most is not None else F.lit(True))).drop("__size")


def first_batch(rows: DataFrame, group: str, order: list[str], wanted: int, batches: int, most: int | None = None) -> DataFrame | None:
    """The first `wanted` rows in the order given, or None if there are too few and another batch may come; an error once `most` batches have come."""
    from quarry.operators.batch import with_row_id

    placed = with_row_id(rows, *order)
    if placed.where(F.col("row_id") == wanted - 1).limit(1).count():
        return placed.where(F.col("row_id") < wanted).drop("row_id")
    if most is not None and batches >= most:
        raise ValueError(f"{batches} batches don't make {wanted} rows of informative groups ({group})")
    return None
