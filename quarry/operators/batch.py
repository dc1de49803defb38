"""Positional batch algebra: rows have a row_id from 0 on, made once from a key."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry import shared


def settled(df: DataFrame) -> DataFrame:
    """df as a checkpoint, in the folder that the session names in spark.checkpoint.dir: its rows and partitions don't change any more, even if an executor is lost."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared.root(df.sparkSession))
    return df.checkpoint(eager=True)


def with_row_id(df: DataFrame, *key: str) -> DataFrame:
    """row_id 0.. in the order of key. The range-sorted rows are settled first, as the bounds of a range exchange are sampled anew each time it runs; a row's place in its partition is then shifted by the counts of those before, so no task sees all rows."""
    spark = df.sparkSession
    at = F.monotonically_increasing_id()
    parts = settled(df.repartitionByRange(*key).sortWithinPartitions(*key)).withColumn("__p", F.shiftright(at, 33)).withColumn("__r", at.bitwiseAND(F.lit((1 << 33) - 1)))
    counts = sorted((r["__p"], r["count"]) for r in parts.groupBy("__p").count().collect())
    base, first = [], 0
    for p, n in counts:
        base.append((p, first))
        first += n
    offsets = spark.createDataFrame(base, "__p long, __base long")
    return parts.join(F.broadcast(offsets), "__p").withColumn("row_id", F.col("__base") + F.col("__r")).drop("__p", "__r", "__base")


def running_sum(df: DataFrame, value: Column, name: str, *key: str) -> DataFrame:
    """df with name: the sum of value up to and with a row, in the order of key. Range-sorted rows are settled, summed within their partitions, and shifted by what the partitions before hold: no task sees all rows."""
    spark = df.sparkSession
    parts = settled(df.withColumn("__v", value).repartitionByRange(*key).sortWithinPartitions(*key)).withColumn("__p", F.spark_partition_id())
    totals = sorted((r["__p"], r["s"]) for r in parts.groupBy("__p").agg(F.sum("__v").alias("s")).collect())
    base, before = [], 0.0
    for p, s in totals:
        base.append((p, float(before)))
        before += s or 0
    offsets = spark.createDataFrame(base, "__p int, __base double")
    within = F.sum("__v").over(Window.partitionBy("__p").orderBy(*key).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return parts.withColumn("__s", within).join(F.broadcast(offsets), "__p").withColumn(name, F.col("__base") + F.col("__s")).drop("__p", "__v", "__s", "__base")


def take(df: DataFrame, start: int | None = None, stop: int | None = None, step: int = 1, n: int | None = None) -> DataFrame:
    """Rows start:stop:step as Python slices them, renumbered in that order."""
    n = df.count() if n is None else n
    a, b, s = slice(start, stop, step).indices(n)
    size = len(range(a, b, s))
    k = (F.col("row_id") - a) / s
    return df.where((k == F.floor(k)) & (k >= 0) & (k < size)).withColumn("row_id", F.floor(k).cast("long"))


def gather(df: DataFrame, places: DataFrame) -> DataFrame:
    """Rows at places (out_id, row_id), repeats allowed, numbered by out_id."""
    return df.join(places, "row_id").drop("row_id").withColumnRenamed("out_id", "row_id")


def repeat(df: DataFrame, times: int, interleave: bool = True, n: int | None = None) -> DataFrame:
    """Each row `times` times: aabbcc if interleaved, else abcabc."""
    rows = df.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    n = n if n is not None or interleave else df.count()
    return rows.withColumn("row_id", F.col("row_id") * times + F.col("__k") if interleave else F.col("__k") * n + F.col("row_id")).drop("__k")


def chunk(df: DataFrame, parts: int, n: int | None = None) -> DataFrame:
    """chunk_id of equal parts; an error if rows can't be dealt out evenly."""
    n = df.count() if n is None else n
    if n % parts:
        raise ValueError(f"{n} rows don't make {parts} equal parts")
    return df.withColumn("chunk_id", F.floor(F.col("row_id") / F.lit(max(1, n // parts))).cast("long"))


def pad_to(df: DataFrame, divisor: int, n: int | None = None) -> tuple[DataFrame, int]:
    """df and rows from its start, over and over, up to a multiple of divisor; how many were added."""
    n = df.count() if n is None else n
    pad = -n % divisor if n else 0
    if not pad:
        return df, 0
    times = -(-pad // n)
    more = df.withColumn("__k", F.explode(F.sequence(F.lit(1), F.lit(times)))).withColumn("row_id", F.col("row_id") + F.col("__k") * n).where(F.col("row_id") < n + pad).drop("__k")
    return df.unionByName(more), pad


def union_columns(a: DataFrame, b: DataFrame) -> DataFrame:
    """Columns of both by row_id; a shared column must hold equal values, else the query fails."""
    shared = [c for c in a.columns if c in b.columns and c != "row_id"]
    other = b.withColumnsRenamed({c: f"__{c}" for c in shared}).withColumn("__in", F.lit(True))
    both = a.withColumn("__own", F.lit(True)).join(other, "row_id", "full")
    bad = F.col("__in").isNull() | F.col("__own").isNull()
    for c in shared:
        bad = bad | ~F.col(c).eqNullSafe(F.col(f"__{c}"))
    # a filter can't be left out, whichever columns are asked for
    right = F.when(bad, F.raise_error(F.lit("rows or shared columns differ")).cast("boolean")).otherwise(F.lit(True))
    return both.where(right).drop("__in", "__own", *(f"__{c}" for c in shared))


def first_wins(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key in the order given, with the number of its rows. Rows are reduced before they are shuffled."""
    rest = [c for c in df.columns if c not in (key, *order)]
    return df.groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("s"), F.count("*").alias("copies")).select(key, "s.*", "copies")


def sample_per(df: DataFrame, group: str, key: str, k: int, seed: int) -> DataFrame:
    """k rows of each group by the order of md5(key, seed): the same rows in any engine."""
    at = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")).cast("binary"))
    return df.withColumn("__at", at).withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy("__at", key))).where(F.col("__n") <= k).drop("__at", "__n")


def snake(df: DataFrame, group: str, size: str, key: str, bins: int) -> DataFrame:
    """bin of each row: by descending size there and back over the bins."""
    r = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(size), key)) - 1
    turn, at = F.floor(r / bins) % 2, r % bins
    return df.withColumn("bin", F.when(turn == 0, at).otherwise(bins - 1 - at).cast("long"))


def pop(df: DataFrame, *names: str) -> tuple[DataFrame, DataFrame]:
    """The columns names with row_id, and df without them; a missing column is an error."""
    return df.select("row_id", *names), df.drop(*names)


def rename(df: DataFrame, old: list[str], new: list[str]) -> DataFrame:
    if len(old) != len(new) or not set(old) <= set(df.columns):
        raise ValueError("as many new names as old ones, all of them columns")
    return df.withColumnsRenamed(dict(zip(old, new, strict=True)))


def unpad(df: DataFrame, pad: int, n: int | None = None) -> DataFrame:
    n = df.count() if n is None else n
    return df.where(F.col("row_id") < n - pad)


def fold(df: DataFrame, groups: int, n: int | None = None) -> DataFrame:
    """A row for each of groups equal parts, with its rows as an array in order; bounded by the size of a part."""
    out = chunk(df, groups, n)
    rows = F.array_sort(F.collect_list(F.struct("row_id", *(c for c in df.columns if c != "row_id"))))
    return out.groupBy(F.col("chunk_id").alias("row_id")).agg(rows.alias("rows"))


def unfold(df: DataFrame, size: int) -> DataFrame:
    """fold() undone: size is the rows of a part."""
    at = df.select(F.col("row_id").alias("__g"), F.posexplode("rows").alias("__i", "r"))
    inner = [f.name for f in df.schema["rows"].dataType.elementType.fields if f.name != "row_id"]
    return at.select((F.col("__g") * size + F.col("__i")).cast("long").alias("row_id"), *(F.col(f"r.{c}").alias(c) for c in inner))


def minibatches(df: DataFrame, size: int, epochs: int, n: int | None = None) -> DataFrame:
    """epoch and mini_batch_id of each row in each epoch; an error if rows don't make whole batches."""
    n = df.count() if n is None else n
    if n % size:
        raise ValueError(f"{n} rows don't make whole batches of {size}")
    return df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))).withColumn("mini_batch_id", F.floor(F.col("row_id") / size).cast("long"))


def shuffled_minibatches(df: DataFrame, key: str, size: int, epochs: int, seed: int) -> DataFrame:
    """epoch, place and mini_batch_id of each row in each epoch, every epoch in an order of its own: the same seed gives the same batches. An error if rows don't make whole batches."""
    out = None
    for epoch in range(epochs):
        placed = with_row_id(df.withColumn("__at", seeded(F.col(key), seed + epoch)), "__at", key).drop("__at")
        if epoch == 0 and placed.count() % size:
            raise ValueError(f"rows don't make whole batches of {size}")
        one = placed.select(F.lit(epoch).alias("epoch"), F.col("row_id").alias("place"), F.floor(F.col("row_id") / size).cast("long").alias("mini_batch_id"), *df.columns)
        out = one if out is None else out.unionByName(one)
    return out


def row_range(df: DataFrame, start: int, end: int = -1, n: int | None = None) -> DataFrame:
    """Rows [start, end); -1: to the end, more than there are: all. A start beyond the rows, or an end not after it, is an error."""
    n = df.count() if n is None else n
    end = n if end == -1 else min(end, n)
    if not 0 <= start < n or end <= start:
        raise ValueError(f"no rows from {start} to {end} of {n}")
    return df.where((F.col("row_id") >= start) & (F.col("row_id") < end))


def seeded(key: Column, seed: int) -> Column:
    """The place of a row in a shuffled order, the same in any engine."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")).cast("binary"))


def batches_until(df: DataFrame, step: str, group: str, enough: int) -> DataFrame:
    """Rows of the steps, in order, until `enough` different groups are there. What a step brings is counted before groups are joined; the step at which there are enough is one number, found in running sums over the steps."""
    first = df.groupBy(group).agg(F.min(step).alias(step))
    per = first.groupBy(step).agg(F.count("*").alias("n"))
    last = running_sum(per, F.col("n"), "upto", step).where(F.col("upto") >= enough).agg(F.min(step)).first()[0]
    return df if last is None else df.where(F.col(step) <= F.lit(last))


def saved(df: DataFrame, path: str, meta: dict | None = None) -> None:
    """A batch and what goes with it, as Parquet; never a pickle."""
    df.write.parquet(f"{path}/rows")
    df.sparkSession.createDataFrame([(json.dumps(meta or {}),)], "meta string").coalesce(1).write.json(f"{path}/meta")


def loaded(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """What saved() has written."""
    return spark.read.parquet(f"{path}/rows"), json.loads(spark.read.schema("meta string").json(f"{path}/meta").first()[0])
