"""Readers of the formats that data sets come in, and writers that never read what they overwrite."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry import shared


#: Rows of a file that a query writes for itself: a file each would cost more than what is in it.
ROWS_A_FILE = 1000


def new_folder(spark: SparkSession, what: str) -> str:
    """A folder that all executors see, below the session's shared one."""
    return f"{shared.root(spark)}/quarry-{what}-{uuid.uuid4().hex}"


def parquet_files(spark: SparkSession, paths: list[str], schema: str | None = None, keys: list[str] | None = None) -> DataFrame:
    """Rows of all files, with the columns of a declared schema; keys: nested columns as dotted paths, named by their last part."""
    rows = (spark.read.schema(schema) if schema else spark.read).parquet(*paths)
    return rows.select(*(F.col(k).alias(k.rpartition(".")[2]) for k in keys)) if keys else rows


def json_lines(spark: SparkSession, path: str, schema: str | None = None, lineage: bool = False) -> DataFrame:
    """JSON Lines of a file, folder or glob; lineage adds src_file, the name of each row's file."""
    rows = (spark.read.schema(schema) if schema else spark.read).json(path)
    return rows.select("*", F.col("_metadata.file_name").alias("src_file")) if lineage else rows


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that holds one JSON array of records."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def tsv(spark: SparkSession, path: str, schema: str, image: str | None = None, json: dict[str, str] | None = None) -> DataFrame:
    """Tab-separated rows under a header; image: a column in base64, read as bytes; json: columns with their types."""
    rows = spark.read.schema(schema).option("sep", "\t").option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    if image:
        rows = rows.withColumn(image, F.unbase64(image))
    for name, kind in (json or {}).items():
        rows = rows.withColumn(name, F.from_json(name, kind))
    return rows


def by_stem(files: DataFrame, notes: DataFrame, file: str, note: str) -> DataFrame:
    """Rows of both whose file names agree without folder and ending."""
    stem = lambda c: F.regexp_extract(c, r"([^/]+?)(\.[^./]*)?$", 1)
    return files.withColumn("stem", stem(F.col(file))).join(notes.withColumn("stem", stem(F.col(note))), "stem")


def split_slice(df: DataFrame, key: str, start: float, end: float) -> DataFrame:
    """Rows from one share of the table to another, in the order of key, as train[25%:75%] takes them. Places are shifted counts, as in batch.with_row_id."""
    from quarry.operators.batch import with_row_id

    rows = with_row_id(df, key)
    n = rows.count()
    return rows.where((F.col("row_id") >= round(start * n)) & (F.col("row_id") < round(end * n))).drop("row_id")


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """new, and the rows of old whose key new doesn't have."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def write_capped(df: DataFrame, path: str, file_bytes: int, row_bytes: int) -> None:
    """Parquet files of at most about file_bytes, by the mean size of a row."""
    df.write.option("maxRecordsPerFile", max(1, file_bytes // max(1, row_bytes))).parquet(path)


def sizes(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the Parquet files of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    return [(r["path"], r["length"]) for r in files.select("path", "length").collect()]


def write_measured(df: DataFrame, path: str, file_bytes: int, rows: int, shrink: float = 0.7, tries: int = 40) -> list[str]:
    """df as Parquet files of file_bytes at most, below path; returns the folders that hold it, which are read together.

    Files are written with so many rows, then measured; the rows of those over the cap
    are written again with `shrink` times as many rows a file, and so on, until none is
    over it or a file has one row. Files within the cap are written once.
    """
    spark, kept, todo, where = df.sparkSession, [], df, 0
    while True:
        out = f"{path}/try={where}"
        todo.write.option("maxRecordsPerFile", max(1, rows)).parquet(out)
        over = [p for p, n in sizes(spark, out) if n > file_bytes]
        if not over or rows <= 1 or where == tries:
            return [*kept, out]
        fine = [p for p, n in sizes(spark, out) if n <= file_bytes]
        kept += fine
        todo, rows, where = spark.read.schema(df.schema).parquet(*over), int(rows * shrink), where + 1


def write_back(df: DataFrame, path: str, kind: str = "json") -> str:
    """df beside what it may have been read from: a new folder below path, which is returned; readers take the newest."""
    out = f"{path}/{uuid.uuid4().hex}"
    getattr(df.write, kind)(out)
    return out


def flattened(df: DataFrame, sep: str = "/") -> DataFrame:
    """Nested fields as columns, named by their path."""

    def leaves(schema, path):
        for f in schema.fields:
            at = [*path, f.name]
            if hasattr(f.dataType, "fields"):
                yield from leaves(f.dataType, at)
            else:
                yield F.col(".".join(f"`{x}`" for x in at)).alias(sep.join(at))

    return df.select(*leaves(df.schema, []))


def first_of_each(df: DataFrame, group: str, order: str, k: int) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("__n") <= k).drop("__n")


def result_path(folder: str, model: str, name: str, start: int = 0, end: int = -1) -> str:
    """Where results of a run are kept; a part of the rows is named by its range."""
    return f"{folder}/{model}/{name}" + (f"_{start}_{end}" if (start, end) != (0, -1) else "") + ".jsonl"
