"""Loaders by name: each reads one layout of an evaluation or training set into samples.

load(spark, name, path, **options) calls the loader registered under a name; users add
their own with @loader. A loader is a function of (spark, path, ...) that returns a
DataFrame, so that files are read by Spark's sources, wherever they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from quarry.operators import batch

LOADERS: dict[str, Callable[..., DataFrame]] = {}
IMAGE_MARK = "<image>\n"


def loader(name: str):
    """Registers a loader; a name can be taken once only."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if LOADERS.setdefault(name, f) is not f:
            raise ValueError(f"a loader named {name} is there already")
        return f

    return add


def load(spark: SparkSession, name: str, path: str, /, **options) -> DataFrame:
    if name not in LOADERS:
        raise ValueError(f"no loader named {name}; there are {', '.join(sorted(LOADERS))}")
    return LOADERS[name](spark, path, **options)


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """(file_path, file_name) of all files below a folder; their contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select(F.col("path").alias("file_path"), F.element_at(F.split("path", "/"), -1).alias("file_name"))


def with_existing(df: DataFrame, path: Column, images: str) -> DataFrame:
    """The rows whose file, by its name, lies below the folder images, and image_path, where it is (the first place in order)."""
    there = listed(df.sparkSession, images).groupBy("file_name").agg(F.min("file_path").alias("image_path"))
    return df.withColumn("file_name", F.element_at(F.split(path, "/"), -1)).join(there, "file_name").drop("file_name")


@loader("paired")
def paired(spark: SparkSession, path: str, kinds: tuple[str, ...] = ("direct_attributes", "relative_position"), name: str = r"^(.*)\.[^./]*$", contents: bool = False, lines: bool = False) -> DataFrame:
    """Images with a JSON file (or JSON Lines) beside each, in a folder for each kind; the first option is the answer. name: what of a path both files have alike. Images without a file, and files without an image, are left out."""
    schema = "question string, options array<string>, bbox array<array<double>>, target_object array<string>"
    stem = lambda c: F.regexp_extract(c, name, 1)
    found = []
    for kind in kinds:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{path}/{kind}").where(~F.col("path").endswith(".json"))
        notes = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("multiLine", not lines).json(f"{path}/{kind}").select("*", stem(F.col("_metadata.file_path")).alias("stem"))
        found.append(files.select(F.col("path").alias("image_path"), *(["content"] if contents else []), stem(F.col("path")).alias("stem")).join(notes, "stem").withColumn("test_type", F.lit(kind)))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    image = F.element_at(F.split("image_path", "/"), -1)
    return out.withColumns({"image": image, "index": F.concat("test_type", F.lit("/"), image), "answer": F.coalesce(F.get("options", F.lit(0)), F.lit("")), "bbox": F.coalesce("bbox", F.array()), "target_object": F.coalesce("target_object", F.array())}).drop("stem")


@loader("multiple_choice_records")
def multiple_choice_records(spark: SparkSession, path: str, images: str | None = None, lines: bool = False) -> DataFrame:
    """One JSON array (or JSON Lines) of records with names of their own; options lose the '(A)' of their place. Another kind of question fails."""
    schema = "index string, `Question Type` string, Image string, Text string, `Answer choices` array<string>, Question_id string, `Ground truth` string, Category string"
    raw = spark.read.schema(schema).option("multiLine", not lines).json(path)  # names are matched whatever their case
    kind = F.col("Question Type")
    checked = F.when(kind == "Multiple Choice", F.col("Text")).otherwise(F.raise_error(F.concat(F.lit("not a multiple-choice question: "), F.coalesce("Question_id", F.lit("?")))).cast("string"))
    options = F.transform("Answer choices", lambda x, i: F.trim(F.replace(x, F.concat(F.lit("("), F.chr(i.cast("long") + 65), F.lit(")")), F.lit(""))))
    out = raw.select(F.coalesce("index", "Question_id").alias("index"), checked.alias("question"), options.alias("options"), F.col("Ground truth").alias("answer"), F.col("Category").alias("category"), F.col("Image").alias("image_path"))
    return with_existing(out.withColumnRenamed("image_path", "__image"), F.col("__image"), images).drop("__image") if images else out


def _question(c: Column) -> Column:
    return F.when(c.startswith(IMAGE_MARK), F.substr(c, F.lit(len(IMAGE_MARK) + 1))).otherwise(c)


@loader("problem_records")
def problem_records(spark: SparkSession, path: str, images: str | None = None, lines: bool = False) -> DataFrame:
    """One JSON array (or JSON Lines) of problem, images, solution, doc_id, data_source; without the image's mark. images: a folder; records whose image isn't there are left out."""
    raw = spark.read.schema("problem string, images array<string>, solution string, doc_id string, data_source string").option("multiLine", not lines).json(path)
    one = F.when(F.size("images") == 1, F.get("images", F.lit(0))).otherwise(F.raise_error(F.concat(F.lit("not one image: "), F.coalesce("doc_id", F.lit("?")))).cast("string"))
    out = raw.select(F.coalesce("doc_id", F.lit("")).alias("index"), _question(F.coalesce("problem", F.lit(""))).alias("question"), F.array().cast("array<string>").alias("options"), F.coalesce("solution", F.lit("")).alias("answer"), F.coalesce("data_source", F.lit("problems")).alias("category"), one.alias("__image"))
    found = with_existing(out, F.col("__image"), images).drop("__image") if images else out.withColumnRenamed("__image", "image_path")
    return found.withColumn("cycle_category", F.col("image_path"))


@loader("grounded_rows")
def grounded_rows(spark: SparkSession, path: str, key: str, start: int = 0, end: int = -1, base: str | None = None) -> DataFrame:
    """Parquet rows from start up to end (-1: the last) in the order of key; index is the row's place. base: the folder that relative paths start from."""
    rows = batch.with_row_id(spark.read.parquet(path), key)
    part = rows.where((F.col("row_id") >= start) & ((F.col("row_id") < end) if end >= 0 else F.lit(True)))
    problem = F.trim(F.coalesce("problem", F.lit("")))
    full = lambda p: F.when(p.startswith("/") | F.lit(base is None), p).otherwise(F.concat(F.lit(f"{base}/"), p))
    return part.select(F.col("row_id").alias("index"), F.trim(_question(problem)).alias("question"), problem.alias("problem"), F.coalesce(F.col("answer").cast("string"), F.lit("")).alias("answer"), F.when(F.size("target_instances") > 0, F.col("target_instances")).alias("target_instances"), F.transform("images", full).alias("image_paths"))


@loader("question_lines")
def question_lines(spark: SparkSession, path: str, schema: str, images: str) -> DataFrame:
    """JSON Lines of samples with image_path below the folder images; index is taken from id where there is none."""
    raw = spark.read.schema(schema).json(path)
    index = F.coalesce("index", F.col("id").cast("string")) if "index" in raw.columns and "id" in raw.columns else F.col("index" if "index" in raw.columns else "id").cast("string")
    return raw.withColumns({"index": index, "image_path": F.concat(F.lit(images.rstrip("/") + "/"), "image_path")}).drop("id")


@loader("preferences")
def preferences(spark: SparkSession, path: str | list[str], prompt: str = "prompt", chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """(prompt, chosen, rejected) of Parquet files."""
    return spark.read.parquet(*([path] if isinstance(path, str) else path)).select(F.col(prompt).alias("prompt"), F.col(chosen).alias("chosen"), F.col(rejected).alias("rejected"))


@loader("chats")
def chats(spark: SparkSession, path: str | list[str], messages: str = "messages") -> DataFrame:
    """messages (role, content) of Parquet files; lists that hold one list each are taken out of it. Other columns stay."""
    rows = spark.read.parquet(*([path] if isinstance(path, str) else path))
    while isinstance(kind := rows.schema[messages].dataType, ArrayType) and isinstance(kind.elementType, ArrayType):
        rows = rows.withColumn(messages, F.when(F.size(messages) == 1, F.get(messages, F.lit(0))).otherwise(F.flatten(messages)))
    return rows.withColumnRenamed(messages, "messages")
