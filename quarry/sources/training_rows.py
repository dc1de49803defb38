"""The row that training reads, and the conversion of five shapes of source to it.

A converter takes raw rows, each with its image (bytes, path), and returns the row's
columns, key and reject: the first rule that the row breaks, null if none. A
rejected row's other columns may be null. Nothing is dropped: accepted() and
rejected() tell the rows apart. Sides are read from the image's header; the overview
is given as its scale and budget, and resize, a function of (bytes, width, height)
columns, may make its pixels.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.functions import geometry, images, text

ROW = """prompt array<struct<role:string,content:string>>, images array<struct<bytes:binary,path:string>>, ability string, env_name string, data_source string,
 reward_model struct<ground_truth:array<string>,style:string,ground_truth_bboxes:array<array<double>>,question:string,path:string>,
 extra_info struct<answer:array<string>,index:string,options:array<string>,question:string,seed_img:struct<bytes:binary,scale:array<double>>,split:string,orig_path:string,pixel_budget_per_image:bigint>"""
#: Pixels that an image may have at all, and as an overview.
MOST_PIXELS, USUAL_PIXELS = 16384 * 28 * 28, 448 * 448


class Task(NamedTuple):
    """What a converter writes into every row."""

    data_source: str
    ability: str = "vqa"
    env_name: str = "focus"
    split: str = "train"
    system: str = "You are a helpful assistant."
    user: str = "<image>\nThink first, then answer. Here is the question:\n"
    most: int = MOST_PIXELS
    usual: int = USUAL_PIXELS
    ratio: float | None = None
    resize: Callable[[Column, Column, Column], Column] | None = None


def _rows(parts: DataFrame, task: Task, least: int = 0, most: int | None = None, budget: int | None = None) -> DataFrame:
    """parts: key, image, question, options, tail (what the prompt has after the question), answer, truth, boxes, index, path, ability and fault, the first rule broken besides those of the image."""
    w, h, area = F.col("size.width"), F.col("size.height"), F.col("size.width") * F.col("size.height")
    sized = parts.withColumn("size", images.image_size(F.col("image.bytes")))
    within = (area > least) if most is None else (area > least) & (area <= most)
    rules = [("no image", F.length("image.bytes") > 0), ("unreadable image", area > 0), ("pixels", within)]
    fault = F.coalesce(*(F.when(~F.coalesce(holds, F.lit(False)), reason) for reason, holds in rules), "fault")
    allowed = geometry.budget(w, h, F.lit(task.ratio).cast("double"), task.most, task.usual) if budget is None else F.lit(budget)
    seen = sized.withColumn("budget", allowed.cast("long")).withColumn("view", F.when(area > 0, geometry.constrained(w, h, F.col("budget"))))
    overview = F.col("image.bytes") if task.resize is None else task.resize(F.col("image.bytes"), F.col("view.width"), F.col("view.height"))
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    style = F.when(F.size("options") > 0, "multiple_choice").otherwise("free_form")
    prompt = F.array(turn("system", F.lit(task.system)), turn("user", F.concat(F.lit(task.user), "question", "tail")))
    reward = F.struct(F.col("truth").alias("ground_truth"), style.alias("style"), F.col("boxes").alias("ground_truth_bboxes"), "question", F.lit(None).cast("string").alias("path"))
    seed = F.struct(F.col("image.bytes").alias("bytes"), F.array("view.scale_x", "view.scale_y").alias("scale"))
    extra = F.struct("answer", "index", "options", "question", seed.alias("seed_img"), F.lit(task.split).alias("split"), F.col("path").alias("orig_path"), F.col("budget").alias("pixel_budget_per_image"))
    picture = F.array(F.struct(overview.alias("bytes"), F.lit(None).cast("string").alias("path")))
    return seen.select("key", fault.alias("reject"), prompt.alias("prompt"), picture.alias("images"), F.coalesce("ability", F.lit(task.ability)).alias("ability"), F.lit(task.env_name).alias("env_name"), F.lit(task.data_source).alias("data_source"), reward.alias("reward_model"), extra.alias("extra_info"))


def _parts(raw: DataFrame, key: str, asked: Column, tail, **columns: Column) -> DataFrame:
    """The columns that _rows takes; asked: (question, options), tail: from the options to the prompt's end. Those not given are null."""
    given = raw.withColumn("__asked", asked)
    kinds = {"answer": "array<string>", "truth": "array<string>", "boxes": "array<array<double>>", "index": "string", "path": "string", "ability": "string", "fault": "string"}
    options = F.col("__asked.options")
    return given.select(F.col(key).alias("key"), columns.pop("image").alias("image"), F.col("__asked.question").alias("question"), options.alias("options"), F.when(F.size(options) > 0, tail(options)).otherwise("").alias("tail"), *(columns.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()))


def _first_fault(*rules: tuple[str, Column]) -> Column:
    return F.coalesce(*(F.when(~F.coalesce(holds, F.lit(False)), reason) for reason, holds in rules))


def _choices(options: Column) -> Column:
    return F.concat(F.lit(" choices: "), _lettered(options, ", "))


def _lettered(options: Column, sep: str) -> Column:
    return F.array_join(F.transform(options, lambda x, i: F.concat(F.chr(i.cast("long") + 65), F.lit(": "), x)), sep)


def _asked(c: Column) -> Column:
    c = F.replace(c, F.lit("<image>"), F.lit(""))
    options = text.option_parts(c)
    return F.struct(text.question_part(c).alias("question"), F.when(F.size(options) > 0, options).alias("options"))


def problem_rows(raw: DataFrame, task: Task, key: str = "key", least: int = 512 * 512, most: int | None = None) -> DataFrame:
    """From problem, solution, doc_id, image: the options are named in the problem, the solution is the one answer."""
    rules = (("no problem", text.stripped(F.col("problem")) != ""), ("no solution", F.col("solution").isNotNull()))
    parts = _parts(raw, key, _asked(F.col("problem")), _choices, image=F.col("image"), answer=F.array("solution"), truth=F.array("solution"), index=F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row_"), F.col(key).cast("string"))), path=F.col("image.path"), fault=_first_fault(*rules))
    return _rows(parts, task, least, most)


def grounded_rows(raw: DataFrame, task: Task, key: str = "key", least: int = 512 * 512) -> DataFrame:
    """From problem, answer, target_instances (an array of structs with bbox), image: the boxes of all instances, null without any."""
    boxes = F.filter(F.transform("target_instances", lambda x: x["bbox"]), lambda b: b.isNotNull())
    rules = (("no problem", text.stripped(F.col("problem")) != ""), ("no answer", F.col("answer").isNotNull()))
    parts = _parts(raw, key, _asked(F.col("problem")), _choices, image=F.col("image"), answer=F.array("answer"), truth=F.array("answer"), boxes=F.when(F.size(boxes) > 0, boxes), index=F.concat(F.lit(f"{task.data_source}_"), F.col(key).cast("string")), path=F.col("image.path"), fault=_first_fault(*rules))
    return _rows(parts, task, least)


def boxed_rows(raw: DataFrame, task: Task, key: str = "key", least: int = 512 * 512, most: int | None = None) -> DataFrame:
    """From images, extra_info (question, answer, index), reward_model (ground_truth, ground_truth_bboxes): options after 'choices:', answer and truth in a box."""
    rules = (("no choices", text.chosen_from(F.col("extra_info.question")).isNotNull()), ("answer not boxed", text.boxed_part(F.col("extra_info.answer")).isNotNull()), ("truth not boxed", text.boxed_part(F.col("reward_model.ground_truth")).isNotNull()))
    parts = _parts(raw, key, text.chosen_from(F.col("extra_info.question")), lambda o: _lettered(o, "\n"), image=F.get("images", F.lit(0)), answer=F.array(text.boxed_part(F.col("extra_info.answer"))), truth=F.array(text.boxed_part(F.col("reward_model.ground_truth"))), boxes=F.array("reward_model.ground_truth_bboxes"), index=F.col("extra_info.index"), fault=_first_fault(*rules))
    return _rows(parts, task, least, most)


def chart_rows(raw: DataFrame, task: Task, key: str = "key", least: int = 256 * 256) -> DataFrame:
    """From images, ability, extra_info (question, answer, index), reward_model (ground_truth): options in any form; a question with options needs a letter for its answer."""
    asked = text.labelled_options(F.col("extra_info.question"))
    options, said, truth = asked["options"], F.col("extra_info.answer"), F.coalesce("reward_model.ground_truth", "extra_info.answer")
    letter = text.choice_letter(said)
    as_list = lambda c: F.when(c.isNull(), F.array().cast("array<string>")).otherwise(F.array(c))
    rules = (("no question", text.stripped(F.col("extra_info.question")) != ""), ("empty question", asked["question"] != ""), ("no letter", options.isNull() | letter.isNotNull()))
    answers = F.when(options.isNull(), as_list(said)).otherwise(F.array(letter))
    truths = F.when(options.isNull(), as_list(truth)).otherwise(F.array(F.coalesce(text.choice_letter(truth), letter)))
    parts = _parts(raw, key, asked, lambda o: F.concat(F.lit("\n"), _lettered(o, "\n")), image=F.get("images", F.lit(0)), answer=answers, truth=truths, index=F.col("extra_info.index"), ability=F.col("ability"), fault=_first_fault(*rules))
    return _rows(parts, task, least)


def sample_rows(raw: DataFrame, task: Task, key: str = "key") -> DataFrame:
    """From an evaluation's samples: index, question, options, answer (an array), image. The budget is the overview's whatever the image's size."""
    asked = F.struct("question", F.when(F.size("options") > 0, F.col("options")).alias("options"))
    parts = _parts(raw, key, asked, _choices, image=F.col("image"), answer=F.col("answer"), truth=F.col("answer"), index=F.coalesce(F.col("index").cast("string"), F.lit("")), path=F.col("image.path"), fault=_first_fault(("no question", F.col("question").isNotNull())))
    return _rows(parts, task._replace(split="eval"), budget=task.usual)


def conformed(rows: DataFrame) -> DataFrame:
    """Rows in the declared schema: missing columns and fields are null, an index of another type becomes text."""
    return rows.to(StructType.fromDDL(ROW))


def accepted(*converted: DataFrame) -> DataFrame:
    """The training rows of all converted sources, in the declared schema."""
    return reduce(DataFrame.unionByName, (conformed(c.where("reject is null").drop("key", "reject")) for c in converted))


def rejected(*converted: DataFrame) -> DataFrame:
    """(data_source, key, reject) of the rows that aren't training rows."""
    return reduce(DataFrame.unionByName, (c.where("reject is not null").select("data_source", F.col("key").cast("string").alias("key"), "reject") for c in converted))
