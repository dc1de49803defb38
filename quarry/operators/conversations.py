"""Checks of whole conversations, with the first rule that each breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import occurrences

CALL = "struct<name:string,arguments:struct<bboxes:array<array<double>>>>"


def call_boxes(c: Column) -> Column:
    """The boxes of a text's first tool call, which may be written with single quotes; null without a call that has some."""
    call = F.regexp_extract(c, r"(?s)<tool_call>(.*?)</tool_call>", 1)
    read = lambda x: F.from_json(x, CALL)["arguments"]["bboxes"]
    return F.coalesce(read(call), read(F.translate(call, "'", '"')))


def conversation_faults(turns: DataFrame, boxes: DataFrame, conv: str = "conv_id", pos: str = "turn", role: str = "role", text: str = "text", box: str = "box", model: str = "gpt", tool: str = "human") -> DataFrame:
    """(conv, n_turns, at, reason) of each conversation: its first fault and the turn that has it; both null if there is none.

    turns: one row a turn, places counted from 0 without gaps. boxes: (conv, box), a row
    for each box that the calls must have between them, as often as it is there. The
    conversation as a whole is looked at first, then its turns in order, then whether
    roles take turns, then the boxes. A turn is compared with the next by a join on
    its place, and boxes by their counts, so that one long conversation is dealt over
    many tasks; texts aren't shuffled.
    """
    has = lambda mark: F.contains(F.col(text), F.lit(mark))
    response = F.regexp_extract(F.col(text), r"(?s)<tool_response>(.*?)</tool_response>", 1)
    matched = lambda tag: F.col(text).rlike(rf"(?s)<{tag}>.*?</{tag}>")
    seen = turns.select(
        F.col(conv).alias("conv"), F.col(pos).cast("long").alias("pos"), F.col(role).alias("role"),
        (has("<think>") & has("</think>")).alias("thought"), has("<answer>").alias("answer"), has("</answer>").alias("answered"),
        has("<tool_call>").alias("opens"), has("</tool_call>").alias("closes"), matched("tool_call").alias("calls"), call_boxes(F.col(text)).alias("boxes"),
        (has("<tool_response>") & has("</tool_response>")).alias("responds"), matched("tool_response").alias("response"), occurrences(response, "<image>").alias("images"), has("<image>").alias("image"),
    )
    after = seen.select("conv", (F.col("pos") - 1).alias("pos"), F.col("role").alias("next_role"), F.col("response").alias("next_response"), F.col("images").alias("next_images"))
    both = seen.join(after, ["conv", "pos"], "left")
    ours, theirs, last = F.col("role") == model, F.col("role") == tool, F.col("next_role").isNull()
    calls = ours & F.col("opens") & F.col("closes") & F.col("calls")
    rules = [
        (1, "starts with another role", (F.col("pos") == 0) & ~ours),
        (2, "ends with another role", last & ~ours),
        (3, "ends without an answer", last & ~F.col("answer")),
        (4, "no thought", ours & ~F.col("thought")),
        (4, "open call", ours & F.col("opens") & ~F.col("closes")),
        (4, "call without boxes", calls & F.col("boxes").isNull()),
        (4, "not 1 to 3 boxes", calls & ~F.size("boxes").between(1, 3)),
        (4, "call without a response", calls & (last | (F.col("next_role") != tool))),
        (4, "response without tags", calls & ~F.col("next_response")),
        (4, "not as many images as boxes", calls & (F.col("next_images") != F.size("boxes"))),
        (4, "answer not closed", ours & last & ~F.col("answered")),
        (4, "response without tags", theirs & ~F.col("responds")),
        (4, "response without an image", theirs & ~F.col("image")),
        (4, "unknown role", ~ours & ~theirs),
        (5, "roles don't take turns", F.col("role") == F.col("next_role")),
    ]
    broken = F.array_compact(F.array(*(F.when(holds, F.struct(F.lit(phase).alias("phase"), F.col("pos").alias("at"), F.lit(n).alias("rule"), F.lit(reason).alias("reason"))) for n, (phase, reason, holds) in enumerate(rules))))
    turns_of = both.groupBy("conv").agg(F.count("*").alias("n_turns"), F.min(F.array_min(broken)).alias("first"))
    said = seen.where((F.col("role") == model) & F.col("opens")).select("conv", F.explode("boxes").alias("box"), F.lit(-1).alias("n"))
    wanted = boxes.select(F.col(conv).alias("conv"), F.col(box).cast("array<double>").alias("box"), F.lit(1).alias("n"))
    differ = wanted.unionByName(said).groupBy("conv", "box").agg(F.sum("n").alias("n")).where("n <> 0").groupBy("conv").agg(F.sum("n").alias("more"))
    fault = F.when(F.col("n_turns") < 3, F.struct(F.lit(None).cast("long").alias("at"), F.lit("fewer than 3 turns").alias("reason"))).when(F.col("first").isNotNull(), F.struct("first.at", "first.reason"))
    of_boxes = F.when(F.col("more").isNotNull(), F.struct(F.lit(None).cast("long").alias("at"), F.when(F.col("more") != 0, "another number of boxes").otherwise("other boxes").alias("reason")))
    return turns_of.join(differ, "conv", "left").withColumn("fault", F.coalesce(fault, of_boxes)).select(F.col("conv").alias(conv), "n_turns", "fault.at", "fault.reason")


def trajectory_verdicts(attempts: DataFrame, sample: str = "sample", attempt: str = "attempt", role: str = "assistant") -> DataFrame:
    """(sample, attempt, good, reason) of every attempt, by the first rule that fits.

    attempts: sample, attempt, correct (1 or not), turns (array of role, content), bad
    (whether its boxes are). An attempt must be right, its turns well formed and its
    boxes fair. A right one that stands alone is good. Where another right attempt
    needed one turn only, an attempt is good if it called no tool. What other attempts
    did is summed by sample and joined back.
    """
    said = F.transform(F.filter("turns", lambda t: t["role"] == role), lambda t: F.btrim(t["content"], F.lit(" \t\n\r\x0b\x0c")))
    after = lambda m: F.btrim(F.element_at(F.split(F.element_at(F.split(m, "<think>", -1), -1), "</think>", -1), -1), F.lit(" \t\n\r\x0b\x0c"))
    thought = lambda m: m.startswith("<think>") & ~m.endswith("</think>") & (F.size(F.split(F.element_at(F.split(m, "<think>", -1), -1), "</think>", -1)) == 2)
    block = lambda x, tag: x.startswith(f"<{tag}>") & x.endswith(f"</{tag}>")
    formed = F.forall(said, lambda m: thought(m) & (block(after(m), "answer") | block(after(m), "tool_call")))
    seen = attempts.select(F.col(sample), F.col(attempt), (F.coalesce("correct", F.lit(0)) == 1).alias("right"), formed.alias("formed"), F.exists(said, lambda m: block(after(m), "tool_call")).alias("called"), F.size(said).alias("n"), F.coalesce("bad", F.lit(False)).alias("bad"))
    short = F.col("right") & (F.col("n") < 2)
    of = seen.groupBy(sample).agg(F.count_if("right").alias("n_right"), F.count_if(short).alias("n_short"))
    both = seen.join(of, sample)
    others = F.col("n_short") - F.when(short, 1).otherwise(0)
    verdict = lambda good, reason: F.struct(good.alias("good"), F.lit(reason).alias("reason"))
    yes, no = F.lit(True), F.lit(False)
    found = F.when(~F.col("right"), verdict(no, "non_correct_sample")).when(~F.col("formed"), verdict(no, "wrong_format")).when(F.col("bad"), verdict(no, "bad_bboxes")).when(F.col("n_right") == 1, verdict(yes, "only_correct_trajectory")).when(others > 0, verdict(~F.col("called"), "other correct trajectory no focus")).otherwise(verdict(yes, "good_trajectory"))
    return both.withColumn("verdict", found).select(sample, attempt, "verdict.good", "verdict.reason")


GROUNDING = "struct<bbox_2d:array<double>,source:string>"


def cold_start(turns: DataFrame, sizes: DataFrame, conv: str = "conv_id", pos: str = "turn", role: str = "role", text: str = "text", most_short: int = 3) -> tuple[DataFrame, DataFrame]:
    """(conv, reason) of all conversations, reason null for those kept, and the kept ones' turns with groundings made tool calls.

    sizes: (conv, width, height) of the image. A conversation goes if it has most_short
    turns or fewer, if a model's turn holds neither a grounding nor an answer, if a
    grounding isn't JSON with a source, or if one is about what an earlier one showed:
    the first of these. Shares of the sides become whole pixels, cut off.
    """
    ground = F.regexp_extract(F.col(text), r"(?s)<grounding>(.*?)</grounding>", 1)
    read = F.from_json(ground, GROUNDING)
    has = lambda tag: F.contains(F.col(text), F.lit(f"<{tag}>")) & F.contains(F.col(text), F.lit(f"</{tag}>"))
    ours = F.col(role) == "gpt"
    faults = turns.groupBy(conv).agg(
        F.count("*").alias("n"), F.max(ours & ~has("grounding") & ~has("answer")).alias("format"), F.max(ours & has("grounding") & read["source"].isNull()).alias("grounding"), F.max(ours & has("grounding") & F.contains(read["source"], F.lit("observation_"))).alias("second")
    )
    reason = F.when(F.col("n") <= most_short, "length").when(F.col("format"), "format").when(F.col("grounding"), "grounding").when(F.col("second"), "second-order grounding")
    judged = faults.select(conv, reason.alias("reason"))
    kept = turns.join(judged.where("reason is null").select(conv), conv, "left_semi").join(sizes, conv)
    pixels = F.transform(read["bbox_2d"], lambda v, i: (v * F.when(i % 2 == 0, F.col("width")).otherwise(F.col("height"))).cast("long"))
    call = F.concat(F.lit('<tool_call>\n{"name": "focus", "arguments": {"bboxes": [['), F.array_join(pixels.cast("array<string>"), ", "), F.lit("]]}}\n</tool_call>"))
    thought = F.regexp_extract(F.col(text), r"(?s)<think>(.*?)</think>", 1)
    out = F.when(ours & has("grounding"), F.concat(F.lit("<think>"), thought, F.lit("</think>\n"), call)).otherwise(F.col(text))
    return judged, kept.select(conv, pos, role, out.alias(text))


def tags_and_images(turns: DataFrame, images: DataFrame, conv: str = "conv_id", role: str = "role", text: str = "text", others: str = "gpt", tag: str = "<image>") -> DataFrame:
    """(conv, found, wanted, agrees): how often the tag stands in a conversation's turns but those of the role others, against (conv, wanted), the number of its images; none where it has no row there."""
    found = turns.groupBy(conv).agg(F.sum(F.when(F.col(role) != others, occurrences(F.col(text), tag)).otherwise(0)).alias("found"))
    both = found.join(images.select(conv, F.col("wanted").cast("long").alias("wanted")), conv, "left").withColumn("wanted", F.coalesce("wanted", F.lit(0).cast("long")))
    return both.withColumn("agrees", F.col("found") == F.col("wanted"))


def repathed(rows: DataFrame, base: str, system: str | None = None, images: str = "images", turns: str = "conversations") -> DataFrame:
    """rows with relative image paths below base, and, if one is given, another system prompt in every system turn (from, value); rows without turns or images stay as they are."""
    full = F.transform(images, lambda p: F.when(p.startswith("/"), p).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), p)))
    out = rows.withColumn(images, full)
    if system is None:
        return out
    return out.withColumn(turns, F.transform(turns, lambda t: t.withField("value", F.when(t["from"] == "system", F.lit(system)).otherwise(t["value"]))))
