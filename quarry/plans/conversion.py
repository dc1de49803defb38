"""Queries over conversions to the training row: raw rows of each shape are made from conversations' whole texts, with pictures of many sizes, and what breaks a rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.plans.catalog import query
from quarry.plans.texts import strip
from quarry.sources import training_rows as rows
from quarry.tables import table

#: Expressions that both engines read alike.
RAW = {
    "key": "conv_id * 1000 + turn",
    "w": "60 + (conv_id * 137 + turn * 91) % 1500",
    "h": "60 + (conv_id * 53 + turn * 217) % 1200",
    "picture": "case (conv_id + turn) % 13 when 0 then 'none' when 1 then 'broken' else 'png' end",
    "said": "case conv_id % 5 when 0 then 'B' when 1 then '(A)' when 2 then 'Answer: B.' when 3 then role end",
    "meant": "case turn % 3 when 0 then 'A' when 1 then cast(null as varchar(9)) else 'the ' || role end",
    "boxed": "case conv_id % 4 when 0 then 'so \\boxed{' || role || '} {x}' when 1 then '\\fboxed{' || text when 2 then text else 'oxed{}' end",
    "form": "case (conv_id * 7 + turn) % 8 when 0 then text || ' Options:' || chr(10) || '(B) ' || role || chr(10) || '(A) x' || conv_id when 1 then text || ' choices: B: ' || role || ', A: y' || turn || ',' when 2 then 'Pick. A. ' || role || chr(10) || 'B) ' || text when 3 then text || chr(10) || 'OPTIONS:' || chr(10) || ' one ' || chr(10) || chr(10) || 'two' when 4 then ' ' when 5 then '<image> choices: ' || text when 6 then '(A)' || text || ' C: ' || role || ' D. e D) f' else '<image>' || text end",
}
RAW_SQL = "raw as (select conv_id, turn, role, text, " + ", ".join(f"{e} as {c}" for c, e in RAW.items()) + " from conversations)"
TASK = rows.Task("asked")
NL = "chr(10)"


def raw(spark, d) -> DataFrame:
    """RAW's columns, and image: a PNG header of the sides, broken bytes, or none."""
    sides = F.concat(*(F.lpad(F.hex(F.col(c).cast("long")), 8, "0") for c in ("w", "h")))
    png = F.unhex(F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), sides))
    some = table(spark, d, "conversations").selectExpr("conv_id", "turn", "role", "text", *(f"{e.replace(chr(92), chr(92) * 2)} as {c}" for c, e in RAW.items()))
    data = F.when(F.col("picture") == "png", png).when(F.col("picture") == "broken", F.lit("no picture").cast("binary"))
    return some.withColumn("image", F.struct(data.alias("bytes"), F.concat(F.lit("images/"), F.col("key").cast("string"), F.lit(".png")).alias("path")))


def told(df: DataFrame, **more: Column) -> DataFrame:
    """What is compared of converted rows: of those rejected only why."""
    ok = F.col("reject").isNull()
    shown = {
        "source": F.col("data_source"), "style": F.col("reward_model.style"), "question": F.col("extra_info.question"), "options": F.array_join("extra_info.options", "|"), "answer": F.array_join("extra_info.answer", "|"), "truth": F.array_join("reward_model.ground_truth", "|"),
        "index": F.col("extra_info.index"), "split": F.col("extra_info.split"), "budget": F.col("extra_info.pixel_budget_per_image"), "scale_x": F.round(F.get("extra_info.seed_img.scale", F.lit(0)), 6), "scale_y": F.round(F.get("extra_info.seed_img.scale", F.lit(1)), 6), "asked": F.md5(F.element_at("prompt", -1)["content"].cast("binary")), "path": F.col("extra_info.orig_path"),
    }
    return df.select("key", "reject", *(F.when(ok, c).alias(name) for name, c in (shown | more).items()))


def side_sql(x: str, x0: str, most: str) -> str:
    return f"(case when w * h <= {most} then w * 0 + {x} when w0 * h0 <= {most} then {x0} else greatest(28, floor(floor({x} / sqrt(w * h / ({most} * 1.0))) / 28) * 28) end)"


def told_sql(asked: str, fault: str, answer: str, truth: str, index: str, tail: str, least: int, source: str = "asked", split: str = "train", path: str = "'images/' || key || '.png'", budget: str | None = None) -> str:
    """asked: SQL of a table asked with the columns of raw, question and options (a list or null); the rest: expressions over it."""
    budget = budget or f"(case when w * h > {rows.USUAL_PIXELS} then {rows.USUAL_PIXELS} else {rows.MOST_PIXELS} end)"
    inner = f"case when picture = 'none' then 'no image' when picture = 'broken' then 'unreadable image' when w * h <= {least} then 'pixels' else {fault} end"
    prompt = f"'{TASK.user.replace(chr(10), chr(39) + ' || chr(10) || ' + chr(39))}' || question || case when len(options) > 0 then {tail} else '' end"
    columns = {"source": f"'{source}'", "style": "case when len(options) > 0 then 'multiple_choice' else 'free_form' end", "question": "question", "options": "array_to_string(options, '|')", "answer": answer, "truth": truth, "index": index, "split": f"'{split}'", "budget": "budget", "scale_x": f"round({side_sql('w', 'w0', 'budget')} / w, 6)", "scale_y": f"round({side_sql('h', 'h0', 'budget')} / h, 6)", "asked": f"md5({prompt})", "path": path}
    return f"with {RAW_SQL}, {asked}, judged as (select *, {inner} as reject, {budget} as budget, greatest(28, round_even(w / 28.0, 0) * 28) as w0, greatest(28, round_even(h / 28.0, 0) * 28) as h0 from asked) select key, reject, " + ", ".join(f"case when reject is null then {e} end as {c}" for c, e in columns.items()) + " from judged"


LETTERED = f"array_to_string(list_transform(options, lambda x, i: chr(64 + i::int) || ': ' || x), {{sep}})"
CHOICES = "' choices: ' || " + LETTERED.format(sep="', '")


def problem_sql(c: str) -> str:
    """The question, its options in the order given, and their mark."""
    one = r"regexp_extract(s, '(?is)^(.*?)(?:options|choices):(.*)$', {})"
    marked = "regexp_matches(s, '(?i)(?:options|choices):')"
    trimmed = lambda pattern: f"list_transform(regexp_extract_all(rest, '{pattern}', 1), lambda x: {strip('x')})"
    lettered, listed = trimmed(r"\([A-Z]\)\s*([^\n]+)"), trimmed(r"[A-Z]:\s*([^,\n]+)")
    lines = f"list_filter(list_transform(string_split({strip('rest')}, {NL}), lambda x: {strip('x')}), lambda x: x <> '')"
    return f"""cut as (select *, replace({c}, '<image>', '') as s from raw), halves as (select *, {strip(f"case when {marked} then {one.format(1)} else s end")} as q, case when {marked} then {one.format(2)} end as rest from cut),
 listed as (select *, case when rest is null then null when len({lettered}) > 0 then {lettered} when len({listed}) > 0 then {listed} else {lines} end as found from halves),
 asked as (select *, case when q = '' or regexp_matches(q, '[?.]$') then q else q || '?' end as question, case when len(found) > 0 then found end as options from listed)"""


@query(told_sql(problem_sql("form"), f"case when {strip('form')} = '' then 'no problem' when said is null then 'no solution' end", "said", "said", "case when turn % 2 = 0 then 'doc' || key else 'row_' || key end", CHOICES, 512 * 512))
def c1_problem_rows(spark, d) -> DataFrame:
    doc = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("doc"), F.col("key").cast("string")))
    return told(rows.problem_rows(raw(spark, d).select("key", F.col("form").alias("problem"), F.col("said").alias("solution"), doc.alias("doc_id"), "image"), TASK))


@query(told_sql(problem_sql("form"), f"case when {strip('form')} = '' then 'no problem' when said is null then 'no answer' end", "said", "said", "'grounded_' || key", CHOICES, 512 * 512, source="grounded").replace(" from judged", ", case when reject is null and turn % 3 > 0 then (turn % 3)::bigint end as n_boxes, case when reject is null and turn % 3 > 0 then w + turn * 1.0 end as right_side from judged"))
def c2_grounded_rows(spark, d) -> DataFrame:
    """With up to two boxes; an instance without a box is left out."""
    box = lambda *v: F.array(*(F.col(x).cast("double") if isinstance(x, str) else x for x in v))
    zero, x2 = F.lit(0.0), (F.col("w") + F.col("turn")).cast("double")
    all_ = F.array(F.struct(box("turn", F.lit(1.5), x2, "h").alias("bbox")), F.struct(F.lit(None).cast("array<double>").alias("bbox")), F.struct(box(zero, zero, "w", "conv_id").alias("bbox")))
    instances = F.when(F.col("turn") % 3 == 1, F.slice(all_, 1, 2)).when(F.col("turn") % 3 == 2, all_)
    out = rows.grounded_rows(raw(spark, d).select("key", F.col("form").alias("problem"), F.col("said").alias("answer"), instances.alias("target_instances"), "image"), TASK._replace(data_source="grounded"))
    b = F.col("reward_model.ground_truth_bboxes")
    return told(out, n_boxes=F.when(b.isNotNull(), F.size(b).cast("long")), right_side=F.get(F.get(b, F.lit(0)), F.lit(2)))


BOXED_PART = "string_split(string_split({c}, 'oxed{{')[2], '}}')[1]"
CHOSEN_SQL = rf"""cut as (select *, regexp_matches(form, '(?i)choices:') as marked, trim(regexp_extract(form, '(?is)^(.*?)choices:(.*)$', 1), ' ?' || {NL}) as q, {strip("regexp_extract(form, '(?is)^(.*?)choices:(.*)$', 2)")} as rest from raw),
 parted as (select *, list_transform(regexp_extract_all(rest, '[A-Z]:\s*([^\n,]+(?:\n|,|$))', 1), lambda x: {strip(f"rtrim(x, ', ' || {NL})")}) as found from cut),
 asked as (select *, q || '?' as question, case when len(found) > 0 then found end as options from parted)"""


@query(told_sql(CHOSEN_SQL, f"case when not marked or q = '' then 'no choices' when {BOXED_PART.format(c='boxed')} is null then 'answer not boxed' when {BOXED_PART.format(c='meant_boxed')} is null then 'truth not boxed' end", BOXED_PART.format(c="boxed"), BOXED_PART.format(c="meant_boxed"), "'i' || key", LETTERED.format(sep=NL), 100 * 100, source="boxed", path="null").replace("raw as (select conv_id", "raw as (select case when turn % 4 < 3 then 'oxed{' || text || '}' else text end as meant_boxed, conv_id"))
def c3_boxed_rows(spark, d) -> DataFrame:
    meant = F.when(F.col("turn") % 4 < 3, F.concat(F.lit("oxed{"), "text", F.lit("}"))).otherwise(F.col("text"))
    extra = F.struct(F.col("form").alias("question"), F.col("boxed").alias("answer"), F.concat(F.lit("i"), F.col("key").cast("string")).alias("index"))
    reward = F.struct(meant.alias("ground_truth"), F.array(F.col("w").cast("double")).alias("ground_truth_bboxes"))
    return told(rows.boxed_rows(raw(spark, d).select("key", F.array("image").alias("images"), extra.alias("extra_info"), reward.alias("reward_model")), TASK._replace(data_source="boxed"), least=100 * 100))


def labelled_sql(c: str) -> str:
    """Options in the order of their letters; a letter's last text counts."""
    one = r"regexp_extract(s, '(?is)^(.*?)(?:options:|choices:)(.*)$', {})"
    mark = r"'(^|[^A-Z0-9])([A-E])\s*[.):]\s*', '\1' || chr(57344) || '\2' || chr(57345), 'g')"
    zipped = lambda p, t: f"list_zip(regexp_extract_all(rest, '{p}', 1), list_transform(regexp_extract_all(rest, '{p}', 2), lambda x: {t}))"
    lettered, listed = zipped(r"\(([A-Z])\)\s*([^\n]+)", strip("x")), zipped(r"([A-Z])\s*:\s*([^\n,]+(?:\n|,|$))", strip(f"rtrim(x, ', ' || {NL})"))
    lines = f"list_filter(list_transform(string_split(rest, {NL}), lambda x: {strip('x')}), lambda x: x <> '')"
    last = "list_transform(list_sort(list_distinct(list_transform({z}, lambda e: e[1]))), lambda k: list_filter({z}, lambda e: e[1] = k)[-1][2])"
    return f"""cut as (select *, {strip(f"replace(coalesce({c}, ''), '<image>', '')")} as s from raw),
 halves as (select *, regexp_matches(s, '(?i)(?:options:|choices:)') as marked, {strip(one.format(2))} as rest, string_split(regexp_replace(regexp_replace(s, {mark}, {mark}, chr(57344)) as parts from cut),
 zips as (select *, {lettered} as lettered, {listed} as listed, {lines} as lines, list_transform(parts[2:], lambda x: row(x[1], {strip('x[3:]')})) as inner_ from halves),
 asked as (select *, case when marked then {strip(one.format(1))} when len(parts) > 2 then {strip('parts[1]')} else s end as question,
 case when marked then case when len(lettered) > 0 then {last.format(z='lettered')} when len(listed) > 0 then {last.format(z='listed')} when len(lines) > 0 then lines end when len(parts) > 2 then {last.format(z='inner_')} end as options from zips)"""


def letter_sql(c: str) -> str:
    return rf"nullif(regexp_extract({c}, '(^|[^\p{{L}}\p{{N}}_])([A-E])($|[^\p{{L}}\p{{N}}_])', 2), '')"


@query(told_sql(labelled_sql("form"), f"case when {strip('form')} = '' then 'no question' when question = '' then 'empty question' when options is not null and {letter_sql('said')} is null then 'no letter' end", f"case when options is null then coalesce(said, '') else {letter_sql('said')} end", f"case when options is null then coalesce(meant, said, '') else coalesce({letter_sql('coalesce(meant, said)')}, {letter_sql('said')}) end", "'c' || key", f"{NL} || " + LETTERED.format(sep=NL), 256 * 256, source="chart", path="null"))
def c4_chart_rows(spark, d) -> DataFrame:
    extra = F.struct(F.col("form").alias("question"), F.col("said").alias("answer"), F.concat(F.lit("c"), F.col("key").cast("string")).alias("index"))
    one = raw(spark, d).select("key", F.array("image").alias("images"), F.col("role").alias("ability"), extra.alias("extra_info"), F.struct(F.col("meant").alias("ground_truth")).alias("reward_model"))
    return told(rows.chart_rows(one, TASK._replace(data_source="chart")))


@query(told_sql("asked as (select *, text as question, case when turn % 2 = 1 then ['x' || conv_id, role] end as options from raw)", "null", "role || '|' || conv_id", "role || '|' || conv_id", "case when turn % 3 = 0 then '' else key::varchar end", CHOICES, 0, source="sample", split="eval", budget=str(rows.USUAL_PIXELS)))
def c6_sample_rows(spark, d) -> DataFrame:
    options = F.when(F.col("turn") % 2 == 1, F.array(F.concat(F.lit("x"), F.col("conv_id").cast("string")), "role")).otherwise(F.array().cast("array<string>"))
    one = raw(spark, d).select("key", F.when(F.col("turn") % 3 != 0, F.col("key")).alias("index"), F.col("text").alias("question"), options.alias("options"), F.array("role", F.col("conv_id").cast("string")).alias("answer"), "image")
    return told(rows.sample_rows(one, TASK._replace(data_source="sample")))
