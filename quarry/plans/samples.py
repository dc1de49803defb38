"""Queries over evaluation samples: resumed runs, times, boxes, filters by image, batches of informative groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import geometry, text
from quarry.operators import batch, conversations, groups, samples
from quarry.plans.catalog import query, r6
from quarry.plans.conversations import COLD_SQL, cold
from quarry.plans.conversion import RAW_SQL, raw
from quarry.tables import SCORES_SQL, TOKENS_SQL, scores, table, tokens


@query("with a as (select o_custkey, count(*) filter (where o_orderstatus <> 'F') as fine from orders where o_orderkey % 3 > 0 group by 1) select c_custkey from customer left join a on c_custkey = o_custkey where coalesce(fine, 0) = 0")
def j6_samples_to_run(spark, d) -> DataFrame:
    """Customers are samples, two thirds of the orders their attempts so far, those of status F have failed."""
    done = table(spark, d, "orders").where("o_orderkey % 3 > 0").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_list(F.when(F.col("o_orderstatus") == "F", "error").otherwise("success")).alias("status"))
    return samples.to_run(table(spark, d, "customer").select("c_custkey"), done, "c_custkey")


def timed(spark, d) -> DataFrame:
    """A prompt's trajectories as attempts: masked tokens are calls of the model, others of the tool; every fourth prompt's ran alone."""
    t = tokens(spark, d)
    seconds = lambda c: F.collect_list(F.when(c, F.col("reward") / 10))
    each = t.groupBy("uid", "traj_id").agg(seconds(F.col("mask") > 0).alias("api_call_times"), seconds(F.col("mask") == 0).alias("tool_call_times"), (F.sum("reward") / 8).alias("total_time"), (F.count("*") / 100).alias("image_load_time"), F.max("value").alias("overview_process_time"))
    per = each.groupBy("uid").agg(F.collect_list(F.struct("image_load_time", "overview_process_time", "total_time", "api_call_times", "tool_call_times")).alias("attempts"), (F.max("total_time") * 1.25).alias("wall"))
    stats = samples.batch_stats(F.col("attempts.total_time"), F.col("wall"))
    return per.withColumn("s", stats).withColumn("batch", F.when(F.col("uid") % 4 > 0, F.struct(F.col("wall").alias("batch_total_time"), "s.sample_n", F.col("s.speedup").alias("parallelization_speedup"), F.col("s.most").alias("max_individual_time"))))


TIMED = f"{TOKENS_SQL}, e as (select uid, traj_id, sum(reward) / 8 as total, count(*) / 100.0 as load, max(value) as view, count(*) filter (where mask > 0) as api, count(*) filter (where mask = 0) as tool from tokens group by 1, 2), b as (select uid, count(*) as n, sum(total) as total, max(total) as most, min(total) as least, max(total) * 1.25 as wall from e group by 1)"


@query(f"with {TIMED} select uid, n as sample_n, round(total, 6) as total, round(total / n, 6) as mean, round(most, 6) as most, round(least, 6) as least, round(case when wall > 0 then total / wall else 0 end, 6) as speedup from b")
def a20_batch_stats(spark, d) -> DataFrame:
    return timed(spark, d).select("uid", "s.sample_n", *(r6(f"s.{c}").alias(c) for c in ("total", "mean", "most", "least", "speedup")))


@query(f"with {TIMED} select count(*) as total_samples, round(avg(load), 6) as avg_image_load_time, round(avg(view), 6) as avg_overview_process_time, round(avg(total), 6) as avg_total_time, (select round(avg(reward / 10), 6) from tokens where mask > 0) as avg_api_call_time, (select round(avg(reward / 10), 6) from tokens where mask = 0) as avg_tool_call_time, round(avg(api), 6) as avg_num_api_calls, round(avg(tool), 6) as avg_num_tool_calls, sum(api)::bigint as total_api_calls, sum(tool)::bigint as total_tool_calls, (select count(*) from b where uid % 4 > 0) as total_batches, (select round(avg(wall), 6) from b where uid % 4 > 0) as avg_batch_total_time, (select round(avg(n), 6) from b where uid % 4 > 0) as avg_sample_n, (select round(avg(case when wall > 0 then total / wall else 0 end), 6) from b where uid % 4 > 0) as avg_parallelization_speedup, (select round(avg(wall / most * 100), 6) from b where uid % 4 > 0 and most > 0) as avg_efficiency from e")
def a19_performance(spark, d) -> DataFrame:
    out = samples.performance(timed(spark, d))
    return out.select(*(r6(c).alias(c) if c.startswith("avg") else c for c in out.columns))


BOXED = "b as (select o_orderkey, o_orderpriority, o_custkey % 40 as x, o_custkey % 30 as y, 20 + o_orderkey % 50 as s, o_orderkey % 3 as k, o_orderstatus = 'F' as ok from orders), i as (select *, case when k = 2 then 0.0 else greatest(least(x + s, 60) - greatest(x, 10), 0) * greatest(least(y + s, 60) - greatest(y, 10), 0) * 1.0 end as i from b), u as (select *, case when k = 2 then 0.0 else i / (s * s + 2500 - i) end as iou from i)"


@query(f"with {BOXED} select o_orderkey, round(iou, 6) as iou from u")
def m17_t54_reply_iou(spark, d) -> DataFrame:
    """Boxes from a reply's text, from its turns, or none; one target."""
    return boxed(spark, d).select("o_orderkey", r6("iou").alias("iou"))


@query(f"with {BOXED} select o_orderpriority, round(coalesce(avg(iou) filter (where ok and k < 2), 0), 6) as mean_iou from u group by 1")
def a15_mean_iou(spark, d) -> DataFrame:
    """By priority, over the right attempts that have a box."""
    out = samples.mean_iou(boxed(spark, d), F.col("ok"), F.col("iou"), F.col("n"), "o_orderpriority")
    return out.select("o_orderpriority", r6("mean_iou").alias("mean_iou"))


def boxed(spark, d) -> DataFrame:
    o = table(spark, d, "orders").selectExpr("o_orderkey", "o_orderpriority", "o_custkey % 40 as x", "o_custkey % 30 as y", "20 + o_orderkey % 50 as s", "o_orderkey % 3 as k", "o_orderstatus = 'F' as ok")
    x, y, s, k = (F.col(c) for c in ("x", "y", "s", "k"))
    told = F.concat(F.lit("see <box>["), F.concat_ws(",", x, y, x + s, y + s), F.lit("]</box> and <box>[9,9,1,1]</box>"))
    reply = F.when(k == 0, told).otherwise("no box")
    half = lambda v: v.cast("double") / 2
    turns = F.when(k == 1, F.array(F.array(F.array(half(x), half(y), half(x + s), half(y + s))))).otherwise(F.array().cast("array<array<array<double>>>"))
    target = F.array(F.array(F.lit(10.0), F.lit(10.0), F.lit(60.0), F.lit(60.0)), F.array(F.lit(1.0)))
    iou = samples.reply_iou(reply, turns, F.array(F.lit(0.5), F.lit(0.5)), target)
    return o.select("o_orderkey", "o_orderpriority", "ok", iou.alias("iou"), F.when(k < 2, 1).otherwise(0).alias("n"))


@query(f"with {RAW_SQL} select key from raw where picture = 'png' and w * h > 65536 and w * h <= 1000000")
def p21_p23_within_pixels(spark, d) -> DataFrame:
    """By the sides in the image's header; one that can't be read goes."""
    return samples.within_pixels(raw(spark, d).select("key", "image"), F.col("image.bytes"), 256 * 256, 1_000_000).select("key")


@query(f"{COLD_SQL} select reason, count(*) as n from f where reason is not null group by 1")
def p25_reasons_of_rejection(spark, d) -> DataFrame:
    """How many conversations each step of the cascade takes out."""
    return cold(spark, d)[0].where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


@query(f"with {SCORES_SQL}, g as (select *, min(score) over w as lo, max(score) over w as hi, count(*) over w as n from scores window w as (partition by uid)), k as (select uid, traj_id, row_number() over (order by uid, traj_id) as r from g where lo < hi or n = 1) select uid, traj_id from k where r <= 1000")
def g10_first_informative_rows(spark, d) -> DataFrame:
    """The first thousand trajectories of informative groups: a step's batch, which is the feature."""
    rows = groups.informative_groups(scores(spark, d)).select("uid", "traj_id")
    return samples.first_batch(rows, "uid", ["uid", "traj_id"], 1000, 1)


@query(f"with {SCORES_SQL} select uid, traj_id, round(avg(score) over w, 6) as mean, round(coalesce(stddev_samp(score) over w, 1), 6) as deviation from scores window w as (partition by uid)")
def j9_mean_and_deviation(spark, d) -> DataFrame:
    """Of a group, joined back to its rows; the deviation of one row is 1."""
    s = scores(spark, d)
    of = s.groupBy("uid").agg(r6(F.avg("score")).alias("mean"), r6(F.coalesce(F.stddev_samp("score"), F.lit(1.0))).alias("deviation"))
    return s.join(of, "uid").select("uid", "traj_id", "mean", "deviation")


@query(f"with {TOKENS_SQL}, n as (select *, count(*) over (partition by traj_id) as n, max(case when mask > 0 then pos end) over (partition by traj_id) as last_on from tokens), m as (select traj_id, pos, case when reward in (1, 2, 50) then 0 else 1 end as padding_mask, case when traj_id % 2 = 0 then mask else 1 end as response_mask, last_on from n) select traj_id, pos, padding_mask, response_mask, case when pos = last_on then traj_id % 5 * 1.0 else 0.0 end as placed from m")
def g13_g15_g16_masks_by_row(spark, d) -> DataFrame:
    """Padding tokens, the action mask where there is one, and a reward on the last valid token."""
    t = tokens(spark, d)
    last = t.where("mask > 0").groupBy("traj_id").agg(F.max("pos").alias("last_on"))
    action = F.when(F.col("traj_id") % 2 == 0, F.col("mask"))
    both = t.join(last, "traj_id", "left")
    return both.select("traj_id", "pos", F.when(F.col("reward").isin(1, 2, 50), 0).otherwise(1).alias("padding_mask"), F.coalesce(action, F.lit(1)).alias("response_mask"), F.when(F.col("pos") == F.col("last_on"), (F.col("traj_id") % 5).cast("double")).otherwise(0.0).alias("placed"))


@query("select e::int as epoch, place, place // 100 as mini_batch_id, o_orderkey from (select o_orderkey, e, row_number() over (partition by e order by md5(o_orderkey || '|' || (7 + e)), o_orderkey) - 1 as place from orders, (select unnest([0, 1]) as e))")
def p14_shuffled_minibatches(spark, d) -> DataFrame:
    return batch.shuffled_minibatches(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 100, 2, 7)


REPLIED = r"""case conv_id % 8 when 0 then text || ' The answer is ' || turn || '. ok' when 1 then text || chr(10) || 'ANSWER: x = ' || conv_id when 2 then conv_id || ' is the answer to it' when 3 then 'so \fbox{ {a}' || turn || '} and \boxed{y=' || turn || '} end' when 4 then text || ' we get ' || conv_id || '. Then more' when 5 then 'It must be' || chr(10) || conv_id when 6 then 'open \boxed{' || conv_id else text end"""


def located_sql() -> str:
    """The same rules, a table for each step."""
    esc = lambda m: m.replace("=", "[=]").replace(". ", "[.] ").replace("\n", "[\\n]")
    lit = lambda m: "'" + m.replace("\n", "' || chr(10) || '") + "'"
    steps, n = [f"s0 as (select conv_id, turn, false as m, {REPLIED} as c from conversations)"], 0

    def add(sql: str) -> None:
        nonlocal n
        n += 1
        steps.append(f"s{n} as ({sql.format(src=f's{n - 1}')})")

    ends = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"
    for marks, pattern in ((text.ANSWER_AFTER, "(?is)^.*{}(.*)$"), (text.ANSWER_BEFORE, "(?is)^(.*){}")):
        for m in marks:
            add(f"select conv_id, turn, m or contains(lower(c), {lit(m)}) as m, case when contains(lower(c), {lit(m)}) then trim(regexp_extract(c, '{pattern.format(esc(m))}', 1), {ends}) else c end as c from {{src}}")
    boxed = "nullif(trim(case when contains(c, '\\boxed') then coalesce(nullif(regexp_extract(c, '(?s)^.*\\\\boxed{{([^{{}}]*)}}', 1), ''), '') when contains(c, '\\fbox') then regexp_extract(c, '(?s)^.*\\\\fbox{{([^{{}}]*)}}', 1) end), '')"
    add(f"select conv_id, turn, m or {boxed} is not null as m, coalesce({boxed}, c) as c from {{src}}")
    add(f"select conv_id, turn, m, case when contains(c, '. ') then trim(regexp_extract(c, '(?is)^(.*)[.] ', 1), {ends}) else c end as c from {{src}}")
    for m in text.VALUE_AFTER:
        add(f"select conv_id, turn, m or contains(lower(c), {lit(m)}) as m, case when contains(lower(c), {lit(m)}) then trim(regexp_extract(c, '(?is)^.*{esc(m)}(.*)$', 1), {ends}) else c end as c from {{src}}")
    return f"with {', '.join(steps)} select conv_id, turn, m and regexp_matches(c, '[0-9]') as matched, md5(c) as answer from s{n}"


@query(located_sql())
def t31_located_answers(spark, d) -> DataFrame:
    rows = table(spark, d, "conversations").selectExpr("conv_id", "turn", f"{REPLIED.replace(chr(92), chr(92) * 2)} as c")
    return rows.select("conv_id", "turn", text.located_answer(F.col("c")).alias("s")).select("conv_id", "turn", "s.matched", F.md5(F.col("s.answer").cast("binary")).alias("answer"))


@query("select vec_id, round(list_sum(list_transform(embedding, lambda x, i: greatest(least(x::double, i * 0.01), i * 0.01 - 0.2))), 5) as total from embeddings")
def m20_clipped(spark, d) -> DataFrame:
    kept = F.transform("embedding", lambda x, i: geometry.clipped(x.cast("double"), (i + 1) * 0.01 - 0.2, (i + 1) * 0.01))
    return table(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(kept, F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query("select conv_id, string_agg(role || ':' || case when role = 'system' then 'be brief' else length(text)::varchar end, ',' order by turn) as turns, '/base/i' || conv_id || '.png|/own/j.png' as images from conversations group by 1")
def c10_paths_and_prompt(spark, d) -> DataFrame:
    turn = F.struct("turn", F.col("role").alias("from"), F.length("text").cast("string").alias("value"))
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("conversations"))
    rows = c.withColumn("images", F.array(F.concat(F.lit("i"), F.col("conv_id").cast("string"), F.lit(".png")), F.lit("/own/j.png")))
    out = conversations.repathed(rows, "/base/", "be brief")
    return out.select("conv_id", F.array_join(F.transform("conversations", lambda t: F.concat(t["from"], F.lit(":"), t["value"])), ",").alias("turns"), F.array_join("images", "|").alias("images"))
