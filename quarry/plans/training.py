"""Queries over what a training step does with scores: estimators by name, bonuses and losses of groups, metrics, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import arrays, text
from quarry.operators import advantages, batch, conversations, groups
from quarry.plans.catalog import ORACLE_SQL, query, r6
from quarry.sources import loaders
from quarry.sources import tables as files
from quarry.tables import SCORES_SQL, TOKENS_SQL, scores, table, tokens

ON_TOKENS = "select '{name}' as estimator, traj_id, t.pos, round(advantage * mask, 6) as advantage from ({sql}) as a join (with " + TOKENS_SQL + " select traj_id, pos, mask from tokens) as t using (traj_id)"
AS_IT_IS = "select '{name}' as estimator, traj_id, pos, advantage from ({sql})"


@query(" union all ".join(form.format(name=name, sql=ORACLE_SQL[q]) for name, form, q in (("grpo", ON_TOKENS, "g1_grpo_advantage"), ("rloo", ON_TOKENS, "g2_rloo"), ("reinforce_plus_plus_baseline", AS_IT_IS, "g3_reinforce_baseline"), ("reinforce_plus_plus", AS_IT_IS, "g4_reinforce_returns"), ("gae", AS_IT_IS, "g5_gae"), ("remax", AS_IT_IS, "g6_remax"))))
def g8_advantages_by_name(spark, d) -> DataFrame:
    options = {"reinforce_plus_plus": {"gamma": 0.95}, "gae": {"gamma": 0.99, "lam": 0.95}, "remax": {"baseline": 10.0}}
    out = advantages.advantages_of(tokens(spark, d), {name: options.get(name, {}) for name in advantages.ESTIMATORS})
    return out.select("estimator", "traj_id", "pos", r6("advantage").alias("advantage"))


TRIES = f"{SCORES_SQL}, t as (select uid, traj_id, score, case when score > 100 then 1 else 0 end as acc, traj_id % 6 as calls from scores)"


def tries(spark, d) -> DataFrame:
    return scores(spark, d).select("uid", "traj_id", "score", F.when(F.col("score") > 100, 1).otherwise(0).alias("acc"), (F.col("traj_id") % 6).alias("calls"))


@query(f"with {TRIES}, g as (select uid, avg(acc) as rate, max(calls) as most, coalesce(max(calls) filter (where acc > 0), 0) as high, coalesce(min(calls) filter (where acc > 0), 100) as low, sum(acc) as n from t group by 1), b as (select *, case when rate < 0.26 then 2.0 * calls / greatest(1, most) else (high - calls) / (high - low + 1e-6) end as bonus from t join g using (uid)) select uid, traj_id, round(case when n = 0 then bonus else bonus * acc end, 6) as tool_bonus from b")
def f6_tool_bonus(spark, d) -> DataFrame:
    return groups.tool_bonus(tries(spark, d), "uid", "acc", "calls").select("uid", "traj_id", r6("tool_bonus").alias("tool_bonus"))


@query(f"""with {TRIES}, q as (select *, (score - 100) * 0.02 as q from t), p as (select a.uid, a.traj_id, any_value(a.q) as q, any_value(a.acc) as acc, avg(b.q) filter (where case when a.acc > 0 then b.acc < a.acc else b.acc > a.acc end) as other, count(*) as n, avg(case when b.q <= a.q then 1.0 else 0 end) as up_to, avg(case when b.acc <= a.acc then 1.0 else 0 end) as acc_to from q a join q b using (uid) group by 1, 2)
 select uid, traj_id, round(acc * ln(1 + exp(-q)) + (1 - acc) * ln(1 + exp(q)), 6) as ce, round(ln(1 + exp(-(q - coalesce(other, 0)) * case when acc > 0 then 1 else -1 end)), 6) as detached, round(n * power(up_to, n - 1), 6) as by_score, round(n * power(acc_to, n - 1), 6) as by_acc from p""")
def g25_preference_losses(spark, d) -> DataFrame:
    rows = tries(spark, d).withColumn("s", F.col("score") - 100)
    return groups.preference_losses(rows, "uid", "s", "acc", 0.02).select("uid", "traj_id", *(r6(c).alias(c) for c in ("ce", "detached", "by_score", "by_acc")))


@query(f"with {TOKENS_SQL}, s as (select traj_id, count(*) as n, sum(mask) as acted from tokens group by 1), w as (select max(n) as longest from s) select (select round(avg(reward), 6) from tokens where mask > 0) as returns_mean, (select max(reward) from tokens where mask > 0) as returns_max, (select min(value) from tokens where mask > 0) as values_min, (select round(1 - var_samp(reward - value) / (var_samp(reward) + 1e-5), 6) from tokens where mask > 0) as explained, round(avg(n), 6) as length_mean, max(n)::bigint as length_max, min(n)::bigint as length_min, round(avg(case when n = longest then 1.0 else 0 end), 6) as clip_ratio from s, w")
def a25_batch_metrics(spark, d) -> DataFrame:
    """Returns, values and lengths; the longest trajectory is counted, not given."""
    t = tokens(spark, d)
    on = t.where("mask > 0").agg(r6(F.avg("reward")).alias("returns_mean"), F.max("reward").alias("returns_max"), F.min("value").alias("values_min"), r6(1 - F.var_samp(F.col("reward") - F.col("value")) / (F.var_samp("reward") + 1e-5)).alias("explained"))
    by_length = t.groupBy("traj_id").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("k"))
    lengths = by_length.agg(r6(F.sum(F.col("n") * F.col("k")) / F.sum("k")).alias("length_mean"), F.max("n").alias("length_max"), F.min("n").alias("length_min"), r6(F.max_by("k", "n") / F.sum("k")).alias("clip_ratio"))
    return on.crossJoin(F.broadcast(lengths))


@query(f"with {TRIES} select uid, traj_id, acc, round(acc + least(-(calls - 3) / 2.0 * 0.5, 0), 6) as reward from t")
def f5_score_with_overlong_penalty(spark, d) -> DataFrame:
    penalty = text.overlong_penalty(F.col("calls"), 5, 2, 0.5)
    return tries(spark, d).select("uid", "traj_id", "acc", r6(F.col("acc") + penalty).alias("reward"))


@query("select conv_id, turn, array_to_string(string_split(role, 'e'), '|') as found from conversations")
def t15_between_marks(spark, d) -> DataFrame:
    marked = F.concat(F.lit("x<|a|>"), F.replace("role", F.lit("e"), F.lit("<|b|>y<|a|>")), F.lit("<|b|>"), "text")
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(text.between_marks(marked, "<|a|>", "<|b|>"), "|").alias("found"))


@query("select conv_id, md5(string_agg('Doc ' || (turn + 1) || '(Title: ' || string_split(text, chr(10))[1] || ') ' || array_to_string(string_split(text, chr(10))[2:], chr(10)) || chr(10), '' order by turn)) as reference from conversations group by 1")
def t52_passages(spark, d) -> DataFrame:
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return c.select("conv_id", F.md5(text.passages(F.col("t.text")).cast("binary")).alias("reference"))


@query("select p_partkey, case when p_partkey % 3 = 1 or p_partkey % 3 = 2 and p_name = p_brand then 1.0 else 0.0 end as score from part")
def t57_exact_match(spark, d) -> DataFrame:
    c = F.concat(F.lit("<answer>no</answer></think> <answer> "), F.when(F.col("p_partkey") % 3 == 1, F.concat(F.upper("p_name"), F.lit("!"))).when(F.col("p_partkey") % 3 == 2, F.col("p_brand")).otherwise(F.lit("no")), F.lit("</answer>"))
    return table(spark, d, "part").select("p_partkey", text.matches_exactly(c, F.col("p_name")).alias("score"))


FIRST = "case conv_id % 4 when 0 then text when 1 then '<think>' || text || '</think><answer>' || role || '</answer>' when 2 then '<tool_call>x</tool_call><answer>' || role || '</answer>' || case when turn % 2 = 0 then chr(10) || '<|im_start|>user' || chr(10) || 'Error: ' else '' end else '<answer>' || text || '</answer>' end"


@query(f"with p as (select conv_id, turn, role, {FIRST} as c, text from conversations), a as (select *, trim(regexp_extract_all(c, '(?s)<answer>(.*?)</answer>', 1)[-1], ' ' || chr(9) || chr(10) || chr(13)) as answer from p), s as (select *, case when contains(c, '<tool_call>') and contains(c, '</tool_call>') and not contains(c, chr(10) || '<|im_start|>user' || chr(10) || 'Error: ') then 1.0 else 0.0 end as tool, case when answer is not null and length(answer) < 200 and lower(answer) = 'user' then 1.0 else 0.0 end as acc, case when length(coalesce(answer, c)) < 200 and turn % 3 > 0 then 1.0 else 0.0 end as form from a) select conv_id, turn, acc + form + acc * tool as score, tool as tool_reward, acc as acc_reward, form as format_reward from s")
def t13_first_score(spark, d) -> DataFrame:
    rows = table(spark, d, "conversations").selectExpr("conv_id", "turn", f"{FIRST} as c")
    return rows.select("conv_id", "turn", text.first_score(F.col("c"), F.array(F.lit("user")), F.col("turn") % 3 == 0).alias("s")).select("conv_id", "turn", "s.*")


TAGGED = "case when role <> 'assistant' then repeat('<image>', cast(1 + (conv_id + turn) % 3 as int)) || text || '<image' else '<image>' || text end"


@query(f"with t as (select conv_id, role, {TAGGED} as text from conversations) select conv_id, sum(case when role <> 'assistant' then (length(text) - length(replace(text, '<image>', ''))) // 7 else 0 end)::bigint as found, 2 * count(*) filter (where role <> 'assistant') as wanted, found = wanted as agrees from t group by 1")
def n7_tags_and_images(spark, d) -> DataFrame:
    """Tags in the turns that aren't the model's, against two images for each of them."""
    c = table(spark, d, "conversations")
    turns = c.selectExpr("conv_id", "role", f"{TAGGED} as text")
    images = c.groupBy("conv_id").agg((2 * F.count_if(F.col("role") != "assistant")).alias("wanted"))
    return conversations.tags_and_images(turns, images, others="assistant")


@query("select o_orderkey, case when o_orderkey % 3 = 0 then 'a:' || o_custkey || ',2;b:1' when o_orderkey % 3 = 1 then 'a:' || o_custkey || ';c:7' else 'b:1' end as merged from orders")
def n11_merged_inputs(spark, d) -> DataFrame:
    k, one = F.col("o_orderkey") % 3, lambda x: F.array(F.lit(x).cast("long") if isinstance(x, int) else x)
    a = F.when(k < 2, F.create_map(F.lit("a"), one(F.col("o_custkey")))).otherwise(F.create_map().cast("map<string,array<bigint>>"))
    b = F.when(k == 0, F.create_map(F.lit("a"), one(2), F.lit("b"), one(1))).when(k == 1, F.create_map(F.lit("c"), one(7))).otherwise(F.create_map(F.lit("b"), one(1)))
    entries = F.array_sort(F.map_entries(arrays.merged_inputs(a, b)))
    told = F.transform(entries, lambda e: F.concat(e["key"], F.lit(":"), F.array_join(e["value"].cast("array<string>"), ",")))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(told, ";").alias("merged"))


@query("select o_orderkey, 'n=' || o_custkey || ',price=' || (o_totalprice::bigint) || ',k=' || o_orderkey as meta from orders")
def j4_union_of_maps(spark, d) -> DataFrame:
    price = F.bround("o_totalprice").cast("long")
    a, b = F.create_map(F.lit("n"), F.col("o_custkey"), F.lit("price"), price), F.create_map(F.lit("k"), F.col("o_orderkey"), F.lit("n"), F.col("o_custkey"))
    entries = F.map_entries(arrays.union_maps(a, b))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("meta"))


@query("select row_number() over (order by doc_id) - 1 as place, doc_id, (row_number() over (order by doc_id) - 1) % 7 = 0 as held from documents")
def f9_map_with_place(spark, d) -> DataFrame:
    rows = batch.with_row_id(table(spark, d, "documents").select("doc_id"), "doc_id")
    return rows.select(F.col("row_id").alias("place"), "doc_id", (F.col("row_id") % 7 == 0).alias("held"))


@query(f"with {TRIES} select traj_id % 3 as step, uid, traj_id, acc, calls from t")
def k6_k7_logged_trajectories(spark, d) -> DataFrame:
    """Trajectories appended as lines, a step after the other, and read back."""
    path = files.new_folder(spark, "trajectories")
    for step in range(3):
        tries(spark, d).where(F.col("traj_id") % 3 == step).select(F.lit(step).cast("long").alias("step"), "uid", "traj_id", "acc", "calls").write.mode("append").json(path)
    return files.json_lines(spark, path, "step long, uid long, traj_id long, acc int, calls long")


@query("select s_suppkey from supplier where s_suppkey % 4 <> 1")
def k13_files_not_kept(spark, d) -> DataFrame:
    """What a clean-up would delete: files whose name isn't in the set kept. They are listed, not deleted; a file holds many suppliers, all to be kept or none."""
    path, s = files.new_folder(spark, "kept"), table(spark, d, "supplier").select("s_suppkey", "s_name")
    for part in ("s_suppkey % 4 = 1", "s_suppkey % 4 <> 1"):
        s.where(part).write.mode("append").option("maxRecordsPerFile", files.ROWS_A_FILE).json(path)
    held = spark.read.schema("s_suppkey long").json(path).select("s_suppkey", F.col("_metadata.file_name").alias("file_name"))
    kept = held.where("s_suppkey % 4 = 1").select("file_name").distinct()
    gone = loaders.listed(spark, path).where(F.col("file_name").startswith("part-")).join(kept, "file_name", "left_anti")
    return gone.join(held, "file_name").select("s_suppkey")


@query("select lang, count(*) as n, sum(n_chars)::bigint as chars from documents where n_chars > 100 group by 1")
def s16_sql_over_files(spark, d) -> DataFrame:
    return spark.sql("select lang, count(*) as n, sum(n_chars) as chars from parquet.`" + f"{d}/documents.parquet" + "` where n_chars > 100 group by 1")


@query(f"with {TRIES}, i as (select *, row_number() over (partition by uid order by traj_id) as i from t), p as (select a.uid, abs(a.acc - b.acc) as w, ((a.calls > b.calls) = (a.acc > b.acc))::int as hit from i a join i b on a.uid = b.uid and a.i < b.i), u as (select uid, case when sum(w) = 0 then 0.5 else sum(hit * w) * 1.0 / sum(w) end as accuracy from p group by 1), all_ as (select coalesce(accuracy, 0.5) as accuracy from (select distinct uid from t) left join u using (uid)) select round(avg(accuracy), 6) as accuracy, count(*) as prompts from all_")
def a22_mean_preference_accuracy(spark, d) -> DataFrame:
    """Mean over prompts; scores tie often here, and the earlier of two equal ones should be the worse."""
    out = groups.preference_accuracy(tries(spark, d), "uid", "calls", "acc", "traj_id")
    return out.agg(r6(F.avg("accuracy")).alias("accuracy"), F.count("*").alias("prompts"))
