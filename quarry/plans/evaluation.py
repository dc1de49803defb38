"""Queries of metrics, roll-ups and losses. An order is a trajectory, its customer the prompt, its priority the data source, lineitems the tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import geometry
from quarry.operators import batch, groups, nearest, scans
from quarry.plans.catalog import query, r6
from quarry.tables import SCORES_SQL, TOKENS_SQL, scores, table, tokens

TRAJ = f"{TOKENS_SQL}, t as (select uid, traj_id, sum(reward) as score, count(*) as n, sum(mask) as acted, max(case when reward > 45 then 1 else 0 end) as acc, sum(case when mask = 0 then 1 else 0 end) as nfr from tokens group by 1, 2)"


def trajectories(spark, d) -> DataFrame:
    return tokens(spark, d).groupBy("uid", "traj_id").agg(F.sum("reward").alias("score"), F.count("*").alias("n"), F.sum("mask").alias("acted"), F.max(F.when(F.col("reward") > 45, 1).otherwise(0)).alias("acc"), F.sum(F.when(F.col("mask") == 0, 1).otherwise(0)).alias("nfr"))


@query(f"with {TRAJ} select sum(acted)::bigint as response_tokens, sum(n - acted)::bigint as observation_tokens, round(avg(acted), 6) as response_mean, max(n - acted)::bigint as observation_max from t")
def a2_length_split(spark, d) -> DataFrame:
    t, o = trajectories(spark, d), F.col("n") - F.col("acted")
    return t.agg(F.sum("acted").alias("response_tokens"), F.sum(o).alias("observation_tokens"), r6(F.avg("acted")).alias("response_mean"), F.max(o).alias("observation_max"))


@query(f"with {TRAJ}, s as (select * from (values ('gen', 3.5), ('ref', 1.25), ('adv', 0.5)) as v(section, seconds)), k as (select sum(acted) as own, sum(n) as every_ from t) select section, round(seconds * 1000 / case when section = 'gen' then own else every_ end, 6) as ms_a_token, round(every_ / (5.25 * 8), 6) as throughput from s, k")
def a3_a4_timing_and_throughput(spark, d) -> DataFrame:
    s = spark.createDataFrame([("gen", 3.5), ("ref", 1.25), ("adv", 0.5)], "section string, seconds double")
    k = trajectories(spark, d).agg(F.sum("acted").alias("own"), F.sum("n").alias("every_"))
    per = F.when(F.col("section") == "gen", F.col("own")).otherwise(F.col("every_"))
    return s.crossJoin(F.broadcast(k)).select("section", r6(F.col("seconds") * 1000 / per).alias("ms_a_token"), r6(F.col("every_") / (5.25 * 8)).alias("throughput"))


@query("select event_type as metric, round(avg(value), 6) as mean from events group by 1")
def a5_mean_of_metrics(spark, d) -> DataFrame:
    return table(spark, d, "events").groupBy(F.col("event_type").alias("metric")).agg(r6(F.avg("value")).alias("mean"))


@query(f"with {TRAJ}, u as (select uid, sum(acc) as a, count(*) as k, sum(nfr) as f, min(nfr) as least from t group by 1) select round((select avg(nfr) from t), 6) as focus_mean, (select max(nfr) from t)::bigint as focus_max, round((select stddev_pop(nfr) from t), 6) as focus_std, round(coalesce((select avg(acc) from t where nfr > 0), 0) - coalesce((select avg(acc) from t where nfr = 0), 0), 6) as gap, round(avg(case when a = k then 1.0 else 0 end), 6) as all_right, round(avg(case when a = 0 then 1.0 else 0 end), 6) as all_wrong, round(avg(case when f = 0 then 1.0 else 0 end), 6) as all_direct, round(avg(case when least > 0 then 1.0 else 0 end), 6) as all_focus from u")
def a6_agent_metrics(spark, d) -> DataFrame:
    t = trajectories(spark, d)
    u = t.groupBy("uid").agg(F.sum("acc").alias("a"), F.count("*").alias("k"), F.sum("nfr").alias("f"), F.min("nfr").alias("least"))
    share = lambda c: r6(F.avg(F.when(c, 1.0).otherwise(0.0)))
    on = lambda c: F.coalesce(F.avg(F.when(c, F.col("acc"))), F.lit(0.0))
    one = t.agg(r6(F.avg("nfr")).alias("focus_mean"), F.max("nfr").alias("focus_max"), r6(F.stddev_pop("nfr")).alias("focus_std"), r6(on(F.col("nfr") > 0) - on(F.col("nfr") == 0)).alias("gap"))
    two = u.agg(share(F.col("a") == F.col("k")).alias("all_right"), share(F.col("a") == 0).alias("all_wrong"), share(F.col("f") == 0).alias("all_direct"), share(F.col("least") > 0).alias("all_focus"))
    return one.crossJoin(F.broadcast(two))


BESTS = "select data_source, uid, {k} as k, sum(score * (power(i * 1.0 / n, {k}) - power((i - 1) * 1.0 / n, {k}))) as best, sum(score * (power((n - i + 1) * 1.0 / n, {k}) - power((n - i) * 1.0 / n, {k}))) as worst from r group by 1, 2"


@query(f"with {SCORES_SQL}, s as (select o_orderpriority as data_source, uid, traj_id, score from scores join orders on traj_id = o_orderkey), r as (select *, row_number() over (partition by data_source, uid order by score, traj_id) as i, count(*) over (partition by data_source, uid) as n from s), b as ({' union all '.join(BESTS.format(k=k) for k in (2, 4))}), m as (select data_source, round(avg(a), 6) as mean, round(avg(v), 6) as std from (select data_source, uid, avg(score) as a, stddev_pop(score) as v from s group by 1, 2) group by 1) select data_source, k, mean, std, round(avg(best), 6) as best, round(avg(worst), 6) as worst, case when k = 4 then 'core' else 'aux' end as section from b join m using (data_source) group by all")
def a10_a11_validation_report(spark, d) -> DataFrame:
    """Mean, deviation and best and worst of k by source, each over prompts; the largest k is the core section."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("traj_id"), F.col("o_orderpriority").alias("data_source"))
    s = scores(spark, d).join(o, "traj_id")
    w = Window.partitionBy("data_source", "uid")
    r = s.withColumn("i", F.row_number().over(w.orderBy("score", "traj_id"))).withColumn("n", F.count("*").over(w)).withColumn("k", F.explode(F.array(F.lit(2), F.lit(4))))
    p = lambda x: F.pow(x / F.col("n"), F.col("k"))
    i, n, x = F.col("i"), F.col("n"), F.col("score")
    b = r.groupBy("data_source", "uid", "k").agg(F.sum(x * (p(i) - p(i - 1))).alias("best"), F.sum(x * (p(n - i + 1) - p(n - i))).alias("worst"), F.avg("score").alias("a"), F.stddev_pop("score").alias("v"))
    return b.groupBy("data_source", "k").agg(r6(F.avg("a")).alias("mean"), r6(F.avg("v")).alias("std"), r6(F.avg("best")).alias("best"), r6(F.avg("worst")).alias("worst")).withColumn("section", F.when(F.col("k") == 4, "core").otherwise("aux"))


@query(f"with {TRAJ}, r as (select *, row_number() over (partition by uid order by traj_id) as i from t) select round(coalesce(sum(case when acc = 1 then acted end) * 1.0 / nullif(sum(acc), 0), 0), 6) as tokens_a_success, round(coalesce(avg(case when acc = 1 and nfr > 0 then nfr * 1.0 / n end), 0), 6) as overlap_a_success from r where i <= 4")
def a14_a15_successes(spark, d) -> DataFrame:
    first = trajectories(spark, d).withColumn("i", F.row_number().over(Window.partitionBy("uid").orderBy("traj_id"))).where("i <= 4")
    ok = F.col("acc") == 1
    return first.agg(r6(F.coalesce(F.try_divide(F.sum(F.when(ok, F.col("acted"))), F.sum("acc")), F.lit(0.0))).alias("tokens_a_success"), r6(F.coalesce(F.avg(F.when(ok & (F.col("nfr") > 0), F.col("nfr") / F.col("n"))), F.lit(0.0))).alias("overlap_a_success"))


@query("with c as (select source as category, avg(quality) as q, avg(1 - toxic) as s, count(*) as n from labels join documents using (doc_id) group by 1) select round(avg(q), 6) as macro, round((avg(q) + avg(s)) / 2, 6) as overall, round(sum(q * n) / sum(n), 6) as micro, count(*) as categories from c")
def a16_a18_macro(spark, d) -> DataFrame:
    both = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    c = both.groupBy("source").agg(F.avg("quality").alias("q"), F.avg(1 - F.col("toxic")).alias("s"), F.count("*").alias("n"))
    return c.agg(r6(F.avg("q")).alias("macro"), r6((F.avg("q") + F.avg("s")) / 2).alias("overall"), r6(F.sum(F.col("q") * F.col("n")) / F.sum("n")).alias("micro"), F.count("*").alias("categories"))


@query("with p as (select o_orderkey, list(l_quantity) as q, sum(l_tax) as tax from orders join lineitem on o_orderkey = l_orderkey group by 1) select o_orderkey, round(list_sum(q), 6) as total, round(list_avg(q), 6) as mean, list_max(q) as most, list_min(q) as least, round(list_sum(q) / (1 + tax), 6) as speed_up from p")
def a19_a20_times(spark, d) -> DataFrame:
    l = table(spark, d, "lineitem")  # noqa: E741
    p = l.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("t"), F.avg("l_quantity").alias("a"), F.max("l_quantity").alias("most"), F.min("l_quantity").alias("least"), F.sum("l_tax").alias("tax"))
    return p.join(table(spark, d, "orders").select("o_orderkey"), "o_orderkey").select("o_orderkey", r6("t").alias("total"), r6("a").alias("mean"), "most", "least", r6(F.col("t") / (1 + F.col("tax"))).alias("speed_up"))


@query(f"with {TRAJ} select uid, coalesce(max(case when acc > 0 then nfr end), 0)::bigint as most, coalesce(min(case when acc > 0 then nfr end), 100)::bigint as least from t group by 1")
def a21_focus_of_right_tries(spark, d) -> DataFrame:
    on = F.when(F.col("acc") > 0, F.col("nfr"))
    return trajectories(spark, d).groupBy("uid").agg(F.coalesce(F.max(on), F.lit(0)).cast("long").alias("most"), F.coalesce(F.min(on), F.lit(100)).cast("long").alias("least"))


@query(f"with {TRAJ} select round(avg(case when sign(score - 80) = sign(2 * acc - 1) then 1.0 else 0 end), 6) as accuracy from t")
def a23_absolute_preference(spark, d) -> DataFrame:
    return trajectories(spark, d).agg(r6(F.avg(F.when(F.signum(F.col("score") - 80) == F.signum((2 * F.col("acc") - 1).cast("double")), 1.0).otherwise(0.0))).alias("accuracy"))


@query(f"with {SCORES_SQL} select uid, traj_id, score from (select *, row_number() over (partition by uid order by traj_id) as i from scores) where i <= 2")
def a26_o3_first_of_each(spark, d) -> DataFrame:
    return scores(spark, d).withColumn("i", F.row_number().over(Window.partitionBy("uid").orderBy("traj_id"))).where("i <= 2").drop("i")


@query(f"with {TOKENS_SQL} select round(sum(reward * mask), 6) as total, round(sum(reward * mask) / (sum(mask) + 1e-8), 6) as mean, round(var_samp(case when mask > 0 then reward end), 6) as variance from tokens")
def a27_masked_statistics(spark, d) -> DataFrame:
    r, m = F.col("reward"), F.col("mask")
    return tokens(spark, d).agg(r6(F.sum(r * m)).alias("total"), r6(F.sum(r * m) / (F.sum(m) + 1e-8)).alias("mean"), r6(F.var_samp(F.when(m > 0, r))).alias("variance"))


@query(f"with {TOKENS_SQL}, s as (select uid, traj_id, sum(reward * mask) / nullif(sum(mask), 0) as m from tokens group by 1, 2), g as (select *, sum(m) over (partition by uid) as total, count(*) over (partition by uid) as n from s), r as (select traj_id, pos, case when mask > 0 and n > 1 then reward * n / (n - 1) - total / (n - 1) when mask > 0 then reward else 0 end as r from tokens join g using (uid, traj_id)) select traj_id, pos, round(sum(coalesce(r, 0)) over (partition by traj_id order by pos desc), 6) + 0.0 as ret from r")
def g7_token_rloo(spark, d) -> DataFrame:
    t = tokens(spark, d)
    on, w = F.col("mask") > 0, Window.partitionBy("uid")
    m = t.groupBy("uid", "traj_id").agg(F.try_divide(F.sum(F.col("reward") * F.col("mask")), F.sum("mask")).alias("m"))
    g = m.withColumn("total", F.sum("m").over(w)).withColumn("n", F.count("*").over(w))
    r = F.when(on & (F.col("n") > 1), F.try_divide(F.col("reward") * F.col("n"), F.col("n") - 1) - F.try_divide(F.col("total"), F.col("n") - 1)).when(on, F.col("reward")).otherwise(0.0)
    out = t.join(g.drop("m"), ["uid", "traj_id"]).withColumn("r", F.coalesce(r, F.lit(0.0)))
    return out.select("traj_id", "pos", r6(scans.suffix_sum(F.col("r"))).alias("ret"))


@query(f"with {SCORES_SQL}, g as (select uid, traj_id, score, min(score) over (partition by uid) as lo, max(score) over (partition by uid) as hi, count(*) over (partition by uid) as n from scores), k as (select * from g where lo < hi or n = 1), r as (select *, dense_rank() over (order by uid) as p from k) select uid, traj_id, score from r where p <= 40")
def g10_first_groups(spark, d) -> DataFrame:
    """Informative trajectories of the first 40 prompts; prompts are ranked, not trajectories."""
    kept = groups.informative_groups(scores(spark, d)).select("uid", "traj_id", "score")
    first = kept.select("uid").distinct().orderBy("uid").limit(40)
    return kept.join(F.broadcast(first), "uid", "left_semi")


@query(f"with {TOKENS_SQL} select traj_id, pos, case when reward in (1, 2, 50) then 0 else 1 end as kept, case when pos = max(pos) over (partition by traj_id) then 1.5 else 0.0 end as placed, coalesce(case when uid % 2 = 0 then mask end, 1) as response_mask from tokens")
def g13_g15_g16_masks(spark, d) -> DataFrame:
    last = F.max("pos").over(Window.partitionBy("traj_id"))
    return tokens(spark, d).select("traj_id", "pos", F.when(F.col("reward").isin(1, 2, 50), 0).otherwise(1).alias("kept"), F.when(F.col("pos") == last, 1.5).otherwise(0.0).alias("placed"), F.coalesce(F.when(F.col("uid") % 2 == 0, F.col("mask")), F.lit(1)).alias("response_mask"))


@query(f"with {TOKENS_SQL}, k as (select traj_id, sum((value / 10 - kl) * mask) / nullif(sum(mask), 0) as m, sum(reward - 0.05 * (value / 10 - kl) * mask) as s, sum(reward - 0.1 * (value / 10 - kl)) as plain from tokens group by 1) select round(avg(m), 6) as kl, round(avg(s), 6) as score, round(avg(plain), 6) as plain from k")
def g18_g19_penalised_rewards(spark, d) -> DataFrame:
    x, m = F.col("value") / 10 - F.col("kl"), F.col("mask")
    k = tokens(spark, d).groupBy("traj_id").agg(F.try_divide(F.sum(x * m), F.sum(m)).alias("m"), F.sum(F.col("reward") - 0.05 * x * m).alias("s"), F.sum(F.col("reward") - 0.1 * x).alias("p"))
    return k.agg(r6(F.avg("m")).alias("kl"), r6(F.avg("s")).alias("score"), r6(F.avg("p")).alias("plain"))


@query("select row_number() over (order by event_id) as step, round(ln(0.2) + sum(ln(1 + greatest(least(value / 50 - 1, 0.2), -0.2) * 8 / 1000)) over (order by event_id), 6) as log_beta from events")
def g20_adaptive_coefficient(spark, d) -> DataFrame:
    """The coefficient after each step, as its logarithm: each step multiplies it, so products are running sums of logarithms."""
    factor = 1 + F.greatest(F.least(F.col("value") / 50 - 1, F.lit(0.2)), F.lit(-0.2)) * 8 / 1000
    e = batch.with_row_id(table(spark, d, "events").select("event_id", "value"), "event_id")
    return batch.running_sum(e, F.log(factor), "upto", "row_id").select((F.col("row_id") + 1).alias("step"), r6(F.log(F.lit(0.2)) + F.col("upto")).alias("log_beta"))


POLICY = "(select *, exp(value / 10 - kl) as ratio, reward - 25 as adv from tokens)"


@query(f"with {TOKENS_SQL}, l as (select *, -adv * ratio as a, -adv * greatest(least(ratio, 1.28), 0.8) as b from {POLICY}), c as (select *, greatest(a, b) as m from l), p as (select *, case when adv < 0 then least(-adv * 3.0, m) else m end as loss from c) select round(sum(loss * mask) / sum(mask), 6) as loss, round(sum((b > a)::int * mask) * 1.0 / sum(mask), 6) as clipped, round(sum((m > -adv * 3.0 and adv < 0)::int * mask) * 1.0 / sum(mask), 6) as clipped_low, round(sum((kl - value / 10) * mask) / sum(mask), 6) as kl, round(sum(greatest((value - reward) * (value - reward), (greatest(least(value, kl + 0.5), kl - 0.5) - reward) * (greatest(least(value, kl + 0.5), kl - 0.5) - reward)) * mask) * 0.5 / sum(mask), 6) as value_loss from p")
def g22_g23_objectives(spark, d) -> DataFrame:
    ratio, adv, m = F.exp(F.col("value") / 10 - F.col("kl")), F.col("reward") - 25, F.col("mask")
    a, b = -adv * ratio, -adv * F.greatest(F.least(ratio, F.lit(1.28)), F.lit(0.8))
    worst, floor = F.greatest(a, b), -adv * 3.0
    loss = F.when(adv < 0, F.least(floor, worst)).otherwise(worst)
    near = F.greatest(F.least(F.col("value"), F.col("kl") + 0.5), F.col("kl") - 0.5)
    sq = lambda x: (x - F.col("reward")) * (x - F.col("reward"))
    mean = lambda c: r6(F.sum(c * m) / F.sum(m))
    return tokens(spark, d).agg(mean(loss).alias("loss"), mean((b > a).cast("int")).alias("clipped"), mean(((worst > floor) & (adv < 0)).cast("int")).alias("clipped_low"), mean(F.col("kl") - F.col("value") / 10).alias("kl"), mean(0.5 * F.greatest(sq(F.col("value")), sq(near))).alias("value_loss"))


@query("with t as (select conv_id, turn, role, length(text) as n from conversations), c as (select *, sum(n) over (partition by conv_id order by turn) as upto from t) select conv_id, turn, (upto - n)::bigint as start, least(upto, 2000)::bigint as stop, case when role = 'assistant' then 1 else 0 end as loss, (upto - n < 2000) as kept from c")
def g26_g27_turns(spark, d) -> DataFrame:
    """Where each recorded turn lies in its conversation, what is learnt from, and what a limit of 2000 leaves."""
    t = table(spark, d, "conversations").select("conv_id", "turn", "role", F.length("text").cast("long").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("conv_id").orderBy("turn"))
    return t.withColumn("upto", upto).select("conv_id", "turn", (F.col("upto") - F.col("n")).alias("start"), F.least("upto", F.lit(2000)).alias("stop"), F.when(F.col("role") == "assistant", 1).otherwise(0).alias("loss"), (F.col("upto") - F.col("n") < 2000).alias("kept"))


@query("select event_id, round_even(greatest(1024 + (256 - 1024) * least(event_id / 500.0, 1), 256), 0)::bigint as tokens, case when event_id < 100 then round(event_id / 100.0, 6) else round(0.1 + 0.9 * 0.5 * (1 + cos(pi() * least((event_id - 100) / 900.0, 1))), 6) end as rate from events")
def g28_m22_schedules(spark, d) -> DataFrame:
    return table(spark, d, "events").select("event_id", geometry.curriculum(F.col("event_id"), 1024, 256, 500).alias("tokens"), r6(geometry.learning_rate(F.col("event_id"), 100, 1000, 0.1)).alias("rate"))


@query(f"with {SCORES_SQL}, a as (select uid, traj_id, score, case when score > 100 then 1 else 0 end as acc from scores), w as (select x.uid, x.traj_id, count(y.traj_id) as wins from a x left join a y on x.uid = y.uid and x.acc > y.acc group by 1, 2) select uid, traj_id, wins from w")
def j11_wins_in_group(spark, d) -> DataFrame:
    """How many of its prompt's others a trajectory beats in accuracy: by counts a value, not by pairs."""
    a = scores(spark, d).withColumn("acc", F.when(F.col("score") > 100, 1).otherwise(0))
    w = Window.partitionBy("uid").orderBy("acc").rangeBetween(Window.unboundedPreceding, -1)
    return a.select("uid", "traj_id", F.count("*").over(w).alias("wins"))


@query("with e as (select vec_id, embedding from embeddings), q as (select vec_id as query_id, embedding as v from e where vec_id % 20 = 0), s as (select query_id, vec_id, list_cosine_similarity(v, embedding) as c from q join e on query_id <> vec_id), r as (select *, row_number() over (partition by query_id order by round(c, 9) desc, vec_id) as n from s) select query_id, vec_id, n as place from r where n <= 3")
def o10_retrieval(spark, d) -> DataFrame:
    """The three nearest of every 20th vector by cosine; the queries are a stated set against all rows."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"))
    s = nearest.candidates(q, e, 3).withColumn("c", F.round("c", 9))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("c"), "vec_id"))
    return s.withColumn("place", place.cast("long")).where("place <= 3").select("query_id", "vec_id", "place")
