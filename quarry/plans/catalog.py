
from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.functions import geometry, text
from quarry.operators import batch, groups, scans
from quarry.tables import SCORES_SQL, TOKENS_SQL, scores, table, tokens

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r6(c) -> F.Column:
    return F.round(c, 6)


# Groups


@query(f"with {SCORES_SQL}, g as (select *, count(*) over w as n, avg(score) over w as m, stddev_samp(score) over w as s from scores window w as (partition by uid)) select uid, traj_id, round(case when n = 1 then score / (1 + 1e-6) else (score - m) / (s + 1e-6) end, 6) as advantage from g")
def g1_grpo_advantage(spark, d) -> DataFrame:
    return groups.grpo_advantage(scores(spark, d)).select("uid", "traj_id", r6("advantage").alias("advantage"))


@query(f"with {SCORES_SQL}, g as (select *, count(*) over w as n, avg(score) over w as m from scores window w as (partition by uid)) select uid, traj_id, round(case when n = 1 then score else n * (score - m) / (n - 1) end, 6) as advantage from g")
def g2_rloo(spark, d) -> DataFrame:
    return groups.rloo_advantage(scores(spark, d)).select("uid", "traj_id", r6("advantage").alias("advantage"))


@query(f"with {TOKENS_SQL}, s as (select uid, traj_id, sum(reward) as score from tokens group by all), g as (select *, case when count(*) over w = 1 then score else score - avg(score) over w end as a from s window w as (partition by uid)), t as (select traj_id, pos, mask, a * mask as a from tokens join g using (traj_id)), m as (select avg(a) as m, var_samp(a) as v from t where mask > 0) select traj_id, pos, round((a - m) / sqrt(v + 1e-8), 6) as advantage from t, m")
def g3_reinforce_baseline(spark, d) -> DataFrame:
    t = tokens(spark, d)
    own = groups.grpo_advantage(scores(spark, d), by_std=False).select("traj_id", F.col("advantage").alias("a"))
    out = t.join(own, "traj_id").withColumn("advantage", F.col("a") * F.col("mask"))
    return scans.whiten(out.select("traj_id", "pos", "mask", "advantage"), "advantage", "mask").select("traj_id", "pos", r6("advantage").alias("advantage"))


DISCOUNT = "sum({v} * power({r}, c)) over (partition by traj_id order by pos rows between current row and unbounded following) / power({r}, c)"
COUNTED = "c as (select *, coalesce(sum(mask) over (partition by traj_id order by pos rows between unbounded preceding and 1 preceding), 0) as c from {src})"


@query(f"with {TOKENS_SQL}, {COUNTED.format(src='tokens')}, t as (select traj_id, pos, mask, {DISCOUNT.format(v='reward', r=0.95)} as ret from c), m as (select avg(ret) as m, var_samp(ret) as v from t where mask > 0) select traj_id, pos, round((ret - m) / sqrt(v + 1e-8) * mask, 6) as advantage from t, m")
def g4_reinforce_returns(spark, d) -> DataFrame:
    t = tokens(spark, d)
    out = scans.discounted(t, F.col("reward"), F.col("mask"), 0.95, "advantage")
    return scans.whiten(out.select("traj_id", "pos", "mask", "advantage"), "advantage", "mask").select("traj_id", "pos", r6(F.col("advantage") * F.col("mask")).alias("advantage"))


@query(f"with {TOKENS_SQL}, n as (select *, coalesce(first(case when mask > 0 then value end ignore nulls) over (partition by traj_id order by pos rows between 1 following and unbounded following), 0) as after from tokens), {COUNTED.format(src='n')}, e as (select *, case when mask > 0 then reward + 0.99 * after - value else 0 end as delta, case when mask > 0 then reward else 0 end as gain from c) select traj_id, pos, round({DISCOUNT.format(v='delta', r=0.99 * 0.95)}, 6) as advantage, round({DISCOUNT.format(v='gain', r=0.99)}, 6) as returns from e".replace("first(case", "first_value(case"))
def g5_gae(spark, d) -> DataFrame:
    return scans.gae(tokens(spark, d), 0.99, 0.95).select("traj_id", "pos", r6("advantage").alias("advantage"), r6("return").alias("returns"))


@query(f"with {TOKENS_SQL} select traj_id, pos, round(sum(reward * mask) over (partition by traj_id order by pos rows between current row and unbounded following) - 10.0 * mask, 6) as advantage from tokens")
def g6_remax(spark, d) -> DataFrame:
    return tokens(spark, d).select("traj_id", "pos", r6(scans.suffix_sum(F.col("reward") * F.col("mask")) - 10.0 * F.col("mask")).alias("advantage"))


@query(f"with {SCORES_SQL}, g as (select *, min(score) over w as lo, max(score) over w as hi, count(*) over w as n from scores window w as (partition by uid)) select uid, traj_id, score from g where lo < hi or n = 1")
def g9_informative_groups(spark, d) -> DataFrame:
    return groups.informative_groups(scores(spark, d)).select("uid", "traj_id", "score")


@query(f"with {TOKENS_SQL} select traj_id, pos, case when coalesce(sum(case when reward > 45 then 1 else 0 end) over (partition by traj_id order by pos rows between unbounded preceding and 1 preceding), 0) = 0 then 1 else 0 end as keep, greatest(sum(mask) over (partition by traj_id order by pos) - 1, 0)::bigint as position_id from tokens")
def g12_eos_mask_and_positions(spark, d) -> DataFrame:
    t = tokens(spark, d)
    at = F.sum("mask").over(Window.partitionBy("traj_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return t.select("traj_id", "pos", scans.until_eos(F.when(F.col("reward") > 45, 1).otherwise(0), F.lit(1)).alias("keep"), F.greatest(at - 1, F.lit(0)).cast("long").alias("position_id"))


@query(f"with {TOKENS_SQL}, k as (select *, value / 10 - kl as x from tokens) select traj_id, pos, round(x, 6) as kl, round(abs(x), 6) as kl_abs, round(0.5 * x * x, 6) as kl_mse, round(greatest(least(exp(-x) + x - 1, 10), -10), 6) as kl_low_var, round(reward - 0.05 * x * mask, 6) as penalised from k")
def g17_kl_penalty(spark, d) -> DataFrame:
    a, b = F.col("value") / 10, F.col("kl")
    k = {n: r6(scans.kl_penalty(kind, a, b)).alias(n) for n, kind in (("kl", "kl"), ("kl_abs", "abs"), ("kl_mse", "mse"), ("kl_low_var", "low_var_kl"))}
    return tokens(spark, d).select("traj_id", "pos", *k.values(), r6(F.col("reward") - 0.05 * (a - b) * F.col("mask")).alias("penalised"))


@query(f"with {TOKENS_SQL}, s as (select traj_id, sum(reward * mask) as t, sum(mask) as n from tokens group by 1) select round(sum(t) / sum(n), 6) as token_mean, round(avg(t), 6) as seq_mean_token_sum, round(avg(t / nullif(n, 0)), 6) as seq_mean_token_mean from s")
def g21_loss_aggregation(spark, d) -> DataFrame:
    s = tokens(spark, d).groupBy("traj_id").agg(F.sum(F.col("reward") * F.col("mask")).alias("t"), F.sum("mask").alias("n"))
    return s.agg(r6(F.try_divide(F.sum("t"), F.sum("n"))).alias("token_mean"), r6(F.avg("t")).alias("seq_mean_token_sum"), r6(F.avg(F.try_divide("t", "n"))).alias("seq_mean_token_mean"))


# Aggregates


@query(f"with {TOKENS_SQL}, s as (select traj_id, sum(reward) as score, count(*) as n, sum(mask) as acted from tokens group by 1) select round(avg(score), 6) as score_mean, max(score) as score_max, min(score) as score_min, round(avg(n), 6) as length_mean, max(n)::bigint as length_max, round(avg(case when n = 13 then 1.0 else 0 end), 6) as clip_ratio, (select round(1 - var_samp(reward - value) / (var_samp(reward) + 1e-5), 6) from tokens where mask > 0) as explained from s")
def a1_batch_metrics(spark, d) -> DataFrame:
    t = tokens(spark, d)
    s = t.groupBy("traj_id").agg(F.sum("reward").alias("score"), F.count("*").alias("n"))
    on = t.where("mask > 0").agg(r6(1 - F.var_samp(F.col("reward") - F.col("value")) / (F.var_samp("reward") + 1e-5)).alias("explained"))
    return s.agg(r6(F.avg("score")).alias("score_mean"), F.max("score").alias("score_max"), F.min("score").alias("score_min"), r6(F.avg("n")).alias("length_mean"), F.max("n").alias("length_max"), r6(F.avg(F.when(F.col("n") == 13, 1.0).otherwise(0.0))).alias("clip_ratio")).crossJoin(F.broadcast(on))


@query(f"with {SCORES_SQL}, u as (select uid, avg(case when score > 100 then 1.0 else 0 end) as p from scores group by 1) select round(avg(p), 6) as pass_rate, round(median(p), 6) as median_rate, round(stddev_pop(p), 6) as std_rate, sum(case when p = 1 then 1 else 0 end)::bigint as all_pass, sum(case when p > 0 and p < 1 then 1 else 0 end)::bigint as some_pass, sum(case when p = 0 then 1 else 0 end)::bigint as none_pass, sum(case when p < 0.3 then 1 else 0 end)::bigint as low, sum(case when p >= 0.3 and p < 0.7 then 1 else 0 end)::bigint as mid, sum(case when p >= 0.7 then 1 else 0 end)::bigint as high from u")
def a6_pass_rates(spark, d) -> DataFrame:
    u = scores(spark, d).groupBy("uid").agg(F.avg(F.when(F.col("score") > 100, 1.0).otherwise(0.0)).alias("p"))
    p, many = F.col("p"), lambda c: F.sum(F.when(c, 1).otherwise(0))
    return u.agg(r6(F.avg(p)).alias("pass_rate"), r6(F.median(p)).alias("median_rate"), r6(F.stddev_pop(p)).alias("std_rate"), many(p == 1).alias("all_pass"), many((p > 0) & (p < 1)).alias("some_pass"), many(p == 0).alias("none_pass"), many(p < 0.3).alias("low"), many((p >= 0.3) & (p < 0.7)).alias("mid"), many(p >= 0.7).alias("high"))


@query(f"with {SCORES_SQL}, r as (select *, row_number() over (partition by uid order by score, traj_id) as i, count(*) over (partition by uid) as n from scores) select uid, round(sum(score * (power(i * 1.0 / n, 4) - power((i - 1) * 1.0 / n, 4))), 6) as best, round(sum(score * (power((n - i + 1) * 1.0 / n, 4) - power((n - i) * 1.0 / n, 4))), 6) as worst from r group by 1")
def a8_best_and_worst_of_4(spark, d) -> DataFrame:
    return groups.best_of(scores(spark, d), "uid", "score", 4, "traj_id").select("uid", r6("best").alias("best"), r6("worst").alias("worst"))


@query("with c as (select o_custkey as uid, o_orderpriority as pred, count(*) as n, min(o_orderkey) as k from orders group by all), b as (select *, row_number() over (partition by uid order by n desc, k) as r from c) select uid, pred, o_totalprice as value, n from b join orders on k = o_orderkey where r = 1")
def a9_majority(spark, d) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("uid"), F.col("o_orderpriority").alias("pred"), F.col("o_totalprice").alias("value"), "o_orderkey")
    return groups.majority(o, "uid", "pred", "value", "o_orderkey")


@query(f"with {SCORES_SQL}, a as (select o_orderpriority as data_source, uid, avg(score) as s from scores join orders on traj_id = o_orderkey group by all) select data_source, round(avg(s), 6) as score from a group by 1")
def a12_score_by_source(spark, d) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("traj_id"), F.col("o_orderpriority").alias("data_source"))
    return scores(spark, d).join(o, "traj_id").groupBy("data_source", "uid").agg(F.avg("score").alias("s")).groupBy("data_source").agg(r6(F.avg("s")).alias("score"))


@query(f"with {SCORES_SQL}, r as (select *, row_number() over (partition by uid order by traj_id) as i from scores), u as (select uid, max(case when score > 100 then 1 else 0 end) as hit, sum(case when score > 100 then 1 else 0 end) as n from r where i <= 4 group by 1) select round(avg(hit), 6) as pass_at_4, round(sum(n) / (count(*) * 4.0), 6) as avg_at_4 from u")
def a13_pass_at_4(spark, d) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("uid").orderBy("traj_id"))
    tries = scores(spark, d).withColumn("i", place).where("i <= 4").groupBy("uid").agg(F.count_if(F.col("score") > 100).alias("n"))
    return tries.agg(r6(F.avg((F.col("n") > 0).cast("int"))).alias("pass_at_4"), r6(F.sum("n") / (F.count("*") * 4.0)).alias("avg_at_4"))


@query("select coalesce(source, 'all') as category, count(*) as n, round(avg(quality), 6) as accuracy from labels join documents using (doc_id) group by rollup (source)")
def a17_accuracy_rollup(spark, d) -> DataFrame:
    both = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return both.rollup("source").agg(F.count("*").alias("n"), r6(F.avg("quality")).alias("accuracy")).select(F.coalesce("source", F.lit("all")).alias("category"), "n", "accuracy")


@query(f"with {SCORES_SQL}, s as (select uid, traj_id, score, o_totalprice as p from scores join orders on traj_id = o_orderkey), x as (select a.uid, sum(case when a.p > b.p then a.score - b.score else 0 end) as hit, sum(a.score - b.score) as w from s a join s b on a.uid = b.uid and a.score > b.score group by 1) select uid, round(coalesce(hit / w, 0.5), 6) as accuracy from (select distinct uid from s) left join x using (uid)")
def a22_preference_accuracy(spark, d) -> DataFrame:
    s = scores(spark, d).join(table(spark, d, "orders").select(F.col("o_orderkey").alias("traj_id"), F.col("o_totalprice").alias("p")), "traj_id")
    return groups.preference_accuracy(s, "uid", "p", "score").select("uid", r6("accuracy").alias("accuracy"))


# Batch algebra

ROWS = "rows as (select row_number() over (order by o_orderkey) - 1 as row_id, o_orderkey, o_totalprice from orders)"


def numbered(spark, d) -> DataFrame:
    return batch.with_row_id(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")


@query(f"with {ROWS} select (row_id - 10) // 7 as row_id, o_orderkey from rows where row_id >= 10 and row_id < (select count(*) from orders) - 5 and (row_id - 10) % 7 = 0")
def p5_slice(spark, d) -> DataFrame:
    return batch.take(numbered(spark, d), 10, -5, 7).select("row_id", "o_orderkey")


@query(f"with {ROWS}, n as (select count(*) as n from orders) select n - 1 - row_id as row_id, o_orderkey from rows, n")
def p7_reorder(spark, d) -> DataFrame:
    rows = numbered(spark, d)
    n = rows.count()
    return batch.gather(rows, spark.range(n).select((n - 1 - F.col("id")).alias("out_id"), F.col("id").alias("row_id"))).select("row_id", "o_orderkey")


@query(f"with {ROWS} select row_id * 3 + k as row_id, o_orderkey from rows, (select unnest([0, 1, 2]) as k)")
def p8_repeat_interleaved(spark, d) -> DataFrame:
    return batch.repeat(numbered(spark, d), 3).select("row_id", "o_orderkey")


@query(f"with {ROWS} select row_id // 3000 as chunk_id, count(*) as n, round(sum(o_totalprice), 2) as total from rows group by 1".replace("3000", "((select count(*) from orders) // 5)"))
def p9_chunk(spark, d) -> DataFrame:
    return batch.chunk(numbered(spark, d), 5).groupBy("chunk_id").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(f"with {ROWS}, n as (select count(*) as n from orders) select row_id, o_orderkey from rows union all select row_id + n, o_orderkey from rows, n where row_id < (7 - n % 7) % 7")
def p10_pad_to_divisor(spark, d) -> DataFrame:
    return batch.pad_to(numbered(spark, d), 7)[0].select("row_id", "o_orderkey")


@query("with c as (select conv_id, turn, role, text from conversations), f as (select conv_id, count(*) as turns, max(case when role = 'system' then 1 else 0 end) as sys, min(length(text)) as least from c group by 1), r as (select case when turns <= 3 then 'short' when sys = 0 then 'no system turn' when least < 20 then 'short turn' else 'kept' end as reason from f) select reason, count(*) as n from r group by 1")
def p25_filter_cascade(spark, d) -> DataFrame:
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.max(F.when(F.col("role") == "system", 1).otherwise(0)).alias("sys"), F.min(F.length("text")).alias("least"))
    return c.select(F.when(F.col("turns") <= 3, "short").when(F.col("sys") == 0, "no system turn").when(F.col("least") < 20, "short turn").otherwise("kept").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(f"with {ROWS} select row_id, o_orderkey, o_totalprice, o_custkey from rows join orders using (o_orderkey, o_totalprice)")
def j1_union_columns(spark, d) -> DataFrame:
    other = batch.with_row_id(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    return batch.union_columns(numbered(spark, d), other).select("row_id", "o_orderkey", "o_totalprice", "o_custkey")


@query("with done as (select distinct doc_id from labels where quality = 1) select doc_id, source from documents where doc_id not in (select doc_id from done)")
def j6_resume_anti_join(spark, d) -> DataFrame:
    done = table(spark, d, "labels").where("quality = 1").select("doc_id")
    return table(spark, d, "documents").select("doc_id", "source").join(done, "doc_id", "left_anti")


@query("select min(doc_id) as doc_id, text, count(*) as copies from documents group by text")
def u4_first_wins_dedup(spark, d) -> DataFrame:
    return batch.first_wins(table(spark, d, "documents").select("text", "doc_id"), "text", "doc_id").select("doc_id", "text", "copies")


@query("select source, doc_id from (select *, row_number() over (partition by source order by md5(doc_id || '|42'), doc_id) as n from documents) where n <= 5")
def u8_sample_per_source(spark, d) -> DataFrame:
    return batch.sample_per(table(spark, d, "documents").select("source", "doc_id"), "source", "doc_id", 5, 42)


@query("with r as (select o_orderpriority as g, o_orderkey, row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey) - 1 as r from orders) select g, o_orderkey, case when (r // 8) % 2 = 0 then r % 8 else 7 - r % 8 end as bin from r")
def o6_snake_balance(spark, d) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("g"), "o_orderkey", "o_totalprice")
    return batch.snake(o, "g", "o_totalprice", "o_orderkey", 8).select("g", "o_orderkey", "bin")


# Texts

@F.pandas_udf(StructType().add("same", "long").add("size", "long"))
def common_words(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Words that two normalised texts share, repeats counted, and the words of both."""
    counted = ([Counter(x.split(" ") if x else ()) for x in c] for c in (a, b))
    return pd.DataFrame([((p & t).total(), p.total() + t.total()) for p, t in zip(*counted, strict=True)], columns=["same", "size"])


NORM = "regexp_replace(lower(replace({x}, '_', ' ')), '[!-/:-@\\[-`{{-~]', ' ', 'g')"


@query(f"with p as (select a.doc_id, a.text as x, b.text as y from documents a join documents b on b.doc_id = a.doc_id + 1), w as (select doc_id, list_filter(regexp_split_to_array({NORM.format(x='x')}, '\\s+'), lambda v: v not in ('', 'a', 'an', 'the')) as p, list_filter(regexp_split_to_array({NORM.format(x='y')}, '\\s+'), lambda v: v not in ('', 'a', 'an', 'the')) as t from p), e as (select doc_id, v, sum(s = 0) as n, sum(s = 1) as m from (select doc_id, unnest(p) as v, 0 as s from w union all select doc_id, unnest(t), 1 from w) group by all), k as (select doc_id, sum(least(n, m)) as same from e group by 1) select doc_id, round(coalesce(2.0 * same / (len(p) + len(t)), 0), 6) as f1 from w left join k using (doc_id)")
def t18_token_f1(spark, d) -> DataFrame:
    """F1 of each text and the next: a text is normalised once and goes to its two pairs whole, and a pair's words are counted where it is."""
    docs = table(spark, d, "documents").select("doc_id", text.normalised(F.col("text")).alias("plain"))
    pairs = docs.join(docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("plain").alias("next")), "doc_id")
    both = pairs.select("doc_id", common_words("plain", "next").alias("w"))
    return both.select("doc_id", r6(F.coalesce(F.try_divide(2.0 * F.col("w.same"), F.col("w.size")), F.lit(0.0))).alias("f1"))


@query("with t as (select o_orderkey, 'so #### $' || cast(o_custkey as varchar) || ',000 then #### ' || cast(o_custkey + o_orderkey % 3 as varchar) as c, cast(o_custkey as varchar) as truth from orders), e as (select *, translate(list_last(regexp_extract_all(c, '#### (\\-?[0-9\\.\\,]+)', 1)), ',$', '') as got from t) select o_orderkey, got, case when got = truth then 1.0 else 0.0 end as score from e".replace("translate(list_last", "(list_last").replace(", ',$', '')", ")"))
def t20_gsm8k_score(spark, d) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("so #### $"), F.col("o_custkey").cast("string"), F.lit(",000 then #### "), (F.col("o_custkey") + F.col("o_orderkey") % 3).cast("string")).alias("c"), F.col("o_custkey").cast("string").alias("truth"))
    got = text.gsm8k_strict(F.col("c"))
    return o.select("o_orderkey", got.alias("got"), F.when(got == F.col("truth"), 1.0).otherwise(0.0).alias("score"))


@query(f"with {TOKENS_SQL}, n as (select traj_id, count(*) as n from tokens group by 1) select traj_id, round(least(-(n - 6) / 4.0 * 1.0, 0), 6) as penalty from n")
def t41_overlong_penalty(spark, d) -> DataFrame:
    n = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("traj_id")).agg(F.count("*").alias("n"))
    kept = n.join(table(spark, d, "orders").select(F.col("o_orderkey").alias("traj_id")), "traj_id")
    return kept.select("traj_id", r6(text.overlong_penalty(F.col("n"), 10, 4, 1.0)).alias("penalty"))


# Geometry

BOX = "b as (select p_partkey, p_size * 1.0 as x1, p_partkey % 37 * 1.0 as y1, p_size + 20.0 as x2, p_partkey % 37 + 30.0 as y2, p_partkey % 41 * 1.0 as u1, p_size % 19 * 1.0 as v1, p_partkey % 41 + 25.0 as u2, p_size % 19 + 15.0 as v2 from part)"


@query(f"with {BOX}, i as (select *, greatest(least(x2, u2) - greatest(x1, u1), 0) * greatest(least(y2, v2) - greatest(y1, v1), 0) as a from b) select p_partkey, round(a / ((x2 - x1) * (y2 - y1) + (u2 - u1) * (v2 - v1) - a), 6) as iou from i")
def m14_iou(spark, d) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    a = [s * 1.0, k % 37 * 1.0, s + 20.0, k % 37 + 30.0]
    b = [k % 41 * 1.0, s % 19 * 1.0, k % 41 + 25.0, s % 19 + 15.0]
    return table(spark, d, "part").select("p_partkey", r6(geometry.iou(a, b)).alias("iou"))


SIDES = "s as (select p_partkey, p_size * 40 + 30 as h, p_partkey % 1500 + 60 as w from part), q as (select *, greatest(28, round_even(h / 28.0, 0) * 28) as h0, greatest(28, round_even(w / 28.0, 0) * 28) as w0, sqrt(h * w / 200704.0) as down, sqrt(3136.0 / (h * w)) as up from s)"


@query(f"with {SIDES}, z as (select p_partkey, (case when h0 * w0 > 200704 then greatest(28, floor(floor(h / down) / 28) * 28) when h0 * w0 < 3136 then ceil(floor(h * up) / 28) * 28 else h0 end)::bigint as height, (case when h0 * w0 > 200704 then greatest(28, floor(floor(w / down) / 28) * 28) when h0 * w0 < 3136 then ceil(floor(w * up) / 28) * 28 else w0 end)::bigint as width from q) select *, (height // 28) * (width // 28) as tokens from z")
def m2_smart_resize(spark, d) -> DataFrame:
    s = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 40 + 30).alias("h"), (F.col("p_partkey") % 1500 + 60).alias("w"))
    h, w = geometry.smart_resize(F.col("h"), F.col("w"), 28, 3136, 200704)
    return s.select("p_partkey", h.alias("height"), w.alias("width")).withColumn("tokens", F.expr("(height div 28) * (width div 28)"))
