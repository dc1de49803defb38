"""Queries of batch algebra, joins, sampling, balancing, boxes and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import geometry
from quarry.operators import balance, batch
from quarry.plans.catalog import ROWS, numbered, query, r6
from quarry.sources import tables as files
from quarry.tables import SCORES_SQL, scores, table


@query(f"with {ROWS} select row_id, o_orderkey as key, o_totalprice as price from rows")
def p1_p3_select_pop_rename(spark, d) -> DataFrame:
    popped, left = batch.pop(numbered(spark, d), "o_totalprice")
    return batch.rename(left, ["o_orderkey"], ["key"]).join(popped.withColumnRenamed("o_totalprice", "price"), "row_id").select("row_id", "key", "price")


@query(f"with {ROWS} select row_id, o_orderkey from rows where row_id < (select count(*) from orders) - 5")
def p11_unpad(spark, d) -> DataFrame:
    rows = numbered(spark, d)
    padded, pad = batch.pad_to(rows, 7)
    n = rows.count() + pad
    return batch.unpad(batch.unpad(padded, pad, n), 5, n - pad).select("row_id", "o_orderkey")


@query(f"with {ROWS} select row_id, o_orderkey, o_totalprice from rows")
def p12_p13_fold_unfold(spark, d) -> DataFrame:
    rows = numbered(spark, d)
    n = rows.count()
    return batch.unfold(batch.fold(rows, n // 5, n), 5).select("row_id", "o_orderkey", "o_totalprice")


@query(f"with {ROWS} select e::int as epoch, row_id // 100 as mini_batch_id, count(*) as n, round(sum(o_totalprice), 2) as total from rows, (select unnest([0, 1]) as e) group by all")
def p14_minibatches(spark, d) -> DataFrame:
    return batch.minibatches(numbered(spark, d), 100, 2).groupBy("epoch", "mini_batch_id").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(f"with {ROWS} select row_id, o_orderkey from rows where row_id >= 20")
def p28_row_range(spark, d) -> DataFrame:
    return batch.row_range(numbered(spark, d), 20, -1).select("row_id", "o_orderkey")


@query("select sum(length(text))::bigint as characters, count(*) as n_rows, count(distinct lang) as languages from documents")
def p17_p18_size(spark, d) -> DataFrame:
    return table(spark, d, "documents").agg(F.sum(F.length("text")).alias("characters"), F.count("*").alias("n_rows"), F.countDistinct("lang").alias("languages"))


@query("select conv_id, count(*) as n, string_agg(role || ':' || turn, ',' order by turn) as members from conversations group by 1")
def p19_n16_lists_by_key(spark, d) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.array_join(F.transform(rows, lambda x: F.concat(x["role"], F.lit(":"), x["turn"].cast("string"))), ",").alias("members"))


@query("with f as (select doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\r]+'), lambda x: x <> '')) as words, n_chars from documents) select doc_id, words::bigint as words from f where words <= 300 and n_chars > 100 and n_chars <= 4000")
def p20_p23_limits(spark, d) -> DataFrame:
    """Texts within a number of words, and within a size as images are within pixels."""
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "[ \\t\\n\\r]+"), lambda x: x != "")).cast("long")
    return table(spark, d, "documents").select("doc_id", words.alias("words"), "n_chars").where("words <= 300 and n_chars > 100 and n_chars <= 4000").drop("n_chars")


@query("select o_orderkey, o_orderpriority from orders where not contains(o_orderpriority, 'LOW') and strftime(o_orderdate, '%Y-%m-%d') >= '1995-01-01' and strftime(o_orderdate, '%Y-%m-%d') < '1997-01-01' and o_orderstatus = 'F' and length(o_orderpriority) > 0")
def p24_p26_p27_p29_p30_filters(spark, d) -> DataFrame:
    o, day = table(spark, d, "orders"), F.date_format("o_orderdate", "yyyy-MM-dd")
    return o.where(~F.contains("o_orderpriority", F.lit("LOW")) & (day >= "1995-01-01") & (day < "1997-01-01") & (F.col("o_orderstatus") == "F") & (F.length("o_orderpriority") > 0)).select("o_orderkey", "o_orderpriority")


@query("with g as (select o_custkey as uid, avg(case when o_totalprice > 150000 then 1.0 else 0 end) as p, count(*) as n from orders group by 1), k as (select uid, p, case when p >= 0.2 and p <= 0.8 then 1 else 0 end as ok, row_number() over (order by case when p >= 0.2 and p <= 0.8 then 1 else 0 end desc, uid) as r from g) select uid, round(p, 6) as rate, ok from k where r <= (select count(*) // 2 from g)")
def p31_accuracy_band(spark, d) -> DataFrame:
    """Half of the prompts: those within the band first. The number kept is known from a count, so rows are numbered in their order and cut there."""
    g = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("uid")).agg(F.avg(F.when(F.col("o_totalprice") > 150000, 1.0).otherwise(0.0)).alias("p"))
    k = g.select("uid", r6("p").alias("rate"), F.when(F.col("p").between(0.2, 0.8), 1).otherwise(0).alias("ok"))
    placed = batch.with_row_id(k.withColumn("out", 1 - F.col("ok")), "out", "uid")
    return placed.where(F.col("row_id") < g.count() // 2).select("uid", "rate", "ok")


@query("select p_partkey, array_to_string(list_filter([p_name, null, p_brand, case when p_size > 20 then p_type end], lambda x: x is not null), '|') as options from part")
def p32_wide_to_array(spark, d) -> DataFrame:
    options = F.array_compact(F.array("p_name", F.lit(None).cast("string"), "p_brand", F.when(F.col("p_size") > 20, F.col("p_type"))))
    return table(spark, d, "part").select("p_partkey", F.array_join(options, "|").alias("options"))


@query("select doc_id, quality, toxic from labels where doc_id in (select doc_id from documents where lang = 'en') order by doc_id")
def j5_semi_join(spark, d) -> DataFrame:
    en = table(spark, d, "documents").where("lang = 'en'").select("doc_id")
    return table(spark, d, "labels").select("doc_id", "quality", "toxic").join(en, "doc_id", "left_semi")


@query("select doc_id from documents except select doc_id from labels")
def j7_u6_difference(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("select 'doc' || doc_id as stem, page_id, doc_id from documents join pages on doc_id = page_id")
def j8_match_by_stem(spark, d) -> DataFrame:
    a = table(spark, d, "documents").select("doc_id", F.concat(F.lit("/data/x/doc"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("f"))
    b = table(spark, d, "pages").select("page_id", F.concat(F.lit("notes/doc"), F.col("page_id").cast("string"), F.lit(".json")).alias("g"))
    return files.by_stem(a, b, "f", "g").select("stem", "page_id", "doc_id")


@query(f"with {SCORES_SQL} select traj_id, round(score - avg(score) over (partition by uid), 6) as apart from scores")
def j9_group_mean(spark, d) -> DataFrame:
    return scores(spark, d).select("traj_id", r6(F.col("score") - F.avg("score").over(Window.partitionBy("uid"))).alias("apart"))


@query("select o_orderkey as id, o_totalprice as amount, null::bigint as user_id from orders union all select event_id, value, user_id from events")
def u1_u2_concat(spark, d) -> DataFrame:
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"))
    return a.unionByName(table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("value").alias("amount"), "user_id"), allowMissingColumns=True)


@query("with f as (select user_id, min(event_id // 50) as step from events group by 1), s as (select distinct event_id // 50 as step from events), n as (select s.step, count(f.user_id) as n from s left join f using (step) group by 1), b as (select step, coalesce(sum(n) over (order by step rows between unbounded preceding and 1 preceding), 0) as before from n) select event_id, user_id from events join b on event_id // 50 = step where before < 60")
def u3_batches_until_enough(spark, d) -> DataFrame:
    e = table(spark, d, "events").withColumn("step", F.floor(F.col("event_id") / 50).cast("long"))
    return batch.batches_until(e, "step", "user_id", 60).select("event_id", "user_id")


@query("select lang, source, count(*) as n from documents group by 1, 2")
def u5_distinct(spark, d) -> DataFrame:
    return table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))


@query("select doc_id, unnest(['chosen', 'rejected']) as side, unnest([quality, 1 - quality]) as label from labels")
def u7_two_rows(spark, d) -> DataFrame:
    two = F.array(F.struct(F.lit("chosen").alias("side"), F.col("quality").alias("label")), F.struct(F.lit("rejected").alias("side"), (1 - F.col("quality")).alias("label")))
    return table(spark, d, "labels").select("doc_id", F.explode(two).alias("x")).select("doc_id", "x.*")


@query("select doc_id, source from documents order by md5(doc_id || '|7'), doc_id limit 100")
def u9_u10_sample(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "source").orderBy(batch.seeded(F.col("doc_id"), 7), "doc_id").limit(100)


@query("with r as (select doc_id, row_number() over (order by md5(doc_id || '|3'), doc_id) - 1 as i from documents) select doc_id, i // 32 as batch_id from r where i < (select count(*) from documents) // 32 * 32")
def u11_shuffled_batches(spark, d) -> DataFrame:
    rows = batch.with_row_id(table(spark, d, "documents").select("doc_id").withColumn("at", batch.seeded(F.col("doc_id"), 3)), "at", "doc_id")
    n = rows.count()
    return rows.where(F.col("row_id") < n // 32 * 32).select("doc_id", F.floor(F.col("row_id") / 32).cast("long").alias("batch_id"))


@query("with o as (select p_partkey, unnest([p_brand, p_type, p_name]) as x, unnest([1, 2, 3]) as i from part), r as (select *, row_number() over (partition by p_partkey order by md5(p_partkey || '-' || i || '|5')) as place from o) select p_partkey, place as gold from r where i = 1")
def u12_shuffled_options(spark, d) -> DataFrame:
    """Where the first option lies after its part's options are shuffled."""
    seeded = [F.struct(batch.seeded(F.concat(F.col("p_partkey").cast("string"), F.lit(f"-{i}")), 5).alias("at"), F.lit(i).alias("i")) for i in (1, 2, 3)]
    return table(spark, d, "part").select("p_partkey", F.array_position(F.transform(F.sort_array(F.array(*seeded)), lambda x: x["i"]), 1).alias("gold"))


def steps(spark, d) -> DataFrame:
    """Orders as sequences, 125 a training step."""
    return table(spark, d, "orders").select(F.floor(F.col("o_orderkey") / 125).cast("long").alias("g"), "o_orderkey", F.floor(F.col("o_totalprice") / 1000).cast("long").alias("size"))


STEPS = "s as (select o_orderkey // 125 as g, o_orderkey, floor(o_totalprice / 1000)::bigint as size from orders)"


@query()
def o4_o6_balanced_partition(spark, d) -> DataFrame:
    return balance.balanced(steps(spark, d), "g", "size", "o_orderkey", 5, equal=True)


@query()
def o5_greedy_partition(spark, d) -> DataFrame:
    return balance.balanced(steps(spark, d), "g", "size", "o_orderkey", 5, how="greedy", equal=True)


@query(f"with {STEPS} select g, (sum(size)::bigint + 4999) // 5000 as bins, count(*) as n from s group by 1")
def o8_bins_under_a_cap(spark, d) -> DataFrame:
    return balance.balanced(steps(spark, d), "g", "size", "o_orderkey", 0, cap=5000).groupBy("g").agg((F.max("bin") + 1).alias("bins"), F.count("*").alias("n"))


@query(f"with {STEPS}, p as (select *, (row_number() over (partition by g order by o_orderkey) - 1) * 5 // count(*) over (partition by g) as b from s), m as (select g, b, sum(size) as n from p group by 1, 2) select g, min(n)::bigint as least, max(n)::bigint as largest, round(avg(n), 6) as mean, (max(n) - min(n))::bigint as spread, true as better from m group by 1")
def a24_imbalance(spark, d) -> DataFrame:
    """Sums of a step's bins as its rows come, and whether balancing brings them closer."""
    dealt = balance.balanced(steps(spark, d), "g", "size", "o_orderkey", 5)
    out = balance.imbalance(dealt, "g", "size", "bin", "o_orderkey", 5)
    better = (F.col("balanced_largest") - F.col("balanced_least")) <= F.col("spread")
    return out.select("g", "least", "largest", r6("mean").alias("mean"), "spread", better.alias("better"))


@query(f"with {ROWS}, n as (select count(*) as n from orders) select row_id, (row_id * 7) % n as place, o_orderkey from rows, n")
def o7_o9_permutation_and_inverse(spark, d) -> DataFrame:
    rows = numbered(spark, d)
    n = rows.count()
    places = spark.range(n).select(F.col("id").alias("row_id"), (F.col("id") * 7 % n).alias("place"))
    there = rows.join(places, "row_id").select(F.col("place").alias("row_id"), "o_orderkey")
    return there.join(places.select(F.col("row_id").alias("back"), F.col("place").alias("row_id")), "row_id").select(F.col("back").alias("row_id"), F.col("row_id").alias("place"), "o_orderkey")


SIDES = "s as (select p_partkey, p_size * 40 + 30 as h, p_partkey % 1500 + 60 as w, p_size / 10.0 as ratio from part)"


@query(f"with {SIDES} select p_partkey, (round_even(h / 28.0, 0) * 28)::bigint as near, (h // 28 * 28)::bigint as low, (ceil(h / 28.0) * 28)::bigint as high, greatest(28, floor(h / case when h * w > 200704 then sqrt(h * w / 200704.0) else 1 end / 28) * 28)::bigint as height, greatest(28, floor(w / case when h * w > 200704 then sqrt(h * w / 200704.0) else 1 end / 28) * 28)::bigint as width from s")
def m1_m3_m4_factors(spark, d) -> DataFrame:
    s = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 40 + 30).alias("h"), (F.col("p_partkey") % 1500 + 60).alias("w"))
    h, w = geometry.shrunk(F.col("h"), F.col("w"), 28, 200704)
    near, low, high = (geometry.to_factor(F.col("h"), 28, k) for k in ("round", "floor", "ceil"))
    return s.select("p_partkey", near.alias("near"), low.alias("low"), high.alias("high"), h.alias("height"), w.alias("width"))


@query(f"with {SIDES} select p_partkey, floor(case when p_partkey % 3 = 0 then case when w * h > 200704 then 200704.0 else 1048576.0 end when ratio = 1 then 1048576.0 else least(w * ratio * h * ratio, 1048576.0) end)::bigint as budget, floor(greatest(least(w * h * ratio, 1048576.0), 132496.0))::bigint as clamped from s")
def m6_m7_budgets(spark, d) -> DataFrame:
    s = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 40 + 30).alias("h"), (F.col("p_partkey") % 1500 + 60).alias("w"), (F.col("p_size") / 10.0).alias("ratio"))
    ratio = F.when(F.col("p_partkey") % 3 != 0, F.col("ratio"))
    return s.select("p_partkey", geometry.budget(F.col("w"), F.col("h"), ratio, 1048576).alias("budget"), geometry.ratio_budget(F.col("w"), F.col("h"), F.col("ratio")).alias("clamped"))


BOXED = "b as (select p_partkey, p_size * 1.0 as x1, p_partkey % 37 * 1.0 as y1, p_size + 20.0 as x2, p_partkey % 37 + 30.0 as y2 from part)"


def boxed(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    return table(spark, d, "part"), [s * 1.0, k % 37 * 1.0, s + 20.0, k % 37 + 30.0]


@query(f"with {BOXED}, o as (select p_partkey, greatest(least(round_even(x1 / 0.5, 0), 60), 0)::bigint as a, greatest(least(round_even(y1 / 0.25, 0), 100), 0)::bigint as b, greatest(least(round_even(x2 / 0.5, 0), 60), 0)::bigint as c, greatest(least(round_even(y2 / 0.25, 0), 100), 0)::bigint as e from b) select *, a < c and b < e as some from o")
def m9_m10_to_original(spark, d) -> DataFrame:
    p, b = boxed(spark, d)
    (x1, y1, x2, y2), some = geometry.box_to_original(b, [F.lit(0.5), F.lit(0.25)], [F.lit(60), F.lit(100)])
    return p.select("p_partkey", x1.alias("a"), y1.alias("b"), x2.alias("c"), y2.alias("e"), some.alias("some"))


@query(f"with {BOXED}, o as (select *, least(greatest(round_even(x1 * 0.05, 0), 0), 59)::bigint as a, least(greatest(round_even(y1 * 0.25, 0), 0), 99)::bigint as b from b) select p_partkey, a, b, least(greatest(round_even(x2 * 0.05, 0), a + 1), 60)::bigint as c, least(greatest(round_even(y2 * 0.25, 0), b + 1), 100)::bigint as e, floor(x2 / 100 * 640)::bigint as share from o")
def m11_m12_to_overview(spark, d) -> DataFrame:
    p, b = boxed(spark, d)
    x1, y1, x2, y2 = geometry.box_to_overview(b, [F.lit(0.05), F.lit(0.25)], [F.lit(60), F.lit(100)])
    return p.select("p_partkey", x1.alias("a"), y1.alias("b"), x2.alias("c"), y2.alias("e"), geometry.box_from_shares([v / 100 for v in b], F.lit(640), F.lit(480))[2].alias("share"))


@query(f"with {BOXED} select p_partkey, 1 as n, x1 / 0.5 as left_, case when p_partkey % 2 = 0 then 1.0 else 0.0 end as best from b")
def m13_m16_boxes_of_turns(spark, d) -> DataFrame:
    p, b = boxed(spark, d)
    turns = F.array(F.array(F.array(*b), F.array(*[F.lit(5.0)] * 4)))
    own = geometry.boxes_to_original(turns, F.array(F.lit(0.5), F.lit(0.5)))
    target = F.when(F.col("p_partkey") % 2 == 0, F.array(F.array(*(v / 0.5 for v in b)))).otherwise(F.array().cast("array<array<double>>"))
    return p.select("p_partkey", F.size(own).alias("n"), F.get(F.get(own, F.lit(0)), F.lit(0)).alias("left_"), geometry.best_iou(own, target).alias("best"))


@query(f"with {BOXED} select p_partkey, case p_partkey % 3 when 0 then true when 1 then 20 * 30 * 4 < 4 * 28 * 28 else true end as bad from b")
def m18_bad_boxes(spark, d) -> DataFrame:
    p, b = boxed(spark, d)
    one = F.array(*b)
    boxes = F.when(F.col("p_partkey") % 3 == 0, F.array(one, one, one, one)).when(F.col("p_partkey") % 3 == 1, F.array(one)).otherwise(F.array(one, one))
    return p.select("p_partkey", geometry.bad_boxes(boxes, [F.lit(0.5), F.lit(0.5)], [F.lit(4000), F.lit(4000)]).alias("bad"))


@query("select doc_id, lang, source from documents where lang is not null and source is not null")
def s1_k1_k2_parquet_round_trip(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.struct("lang", "source").alias("extra")).where("extra.lang is not null and extra.source is not null")
    path = files.new_folder(spark, "capped")
    files.write_capped(docs, path, 4096, 64)
    return files.parquet_files(spark, [path], "doc_id long, extra struct<lang:string,source:string>", ["doc_id", "extra.lang", "extra.source"])


@query("select conv_id, turn, role, text from conversations")
def s9_s18_k4_json_lines_round_trip(spark, d) -> DataFrame:
    path = files.new_folder(spark, "lines")
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    c.where("turn % 2 = 0").write.mode("append").json(path)
    c.where("turn % 2 = 1").write.mode("append").json(path)
    return files.json_lines(spark, f"{path}/*.json", "conv_id long, turn long, role string, text string", lineage=True).where("src_file is not null").drop("src_file")


@query("select p_partkey, p_name, p_brand as image, p_size::bigint as k from part")
def s5_s7_tsv_round_trip(spark, d) -> DataFrame:
    path = files.new_folder(spark, "tsv")
    rows = table(spark, d, "part").select("p_partkey", "p_name", F.base64(F.col("p_brand").cast("binary")).alias("image"), F.to_json(F.struct(F.col("p_size").alias("k"))).alias("extra"))
    rows.write.option("sep", "\t").option("header", True).option("quote", '"').option("escape", '"').csv(path)
    back = files.tsv(spark, path, "p_partkey long, p_name string, image string, extra string", "image", {"extra": "k bigint"})
    return back.select("p_partkey", "p_name", F.col("image").cast("string").alias("image"), F.col("extra.k").alias("k"))


@query("select doc_id, case when doc_id % 3 = 0 then quality + 10 else quality end as quality from labels")
def k3_k5_upsert(spark, d) -> DataFrame:
    old = table(spark, d, "labels").select("doc_id", "quality")
    new = old.where("doc_id % 3 = 0").withColumn("quality", F.col("quality") + 10)
    path = files.write_back(files.upserted(old, new, "doc_id"), files.new_folder(spark, "upsert"))
    return files.json_lines(spark, path, "doc_id long, quality int").orderBy("doc_id")


@query("select doc_id, lang as \"extra/lang\", source as \"extra/more/source\" from documents")
def k10_flattened(spark, d) -> DataFrame:
    nested = table(spark, d, "documents").select("doc_id", F.struct("lang", F.struct("source").alias("more")).alias("extra"))
    return files.flattened(nested)


@query("with r as (select doc_id, row_number() over (order by doc_id) - 1 as i from documents), n as (select count(*) as n from documents) select doc_id from r, n where i >= round(0.75 * n)")
def s17_split_slice(spark, d) -> DataFrame:
    return files.split_slice(table(spark, d, "documents").select("doc_id"), "doc_id", 0.75, 1.0)


@query("select a * 10 + b as prompt, a || ',' || b as text from (select unnest(range(10)) as a), (select unnest(range(10)) as b)")
def s21_prompts(spark, d) -> DataFrame:
    """All pairs of two digits: a generator of bounded size."""
    a, b = spark.range(10).select(F.col("id").alias("a")), spark.range(10).select(F.col("id").alias("b"))
    return a.crossJoin(b).select((F.col("a") * 10 + F.col("b")).alias("prompt"), F.concat(F.col("a").cast("string"), F.lit(","), F.col("b").cast("string")).alias("text"))
