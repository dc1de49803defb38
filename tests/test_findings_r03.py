"""What the third round's findings asked for."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry import shared
from quarry import tables as sources
from quarry.llm import common, substring_dedup, toxicity
from quarry.operators import advantages, groups, nearest
from quarry.plans import catalog, evaluation, plugins, texts, training  # noqa: F401 (each registers its queries)


@pytest.fixture
def tables(spark, tmp_path):
    """Writes tables that a query reads, and returns their folder."""

    def write(**frames):
        for name, df in frames.items():
            df.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def test_numbers_that_differ_stay_different_at_any_key(spark, tables):
    """A hundredth of a key and five millions is the key itself near 50505."""
    keys = [0, 1, 7, 50500, 50505, 50510, 5_000_000, 505_050_505, 2**40]
    d = tables(orders=spark.createDataFrame([(i * 3 + r, n) for i, n in enumerate(keys) for r in range(3)], "o_orderkey long, o_custkey long"))
    got = {r["o_orderkey"]: r["same"] for r in catalog.QUERIES["t32_t33_numbers_and_format"](spark, d).collect()}
    assert got == {k: k % 3 != 2 for k in got} and len(got) == 3 * len(keys)


def test_tokens_are_dealt_out_by_their_number(spark, tables, monkeypatch):
    """A task holds about so many rows, however many there are and whatever Spark's own partitions are."""
    monkeypatch.setattr(sources, "ROWS_A_TASK", 100)
    n = 4000
    d = tables(
        orders=spark.range(n // 4).selectExpr("id as o_orderkey", "id % 7 as o_custkey"),
        lineitem=spark.range(n).selectExpr("id div 4 as l_orderkey", "id as l_partkey", "id as l_suppkey", "cast(id % 4 as int) as l_linenumber", "1.0D as l_quantity", "1.0D as l_extendedprice", "0.0D as l_discount", "0.0D as l_tax", "'N' as l_returnflag"),
    )
    t = sources.tokens(spark, d)
    rows = [r["n"] for r in t.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n")).collect()]
    assert sum(rows) == n and max(rows) <= 250
    assert t.where("pos = 4").count() == n // 4


def test_nearest_in_blocks_are_those_of_all_pairs(spark, tables, tmp_path, monkeypatch):
    """Copies, a null vector and blocks of a few; pairs aren't rows of a join."""
    for name, n in (("BLOCK", 7), ("SLICE", 50), ("TILE", 3)):
        monkeypatch.setattr(nearest, name, n)
    rng = np.random.default_rng(5)
    v = rng.standard_normal((400, 8)).astype(np.float32)
    v[100:160] = v[100]  # copies, some of them queries
    rows = [(i, [float(x) for x in v[i]] if i != 33 else None) for i in range(400)]
    d = tables(embeddings=spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    df = catalog.QUERIES["o10_retrieval"](spark, d)
    assert "CoGroup" in df._jdf.queryExecution().optimizedPlan().toString()
    got = sorted(tuple(r) for r in df.collect())
    duckdb.sql(f"create or replace view embeddings as select * from '{d}/embeddings.parquet/*.parquet'")
    assert got == sorted(duckdb.sql(catalog.ORACLE_SQL["o10_retrieval"]).fetchall()) and len(got) == 60


def test_nearest_of_few_rows(spark):
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, v array<float>")
    e = spark.createDataFrame([(0, [1.0, 0.0]), (5, None), (6, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r["vec_id"], r["c"] and round(r["c"], 6)) for r in nearest.candidates(q, e, 3).orderBy("vec_id").collect()] == [(5, None), (6, 0.707107)]


@pytest.mark.parametrize("name", ["k13_files_not_kept", "s11_paired_images", "s13_problem_records"])
def test_files_hold_many_rows(spark, tables, tmp_path, monkeypatch, name):
    monkeypatch.setattr(shared, "root", lambda spark: f"{tmp_path}/shared")
    rows = [(i, f"s{i}", i % 25) for i in range(1, 2501)]
    d = tables(supplier=spark.createDataFrame(rows, "s_suppkey long, s_name string, s_nationkey int").coalesce(1))
    got = sorted(tuple(r) for r in catalog.QUERIES[name](spark, d).collect())
    duckdb.sql(f"create or replace view supplier as select * from '{d}/supplier.parquet/*.parquet'")
    assert got == sorted(duckdb.sql(catalog.ORACLE_SQL[name]).fetchall()) and len(got) > 1600
    assert 0 < sum(p.name.startswith("part-") for p in (tmp_path / "shared").rglob("*")) < 250


def test_f1_of_neighbours_shuffles_texts_and_not_words(spark, tables):
    rows = [(0, "The cat, a cat_and a dog"), (1, "cat CAT dog dog"), (2, None), (3, ""), (4, "an a the"), (5, "x y"), (7, "x"), (8, "y x x"), (9, "word " * 3000)]
    d = tables(documents=spark.createDataFrame(rows, "doc_id long, text string"))
    df = catalog.QUERIES["t18_token_f1"](spark, d)
    assert "Generate" not in (plan := df._jdf.queryExecution().executedPlan().toString()) and plan.count("Exchange") <= 2
    duckdb.sql(f"create or replace view documents as select * from '{d}/documents.parquet/*.parquet'")
    assert sorted(tuple(r) for r in df.collect()) == sorted(duckdb.sql(catalog.ORACLE_SQL["t18_token_f1"]).fetchall())


def test_preference_pairs_are_dealt_out_by_their_number(spark, monkeypatch):
    """Groups of ten with ten levels each: a hundred rows a group come of them."""
    monkeypatch.setattr(sources, "ROWS_A_TASK", 1000)
    rows = [(g, i, float((i * 7 + g) % 10), float(i)) for g in range(400) for i in range(10)]
    out = groups.preference_accuracy(spark.createDataFrame(rows, "uid int, i int, p double, score double"), "uid", "p", "score")
    per = [r["n"] for r in out.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n")).collect()]
    assert sum(per) == 400 and max(per) <= 40
    pairs = lambda g: [(a[3] - b[3], a[2] > b[2]) for a in rows for b in rows if a[0] == b[0] == g and a[3] > b[3]]
    got = {r["uid"]: r["accuracy"] for r in out.where("uid < 5").collect()}
    assert all(got[g] == pytest.approx(sum(w for w, ok in pairs(g) if ok) / sum(w for w, _ in pairs(g))) for g in range(5))


def test_star_search_meets_marks_in_turns(spark, monkeypatch):
    """Five buckets of forty that no centre joins: the rows that carry marks are dealt over several actions, and no link is lost."""
    names, old = [], common.written
    monkeypatch.setattr(common, "ROWS_AN_EXCHANGE", 10, raising=False)
    monkeypatch.setattr(common, "written", lambda df, what: (names.append(what), old(df, what))[1])
    members, path = old(spark.range(200).selectExpr("id div 40 as bucket", "id % 40 as id"), "members")
    marks = spark.range(40).selectExpr("id", "id % 8 as mark")
    gone = {"dealt_from": (path,)}
    got = {r["id"]: r["component"] for r in common.star_components(members, marks, lambda a, b: a == b, lambda ids: lambda pairs: pairs, "t", turns=2, careful=1, **gone).collect()}
    assert got == {i: i % 8 for i in range(40)}
    assert names.count("t-part") >= 4 and names.count("t-marks") == 2


def test_substrings_are_dealt_out_in_turns(spark, monkeypatch):
    """A turn has a part of the anchors, all turns have them once, and what is removed doesn't depend on their number."""
    word = lambda i: f"w{i * 7919 % 1009:04d}"
    texts = [" ".join(word(i * 17 + j) for j in range(150)) for i in range(60)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = docs.where("text is not null").selectExpr("doc_id as id", "xxhash64(text) as of", "doc_id as raw", "text")
    sizes = [substring_dedup.find_anchors(rows, 50, 16, n, i).agg(F.sum(F.length("data"))).first()[0] for n, i in ((1, 0), (3, 0), (3, 1), (3, 2))]
    assert max(sizes[1:]) < 0.6 * sizes[0] <= sum(sizes[1:])
    names, old = [], substring_dedup.written
    monkeypatch.setattr(substring_dedup, "written", lambda df, what: (names.append(what), old(df, what))[1])
    got = []
    for n in (1, 3):
        monkeypatch.setattr(substring_dedup, "TURNS", n)
        got.append(sorted(tuple(r) for r in substring_dedup.remove_repeats(docs).collect()))
    assert got[0] == got[1] and len(got[0]) == 62 and sum(r[2] for r in got[0]) > 20000
    assert all(names.count(x) == 4 for x in ("anchor-marks", "contexts", "cut"))


def test_estimators_share_one_pass(spark):
    """Each name has what it has alone, long trajectories and masked tokens included; the plan doesn't go over the tokens for each name."""
    rows = [(t % 3, t, p, float((t * p) % 7), float(p % 5), int((t + p) % 4 > 0)) for t, n in ((1, 3), (2, 1200), (4, 5), (5, 1), (6, 40)) for p in range(1, n + 1)]
    t = spark.createDataFrame(rows, "uid long, traj_id long, pos long, reward double, value double, mask int")
    options = {"reinforce_plus_plus": {"gamma": 0.95}, "gae": {"gamma": 0.99, "lam": 0.95}, "remax": {"baseline": 10.0}}
    names = {n: options.get(n, {}) for n in advantages.ESTIMATORS}
    together = advantages.advantages_of(t, names)
    got = {(r["estimator"], r["traj_id"], r["pos"]): r["advantage"] for r in together.collect()}
    want = {(n, r["traj_id"], r["pos"]): r["advantage"] for n, o in names.items() for r in advantages.advantages(t, n, **o).collect()}
    assert got.keys() == want.keys() and len(got) == 6 * len(rows)
    assert all(got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-9) for k in want)
    assert together._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= 6
    with pytest.raises(ValueError):
        advantages.advantages_of(t, {"none": {}})


def test_all_labels_teach(spark, monkeypatch):
    """Beyond the bounded start, each labelled row is learnt from, one language of a single row too, and each row kept apart counts for the thresholds."""
    monkeypatch.setattr(toxicity, "ROWS_A_LABEL", 5)
    rows = [(f"word{i} {'vile' if i % 2 else 'kind'} number{i % 7}", i % 2, "only" if i == 77 else "en", i % 4 == 0) for i in range(400)]
    told, old = [], toxicity.Network.calibrate
    monkeypatch.setattr(toxicity.Network, "calibrate", lambda net, z, lang, n0, n1: (told.append((n0.sum(), n1.sum())), old(net, z, lang, n0, n1))[1])
    df = spark.createDataFrame(rows, "text string, toxic int, lang string, apart boolean")
    net = toxicity.fit(df, calibrate=F.col("apart"))
    assert told == [(100, 0)] and net.languages == ["en", "only"]
    row = toxicity.buckets(pa.array(["word77"]))[0][0, 0]
    assert net.evidence[row, 1] > net.evidence[row, 0]
    start = toxicity.Network()
    monkeypatch.setattr(toxicity, "learnt_by_all", lambda *a: None)
    start = toxicity.fit(df, calibrate=F.col("apart"))
    assert np.abs(net.flat() - start.flat()).max() > 0
