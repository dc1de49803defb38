"""Cases beyond the catalogue's tables: many partitions, long trajectories, pruned columns, partitions against brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from quarry.functions import arrays, geometry, text
from quarry.operators import balance, batch, scans
from quarry.sources import tables as files


def test_row_ids_over_many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = batch.with_row_id(spark.range(150_000).select(F.xxhash64("id").alias("k")).repartition(7), "k")
        got = rows.agg(F.count("*"), F.countDistinct("row_id"), F.min("row_id"), F.max("row_id")).first()
        assert tuple(got) == (150_000, 150_000, 0, 149_999)
        pairs = rows.select("k", "row_id").orderBy("row_id").limit(500).collect()
        assert [r["k"] for r in pairs] == sorted(r["k"] for r in pairs)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_long_trajectories(spark):
    n, gamma, lam = 30_000, 0.99, 0.95
    rng = random.Random(1)
    rows = [("a", i, rng.random(), rng.random(), int(rng.random() > 0.2)) for i in range(n)] + [("b", 0, 1.0, 0.5, 1), ("c", 0, 1.0, 0.5, 0)]
    got = scans.gae(spark.createDataFrame(rows, "traj_id string, pos long, reward double, value double, mask int"), gamma, lam).collect()
    adv, ret, nxt, want = 0.0, 0.0, 0.0, {}
    for _, i, r, v, m in reversed(rows[:n]):
        if m:
            adv = r + gamma * nxt - v + gamma * lam * adv
            ret = r + gamma * ret
            nxt = v
        want[i] = adv, ret
    mine = {r["pos"]: r for r in got if r["traj_id"] == "a"}
    assert all(abs(mine[i]["advantage"] - a) < 1e-6 and abs(mine[i]["return"] - b) < 1e-6 for i, (a, b) in want.items())
    assert {r["traj_id"]: (r["advantage"], r["return"]) for r in got if r["traj_id"] != "a"} == {"b": (0.5, 1.0), "c": (0.0, 0.0)}


def test_union_check_stays_in_pruned_plans(spark):
    a = spark.createDataFrame([(0, "a", 1), (1, "b", 2)], "row_id long, l string, x int")
    b = spark.createDataFrame([(0, "z", 1.0), (1, "b", 2.0)], "row_id long, l string, y double")
    for use in (lambda d: d.select("x", "l").collect(), lambda d: d.count()):
        with pytest.raises(Exception, match="differ"):
            use(batch.union_columns(a, b))


def test_partitions_against_brute_force():
    rng = random.Random(4)
    for _ in range(30):
        sizes = [rng.randrange(1, 40) for _ in range(7)]
        parts = balance.differencing(sizes, 2)
        assert sorted(i for p in parts for i in p) == list(range(7))
        spread = abs(sum(sizes[i] for i in parts[0]) - sum(sizes[i] for i in parts[1]))
        best = min(abs(sum(sizes) - 2 * sum(c)) for k in range(8) for c in itertools.combinations(sizes, k))
        assert best <= spread <= best + max(sizes)
    even = balance.differencing([5, 1, 4, 2, 3, 6], 2, equal=True)
    assert [len(p) for p in even] == [3, 3]
    with pytest.raises(ValueError):
        balance.differencing([1, 2, 3], 2, equal=True)
    assert balance.greedy([5, 4, 3, 3], 2) == [[0, 3], [1, 2]]


def test_folds_and_ranges(spark):
    df = spark.createDataFrame([(i, f"l{i}") for i in range(6)], "row_id long, l string")
    assert [r["l"] for r in batch.unfold(batch.fold(df, 3), 2).orderBy("row_id").collect()] == [f"l{i}" for i in range(6)]
    assert [r["row_id"] for r in batch.row_range(df, 2, 99).orderBy("row_id").collect()] == [2, 3, 4, 5]
    for bad in (lambda: batch.row_range(df, 6), lambda: batch.row_range(df, 3, 3), lambda: batch.minibatches(df, 4, 1), lambda: batch.rename(df, ["l"], ["a", "b"])):
        with pytest.raises(ValueError):
            bad()


def test_rules_of_texts(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    lit = F.lit
    assert one(text.gsm8k_strict(lit("#### 5 then #### 7"))) == "5" and one(text.gsm8k_flexible(lit("a 5 then 7 ."))) == "7"
    assert one(text.last_answer(lit("<answer>\n x \n</answer>"))) == "x"
    assert one(text.valid_message(lit("<think>\nt\n</think>\n<answer>a</answer>\n")))
    for bad in ("<think>a <box></think><answer>a</answer>", "<think>t</think><answer><th</answer>", "<think>t</think></think><answer>a</answer>", "t</think><answer>a</answer>", "<think>t</think>", ""):
        assert not one(text.valid_message(lit(bad))), bad
    assert one(text.last_boxed(lit(r"\boxed{1} \boxed{\frac{1}{{2}}} x}"))) == r"\boxed{\frac{1}{{2}}}"
    assert one(text.last_boxed(lit(r"\boxed{1"))) is None and one(text.last_boxed(lit("none"))) is None
    for raw, plain in ((r"\tfrac12", r"\frac{1}{2}"), ("k = 3", "3"), ("1/2", r"\frac{1}{2}"), (r"\sqrt3", r"\sqrt{3}"), ("0.5", r"\frac{1}{2}"), (".5", r"\frac{1}{2}"), (r"5\text{ cm}", "5"), (r"50\%", "50")):
        assert one(text.math_plain(lit(raw))) == plain, raw
    assert one(arrays.call_status(lit("{'name': 'focus', 'arguments': {'bbox_2d': [[1,2,3,4]]}}"))) == "ok"
    with pytest.raises(Exception, match="over 1"):
        one(arrays.fitted(F.array(lit(1).cast("long"), lit(2).cast("long")), 1, lit(0).cast("long")))


def test_boxes_beyond_bounds(spark):
    box = [F.lit(float(x)) for x in (-5, -5, 500, 3)]
    (x1, y1, x2, y2), some = geometry.box_to_original(box, [F.lit(1.0), F.lit(1.0)], [F.lit(100), F.lit(100)])
    assert tuple(spark.range(1).select(x1, y1, x2, y2, some).first()) == (0, 0, 100, 3, True)


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"k": 1}, {"k": 2}]')
    assert [r["k"] for r in files.json_array(spark, str(tmp_path / "a.json"), "k long").collect()] == [1, 2]
    assert files.result_path("out", "m", "x") == "out/m/x.jsonl" and files.result_path("out", "m", "x", 3, 9) == "out/m/x_3_9.jsonl"
    rows = spark.createDataFrame([(1, "a", 3), (2, "a", 1), (3, "b", 2)], "id long, g string, o int")
    assert sorted(r["id"] for r in files.first_of_each(rows, "g", "o", 1).collect()) == [2, 3]
