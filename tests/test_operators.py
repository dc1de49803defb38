import pytest
from pyspark.sql import functions as F

from quarry.functions import geometry, text
from quarry.operators import batch, groups


def made(spark):
    return spark.createDataFrame([(0, [1, 2], "a"), (1, [3, 4], "b"), (2, [5, 6], "c")], "row_id long, obs array<long>, labels string")


def labels(df):
    return [r["labels"] for r in df.orderBy("row_id").collect()]


def test_repeat(spark):
    assert labels(batch.repeat(made(spark), 2)) == list("aabbcc")
    assert labels(batch.repeat(made(spark), 2, interleave=False)) == list("abcabc")


@pytest.mark.parametrize(("divisor", "pad", "want"), [(2, 1, "abca"), (3, 0, "abc"), (7, 4, "abcabca")])
def test_pad(spark, divisor, pad, want):
    out, n = batch.pad_to(made(spark), divisor)
    assert (labels(out), n) == (list(want), pad)


def test_take_and_gather(spark):
    assert labels(batch.take(made(spark), None, None, -1)) == list("cba")
    assert labels(batch.gather(made(spark), spark.createDataFrame([(0, 2), (1, 2), (2, 0)], "out_id long, row_id long"))) == list("cca")


def test_chunk(spark):
    with pytest.raises(ValueError):
        batch.chunk(made(spark), 2)


def test_union_columns(spark):
    a = made(spark)
    assert batch.union_columns(a, a.select("row_id", "labels", F.lit(1).alias("x"))).count() == 3
    with pytest.raises(Exception, match="differ"):
        batch.union_columns(a, a.withColumn("labels", F.lit("z"))).collect()


def test_group_advantages(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 0.0), ("b", 5.0)], "uid string, score double")
    got = sorted(round(r["advantage"], 4) for r in groups.grpo_advantage(df).collect())
    assert got == [-0.7071, 0.7071, 5.0]
    assert sorted(r["advantage"] for r in groups.rloo_advantage(df).collect()) == [-1.0, 1.0, 5.0]
    kept = groups.informative_groups(spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 0.0), ("b", 1.0), ("c", 0.0)], "uid string, score double"))
    assert {r["uid"] for r in kept.collect()} == {"b", "c"}


def test_best_of_two(spark):
    df = spark.createDataFrame([("u", i, v) for i, v in enumerate((0.1, 0.5, 0.5, 0.9))], "uid string, i int, v double")
    assert abs(groups.best_of(df, "uid", "v", 2, "i").first()["best"] - 0.65) < 1e-9


def test_texts(spark):
    one = lambda what, **v: spark.range(1).select("id", *(F.lit(x).alias(k) for k, x in v.items())).select(what).first()[0]
    assert one(text.last_answer(F.col("c")), c="<answer>x</answer> <answer> y </answer>") == "y"
    assert one(text.last_answer(F.col("c")), c="none") is None
    assert one(text.valid_message(F.col("c")), c="<think>t</think><answer>a</answer>")
    assert not one(text.valid_message(F.col("c")), c="<think>t</think><answer>a</answer> b")
    assert one(text.gsm8k_strict(F.col("c")), c="so #### 1,072") == "1072"
    assert one(F.size(text.boxes(F.col("c"))), c="<box>[0,0,2,2]</box><box>[3,3,1,1]</box>") == 1
    assert abs(one(text.token_f1(F.lit("The cat sat"), F.lit("a cat ran"))) - 0.5) < 1e-9


def test_geometry(spark):
    box = lambda *v: [F.lit(float(x)) for x in v]
    assert abs(spark.range(1).select(geometry.iou(box(0, 0, 2, 2), box(1, 1, 3, 3))).first()[0] - 1 / 7) < 1e-9
    h, w = geometry.smart_resize(F.lit(1000), F.lit(1000), 28, 3136, 448 * 448)
    assert tuple(spark.range(1).select(h, w).first()) == (448, 448)
