"""Features that have state, files or functions of a user: restarts, measured sizes, plug-ins, converted rows."""

import struct

import pytest
from pyspark.sql import functions as F

from quarry.functions import images, plugins, text
from quarry.operators import conversations, scans
from quarry.sources import loaders, tables, training_rows
from quarry.streaming import curriculum, tracking

RATIO = {"start": 0.3, "least": 0.2, "most": 0.4, "alpha": 0.05}


def folded(rates):
    out, ratio = [], 0.3
    for rate in rates:
        ratio = round(max(0.2, min(0.4, ratio + (-0.05 if (rate or 0.0) > 0.5 else 0.05))), 4)
        out.append(ratio)
    return out


def test_ratio_over_blocks(spark, monkeypatch):
    """One run over many blocks, a short one, a null rate."""
    monkeypatch.setattr(scans, "BLOCK", 7)
    rates = {1: [((i * 37) % 11) / 10 for i in range(200)], 2: [0.9, None, 0.5], 3: [1.0] * 40 + [0.0] * 3}
    rows = [(k, i, r) for k, rs in rates.items() for i, r in enumerate(rs)]
    got = scans.ratio_curriculum(spark.createDataFrame(rows, "run int, step long, pass_rate double").repartition(5), **RATIO).collect()
    for k, rs in rates.items():
        assert [r["ratio"] for r in sorted(got, key=lambda r: r["step"]) if r["run"] == k] == folded(rs)
    assert scans.ratio_curriculum(spark.createDataFrame([], "run int, step long, pass_rate double")).count() == 0
    with pytest.raises(ValueError):
        scans.ratio_curriculum(spark.createDataFrame(rows, "run int, step long, pass_rate double"), alpha=0.00001)


def test_ratio_of_a_stream_over_restarts(spark, tmp_path):
    rates = [((i * 37) % 11) / 10 for i in range(60)]
    schema = "run int, step long, pass_rate double"
    for part in range(3):  # a query a part, each from the checkpoint of the one before; some steps are sent twice
        rows = [(k, i, rates[i]) for k in (1, 2) for i in range(max(0, part * 20 - 5), part * 20 + 20)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        steps = spark.readStream.schema(schema).json(f"{tmp_path}/in")
        query = curriculum.streamed_ratios(steps, **RATIO).writeStream.format("json").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    got = spark.read.schema("run int, step long, ratio double").json(f"{tmp_path}/out").collect()
    for k in (1, 2):
        assert [r["ratio"] for r in sorted(got, key=lambda r: r["step"]) if r["run"] == k] == folded(rates)


def test_sinks_of_a_batch_run_again(spark, tmp_path):
    sinks = {"table": tracking.table_sink(f"{tmp_path}/table"), "lines": tracking.lines_sink(f"{tmp_path}/lines")}
    for value, step in ((1, 0), (2, 1), (3, 1)):
        tracking.log(spark.createDataFrame([(value,)], "value int"), step, sinks)
    tracking.log(spark.createDataFrame([(9,)], "value int"), 2, sinks, ["lines"])
    found = lambda name, kind: sorted((r["step"], r["value"]) for r in tracking.logged(spark, f"{tmp_path}/{name}", kind).collect())
    assert found("table", "parquet") == [(0, 1), (1, 3)] and found("lines", "json") == [(0, 1), (1, 3), (2, 9)]


def test_no_file_is_over_the_cap(spark, tmp_path):
    df = spark.range(400).select("id", F.when(F.col("id") % 50 == 0, F.array_join(F.transform(F.sequence(F.lit(1), F.lit(3000)), lambda i: F.md5((F.col("id") * 5000 + i).cast("string").cast("binary"))), "")).otherwise("x").alias("t")).coalesce(2)
    folders = tables.write_measured(df, str(tmp_path), 150_000, 200)
    back = spark.read.schema(df.schema).parquet(*folders)
    assert back.count() == 400 and back.select(F.sum(F.length("t"))).first()[0] == df.select(F.sum(F.length("t"))).first()[0]
    held = [n for f in folders for _, n in (tables.sizes(spark, f) if "part-" not in f else [])]
    assert len(folders) > 1 and max(held) <= 150_000


def test_sides_of_image_files(spark):
    png = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 640, 480)
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 6) + b"JFIF" + b"\xff\xff\xc0" + struct.pack(">HBHH", 17, 8, 300, 400) + b"rest"
    bmp = b"BM" + b"\0" * 16 + struct.pack("<ii", 33, -44)
    rows = [(1, png), (2, jpeg), (3, bmp), (4, b"GIF89a" + struct.pack("<HH", 7, 9)), (5, b"none"), (6, None), (7, b""), (8, jpeg[:14]), (9, png[:20])]
    got = {r["k"]: tuple(r["s"]) for r in spark.createDataFrame(rows, "k int, b binary").select("k", images.image_size(F.col("b")).alias("s")).collect()}
    assert got == {1: (640, 480), 2: (400, 300), 3: (33, 44), 4: (7, 9), **dict.fromkeys(range(5, 10), (None, None))}


def test_converted_rows_have_one_schema(spark):
    png = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 1000, 700)
    task = training_rows.Task("a")
    picture = "struct<bytes:binary,path:string>"
    problems = spark.createDataFrame([(1, "<image>\nWhat? Options:\n(A) x\n(B) y", "A", "d1", (png, "p")), (2, "Why", "z", None, (png, "p")), (3, "Why", "z", None, (b"", "p")), (4, "", "z", None, (png, "p")), (5, "Why", None, None, (png, "p"))], f"key int, problem string, solution string, doc_id string, image {picture}")
    charts = spark.createDataFrame([(1, [(png, "p")], "chart", ("Q?A. one\nB. two", "It is B", 7), ("B",)), (2, [(png, "p")], "chart", ("Q?A. one\nB. two", "one", 7), (None,)), (3, [], None, ("Q", None, 7), (None,))], f"key int, images array<{picture}>, ability string, extra_info struct<question:string,answer:string,index:int>, reward_model struct<ground_truth:string>")
    a, b = training_rows.problem_rows(problems, task), training_rows.chart_rows(charts, task._replace(data_source="b"))
    assert {(r["data_source"], r["key"]): r["reject"] for r in training_rows.rejected(a, b).collect()} == {("a", "3"): "no image", ("a", "4"): "no problem", ("a", "5"): "no solution", ("b", "2"): "no letter", ("b", "3"): "no image"}
    rows = training_rows.accepted(a, b)
    assert rows.schema.simpleString() == training_rows.conformed(rows).schema.simpleString() and rows.count() == 3
    one = rows.where("extra_info.index = 'd1'").first()
    assert one["extra_info"]["question"] == "What?" and one["extra_info"]["options"] == ["x", "y"] and one["reward_model"]["style"] == "multiple_choice"
    assert one["prompt"][1]["content"].endswith("What? choices: A: x, B: y") and one["extra_info"]["pixel_budget_per_image"] == 448 * 448
    chart = rows.where("data_source = 'b'").first()
    assert chart["reward_model"]["ground_truth"] == ["B"] and chart["extra_info"]["index"] == "7" and chart["prompt"][1]["content"].endswith("Q?\nA: one\nB: two")


def test_loader_names(spark):
    with pytest.raises(ValueError, match="paired"):
        loaders.load(spark, "nothing", "x")
    with pytest.raises(ValueError):
        loaders.loader("paired")(lambda spark, path: None)

    @loaders.loader("own")
    def own(spark, path, n):
        return spark.range(n).withColumn("path", F.lit(path))

    assert loaders.load(spark, "own", "x", n=3).count() == 3


def test_users_scorers(spark, tmp_path):
    (tmp_path / "mine.py").write_text("def score(source, reply, truth, extra, bonus=0.0):\n    return {'score': 1.0 / len(reply) + bonus}\n")
    mine = plugins.load_function(str(tmp_path / "mine.py"), "score")
    plugins.register_scorer(spark, "mine", mine, bonus=0.5)
    got = spark.sql("select mine('s', r, 't', null) as s from values ('ab'), (''), (null), ('abcd') as t(r)").collect()
    assert sorted((r["s"]["score"], r["s"]["failed"]) for r in got) == [(0.0, True), (0.0, True), (0.75, False), (1.0, False)]
    with pytest.raises(AttributeError):
        plugins.load_function(str(tmp_path / "mine.py"), "other")
    with pytest.raises(FileNotFoundError):
        plugins.load_function(str(tmp_path / "none.py"), "score")
    source = spark.createDataFrame([("a",), ("bx",), ("c",)], "s string")
    assert [r[0] for r in source.select(plugins.dispatched(F.col("s"), {"a": F.lit(1.0), "b*": F.lit(2.0), "d": F.lit(3.0)}, "d")).collect()] == [1.0, 2.0, 3.0]
    with pytest.raises(Exception, match="no scorer for c"):
        source.select(plugins.dispatched(F.col("s"), {"a": F.lit(1.0), "b*": F.lit(2.0)})).collect()


@pytest.mark.parametrize(("told", "truth", "same"), [("12345678901", "12345678901.0", True), ("1e3", "1000", True), ("[1,2]", "[1.0,2.0]", True), ("0", "0.00005", False), ("50%", "0.5", True), ("(1,2)", "[1,2]", False), ("Interval.Lopen(1, 2)", "(1.0,2]", True), ("a, 2", "A,2.0", True), ("", "0", False), ("{x}", "x", True), ("$5", "5", True), ("[3]", "3", True), ("1,2,3", "1,2", False)])
def test_math_equal(spark, told, truth, same):
    assert spark.range(1).select(text.math_equal(F.lit(told), F.lit(truth))).first()[0] is same


@pytest.mark.parametrize(("told", "truth", "f1"), [("no", "no wait", 0.0), ("True", "yes", 1.0), ("yes", "no", 0.0), ("noanswer", "No_answer", 0.0), ("The cat", "a cat!", 1.0), ("x", "", 0.0), ("a a b", "a b b", 1.0)])
def test_f1_of_yes_and_no(spark, told, truth, f1):
    got = spark.range(1).select(text.token_f1(F.lit(told), F.lit(truth))).first()[0]
    assert abs(got - f1) < 1e-9 or (told, f1) == ("a a b", 1.0) and abs(got - 2 / 3) < 1e-9


def test_conversation_without_faults(spark):
    turns = [(1, 0, "gpt", '<think>a</think><tool_call>{"name": "focus", "arguments": {"bboxes": [[1, 2, 3, 4], [1, 2, 3, 4]]}}</tool_call>'), (1, 1, "human", "<tool_response><image><image></tool_response>"), (1, 2, "gpt", "<think>b</think><answer>c</answer>")]
    df = spark.createDataFrame(turns, "conv_id int, turn int, role string, text string")
    box = lambda *bs: spark.createDataFrame([(1, list(b)) for b in bs], "conv_id int, box array<double>")
    one, other = (1.0, 2.0, 3.0, 4.0), (1.0, 2.0, 3.0, 5.0)
    reason = lambda boxes: conversations.conversation_faults(df, boxes).first()["reason"]
    assert reason(box(one, one)) is None and reason(box(one)) == "another number of boxes" and reason(box(one, other)) == "other boxes"
