"""Importance resampling against a plain version, and awkward rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import queries, resample
from test_llm import DATA, awkward_rows, DOC  # noqa: E402

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_features(text):
    w = WORDS.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return w, [zlib.crc32(x.encode()) % 10000 for x in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]]


def plain(docs, target):
    own = [plain_features(t) for _, t in docs]
    s, t = Counter(b for _, f in own for b in f), Counter(b for x in target for b in plain_features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in range(10000)]
    rows = []
    for (i, _), (w, f) in zip(docs, own, strict=True):
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)])
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0]))
    ranks = {r[0]: k for k, r in enumerate(able[: 25 * len(able) // 100], 1)}
    return {r[0]: (*r[1:4], ranks.get(r[0])) for r in rows}


def test_query_is_the_plain_version(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    target = [r[0] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("text").collect()]
    got = queries.QUERIES["op12_importance_resampling"](spark, DATA).collect()
    assert {r["doc_id"]: (r["n_features"], r["weight"], r["score"], r["rank"]) for r in got} == plain(docs, target)


def test_registers_of_any_length():
    texts = ["a", "ab" * 23, "x" * 47 + " " + "y" * 48 + " " + "z" * 49, "w" * 1000 + " é½ " + "v" * 300, "", None, "A-B"]
    n, text, bucket = resample.features(pa.array(texts), 10000)
    for i, t in enumerate(texts):
        w, want = plain_features(t)
        assert n[i] == len(w) and sorted(bucket[text == i].tolist()) == sorted(want)


def test_awkward_rows(spark):
    docs = spark.createDataFrame(awkward_rows(), DOC).repartition(3)
    target = spark.createDataFrame([("one two three",), (None,), ("",)], "text string")
    got = resample.resample(docs, target).collect()
    assert len(got) == docs.count()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert all(r["n_features"] == 0 and r["weight"] == 0 and r["rank"] is None for i in (4, 5, 6) for r in by[i])
    assert len({(r["n_features"], r["weight"], r["score"]) for r in by[0]}) == 1  # a repeated row
    able = sum(r["n_words"] >= 20 for r in got)
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, able // 4 + 1))


@pytest.mark.parametrize("which", ["docs", "target", "both"])
def test_empty_tables(spark, which):
    some, none = spark.createDataFrame([(1, "a b c " * 20), (2, "d e f " * 20)], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, text string")
    docs, target = (none if which in (x, "both") else some for x in ("docs", "target"))
    out = resample.resample(docs, target)
    assert out.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"] and out.count() == docs.count()


def test_order_over_partitions(spark):
    docs = spark.range(2000).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(1, 30), i -> concat('w', pmod(hash(id, i), 50)))) as text")
    got = resample.resample(docs, docs.where("doc_id < 40"), percent=50).where("rank is not null").collect()
    order = sorted(got, key=lambda r: (-r["score"], r["doc_id"]))
    assert [r["rank"] for r in order] == list(range(1, 1001))
    assert isinstance(got[0]["score"], int) and np.mean([r["weight"] for r in got]) > -10**6
