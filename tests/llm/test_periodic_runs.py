"""Periodic runs against all periods at all places, and awkward rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from quarry.llm import periodic_runs, queries
from test_llm import DATA, DOC, awkward_rows  # noqa: E402

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain(w, least_length=6, least_exponent=4):
    """(start, length, period) of all runs, by trying every period; a run that a smaller period has isn't one."""
    found = {}
    for q in range(1, len(w) // least_exponent + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least_length, least_exponent * q):
                found.setdefault((i, j + q - i), q)
            i = j
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_row(doc_id, text):
    w = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain(w)
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    top = None
    for r in runs:
        if top is None or r[1] * top[2] > top[1] * r[2]:
            top = r
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    lines = "".join(f"{s},{k},{q}\n" for s, k, q in runs)
    return (len(runs), *((*top, 1000 * top[1] // top[2]) if top else (None,) * 4), digest(lines), digest(" ".join(x for i, x in enumerate(w) if i not in gone)))


def sequences():
    rng = random.Random(9)
    for _ in range(250):
        k, n = rng.randrange(1, 5), rng.randrange(1, 60)
        w = [rng.randrange(k) for _ in range(n)]
        for _ in range(rng.randrange(3)):
            root = [rng.randrange(k + 2) for _ in range(rng.randrange(1, 9))]
            times = root * rng.randrange(2, 8)
            at = rng.randrange(len(w) + 1)
            w[at:at] = times[: len(times) - rng.randrange(len(root))]
        yield w
    yield [7] * 500
    yield [0, 1] * 300 + [0] * 40
    fib = [[0], [0, 1]]
    for _ in range(12):
        fib.append(fib[-1] + fib[-2])
    yield fib[-1]


@pytest.mark.parametrize("exponent", [2, 3, 4])
def test_tree_finds_all_runs(exponent):
    some = [np.array(w) for w in sequences()]
    got = periodic_runs.runs_of(some, 6, exponent)
    for w, found in zip(some, got, strict=True):
        assert sorted(found) == plain(w.tolist(), 6, exponent)
    for w in some[:40]:
        assert sorted(periodic_runs.runs_of([w], 6, exponent)[0]) == plain(w.tolist(), 6, exponent)


def test_squares_are_the_vocabulary():
    for w in list(sequences())[:80]:
        x = np.array([9, *(v + 1 for v in w), 10])
        at, half = periodic_runs.SuffixTree(np.unique(x, return_inverse=True)[1] + 1).squares()
        got = sorted(tuple(x[a : a + 2 * h].tolist()) for a, h in zip(at.tolist(), half.tolist(), strict=True))
        want = set()
        for h in range(1, len(w) // 2 + 1):
            for a in range(1, len(w) + 2 - 2 * h):
                root = tuple(x[a : a + h].tolist())
                if root == tuple(x[a + h : a + 2 * h].tolist()) and not any(h % d == 0 and root == root[:d] * (h // d) for d in range(1, h)):
                    want.add(root * 2)
        assert got == sorted(want)


def test_stretches_hold_all_runs():
    some = list(sequences())
    ids, own = np.concatenate([np.array(w) for w in some]), np.cumsum([0, *map(len, some)])
    bounds = periodic_runs.stretches(ids, own, 6, 4)
    for i, w in enumerate(some):
        for s, n, _ in plain(w):
            assert any(a <= own[i] + s and own[i] + s + n <= b <= own[i + 1] for a, b in bounds)


def test_query_is_the_plain_version(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.QUERIES["op11_periodic_runs"](spark, DATA).collect()}
    assert len(got) == len(docs) and sum(x[0] for x in got.values()) > 5
    for doc_id, text in docs:
        if len(text or "") < 30_000:
            assert got[doc_id] == plain_row(doc_id, text), doc_id


def test_awkward_rows(spark):
    docs = spark.createDataFrame(awkward_rows(), DOC).repartition(3)
    got = periodic_runs.periodic_runs(docs, ["doc_id", "items"]).collect()
    assert len(got) == docs.count()
    for r in got:
        if r["doc_id"] in (4, 5, 6):
            assert r["runs"] == [] and r["collapsed"] == ""
    ties = spark.createDataFrame([(1, "a b " * 6 + "\tx\n" + "c d " * 6), (1, "a b " * 6 + "\tx\n" + "c d " * 6), (2, "e " * 5), (3, "e e " * 7), (None, "f " * 6)], "doc_id long, text string").coalesce(1)
    rows = periodic_runs.periodic_runs(ties, ["doc_id"]).collect()
    assert sorted((r["doc_id"] or 0, [tuple(x) for x in r["runs"]], r["collapsed"]) for r in rows) == [
        (0, [(0, 6, 1)], "f"), (1, [(0, 12, 2), (13, 12, 2)], "a b x c d"), (1, [(0, 12, 2), (13, 12, 2)], "a b x c d"), (2, [], "e e e e e"), (3, [(0, 7, 1)], "e e")]


def test_long_texts_in_small_groups(spark, monkeypatch):
    rng = random.Random(2)
    root = [f"w{rng.randrange(50)}" for _ in range(700)]
    text = " ".join(root * 9 + [f"v{i}" for i in range(30_000)] + ["x", "y"] * 5000)
    docs = spark.createDataFrame([(i, text if i % 3 == 0 else " ".join(root[: 50 + i])) for i in range(9)], "doc_id long, text string").coalesce(1)
    for r in periodic_runs.periodic_runs(docs, ["doc_id"]).collect():
        assert [tuple(x) for x in r["runs"]][-2:] == ([(0, 6300, 700), (36_300, 10_000, 2)] if r["doc_id"] % 3 == 0 else [])


def test_empty_table(spark):
    out = periodic_runs.periodic_runs(spark.createDataFrame([], DOC), ["doc_id"])
    assert out.count() == 0 and out.columns == ["doc_id", "runs", "collapsed"]
