"""Licence scans against all alignments of all templates, and awkward rows."""

import random

import pytest

from quarry.llm import licenses, queries
from test_llm import DATA, DOC, awkward_rows  # noqa: E402


def plain(text, found=None):
    """Base places, and passages by trying every template at every start."""
    w, base, more = licenses.words_of(text), [], []
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        base += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    for t in found or licenses.templates():
        want, key = licenses.words_of(t.text), licenses.words_of(t.key)
        at = next(i for i in range(len(want)) if want[i : i + len(key)] == key)
        for start in range(-len(want) + 1, len(w)):
            same = sum(0 <= start + i < len(w) and w[start + i] == x for i, x in enumerate(want))
            if len(want) - same <= int(0.2 * len(want) + 1e-9) and start + at >= 0 and w[start + at : start + at + len(key)] == key:
                more.append((start, t.label, same / len(want)))
    return w, sorted(base), sorted(more)


def check(rows, texts):
    for r in rows:
        w, base, more = plain(texts[r["doc_id"]])
        assert r["n_words"] == len(w)
        assert [(x["start"], x["label"]) for x in r["base_places"]] == base
        assert sorted((x["start"], x["label"], x["agreement"]) for x in r["passages"]) == more


def test_every_alignment_of_edited_notices(spark):
    rng, texts = random.Random(3), {}
    filler = "the of and software license under version public all rights a copy use 2 0 3 gnu cc by".split()
    for i in range(300):
        words = [rng.choice(filler) for _ in range(rng.randrange(40))]
        for t in rng.sample(licenses.templates(), 3):
            passage = licenses.words_of(t.text)
            for _ in range(rng.randrange(4)):
                passage[rng.randrange(len(passage))] = rng.choice(filler)
            at = rng.randrange(len(words) + 1)
            words[at:at] = passage[rng.randrange(2) :]
        texts[i] = " ".join(x.upper() if rng.random() < 0.3 else x for x in words)
    got = licenses.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4), ["doc_id"]).collect()
    assert len(got) == 300 and any(x["agreement"] < 1 for r in got for x in r["passages"])
    check(got, texts)


def test_query_is_the_plain_version(spark):
    texts = dict(tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect())
    got = queries.QUERIES["op13_license_scan"](spark, DATA).collect()
    assert len(got) == len(texts) and any(r["labels"] != r["base_labels"] for r in got)
    short = [t for t in licenses.templates() if t.label.startswith(("apache", "mit", "gpl", "cc-by-nc"))]
    for r in got:
        w, base, _ = plain(texts[r["doc_id"]], short[:1])
        starts = [x for x, _ in base]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(base), min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in base}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
        text = texts[r["doc_id"]] or ""
        for said, label in (("Licensed under the Apache License, Version 2.0.", "apache-2.0"), ("Released under the MIT License.", "mit"), ("GNU General Public License, version 3.", "gpl-3.0"), ("Licensed under CC BY-NC 4.0.", "cc-by-nc-4.0")):
            assert (label in r["labels"].split(",")) >= (said in text)


def test_awkward_rows(spark):
    docs = spark.createDataFrame(awkward_rows(), DOC).repartition(3)
    got = licenses.scan(docs, ["doc_id", "items"]).collect()
    assert len(got) == docs.count() and all(not r["passages"] for r in got)
    assert all(r["n_words"] == 0 for r in got if r["doc_id"] in (4, 5, 6))
    ties = spark.createDataFrame([(1, "all rights reserved all rights reserved"), (1, "all rights reserved all rights reserved"), (2, "all rights"), (3, "reserved. All"), (4, "rights reserved")], "doc_id long, text string").coalesce(1)
    assert sorted((r["doc_id"], [x["start"] for x in r["base_places"]]) for r in licenses.scan(ties, ["doc_id"]).collect()) == [(1, [0, 3]), (1, [0, 3]), (2, []), (3, []), (4, [])]


def test_empty_table(spark):
    out = licenses.scan(spark.createDataFrame([], DOC), ["doc_id"])
    assert out.count() == 0 and out.columns == ["doc_id", "n_words", "base_places", "passages"]


@pytest.mark.parametrize("seen", [{}, {"license": 10**6, "the": 10**9}])
def test_anchors_are_the_rarest(seen):
    index = licenses.Index(licenses.templates(), seen)
    assert (index.least == 2).all()
    common = {int(licenses.hashed([w])[0]) for w in seen}
    for t in range(len(index.labels)):
        held = {int(k) for k, f, n in zip(index.keys, index.first, index.times, strict=True) if t in index.template[f : f + n]}
        assert len(held & common) <= max(0, index.most[t] + 2 - (len(index.words[t]) - sum(int(x) in common for x in index.words[t])))
