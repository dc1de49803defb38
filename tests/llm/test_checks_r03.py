"""Findings of the check tool in round 3."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import line_dedup, tokens, toxicity


def test_folded_sketches_never_rule_out_what_sketches_allow(spark):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(rng.choice((4, 8, 20, 40)))]
        other = [w if rng.random() < rng.choice((0.5, 0.9)) else w[::-1] + "x" for w in words]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    found = line_dedup.sketches(spark.createDataFrame(rows, "key long, line string"))
    mark = F.struct("n", "k0", "k1", "b0", "b1", "by_words", "shape")
    a, b = found.select(F.col("key").alias("a"), mark.alias("x")), found.select(F.col("key").alias("b"), mark.alias("y"))
    near = F.lit(False)
    for kind, share in line_dedup.LEAST_COMMON.items():
        x, y = F.col("x")[f"k{kind}"], F.col("y")[f"k{kind}"]
        near = near | F.coalesce(F.size(F.array_intersect(x, y)) >= share * F.least(F.size(x), F.size(y)), F.lit(False))
    told = a.join(b, F.col("a") < F.col("b")).select(near.alias("near"), line_dedup.may_share(F.col("x"), F.col("y")).alias("may")).groupBy("near", "may").count().collect()
    n = {(r["near"], r["may"]): r["count"] for r in told}
    assert (True, False) not in n and n[True, True] > 50
    assert n[False, False] > 10 * n.get((False, True), 0)


def test_documents_meet_their_labels_once_and_texts_are_not_sorted(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "en") for i in range(500)] + [(None, "no id", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i % 400, i % 2) for i in range(0, 800, 2)] + [(7, 1), (7, 3), (None, 1), (900, 0)], "doc_id long, toxic int")
    rows, paths = toxicity.labelled_in_turns(docs, labels)
    assert len(paths) == toxicity.TURNS
    usable = {(i % 400, i % 2) for i in range(0, 800, 2)} | {(7, 1)}
    assert sorted((r["doc_id"], r["toxic"], r["text"]) for r in rows.collect()) == sorted((i, y, f"text {i}") for i, y in usable)
    plan = toxicity.labelled(docs, labels)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Broadcast" not in plan


def test_copies_of_a_line_are_one_member_of_each_block(spark, monkeypatch):
    rng = random.Random(7)
    lines = [" ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(8)) for _ in range(399)]
    lines.append(lines[0] + "x")  # a pair to confirm
    docs = spark.createDataFrame([(3 * i + k, x) for i, x in enumerate(lines) for k in range(3)], "doc_id long, text string")
    seen, search = [], line_dedup.star_components

    def counted(members, marks, *args, **options):
        seen.append((members.count(), members.distinct().count(), marks.count()))
        return search(members, marks, *args, **options)

    plans, write = {}, line_dedup.written

    def planned(df, what):
        plans[what] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, what)

    monkeypatch.setattr(line_dedup, "star_components", counted)
    monkeypatch.setattr(line_dedup, "written", planned)
    assert line_dedup.dedup_lines(docs).where("n_lines_removed = 1").count() == 801
    assert seen[0][0] == seen[0][1] and seen[0][2] == 400
    # few candidates are sent to the lines, which aren't shuffled for them
    assert "BroadcastHashJoin" in plans["line-candidates"] and "ShuffledHashJoin" not in plans["line-candidates"]


def test_batches_are_encoded_at_once_as_the_library_does():
    library, files = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    rng = random.Random(3)
    parts = [" ", "  ", "\t", "\n", " \n ", "'", "''", "'s", "'ll", "'re", "'v", "'ve", "'d", "'st", "'S", "a", "Zé", "ſ", "12", "!", "-'", "<|endoftext|>", "×", "İ", "日", "\x1c", "\xa0"]
    texts = ["".join(rng.choices(parts[: rng.choice((21, 21, 21, len(parts)))], k=rng.randint(0, 12))) for _ in range(20_000)] + ["", None, "'", " ", "'s", " 's", "x'l"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        tool = library.Tokenizer.from_file(files.path(name))
        for added in (False, True):
            tool.encode_special_tokens = not added
            ids, at = tokens.Encoder(files.path(name), added=added).encode_flat(pa.array(texts))
            want = [e.ids for e in tool.encode_batch([x or "" for x in texts], add_special_tokens=False)]
            assert len(at) == len(texts) + 1 and np.diff(at).tolist() == [len(w) for w in want]
            assert ids.tolist() == [i for w in want for i in w]
