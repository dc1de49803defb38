"""Small fixtures against brute force, and the awkward rows every operator must take: nulls, empty and long texts, ties, repeated rows, clashing columns, empty tables."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from quarry.llm import common, decontaminate, lang_id, line_dedup, near_dup, packing, quality, queries, spans, substring_dedup, token_counts, token_store, toxicity  # noqa: E402
from quarry.llm.suffix_groups import suffix_array  # noqa: E402
from quarry.llm.tokens import Encoder  # noqa: E402

DATA = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long, SCORE double, items string, bucket int"


def awkward_rows():
    rng = random.Random(5)
    words = [f"w{i}{'é' * (i % 3)}" for i in range(400)]
    base = " ".join(rng.choice(words) for _ in range(120))
    near = " ".join("other" if i == 60 else w for i, w in enumerate(base.split()))
    texts = [base, base, near, base.upper(), "", None, "   \n\t", "one", "two words", base + "\n" + base, "x" * 3000, " ".join(rng.choice(words) for _ in range(20_000)), "日本語のテキスト ½ Ⅷ x", "a\nb\n" + base[:200] + "\nb"]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}" if i % 5 else None, len(t or ""), 0.5, "k", 1) for i, t in enumerate(texts)]
    return [*rows, rows[0], (None, base, "fr", "s1", 3, None, None, None), (None, None, None, None, None, None, None, None), (3, "another text under a repeated id", "en", "s1", 1, 0.1, "z", 2)]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), DOC).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def bench(spark):
    text = awkward_rows()[0][1].split()
    return spark.createDataFrame([(1, " ".join(text[10:40]), "x"), (2, None, "x"), (None, "no id", "x"), (3, "tiny", "x"), (4, "", "x"), (5, " ".join(text[10:40]), "y")], "item_id long, text string, doc_id string")


def docs_of(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").collect()]


def shingles(t, k):
    w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def grouped(sets, percent=80):
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {i: top(i) for i in ids}


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)]
    got = {r["id"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    ids = {x for e in edges if e[0] != e[1] for x in e}
    sets = {i: i for i in ids}
    for _ in ids:
        for a, b in edges:
            if a != b:
                sets[a] = sets[b] = min(sets[a], sets[b])
    assert got == sets


def test_star_components_lose_no_link(spark):
    """Links that a bucket's first centre has no part in are found in later rounds, whatever the spending limit."""
    marks = spark.createDataFrame([(i, i % 5) for i in range(12)], "id long, mark long")
    members = spark.createDataFrame([(7, i) for i in range(12)], "bucket long, id long")
    confirm = lambda ids: lambda pairs: pairs.where("(a % 5 = b % 5) and a + b > 6")
    for spend, close in ((0, lambda a, b: a == b), (100, lambda a, b: a >= b - 5)):  # the second tells nothing apart
        got = {r["id"]: r["component"] for r in common.star_components(members, marks, close, confirm, "t", spend=spend).collect()}
        want = grouped({i: {i % 5} for i in range(12)})
        links = [(a, b) for a in range(12) for b in range(a) if a % 5 == b % 5 and a + b > 6]
        assert set(got) == {x for e in links for x in e}
        assert all(got[a] == got[b] for a, b in links) and all(want[i] == want[got[i]] for i in got)


def test_near_duplicates(spark):
    got = {r["doc_id"]: r for r in near_dup.op2_near_dedup(spark, DATA).collect()}
    sets = {i: shingles(t, 2) for i, t in docs_of(spark)}
    want = grouped(sets)
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (len(s), want[i], want[i] == i) for i, s in sets.items()}


def test_near_duplicates_awkward(awkward, empty):
    out = near_dup.near_duplicates(awkward).collect()
    assert len(out) == awkward.count() and near_dup.near_duplicates(empty).count() == 0
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append(r)
    assert {r["component_id"] for i in (0, 1, 2) for r in by[i]} == {0}  # 3 is in upper case, which only A-Z leave
    assert all(r["n_shingles"] == 0 and r["kept"] for i in (4, 5, 6) for r in by[i]) and all(r["kept"] and r["component_id"] is None for r in by[None])


def test_encoders_agree_with_the_library(spark):
    from tokenizers import Tokenizer

    texts = [t or "" for _, t in docs_of(spark)] + ["  a  b\n\n c's I'LL don't 12 345 $$ \t x ", "日本語 x", "½ ² Ⅷ", "<|endoftext|> hi", "\x1c\x7f", "İ ſ", ""]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        tool = Tokenizer.from_file(public_tokenizers.path(name))
        tool.encode_special_tokens = True
        assert Encoder(public_tokenizers.path(name)).encode(texts) == [np.array(e.ids, "<u4").tobytes() for e in tool.encode_batch(texts, add_special_tokens=False)]


def test_added_tokens_as_the_library_finds_them(spark, tmp_path):
    from tokenizers import Tokenizer

    texts = ["hello <|endoftext|>", "<|startoftext|>a<|endoftext|> b", "a<|ENDOFTEXT|>b <|StartOfText|>", "日本 <|endoftext|>", "plain < | > text", "<|endoftext|>"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        tool = Tokenizer.from_file(public_tokenizers.path(name))
        assert Encoder(public_tokenizers.path(name), added=True).encode(texts) == [np.array(e.ids, "<u4").tobytes() for e in tool.encode_batch(texts, add_special_tokens=False)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    want = [Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(t, add_special_tokens=False).ids for t in texts]
    token_store.write_store(docs, f"{tmp_path}/s", public_tokenizers.path("byte_bpe_50k.json"))
    got = token_store.read_store(spark, f"{tmp_path}/s", with_ids=True).collect()
    assert {r["id"]: np.frombuffer(bytes(r["ids"]), "<u4").tolist()[: len(w)] for r, w in ((r, want[r["id"]]) for r in got)} == dict(enumerate(want))
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in pieces} == {i: len(tool.encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}


def test_token_store(spark, awkward, empty, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder = Encoder(path)
    for n, df in enumerate((spark.read.parquet(f"{DATA}/documents.parquet"), awkward, empty)):
        token_store.write_store(df, f"{tmp_path}/s{n}", path)
        got = token_store.read_store(spark, f"{tmp_path}/s{n}", with_ids=True).orderBy("start").collect()
        rows = df.select("doc_id", "text").collect()
        assert len(got) == len(rows) and [r["id"] for r in got] == sorted((r["doc_id"] for r in rows), key=lambda x: -1 if x is None else x)
        want = sorted(encoder.encode([r["text"]])[0] + b"\2\0\0\0" for r in rows)
        assert sorted(bytes(r["ids"]) for r in got) == want
        at = 0
        for r in got:
            assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(r["ids"]) // 4, zlib.crc32(r["ids"]))
            at += r["n_tokens"]


def test_token_store_tells_damage():
    row = {"segment": 1, "digests": [token_store.digest(b"abcd")], "sizes": [1], "owners": [1], "payload": token_store.zstandard.ZstdCompressor().compress(b"abce")}
    with pytest.raises(ValueError):
        token_store.opened(row)


def test_packing(spark, awkward, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    for df in (spark.read.parquet(f"{DATA}/documents.parquet"), awkward):
        out = packing.pack(df, path, keep_ids=True).toPandas()
        seqs = out.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
        assert all((g.offset.to_numpy() == np.r_[0, g.length.cumsum().to_numpy()[:-1]]).all() and g.length.sum() <= 2048 for _, g in seqs)
        assert len(seqs) <= -(-out.length.sum() // 2048) + 1
        assert all(zlib.crc32(x) == c for x, c in zip(out.ids, out.ids_crc32, strict=True)) and (out.groupby("doc_id", dropna=False).piece.min() == 0).all()
        assert out.length.sum() == sum(len(x) // 4 + 1 for x in Encoder(path).encode([r["text"] for r in df.select("text").collect()]))
    assert packing.pack(empty, path).count() == 0


def test_sweep_never_overfills():
    rng = random.Random(3)
    for _ in range(200):
        counts = {rng.randrange(1, 65): rng.randrange(1, 30) for _ in range(rng.randrange(1, 20))}
        runs, n = packing.sweep(counts, 64)
        fill, seen = {}, {}
        for length, rank, many, seq, offset in runs:
            for k in range(many):
                seen.setdefault(length, set()).add(rank + k)
                fill.setdefault(seq + k, []).append((offset, length))
        assert {k: len(v) for k, v in seen.items()} == counts and len(fill) == n
        for items in fill.values():
            at = 0
            for offset, length in sorted(items):
                assert offset == at
                at += length
            assert at <= 64


def test_languages(spark, awkward, empty):
    out = lang_id.op5_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = out[out.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.95
    model = lang_id.Dictionaries.fit(awkward)
    rows = lang_id.identify(awkward, model).collect()
    assert len(rows) == awkward.count() and all(r["lang_pred"] == "und" for r in rows if not (r["text"] or "").strip())
    nothing = lang_id.Dictionaries.fit(empty)
    assert lang_id.identify(empty, model).count() == 0 and {r["lang_pred"] for r in lang_id.identify(awkward, nothing).collect()} == {"und"}


def test_toxicity(spark, awkward, empty):
    d = "/root/testdata/sf0.1"
    out = toxicity.op1_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").toPandas()
    held = out[out.held_out]
    assert (held.predicted == held.toxic).mean() > 0.95 and out.score.between(0, 1).all()
    net = toxicity.fit(awkward.withColumn("toxic", F.col("doc_id").cast("int") % 2))
    got = toxicity.score(awkward, net, ["doc_id"]).collect()
    assert len(got) == awkward.count() and toxicity.score(empty, toxicity.fit(empty.withColumn("toxic", F.lit(1))), ["doc_id"]).count() == 0


def test_token_counts(spark, awkward, empty):
    model = token_counts.Unigram(token_counts.vocabulary(public_tokenizers.path("piece_bpe_32k.model")))
    got = token_counts.token_counts(awkward, model, ["text"]).collect()
    assert len(got) == awkward.count() and token_counts.token_counts(empty, model, ["doc_id"]).count() == 0
    for r in got:
        words = (r["text"] or "").split()
        assert (r["n_pretokens"], r["n_tokens"]) == (len(words), sum(model.one((token_counts.MARK + w).encode()) for w in words))


def test_quality(spark, awkward, empty):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    want = con.sql(quality.OP10_SQL).df().sort_values("doc_id").reset_index(drop=True)
    got = quality.op10_quality_rules(spark, DATA).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert all((want[c] == got[c]).all() for c in want.columns) and sorted(want.columns) == sorted(got.columns)
    plain = quality.quality(awkward, most_documents=1, with_text=True).collect()
    rows = quality.quality(awkward, most_documents=1, with_text=True, long_text=100).collect()
    assert len(plain) == awkward.count() and sorted(map(str, plain)) == sorted(map(str, rows)) and quality.quality(empty).count() == 0


def test_lines(spark, awkward, empty):
    line = "the quick brown fox jumps over the lazy dog and runs far away from here into the dark green wood tonight"
    rows = [(1, f"{line}\nshort"), (2, f"intro of its own, long enough\n{line.upper()}!\nshort"), (3, line.replace("tonight", "tonite")), (4, "something else entirely different from the others " * 3)]
    out = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1]["text"] == rows[0][1] and out[2]["text"] == "intro of its own, long enough" and out[4]["text"] == rows[3][1]
    got = line_dedup.dedup_lines(awkward)
    assert got.count() == awkward.count() and line_dedup.dedup_lines(empty).count() == 0
    assert all(r["text"] is None for r in got.where("n_chars is null").collect())


def edits(x, y):
    row = np.arange(len(y) + 1)
    other = np.array(list(y))
    for i, c in enumerate(x, 1):
        new = np.minimum(row[1:] + 1, row[:-1] + (other != c))
        row = np.minimum.accumulate(np.r_[i, new] - np.arange(len(y) + 1)) + np.arange(len(y) + 1)
    return int(row[-1])


def test_fuzzy_lines_against_brute_force(spark):
    """One line a document, words substituted, left out or misspelt: groups of edit similarity 0.8 are found, and nothing else goes."""
    rng = random.Random(11)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(900)]
    lines = []
    for n in [5, 8, 12, 20, 40] * 8:
        base = [rng.choice(words) for _ in range(n)]
        gone = rng.randrange(n)
        lines += [base, [*base[:gone], *base[gone + 1 :]], [rng.choice(words) if rng.random() < 0.1 else w for w in base], [w[:1] + "x" + w[2:] if rng.random() < 0.15 else w for w in base]]
    lines = [" ".join(x) for x in lines]
    lines = [x for x in lines if len(x) >= line_dedup.LEAST_CHARS]
    up = list(range(len(lines)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for b in range(len(lines)):
        for a in range(b):
            most = 0.2 * max(len(lines[a]), len(lines[b])) + 1e-9
            if abs(len(lines[a]) - len(lines[b])) <= most and top(a) != top(b) and edits(lines[a], lines[b]) <= most:
                x, y = sorted((top(a), top(b)))
                up[y] = x
    want = {i for i in range(len(lines)) if top(i) != i}
    got = {r["id"] for r in line_dedup.duplicates(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()}
    assert got <= want and len(got) >= 0.97 * len(want) > 50, (len(got), len(want), len(lines))


def test_decontamination(spark, awkward, empty, bench):
    out = decontaminate.decontaminate(awkward, bench)
    rows = out.collect()
    assert len(rows) == awkward.count() and {r["doc_id"] for r in rows if r["contaminated"]} == {0, 1, 2, 9, 13, None}
    assert all(r["items"] == [1] for r in rows if r["contaminated"])
    assert decontaminate.decontaminate(empty, bench).count() == 0 and not decontaminate.decontaminate(awkward, bench.limit(0)).where("contaminated").count()
    words = awkward_rows()[0][1].split()[10:40]
    for i in (3, 9, 15, 21, 27):  # substitutions
        words[i] = "zz"
    changed = spark.createDataFrame([(1, "before " * 30 + " ".join(words) + " after" * 30), (2, "before " * 60)], "doc_id long, text string")
    assert [r["contaminated"] for r in decontaminate.decontaminate(changed, bench).orderBy("doc_id").collect()] == [True, False]


def test_short_items_with_substitutions(spark):
    """Items of 5 to 11 words, with every choice of as many substituted words as an overlap allows, and with one more."""
    rows, items, want = [], [], set()
    for n in range(5, 12):
        item = [f"i{n}w{k}" for k in range(n)]
        items.append((n, " ".join(item)))
        for apart in (n // 5, n // 5 + 1):
            for gone in itertools.combinations(range(n), apart):
                if apart == n // 5:
                    want.add(len(rows))
                rows.append((len(rows), "before it " + " ".join("zz" if k in gone else w for k, w in enumerate(item)) + " after it"))
    out = decontaminate.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r["doc_id"] for r in out.where("contaminated").collect()} == want


def test_suffix_array():
    rng = random.Random(2)
    for _ in range(1500):
        x = [rng.randint(1, rng.choice([1, 2, 3, 6])) for _ in range(rng.randint(1, 40))] + [0]
        assert suffix_array(np.array(x)) == sorted(range(len(x)), key=lambda i: x[i:])


def brute_repeats(rows, width=50):
    low, out = {}, []
    for i, b in sorted(rows, key=lambda r: r[0]):
        for p in range(len(b) - width + 1):
            low.setdefault(b[p : p + width], i)
    for i, b in rows:
        gone = np.zeros(len(b) + 1, int)
        for p in range(len(b) - width + 1):
            if low[b[p : p + width]] < i:
                gone[p] += 1
                gone[p + width] -= 1
        m = np.cumsum(gone[:-1]) > 0
        out.append((len(b), int(m.sum()), int((m & ~np.r_[False, m[:-1]]).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~m].tobytes()).hexdigest()))
    return out


def test_repeats(spark, awkward, empty):
    for df in (spark.read.parquet(f"{DATA}/documents.parquet"), awkward):
        rows = [(2**63 - 1 if r["doc_id"] is None else r["doc_id"], (r["text"] or "").encode()) for r in df.select("doc_id", "text").collect()]
        got = substring_dedup.remove_repeats(df).collect()
        assert sorted((2**63 - 1 if r[0] is None else r[0], *r[1:]) for r in got) == sorted((i, *x) for (i, _), x in zip(rows, brute_repeats(rows), strict=True))
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_pipeline_takes_awkward_rows(spark, awkward, empty, bench, tmp_path):
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    for df in (awkward, empty):
        docs = df
        for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            if n < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == df.columns
            out.write.parquet(path := f"{tmp_path}/{n}-{df is empty}")
            docs = spark.read.parquet(path)


def test_queries_are_eleven():
    assert len(queries.QUERIES) == 11 and set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_marks_rule_out_no_link(spark):
    """Pairs of sets whose marks aren't close are never similar enough, at every percentage near the edge."""
    rng = random.Random(5)
    texts = []
    for _ in range(40):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([3, 30, 300]))]
        texts += [" ".join(words), " ".join(w if rng.random() > 0.06 else "x" for w in words), " ".join(words[: len(words) * 9 // 10])]
    texts = pa.array(texts)
    n, _, _, marks, _, _ = near_dup.signatures(texts, 2, 4, 4)
    rows = spark.createDataFrame([(i, (int(n[i]), [int(v) for v in marks[i]])) for i in range(len(texts))], "id int, mark struct<n: long, bits: array<long>>")
    sets = [set(x.tolist()) for x in spans.shingle_sets(texts, 2)]
    links = {(a, b) for b in range(len(sets)) for a in range(b) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    x, y = rows.toDF("a", "ma"), rows.toDF("b", "mb")
    close = {(r["a"], r["b"]) for r in x.join(y, x["a"] < y["b"]).where(near_dup.close(80)(F.col("ma"), F.col("mb"))).select("a", "b").collect()}
    assert links <= close and len(close) < len(sets) ** 2 / 4


def test_store_by_document_and_manifest(spark, tmp_path):
    """Ids of each document by its id; a lost segment file, and a manifest of another store, are seen."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tool = Tokenizer.from_file(path)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        token_store.write_store(docs, f"{tmp_path}/s", path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = {r["id"]: np.frombuffer(bytes(r["ids"]), "<u4").tolist() for r in token_store.read_store(spark, f"{tmp_path}/s", with_ids=True).collect()}
    assert got == {i: [*tool.encode(t or "", add_special_tokens=False).ids, 2] for i, t in docs_of(spark)}
    token_store.write_store(docs.where("doc_id > 50"), f"{tmp_path}/other", path)
    (tmp_path / "s" / "manifest").rename(tmp_path / "own")
    (tmp_path / "other" / "manifest").rename(tmp_path / "s" / "manifest")
    with pytest.raises(ValueError):
        token_store.read_store(spark, f"{tmp_path}/s")
    (tmp_path / "s" / "manifest").rename(tmp_path / "other" / "manifest")
    (tmp_path / "own").rename(tmp_path / "s" / "manifest")
    next((tmp_path / "s" / "segments").glob("part-*.parquet")).unlink()
    with pytest.raises(ValueError):
        token_store.read_store(spark, f"{tmp_path}/s")


def test_quality_of_much_repetition(spark):
    """One text that repeats its first half: as many words as brute force finds, in about linear time."""
    rng = random.Random(4)
    for n in (5, 2000):
        half = [f"w{rng.randrange(9 * n)}" for _ in range(n)]
        words = [*half, "middle", *half, "end"]
        seen = {}
        for i in range(len(words) - 2):
            seen.setdefault(tuple(words[i : i + 3]), []).append(i)
        want = len({j for at in seen.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)})
        docs = spark.createDataFrame([(1, " ".join(words), "s")], "doc_id long, text string, source string")
        assert quality.quality(docs).first()["n_repeat_words"] == want


def test_lines_fuzzy_row_goes(spark):
    line = "the quick brown fox jumps over the lazy dog and runs far away from here into the dark green wood tonight"
    rows = [(1, line), (2, line.replace("tonight", "tonite")), (3, None), (4, ""), (5, f"an opening line of its own kind\n{line}\nclosing words that nobody else has\n")]
    out = {r["doc_id"]: (r["text"], r["n_lines_removed"]) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: (line, 0), 2: ("", 1), 3: (None, 0), 4: ("", 0), 5: ("an opening line of its own kind\nclosing words that nobody else has\n", 1)}


def test_lines_one_word_edited_by_length(spark):
    """Recall of lines with one word substituted, by length class, and no line that shouldn't go."""
    rng = random.Random(3)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(900)]
    rows, of, least = [], {}, {5: 0.7, 8: 0.9, 15: 0.9, 25: 0.9, 50: 0.9, 100: 0.9, 200: 0.9}
    for n in least:
        for _ in range(40):
            base = [rng.choice(words) for _ in range(n)]
            other = list(base)
            other[rng.randrange(n)] = rng.choice(words)
            a, b = " ".join(base), " ".join(other)
            if a != b and min(len(a), len(b)) >= line_dedup.LEAST_CHARS and edits(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9:
                of[len(rows) + 1] = n
                rows += [(len(rows), a), (len(rows) + 1, b)]
    gone = {r["id"] for r in line_dedup.duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert gone <= set(of)
    for n, share in least.items():
        mine = [i for i, m in of.items() if m == n]
        assert sum(i in gone for i in mine) >= share * len(mine), n


def test_toxicity_of_long_texts_by_blocks(spark):
    """Blocks of words and of bytes give what one pass gives."""
    net, rng = toxicity.Network(), random.Random(6)
    texts = pa.array([" ".join(f"w{rng.randrange(500)}" for _ in range(n)) for n in (0, 1, 2, 700, 3000)])
    rows, own = toxicity.buckets(texts)
    net.learn_languages(["w1 w2 w3", "w4 w5 w6"], ["a", "b"])
    whole, lang = net.logits(rows, own), net.language(rows, own)
    before = toxicity.BLOCK_WORDS, toxicity.BLOCK_BYTES
    try:
        toxicity.BLOCK_WORDS, toxicity.BLOCK_BYTES = 64, 100
        assert np.allclose(net.logits(rows, own), whole, atol=1e-5) and (net.language(rows, own) == lang).all()
        cut, _ = toxicity.buckets(texts.slice(4))
        assert (cut == rows[own[4] :]).all()
    finally:
        toxicity.BLOCK_WORDS, toxicity.BLOCK_BYTES = before


def test_sample_is_of_distinct_texts(spark):
    """A text copied very often takes one place of its label, and the other labels keep theirs."""
    rows = spark.range(5000).selectExpr("case when id < 4000 then 'a' when id < 4800 then concat('a', id) else concat('b', id) end as t", "case when id < 4800 then 'x' else 'y' end as l")
    got = lang_id.labelled_sample(rows, "l", ["t"], 50, 5, [F.col("t")])
    assert {k: sum(r["l"] == k for r in got) for k in ("x", "y")} == {"x": 50, "y": 50} and len({r["t"] for r in got}) == 100


def test_counts_equal_the_library(spark):
    """Words that pieces cover, against the unigram model of the tokenizers library with the same scores."""
    from tokenizers import Tokenizer, models

    scores = token_counts.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    chars = {p.decode() for p in scores if len(p.decode()) == 1}
    tool = Tokenizer(models.Unigram([("<unk>", -100.0), *((p.decode(), s) for p, s in scores.items())], 0, False))
    words = sorted({w for _, t in docs_of(spark) for w in (t or "").split() if set(w) <= chars and len(w) < 60})[:3000]
    model = token_counts.Unigram(scores)
    got = [n for _, n in model.counts(words)]
    assert len(words) > 500 and got == [len(tool.encode(token_counts.MARK + w).ids) for w in words]


def test_seeds_fit_any_two_substitutions():
    for gone in itertools.combinations(range(12), 2):
        assert any(all(m[j] == "0" or s + j not in gone for j in range(len(m))) for m in decontaminate.MASKS for s in range(13 - len(m)))


def test_items_without_spaces(spark):
    docs = spark.createDataFrame([(1, "これは長い文章の前の部分です。東京都は日本の首都であり世界最大の都市圏の一つである。後ろの部分"), (2, "全く別の文章で何も共通していないはずです")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "東京都は日本の首都であり世界最大の都市圏の一つである")], "item_id long, text string")
    assert {r["doc_id"]: r["items"] for r in decontaminate.decontaminate(docs, items).collect()} == {1: [7], 2: []}


def test_hot_passage_stays_small():
    """A passage in every document adds one document's anchors to its bucket for each batch."""
    rng = np.random.default_rng(1)
    passage = bytes(rng.integers(97, 123, 300).astype(np.uint8)).decode()
    sizes = []
    for n in (500, 2000):
        own = [bytes(rng.integers(97, 123, 60).astype(np.uint8)).decode() for _ in range(n)]
        part = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(np.arange(n)), pa.array([a + passage for a in own])], ["id", "of", "text"])

        class Rows:
            def mapInArrow(self, run, schema, part=part):
                return list(run([part]))

        found = substring_dedup.find_anchors(Rows(), 50, 16)
        gram = [b for x in found for b, k, d in zip(*(x.column(c).to_pylist() for c in ("bucket", "kind", "data"))) if k == 0]
        bulk = [len(d) for x in found for k, d in zip(*(x.column(c).to_pylist() for c in ("kind", "data"))) if k == 0]
        assert gram
        sizes.append(max(bulk) / n)
    assert sizes[1] < 1.5 * sizes[0]


def test_packing_by_document(spark):
    """Each document's pieces, ids and starts, by its id, against the library's ids."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tool = Tokenizer.from_file(path)
    got = {}
    for r in packing.pack(spark.read.parquet(f"{DATA}/documents.parquet"), path, keep_ids=True).orderBy("doc_id", "piece").collect():
        got.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], np.frombuffer(bytes(r["ids"]), "<u4").tolist()))
    for i, t in docs_of(spark):
        ids = [*tool.encode(t or "", add_special_tokens=False).ids, 0]
        assert got[i] == [(n, a, len(ids[a : a + 2048]), ids[a : a + 2048]) for n, a in enumerate(range(0, len(ids), 2048))]


def test_matching_over_many_slices(spark):
    """Slices of a few runs: every item is placed once, no sequence overflows or has holes, and few more sequences are used than the lengths add up to."""
    rng = random.Random(8)
    runs = [(packing.ITEM, rng.choice([rng.randrange(1, 65), rng.randrange(1, 12), 40]), t, 0, rng.randrange(1, 40), 0, 0, 0) for t in range(150)]
    before = packing.SLICE_ROWS
    packing.SLICE_ROWS = 15
    try:
        tables = packing.matched(spark.createDataFrame(runs, packing.STATE).coalesce(1), 64)
        rows = [r for t in tables for r in t.where(F.col("kind") == packing.PLACED).collect()]
    finally:
        packing.SLICE_ROWS = before
    seen, fill = {}, {}
    for r in rows:
        for j in range(r["count"]):
            seen.setdefault((r["size"], r["a"]), []).append(r["first"] + j)
            fill.setdefault(r["sequence"] + j // r["each"], []).append((r["offset"] + j % r["each"] * r["size"], r["size"]))
    assert {k: sorted(v) for k, v in seen.items()} == {(n, t): list(range(c)) for _, n, t, _, c, *_ in runs}
    for items in fill.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(n * c for _, n, _, _, c, *_ in runs)
    large = sum(c for _, n, _, _, c, *_ in runs if 2 * n > 64)
    assert len(fill) <= 1.05 * max(-(-total // 64), large) + 1


def test_claims_never_share_a_gap():
    rng = random.Random(2)
    for _ in range(300):
        slices, low = [], 1
        for p in range(rng.randrange(1, 8)):
            high = low + rng.randrange(0, 9)
            slices.append((p, rng.randrange(0, 9), rng.randrange(low, high + 1), rng.randrange(0, 9), rng.randrange(low, high + 1)))
            low = high
        out = packing.claims(slices)
        for side, at in ((0, 1), (3, 4)):
            for number in {c[side] for c in out}:
                end = 0
                for c in sorted((c for c in out if c[side] == number), key=lambda c: c[at]):
                    assert c[at] == end
                    end += c[at + 1]
                assert end <= next(s[1 if side == 0 else 3] for s in slices if s[0] == number)
        rooms = {s[0]: (s[2], s[4]) for s in slices}
        assert all(c[0] < c[3] and c[2] <= c[5] * (rooms[c[3]][1] // rooms[c[0]][0]) for c in out)
