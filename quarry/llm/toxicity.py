"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's vector is the sum of three rows of one hashed table: of the word, of
its first four and of its first six bytes, so inflected forms share evidence.
Filters of widths 1 to 3 run over the words, each filter's largest value in the
document is kept (max pooling), and a logistic layer reads those. The weights
begin with a bounded sample; then every labelled row is learnt from once, where it
lies, and the tasks' changes are averaged by their rows. Thresholds
are calibrated by language on all labelled rows kept apart for that; the language
is told from the text by counts of hashed words, never read from a column. The
score is shifted so that every language's threshold lies at 0.5.
"""

from __future__ import annotations

import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import spans
from quarry.llm.common import drop_path, written
from quarry.llm.lang_id import crc_mod, labelled_sample

#: Bounds of the start, which is learnt on the driver: labelled rows for each label, characters of all of them; and languages. Texts are used whole.
ROWS_A_LABEL, CHARS_TO_LEARN, MOST_LANGUAGES = 3500, 48 << 20, 64
#: Parts in which a task sends what it has learnt; steps of a logit that are told apart in calibration.
PARTS, STEPS = 256, 256
#: Documents meet their labels in so many turns, by id: one turn's shuffle files are gone before the next.
TURNS = 3
#: Words of a text that are convolved at once, and bytes that are cut into words at once.
BLOCK_WORDS, BLOCK_BYTES = 1 << 16, 1 << 20
BUCKETS, DIM, WIDTHS, FILTERS, EPOCHS, BATCH, RATE, PREFIXES = 1 << 16, 24, (1, 2, 3), 16, 5, 32, 0.02, (4, 6)
PAD = max(WIDTHS) - 1


def blocks_of(data: np.ndarray) -> list[np.ndarray]:
    """data in parts of about BLOCK_BYTES, cut where no word is."""
    out, a = [], 0
    while a < len(data):
        b = a + BLOCK_BYTES
        while b < len(data):
            apart = np.flatnonzero(spans.PUNCT[data[b : b + BLOCK_BYTES]])
            if len(apart):
                b += int(apart[0])
                break
            b += BLOCK_BYTES
        out.append(data[a:b])
        a = b
    return out


def buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the table for each word (word, prefixes), and the n + 1 offsets of each text's words. A long text is cut into words part by part."""
    data, at = spans.flat(texts)
    if len(at) == 2 and len(data) > 2 * BLOCK_BYTES:
        rows = np.concatenate([rows_of(x, np.array([0, len(x)]))[0] for x in blocks_of(data)])
        return rows, np.array([0, len(rows)])
    return rows_of(data, at)


def rows_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = spans.LOWER[data]
    s, e, own = spans.words(data, at, spans.PUNCT)
    sums = spans.prefix_sums(data)
    cols = [spans.hashes(sums, s, e), *(spans.hashes(sums, s, np.minimum(e, s + n)) + spans.P * np.full(1, n, np.uint64) for n in PREFIXES)]
    return (np.stack(cols, 1) >> np.uint64(24)).astype(np.int32) & (BUCKETS - 1), own


class Network:
    """Weights, and what is known of languages; a few MB, whatever the corpus."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.table = (rng.standard_normal((BUCKETS, DIM)) * 0.1).astype(np.float32)
        self.filters = [(rng.standard_normal((k * DIM, FILTERS)) * (1 / np.sqrt(k * DIM))).astype(np.float32) for k in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out, self.out_bias = (rng.standard_normal(len(WIDTHS) * FILTERS) * 0.1).astype(np.float32), np.float32(0)
        self.languages: list[str] = []
        self.evidence = np.zeros((BUCKETS, 0), np.float32)
        self.shift = np.zeros(1)
        self.squares: list[np.ndarray] | None = None
        self.bias_square = 1e-6

    def weights(self) -> list[np.ndarray]:
        return [self.table, *self.filters, *self.bias, self.out]

    def flat(self) -> np.ndarray:
        return np.concatenate([*(w.reshape(-1) for w in self.weights()), [self.out_bias]]).astype(np.float32)

    def add(self, change: np.ndarray) -> None:
        at = 0
        for w in self.weights():
            w += change[at : at + w.size].reshape(w.shape).astype(np.float32)
            at += w.size
        self.out_bias = np.float32(self.out_bias + change[at])

    def laid_out(self, rows: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word vectors with PAD zero rows after each text, and where each text starts (n + 1)."""
        n = len(own) - 1
        start = own + PAD * np.arange(n + 1)
        x = np.zeros((start[-1] + PAD, DIM), np.float32)
        to = np.arange(len(rows)) + PAD * np.repeat(np.arange(n), np.diff(own))
        v = self.table[rows[:, 0]]
        for j in range(1, rows.shape[1]):
            v += self.table[rows[:, j]]
        x[to] = v
        return x, start

    def convolved(self, x: np.ndarray, k: int, i: int) -> np.ndarray:
        """A filter at a word sees it and the k - 1 words after it, or zeros beyond the text."""
        n = len(x) - k + 1
        windows = np.lib.stride_tricks.as_strided(x, (n, k * DIM), (x.strides[0], x.strides[1]), writeable=False)
        return windows @ self.filters[i] + self.bias[i]

    def logits(self, rows: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Of each text; a text without words pools zeros. Long texts are convolved block by block, each seeing the words after it that its last windows reach."""
        n = len(own) - 1
        pooled = np.full((n, len(WIDTHS) * FILTERS), -np.inf, np.float32)
        pieces = [(t, a, min(a + BLOCK_WORDS, int(own[t + 1])), min(a + BLOCK_WORDS + PAD, int(own[t + 1]))) for t in range(n) for a in range(int(own[t]), int(own[t + 1]), BLOCK_WORDS)]
        i = 0
        while i < len(pieces):
            j, size = i, 0
            while j < len(pieces) and (j == i or size + pieces[j][3] - pieces[j][1] <= BLOCK_WORDS):
                size += pieces[j][3] - pieces[j][1]
                j += 1
            some, a, b, stop = (np.array(x) for x in zip(*pieces[i:j], strict=True))
            words = np.concatenate([np.arange(p, q) for p, q in zip(a, stop, strict=True)])
            x, start = self.laid_out(rows[words], np.r_[0, np.cumsum(stop - a)])
            for k_at, k in enumerate(WIDTHS):
                c = self.convolved(x, k, k_at)
                # the positions of a piece end before what follows it; reduceat takes the odd slices only
                cuts = np.stack([start[:-1], start[:-1] + b - a], 1).reshape(-1)
                best = np.maximum.reduceat(c, np.minimum(cuts, len(c) - 1), axis=0)[::2]
                cols = slice(k_at * FILTERS, (k_at + 1) * FILTERS)
                np.maximum.at(pooled[:, cols], some, best)
            i = j
        pooled[np.isneginf(pooled)] = 0
        return np.maximum(pooled, 0) @ self.out + self.out_bias

    def train(self, texts: list[str], labels: np.ndarray, seed: int = 11, epochs: int = EPOCHS) -> None:
        """Takes the steps of epochs over the texts; called again, it goes on with the step sizes it had."""
        rng, order = np.random.default_rng(seed), np.arange(len(texts))
        cache: dict[int, np.ndarray] = {i: buckets(pa.array([t]))[0] for i, t in enumerate(texts)}
        params = self.weights()
        squares = self.squares = self.squares or [np.full(p.shape, 1e-6, np.float32) for p in params]
        for _ in range(epochs):
            rng.shuffle(order)
            for b in range(0, len(order), BATCH):
                pick = [i for i in order[b : b + BATCH] if len(cache[i])]
                if not pick:
                    continue
                own = np.r_[0, np.cumsum([len(cache[i]) for i in pick])]
                rows = np.concatenate([cache[i] for i in pick])
                x, start = self.laid_out(rows, own)
                pooled, best = np.zeros((len(pick), len(WIDTHS) * FILTERS), np.float32), []
                for i, k in enumerate(WIDTHS):
                    c = self.convolved(x, k, i)
                    at = np.stack([start[d] + c[start[d] : start[d] + own[d + 1] - own[d]].argmax(0) for d in range(len(pick))])
                    pooled[:, i * FILTERS : (i + 1) * FILTERS] = c[at, np.arange(FILTERS)]
                    best.append(at)
                active = np.maximum(pooled, 0)
                p = 1 / (1 + np.exp(-(active @ self.out + self.out_bias)))
                err = ((p - labels[pick]) / len(pick)).astype(np.float32)
                grad_out, grad_pool = active.T @ err, (err[:, None] * self.out) * (pooled > 0)
                grad_x = np.zeros_like(x)
                grads_w, grads_b = [], []
                for i, k in enumerate(WIDTHS):
                    g, at = grad_pool[:, i * FILTERS : (i + 1) * FILTERS], best[i]
                    gw = np.zeros_like(self.filters[i])
                    for j in range(k):
                        gw[j * DIM : (j + 1) * DIM] = np.einsum("df,dfe->ef", g, x[at + j])
                        np.add.at(grad_x, (at + j).reshape(-1), (g[:, :, None] * self.filters[i][j * DIM : (j + 1) * DIM].T[None]).reshape(-1, DIM))
                    grads_w.append(gw)
                    grads_b.append(g.sum(0))
                hit = np.flatnonzero(grad_x[: start[-1]].any(1))
                back = np.full(len(x), -1, np.int64)
                back[np.arange(len(rows)) + PAD * np.repeat(np.arange(len(pick)), np.diff(own))] = np.arange(len(rows))
                hit = hit[back[hit] >= 0]
                ids, where = np.unique(rows[back[hit]].reshape(-1), return_inverse=True)
                grad_t = np.zeros((len(ids), DIM), np.float32)
                np.add.at(grad_t, where.reshape(-1), np.repeat(grad_x[hit], rows.shape[1], 0))
                squares[0][ids] += grad_t**2
                self.table[ids] -= RATE * 4 * grad_t / np.sqrt(squares[0][ids])
                for param, grad, square in zip(params[1:], [*grads_w, *grads_b, grad_out], squares[1:], strict=True):
                    square += grad**2
                    param -= RATE * grad / np.sqrt(square)
                self.bias_square += float(err.sum()) ** 2
                self.out_bias = np.float32(self.out_bias - RATE * err.sum() / np.sqrt(self.bias_square))

    def learn_languages(self, texts: list[str], langs: list[str]) -> None:
        names = sorted(set(langs))
        counts = np.zeros((BUCKETS, len(names)))
        for t, name in zip(texts, langs, strict=True):
            np.add.at(counts[:, names.index(name)], buckets(pa.array([t]))[0][:, 0], 1)
        self.count_languages(names, counts)

    def count_languages(self, names: list[str], counts: np.ndarray) -> None:
        """counts: of hashed words, by language."""
        self.languages = names
        counts = counts.reshape(BUCKETS, len(names)) + 0.5
        self.evidence = np.log(counts / counts.sum(0)).astype(np.float32) if names else counts.astype(np.float32)

    def language(self, rows: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Index of the likeliest language of each text; one past the last for a text without words, or when none is known."""
        none, n = len(self.languages), len(own) - 1
        out, some = np.full(n, none), np.flatnonzero(np.diff(own) > 0)
        if none and len(some):
            total = np.zeros((n, none))
            for a in range(0, len(rows), BLOCK_WORDS):
                b = min(a + BLOCK_WORDS, len(rows))
                of = np.searchsorted(own, np.arange(a, b), "right") - 1
                first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
                total[of[first]] += np.add.reduceat(self.evidence[rows[a:b, 0]].astype(np.float64), first, axis=0)
            out[some] = total[some].argmax(1)
        return out

    def calibrate(self, z: np.ndarray, lang: np.ndarray, right0: np.ndarray, right1: np.ndarray) -> None:
        """The shift of each language, from logits with their language and how many rows of label 0 and 1 have them: the cut of most right labels, halfway between its neighbours; too few rows take that of all rows."""
        self.shift = np.zeros(len(self.languages) + 1)
        if not len(z):
            return

        def cut(z: np.ndarray, n0: np.ndarray, n1: np.ndarray) -> float:
            z, of = np.unique(z, return_inverse=True)
            n0, n1 = (np.bincount(of, n, len(z)) for n in (n0, n1))
            right = np.r_[0, np.cumsum(n0)] + np.r_[np.cumsum(n1[::-1])[::-1], 0]
            ends = np.r_[z[0] - 1, (z[1:] + z[:-1]) / 2, z[-1] + 1]
            best = np.flatnonzero(right == right.max())
            return float(ends[best[len(best) // 2]])

        self.shift[:] = cut(z, right0, right1)
        for i in range(len(self.languages)):
            mine = lang == i
            if (right0 + right1)[mine].sum() >= 200 and right1[mine].sum() >= 10:
                self.shift[i] = cut(z[mine], right0[mine], right1[mine])

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, list[str]]:
        rows, own = buckets(texts)
        lang = self.language(rows, own)
        z = self.logits(rows, own) - self.shift[lang]
        names = [*self.languages, "und"]
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -60, 60))), [names[i] for i in lang]


def told(rows: DataFrame, run) -> list:
    """How many rows (t, y) of each label have a logit and a language by run: logits are told apart to a STEPS-th, so what is collected is bounded however many rows there are."""

    def parts(batches):
        for part in batches:
            for i, j in spans.batches(part.column("t"), 2 << 20):
                x = part.slice(i, j - i)
                z, lang = run(x.column("t"))
                step = np.round(np.clip(z.astype(np.float64), -60, 60) * STEPS)
                yield pa.RecordBatch.from_arrays([pa.array(step.astype(np.int32)), pa.array(lang.astype(np.int32)), x.column("y")], ["z", "lang", "y"])

    counts = rows.select("t", "y").mapInArrow(parts, "z int, lang int, y int").groupBy("z", "lang").agg(F.sum(1 - F.col("y")).alias("n0"), F.sum("y").alias("n1"))
    return counts.orderBy("z", "lang").collect()


def learnt_by_all(rows: DataFrame, net: Network, names: list[str]) -> None:
    """net after each row (t, y, l) was learnt from once, and the words of each language of names counted.

    A task goes on from net with its own rows, a few MB at a time, and sends how its weights changed; parts of the changes are
    averaged by rows where they meet, so the driver gets one set of weights.
    """
    known = {name: i for i, name in enumerate(names)}

    def run(batches):
        own, counts, n = copy.deepcopy(net), np.zeros(BUCKETS * len(names)), 0
        before = own.flat()
        for part in batches:
            for i, j in spans.batches(part.column("t"), 2 << 20):
                x = part.slice(i, j - i)
                n += x.num_rows
                own.train(x.column("t").to_pylist(), x.column("y").to_numpy().astype(np.float32), epochs=1)
                if names:
                    words, at = buckets(x.column("t"))
                    lang = np.repeat([known.get(v, -1) for v in x.column("l").to_pylist()], np.diff(at))
                    counts += np.bincount(words[lang >= 0, 0].astype(np.int64) * len(names) + lang[lang >= 0], minlength=len(counts))
        if n:
            for kind, values in ((0, (own.flat() - before).astype(np.float16)), (1, counts.astype(np.float32))):
                if len(values):
                    each = np.array_split(values, PARTS)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(PARTS, kind, np.int32)), pa.array(np.arange(PARTS, dtype=np.int32)), pa.array(np.full(PARTS, n, np.int64)), pa.array([v.tobytes() for v in each], pa.binary())], ["kind", "part", "n", "data"])

    def met(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        kind, part = (k.as_py() for k in key)
        n = table.column("n").to_numpy()
        values = [np.frombuffer(d.as_py(), np.float32 if kind else np.float16).astype(np.float64) for d in table.column("data")]
        total = sum(values) if kind else sum(v * m for v, m in zip(values, n, strict=True)) / n.sum()
        return pa.table({"kind": pa.array([kind], pa.int32()), "part": pa.array([part], pa.int32()), "n": pa.array([int(n.sum())], pa.int64()), "data": pa.array([total.tobytes()], pa.binary())})

    schema = "kind int, part int, n long, data binary"
    # in the order of a hash, so that a task learns the same whenever it runs
    sent = rows.select("t", "y", "l").sortWithinPartitions(F.xxhash64("t"), "y", "l").mapInArrow(run, schema)
    got = sent.groupBy("kind", "part").applyInArrow(met, schema).orderBy("kind", "part").collect()
    change, counts = (np.concatenate([np.zeros(0), *(np.frombuffer(r["data"]) for r in got if r["kind"] == k)]) for k in (0, 1))
    if len(change):
        net.add(change)
    net.count_languages(names, counts if len(counts) else np.zeros(BUCKETS * len(names)))


def fit(rows: DataFrame, text: str = "text", label: str = "toxic", lang: str | None = "lang", calibrate=None) -> Network:
    """A network learnt from all labelled rows: null texts and labels other than 0 and 1 teach nothing.

    calibrate: condition of the rows kept apart for thresholds, all of which count; by default a fifth, by hash of the text. With no row at all the network is the untrained one.
    Texts are whole. The start is learnt from a bounded sample, in the order of a hash as many rows as have CHARS_TO_LEARN characters; then each row
    is learnt from once. A row longer than a 64th of CHARS_TO_LEARN isn't, as one text would outweigh the others.
    """
    net = Network()
    rows = rows.select(F.col(text).alias("t"), F.col(label).cast("int").alias("y"), (F.col(lang) if lang else F.lit(None)).cast("string").alias("l"), (calibrate if calibrate is not None else F.pmod(F.xxhash64(text), F.lit(5)) == 1).alias("apart")).where("t is not null and y in (0, 1)")
    learnt = rows.where("not apart").where(F.length("t") <= CHARS_TO_LEARN // 64)
    sizes = sorted(labelled_sample(learnt, "y", ["t"], ROWS_A_LABEL, 2, [F.length("t").alias("n")]), key=lambda r: r["__n"])
    total = np.cumsum([r["n"] for r in sizes]) if sizes else np.zeros(0)
    chosen = [(r["y"], r["__at"]) for r in sizes[: int(np.searchsorted(total, CHARS_TO_LEARN, "right"))]]
    if chosen:
        keys = rows.sparkSession.createDataFrame(chosen, "y int, at long")
        got = learnt.withColumn("at", F.xxhash64("t")).join(F.broadcast(keys), ["y", "at"]).groupBy("y", "at").agg(F.min("t").alias("t")).orderBy("y", "at").collect()
        net.train([r["t"] for r in got], np.array([r["y"] for r in got], np.float32))
        names = learnt.where("l is not null").groupBy("l").count().orderBy(F.desc("count"), "l").limit(MOST_LANGUAGES).collect()
        learnt_by_all(learnt, net, sorted(r["l"] for r in names))
        net.squares = None  # texts are scored without them

    def run(texts: pa.Array):
        words, own = buckets(texts)
        return net.logits(words, own), net.language(words, own)

    judged = told(rows.where("apart"), run)
    net.calibrate(np.array([r["z"] for r in judged]) / STEPS, *(np.array([r[c] for r in judged], np.int64) for c in ("lang", "n0", "n1")))
    return net


def score(docs: DataFrame, net: Network, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns keep, then score (0 to 1), predicted (1 from 0.5 on) and lang_read, one row for each row.

    Whole texts count. A null, empty or wordless text gets the score of pooled zeros; rows are judged alone, so repeated rows agree; an empty table stays empty. Columns of other names are left out.
    """
    schema = docs.select(*keep).schema.add("score", "double").add("predicted", "integer").add("lang_read", "string")

    def run(parts):
        for part in parts:
            for i, j in spans.batches(part.column("__text"), 2 << 20):
                x = part.slice(i, j - i)
                s, lang = net.scores(x.column("__text"))
                yield pa.RecordBatch.from_arrays([*(x.column(c) for c in keep), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(lang)], [*keep, "score", "predicted", "lang_read"])

    return docs.select(*keep, F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)


def labelled(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "toxic") -> DataFrame:
    """docs with label, for all labels that fit() can use: null ids and labels other than 0 and 1 teach nothing, a label said twice counts once."""
    usable = labels.select(key, label).where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).distinct()
    # texts are shuffled whatever the number of labels, and not sorted
    return docs.join(usable.hint("shuffle_hash"), key)


def labelled_in_turns(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> tuple[DataFrame, list[str]]:
    """labelled() as written tables, and their paths."""
    mine = lambda rows, turn: rows.where(F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(TURNS)) == turn)
    tables = [written(labelled(mine(docs, turn), mine(labels, turn), key), "toxicity-labelled") for turn in range(TURNS)]
    paths = [path for _, path in tables]
    return docs.sparkSession.read.schema(tables[0][0].schema).parquet(*paths), paths


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    fold = crc_mod(F.col("doc_id"), 5)
    rows, paths = labelled_in_turns(docs.where(fold != 0), labels.where(fold != 0))
    net = fit(rows, calibrate=fold == 1)
    drop_path(spark, *paths)
    out = score(docs.withColumn("held_out", fold == 0), net, ["doc_id", "held_out"])
    return out
