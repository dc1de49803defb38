"""Periodic runs of words by the linear tandem-repeat method of Gusfield and Stoye.

A run is a maximal stretch of words with a smallest period. Each word of a run of
exponent four stands four times in it, so a word that is rarer between its
neighbours cuts a text: stretches between such words are all that can hold runs.
Stretches of many texts are searched together, with a symbol of its own between
any two:

* The suffix tree is held as the order of suffixes, the common prefixes of
  neighbours (a node is an interval of the order and a depth) and the names of
  basic factors, from which the order was made; names give the longest common
  extension of two places in either direction.
* Lempel-Ziv blocks: the longest piece that also starts before. About each block's
  bounds, extensions give squares that cover the leftmost place of every square.
* Suffix-link walks: from the node of a square aw, the node of w and its child by
  a are the square's rotation wa. Walks go on until a node is known, all in step;
  then every distinct square of the texts is known.
* Squares of primitive roots are located: the leaves below their nodes. Places of
  one period that follow each other merge into a run.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from quarry.llm import spans
from quarry.llm.line_dedup import bound

LEAST_LENGTH, LEAST_EXPONENT = 6, 4
#: Symbols searched together, unless one text has more; rounds of cutting, which only save work.
SYMBOLS, CUTS = 400_000, 12


class SuffixTree:
    """Of symbols from 1 on; the first and the last symbol must each stand once."""

    def __init__(self, symbols: np.ndarray):
        n = self.n = len(symbols)
        self.names = [symbols.astype(np.int64)]  # names[t][i]: rank of the 2**t symbols from i on
        while True:
            now, width = self.names[-1], 1 << (len(self.names) - 1)
            later = np.zeros(n, np.int64)
            later[: n - width] = now[width:]
            distinct, name = np.unique(now * (n + 2) + later, return_inverse=True)
            if len(distinct) == n:
                break
            self.names.append(name + 1)
        self.rank = name
        self.order = np.empty(n, np.int64)
        self.order[name] = np.arange(n)
        shared = np.zeros(n, np.int64)
        shared[1:] = self.ahead(self.order[:-1], self.order[1:])
        self.least = [shared]  # least[t][r]: smallest of 2**t shared prefixes from r on
        while 2 << (len(self.least) - 1) <= n:
            last, half = self.least[-1], 1 << (len(self.least) - 1)
            self.least.append(np.minimum(last[:-half], last[half:]))

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Symbols that agree from i and j on (i <> j)."""
        out = np.zeros(len(i), np.int64)
        for t in reversed(range(len(self.names))):
            name = self.names[t]
            out += (name[i + out] == name[j + out]).astype(np.int64) << t
        return out

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Symbols that agree at i and j and before."""
        out = np.zeros(len(i), np.int64)
        for t in reversed(range(len(self.names))):
            name, a, b = self.names[t], i - out - (1 << t) + 1, j - out - (1 << t) + 1
            out += ((np.minimum(a, b) >= 0) & (name[np.maximum(a, 0)] == name[np.maximum(b, 0)])).astype(np.int64) << t
        return out

    def node(self, rank: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last place in the order of the suffixes that share depth symbols with the one at rank."""
        low, high = rank.copy(), rank.copy()
        for t in reversed(range(len(self.least))):
            least, step = self.least[t], 1 << t
            low -= ((low >= step) & (least[np.maximum(low - step + 1, 0)] >= depth)).astype(np.int64) << t
            high += ((high + step < self.n) & (least[np.minimum(high + 1, len(least) - 1)] >= depth)).astype(np.int64) << t
        return low, high

    def blocks(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the Lempel-Ziv blocks."""
        before, after, stack = [-1] * self.n, [-1] * self.n, []
        for p in self.order.tolist():
            while stack and stack[-1] > p:
                after[stack.pop()] = p
            if stack:
                before[p] = stack[-1]
            stack.append(p)
        longest = np.ones(self.n, np.int64)
        for other in (np.array(before), np.array(after)):
            at = np.flatnonzero(other >= 0)
            longest[at] = np.maximum(longest[at], self.ahead(at, other[at]))
        starts, at, longest = [], 0, longest.tolist()
        while at < self.n:
            starts.append(at)
            at += longest[at]
        return np.array(starts), np.array([*starts[1:], self.n])

    def covering_squares(self) -> tuple[np.ndarray, np.ndarray]:
        """(start, half) of squares that cover the leftmost place of each distinct square."""
        starts, ends = self.blocks()
        size = ends - starts
        following = np.r_[size[1:], 0]
        found = []
        for edge, most, right in ((ends, size, True), (starts, size + following, False)):
            block = np.repeat(np.arange(len(size)), most)
            half = np.arange(len(block)) - np.repeat(np.cumsum(most) - most, most) + 1
            at = edge[block]
            other = at - half if right else at + half  # a period before the block's end, or after its start
            ok = (at >= 1) & (at < self.n) & (other >= 1) & (other < self.n)
            block, half, at, other = block[ok], half[ok], at[ok], other[ok]
            on, back = self.ahead(at, other), self.behind(at - 1, other - 1)
            first = np.minimum(at, other)
            start = np.maximum(first - back, first - half + 1)
            ok = (on + back >= half) & (on > 0)
            if not right:
                ok &= (back > 0) & (start + half <= ends[block])
            found.append((start[ok], half[ok]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def primitive(self, start: np.ndarray, half: np.ndarray) -> np.ndarray:
        """Whether the half words from start on aren't a shorter piece again and again."""
        factor = np.arange(int(half.max(initial=1)) + 1)
        for p in range(2, int(len(factor) ** 0.5) + 1):
            if factor[p] == p:
                multiples = factor[p * p :: p]
                multiples[multiples == np.arange(p * p, len(factor), p)] = p
        out, left = np.ones(len(half), bool), half.copy()
        while (left > 1).any():
            some = np.flatnonzero(left > 1)
            p = factor[left[some]]
            period = half[some] // p
            out[some] &= self.ahead(start[some], start[some] + period) < half[some] - period
            left[some] //= p
        return out

    def squares(self) -> tuple[np.ndarray, np.ndarray]:
        """(a place, half) of every distinct square of primitive root."""
        at, half = self.covering_squares()
        ok = self.primitive(at, half)
        at, half = at[ok], half[ok]
        low = self.node(self.rank[at], 2 * half)[0]
        seen: set[tuple[int, int]] = set()
        places, halves = [at[:0]], [half[:0]]
        while len(at):
            new = []
            for i, key in enumerate(zip(low.tolist(), half.tolist(), strict=True)):
                if key not in seen:
                    seen.add(key)
                    new.append(i)
            at, half = at[new], half[new]
            places.append(at)
            halves.append(half)
            # the suffix link's node, and its child by the square's first symbol
            first, last = self.node(self.rank[at + 1], 2 * half - 1)
            symbol, low, high = self.names[0][at], first.copy(), last + 1
            while (open_ := low < high).any():
                middle = (low + high) // 2
                less = open_ & (self._symbol(middle, half) < symbol)
                low, high = np.where(less, middle + 1, low), np.where(open_ & ~less, middle, high)
            ok = low <= last
            ok[ok] = self._symbol(low[ok], half[ok]) == symbol[ok]
            low, half = low[ok], half[ok]
            at = self.order[low]
        return np.concatenate(places), np.concatenate(halves)

    def _symbol(self, place: np.ndarray, half: np.ndarray) -> np.ndarray:
        """The last of the 2 * half symbols from the suffix at a place of the order on."""
        return self.names[0][np.minimum(self.order[np.minimum(place, self.n - 1)] + 2 * half - 1, self.n - 1)]

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, period) of every maximal stretch with a smallest period of half its length at most."""
        at, half = self.squares()
        low, high = self.node(self.rank[at], 2 * half)
        times = high - low + 1
        place = self.order[np.repeat(low - (np.cumsum(times) - times), times) + np.arange(times.sum())]
        half = np.repeat(half, times)
        sorted_ = np.lexsort((place, half))
        place, half = place[sorted_], half[sorted_]
        opens = np.ones(len(place), bool)
        opens[1:] = (half[1:] != half[:-1]) | (place[1:] != place[:-1] + 1)
        first = np.flatnonzero(opens)
        last = np.r_[first[1:], len(place)] - 1 if len(first) else first
        return place[first], place[last] + 2 * half[first] - place[first], half[first]


def word_ids(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word, equal for equal words of these texts, and the bounds of each text's words."""
    data, at = spans.flat(texts)
    starts, ends, own = spans.words(data, at)
    if not len(starts):
        return np.zeros(0, np.int64), own
    bounds = np.r_[0, np.cumsum(ends - starts)]
    letters = data[~spans.SPACE[data]]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(letters)])
    return words.dictionary_encode().indices.to_numpy().astype(np.int64), own


def stretches(ids: np.ndarray, own: np.ndarray, least_length: int, least_exponent: int) -> list[tuple[int, int]]:
    """Bounds of all stretches of words that may hold a run: of a run's words each stands least_exponent times in it."""
    at, part = np.arange(len(ids)), np.repeat(np.arange(len(own) - 1), np.diff(own))
    values = int(ids.max(initial=0)) + 1
    for _ in range(CUTS):
        if not len(at):
            break
        _, which, n = np.unique(part * values + ids[at], return_inverse=True, return_counts=True)
        keep = n[which] >= least_exponent
        at, old = at[keep], part[keep]
        opens = np.ones(len(at), bool)
        opens[1:] = (np.diff(at) != 1) | (np.diff(old) != 0)
        part = np.cumsum(opens) - 1
        long_ = (np.bincount(part) >= least_length)[part] if len(part) else np.zeros(0, bool)
        at, part = at[long_], part[long_]
        if keep.all() and long_.all():
            break
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(part)) + 1
    return list(zip(at[np.r_[0, cut]].tolist(), (at[np.r_[cut - 1, len(at) - 1]] + 1).tolist(), strict=True))


def runs_of(pieces: list[np.ndarray], least_length: int, least_exponent: int) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each piece."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in pieces]
    if not pieces:
        return out
    _, ranks = np.unique(np.concatenate(pieces), return_inverse=True)
    sizes = np.array([len(p) for p in pieces])
    begins = np.cumsum(sizes + 1) - sizes  # each piece stands between two symbols of their own
    symbols = np.zeros(sizes.sum() + len(sizes) + 1, np.int64)
    symbols[np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())] = ranks + 1
    between = np.flatnonzero(symbols == 0)
    symbols[between] = ranks.max() + 2 + np.arange(len(between))
    start, length, period = SuffixTree(symbols).runs()
    ok = length >= np.maximum(least_length, least_exponent * period)
    start, length, period = start[ok], length[ok], period[ok]
    piece = np.searchsorted(begins, start, "right") - 1
    for p, s, n, q in zip(piece.tolist(), (start - begins[piece]).tolist(), length.tolist(), period.tolist(), strict=True):
        out[p].append((s, n, q))
    return out


def periodic_runs(docs: DataFrame, keep: list[str], text_col: str = "text", least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> DataFrame:
    """The columns keep, runs (start, length, period in words; by start, then period) and collapsed of each row's whole text.

    A run has a smallest period q and max(least_length, least_exponent * q) words or
    more; collapsed has the words of no run but those of its first period, joined by
    single spaces. Words are what spaces, tabs and line ends separate. Null, empty
    and blank texts have no runs and an empty collapsed text. Rows are searched by
    themselves: repeated rows agree, null ids are kept, an empty table stays empty.
    Other columns are left out. least_exponent is an integer, two or more. One text's
    words are in one task, with about 40 numbers a word of its stretches.
    """
    run_type = StructType().add("start", "long").add("length", "long").add("period", "long")
    schema = docs.select(*keep).schema.add("runs", ArrayType(run_type)).add("collapsed", "string")
    list_type = pa.list_(pa.struct([(c, pa.int64()) for c in run_type.names]))

    def made(rows: pa.RecordBatch, found: list[list[tuple[int, int, int]]]) -> pa.RecordBatch:
        left = []
        for text, runs in zip(rows.column("__text").to_pylist(), found, strict=True):
            words = text.encode().split() if text else []
            if runs:
                stays = np.ones(len(words), bool)
                for s, n, q in runs:
                    stays[s + q : s + n] = False
                words = [words[i] for i in np.flatnonzero(stays)]
            left.append(b" ".join(words))
        runs = pa.array([[dict(zip(run_type.names, r, strict=True)) for r in x] for x in found], list_type)
        return pa.RecordBatch.from_arrays([*(rows.column(c) for c in keep), runs, pa.array(left, pa.binary()).cast(pa.string())], schema.names)

    def run(parts):
        held, pieces, places, n_held, symbols, high = [], [], [], 0, 0, 0

        def flushed():
            rows = pa.Table.from_batches(held).combine_chunks()
            found = [[] for _ in range(len(rows))]
            for (row, at), runs in zip(places, runs_of(pieces, least_length, least_exponent), strict=True):
                found[row] += [(at + s, n, q) for s, n, q in runs]
            begin = 0
            for batch in rows.to_batches():
                yield made(batch, [sorted(x, key=lambda r: (r[0], r[2])) for x in found[begin : begin + len(batch)]])
                begin += len(batch)

        for part in parts:
            for i, j in spans.batches(part.column("__text")):
                rows = part.slice(i, j - i)
                ids, own = word_ids(rows.column("__text"))
                bounds = stretches(ids, own, least_length, least_exponent)
                text = np.searchsorted(own, [a for a, _ in bounds], "right") - 1
                some = np.unique(text)
                others = np.setdiff1d(np.arange(len(rows)), some)
                if len(others):
                    yield made(rows.take(pa.array(others)), [[]] * len(others))
                if len(some):
                    held.append(rows.take(pa.array(some)))
                    for (a, b), d in zip(bounds, text.tolist(), strict=True):
                        pieces.append(ids[a:b] + high)  # words of another slice get other numbers
                        places.append((n_held + int(np.searchsorted(some, d)), a - int(own[d])))
                        symbols += b - a
                    high += int(ids.max()) + 1
                    n_held += len(some)
                if symbols >= SYMBOLS:
                    yield from flushed()
                    held, pieces, places, n_held, symbols, high = [], [], [], 0, 0, 0
        if held:
            yield from flushed()

    return docs.select(*keep, F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)


def planted(id_col: str, text_col: str) -> Column:
    """The text, of a tenth of the ids with the words from some place on put periodically in place of what stood there."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = F.floor(h / 10)

    def periodic(w: Column) -> Column:
        n = F.size(w)
        return bound(F.struct((g % n).cast("int").alias("a"), w.alias("w")), lambda x: at_period(x, 1 + F.floor((F.size(x["w"]) - x["a"]) / (3 + g % 8)).cast("int")))

    def at_period(x: Column, p: Column) -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(0), F.size(x["w"]) - 1), lambda i: F.get(x["w"], F.when(i < x["a"], i).otherwise(x["a"] + (i - x["a"]) % p))), " ")

    words = F.regexp_extract_all(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    return F.when((h % 10 == 0) & F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), bound(words, periodic)).otherwise(F.col(text_col))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document, with stretches planted in a tenth: its runs, the one of the greatest exponent, and a digest of the collapsed text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", planted("doc_id", "text").alias("text"))
    out = periodic_runs(docs, ["doc_id"])

    def before(a: Column, b: Column) -> Column:
        x, y = a["length"] * b["period"], b["length"] * a["period"]
        return F.when(x > y, -1).when(x < y, 1).when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).when(a["period"] < b["period"], -1).when(a["period"] > b["period"], 1).otherwise(0)

    top = F.get(F.array_sort("runs", before), F.lit(0))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    digest = lambda x: F.sha2(x.cast("binary"), 256)
    cut = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), top.alias("top"), digest(lines).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"))
    return cut.select("doc_id", "n_runs", "top.start", "top.length", "top.period", F.expr("1000 * top.length div top.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
