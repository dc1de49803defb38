"""Benchmark decontamination by spaced seeds.

A seed is the hash of the words that a fixed mask keeps of a short window, so a
substituted word in an ignored place leaves the seed as it is. Seeds of test
and training texts are joined on equality; each hit gives an alignment of an
item and a document, and the words around the hit are compared place by place.
An alignment is an overlap if a window of WINDOW words (the whole item if it is
shorter) agrees in at least 80 percent of its places.

Training texts are read once; a Bloom filter of the items' seeds tells which
documents can have hits, and only those go to the join. Its size follows the
number of seeds up to MOST_FILTER_BITS, as it is sent to all workers; a benchmark
of more seeds lets more documents through to the join, with the same result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import spans
from quarry.llm.common import drop_path, written
from quarry.llm.line_dedup import row_key

#: Fixed masks: 1 keeps a word, 0 ignores it. Of a window of 12 words one of them fits whichever two are substituted.
MASKS = ("11011011", "110100111", "1011001101", "1100110101")
WINDOW, AGREE_PERCENT, LEAST_WORDS = 12, 80, 5
LEAST_FILTER_BITS, MOST_FILTER_BITS = 1 << 20, 1 << 28
#: Kana and Han characters: words are not set apart there, so each is a word, if the benchmark has any.
UNSPACED = "([\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff])"


def short_masks(n: int) -> list[str]:
    """Masks of n places that ignore as many as may differ in an overlap of n words."""
    apart = n - -(-n * AGREE_PERCENT // 100)
    return ["".join("0" if j in gone else "1" for j in range(n)) for gone in combinations(range(n), apart)]


def seeds(words: np.ndarray, own: np.ndarray, masks: list[str]):
    """(seed hashes, positions) of each mask over all texts; no window crosses the end of a text."""
    end = np.repeat(own[1:], np.diff(own))
    for mask in masks:
        n = max(0, len(words) - len(mask) + 1)
        h = np.full(n, spans.mix(np.array([int("1" + mask, 2)], np.uint64))[0])
        for j, keep in enumerate(mask):
            if keep == "1":
                h = spans.mix(h * spans.P + words[j : j + n])
        ok = np.flatnonzero(np.arange(n) + len(mask) <= end[:n])
        yield h[ok], ok


def probes(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """Three places of each seed in a filter of so many bits, a power of two."""
    return [(spans.mix(h + np.uint64(k)) & np.uint64(bits - 1)).astype(np.int64) for k in range(3)]


def lit(known: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Whether the bits at places of a packed filter are set."""
    return (known[places >> 3] >> (7 - (places & 7)).astype(np.uint8)) & np.uint8(1) > 0


def spaced(text, unspaced: bool):
    """text with Kana and Han characters set apart."""
    return F.regexp_replace(text, UNSPACED, " $1 ") if unspaced else text


def item_words(benchmark: DataFrame, id_col: str, text_col: str, unspaced: bool = False) -> DataFrame:
    """(item, n, words): the word hashes of each distinct item text; item is its smallest id. Items under LEAST_WORDS words aren't searched for."""

    def run(parts):
        for part in parts:
            h, own = spans.word_hashes(part.column("text"), apart=spans.PUNCT)
            yield pa.RecordBatch.from_arrays([part.column("item"), pa.array(np.diff(own)), pa.array([h[a:b].tobytes() for a, b in zip(own[:-1], own[1:], strict=True)], pa.binary())], ["item", "n", "words"])

    rows = benchmark.select(F.col(id_col).cast("long").alias("item"), spaced(F.col(text_col).cast("string"), unspaced).alias("text")).where("item is not null and text is not null")
    return rows.mapInArrow(run, "item long, n long, words binary").where(F.col("n") >= LEAST_WORDS).groupBy("n", "words").agg(F.min("item").alias("item")).select("item", "n", "words")


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, of, item, start, words, agree): each document and item with an overlap: its first word in the document, its words and how many agree, of the best alignment. id and of as in line_dedup.row_key."""
    unspaced = benchmark.where(F.col(item_text).cast("string").rlike(UNSPACED)).limit(1).count() > 0
    items, items_path = written(item_words(benchmark, item_id, item_text, unspaced), "items")
    # an item shorter than a window has masks of its length, for every substitution that leaves it an overlap
    short = sorted(r["n"] for r in items.where(F.col("n") < WINDOW).select("n").distinct().collect())
    own_masks = {n: short_masks(n) for n in short}
    masks = [*MASKS, *(m for n in short for m in own_masks[n])]

    def seed_items(parts):
        for part in parts:
            for item, n, words in zip(*(part.column(c).to_pylist() for c in ("item", "n", "words")), strict=True):
                w = np.frombuffer(words, np.uint64)
                found = list(seeds(w, np.array([0, n]), [*MASKS, *own_masks.get(n, [])]))
                h, at = (np.concatenate([x[i] for x in found]) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), item)), pa.array(at.astype(np.int32))], ["seed", "item", "at"])

    item_seeds, seeds_path = written(items.mapInArrow(seed_items, "seed long, item long, at int"), "item-seeds")

    size = LEAST_FILTER_BITS
    n_seeds = item_seeds.count()
    while size < min(16 * n_seeds, MOST_FILTER_BITS):
        size *= 2

    def filters(parts):
        bits = np.zeros(size, bool)
        for part in parts:
            for p in probes(part.column("seed").to_numpy().view(np.uint64), size):
                bits[p] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], ["bits"])

    known = np.zeros(size // 8, np.uint8)
    for r in item_seeds.select("seed").coalesce(4).mapInArrow(filters, "bits binary").toLocalIterator():
        known |= np.frombuffer(r["bits"], np.uint8)
    known = docs.sparkSession.sparkContext.broadcast(known)

    def probe(parts):
        for part in parts:
            for i, j in spans.batches(part.column("text")):
                x = part.slice(i, j - i)
                h, own = spans.word_hashes(x.column("text"), apart=spans.PUNCT)
                found, at = [], []
                for s, p in seeds(h, own, masks):
                    hit = np.arange(len(s))
                    for k in range(3):  # few seeds get to the second place
                        hit = hit[lit(known.value, (spans.mix(s[hit] + np.uint64(k)) & np.uint64(size - 1)).astype(np.int64))]
                    found.append(s[hit])
                    at.append(p[hit])
                found, at = np.concatenate(found), np.concatenate(at)
                order = np.argsort(at, kind="stable")
                found, at = found[order], at[order]
                of = np.searchsorted(own, at, "right") - 1
                some, first = np.unique(of, return_index=True)
                yield pa.RecordBatch.from_arrays(
                    [x.column("id").take(pa.array(some)), x.column("of").take(pa.array(some)), pa.array([h[own[d] : own[d + 1]].tobytes() for d in some], pa.binary()), pa.ListArray.from_arrays(pa.array(np.r_[first, len(of)].astype(np.int32)), pa.array(found.view(np.int64))), pa.ListArray.from_arrays(pa.array(np.r_[first, len(of)].astype(np.int32)), pa.array((at - own[of]).astype(np.int32)))],
                    ["id", "of", "words", "seeds", "at"],
                )

    rows = docs.select(*row_key(id_col, text_col), spaced(F.col(text_col).cast("string"), unspaced).alias("text"))
    hits, hits_path = written(rows.mapInArrow(probe, "id long, of long, words binary, seeds array<long>, at array<int>"), "seed-hits")
    each = hits.select("id", "of", F.explode(F.arrays_zip("seeds", "at")).alias("h")).select("id", "of", F.col("h.seeds").alias("seed"), F.col("h.at").alias("pos"))
    lined = each.join(item_seeds, "seed").select("id", "of", "item", (F.col("pos") - F.col("at")).alias("shift")).distinct()
    # the document's words that lie under the item, and where they begin in it
    part = hits.select("id", "of", "words").distinct().join(lined.join(items.select("item", "n", F.col("words").alias("own")), "item"), ["id", "of"])
    cut = part.select("id", "of", "item", "shift", "own", F.greatest(-F.col("shift"), F.lit(0)).alias("skip"), F.expr("substring(words, 8 * greatest(shift, 0) + 1, cast(8 * (n - greatest(-shift, 0)) as int))").alias("under"))

    def verify(batches):
        for batch in batches:
            out = []
            for i, of, item, shift, own, skip, under in zip(*(batch.column(c).to_pylist() for c in ("id", "of", "item", "shift", "own", "skip", "under")), strict=True):
                a, b = np.frombuffer(own, np.uint64), np.frombuffer(under, np.uint64)
                same = np.zeros(len(a), np.int64)
                same[skip : skip + len(b)] = a[skip : skip + len(b)] == b
                w = min(WINDOW, len(a))
                total = np.r_[0, np.cumsum(same)]
                good = np.flatnonzero(100 * (total[w:] - total[:-w]) >= AGREE_PERCENT * w)
                if len(good):
                    lo, hi = int(good[0]), int(good[-1]) + w
                    out.append((i, of, item, max(shift + lo, 0), hi - lo, int(total[hi] - total[lo])))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(6)], ["id", "of", "item", "start", "words", "agree"])

    best = cut.mapInArrow(verify, "id long, of long, item long, start long, words long, agree long").groupBy("id", "of", "item").agg(F.max(F.struct("agree", -F.col("start"), "start", "words")).alias("s"))
    found, _ = written(best.select("id", "of", "item", "s.start", "s.words", "s.agree"), "overlaps")
    drop_path(docs.sparkSession, items_path, seeds_path, hits_path)
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs with `contaminated` and `items` (ids of the items found, ascending; of equal item texts the smallest id).

    Words are runs of letters and digits in lower case (A-Z), and single Kana and Han
    characters if an item has any. Every row stays, with
    its columns (own columns of those names, whatever their case, are replaced). A
    null or empty text has no overlap; rows of equal id and text agree; null ids
    are allowed. Items with a null id or text, or of under LEAST_WORDS words, are
    not searched for; an empty benchmark contaminates nothing; an empty table of
    documents stays empty.
    """
    found = overlaps(docs, benchmark, id_col, text_col, item_id, item_text).groupBy(F.col("id").alias("__id"), F.col("of").alias("__of")).agg(F.sort_array(F.collect_set("item")).alias("items"))
    name, of = row_key(id_col, text_col)
    rows = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("contaminated", "items")), name.alias("__id"), of.alias("__of"))
    out = rows.join(found, ["__id", "__of"], "left")
    return out.withColumn("contaminated", F.col("items").isNotNull()).withColumn("items", F.coalesce("items", F.array().cast("array<bigint>"))).drop("__id", "__of")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id", "contaminated", F.size("items").alias("n_items"), "items")
