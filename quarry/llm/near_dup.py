"""MinHash near-duplicate groups: one-permutation hashing, banded buckets, star-shaped candidates.

A document's set of k-word shingles is hashed once; the hash's leading bits
choose a bin, the smallest hash in a bin is the bin's value (one-permutation
hashing). An empty bin takes the value of a bin drawn for (bin, attempt), the
same for every document (optimal densification). Bins in groups of `rows` make
the banded buckets: two sets of similarity s share one of b buckets with
probability 1 - (1 - s**rows)**b, for 0.8 and 32 bands of 4 all but 5e-8.
Documents of equal sets collapse first. Within buckets candidates form stars
and are confirmed on full sets (common.star_components), so pairs stay linear
in the rows and no confirmed link between different sets is lost. What a star
leaves open is first compared by marks: each shingle flips one of MARK_BITS
bits, so two sets differ in at least as many shingles as their marks in bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import spans
from quarry.llm.common import drop_path, star_components, written

ATTEMPTS = 64
MARK_BITS = 1024


def densified(values: np.ndarray, empty: np.ndarray) -> np.ndarray:
    """values: sets by bins; empty bins take the value of the first filled bin of their own sequence of draws."""
    bins = values.shape[1]
    draws = (spans.mix(np.arange(bins * ATTEMPTS, dtype=np.uint64)) % np.uint64(bins)).astype(np.int64).reshape(ATTEMPTS, bins)
    out, left = values.copy(), empty.copy()
    for t in range(ATTEMPTS):
        if not left.any():
            return out
        r, c = np.nonzero(left)
        source = draws[t, c]
        ok = ~empty[r, source]
        out[r[ok], c[ok]] = values[r[ok], source[ok]]
        left[r[ok], c[ok]] = False
    for r in np.flatnonzero(left.any(axis=1)):  # the rare rest: the next filled bin
        filled = np.flatnonzero(~empty[r])
        c = np.flatnonzero(left[r])
        out[r, c] = values[r, filled[np.searchsorted(filled, c) % len(filled)]]
    return out


def signatures(texts: pa.Array, k: int, bands: int, rows: int):
    """Per text: set size, two sums that name the set, its mark, banded bucket hashes (none for an empty set)."""
    bins = bands * rows
    marks = np.zeros((len(texts), MARK_BITS // 8), np.uint8)
    n, first, second = (np.zeros(len(texts), np.int64), np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.uint64))
    values, empty = np.zeros((len(texts), bins), np.uint64), np.ones((len(texts), bins), bool)
    for i, x in enumerate(spans.shingle_sets(texts, k)):
        n[i] = len(x)
        if not len(x):
            continue
        first[i], second[i] = x.sum(), spans.mix(x ^ np.uint64(0x5BD1E995)).sum()
        marks[i] = np.packbits((np.bincount((x % np.uint64(MARK_BITS)).astype(np.int64), minlength=MARK_BITS) & 1).astype(np.uint8))
        which = ((x >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)  # rises with x
        at = np.flatnonzero(np.r_[True, which[1:] != which[:-1]])
        values[i, which[at]], empty[i, which[at]] = x[at], False
    some = n > 0
    keys = np.zeros((len(texts), bands), np.uint64)
    if some.any():
        full = densified(values[some], empty[some]).reshape(-1, bands, rows)
        h = np.broadcast_to(spans.mix(np.arange(bands, dtype=np.uint64)), full.shape[:2])
        for j in range(rows):
            h = spans.mix(h * spans.P + full[:, :, j])
        keys[some] = h
    return n, first, second, marks.view(np.int64), keys, some


def close(percent: int):
    """close() of star_components: false where the sizes, or the bits in which two marks differ, rule out 100 * common >= percent * union."""

    def test(a, b):
        bits = [F.bit_count(F.get(a["bits"], F.lit(i)).bitwiseXOR(F.get(b["bits"], F.lit(i)))) for i in range(MARK_BITS // 64)]
        most = (a["n"] + b["n"]) * (100 - percent)  # (total - apart) * 100 >= (total + apart) * percent
        return (F.abs(a["n"] - b["n"]) * (100 + percent) <= most) & (sum(bits[1:], bits[0]) * F.lit(100 + percent) <= most)

    return test


def confirmer(candidates: DataFrame, k: int, percent: int):
    """confirm() of star_components: pairs of candidates (id, text) whose full sets have 100 * common >= percent * union."""

    def check(parts):
        for part in parts:
            a, b = (part.column(c).dictionary_encode() for c in ("ta", "tb"))
            sets = [list(spans.shingle_sets(x.dictionary, k)) for x in (a, b)]
            keep = []
            for i, j in zip(a.indices.to_numpy(), b.indices.to_numpy(), strict=True):
                x, y = sets[0][i], sets[1][j]
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    keep.append(False)
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def confirm(pairs: DataFrame) -> DataFrame:
        both = pairs.join(candidates.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").join(candidates.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
        return both.select("a", "b", "ta", "tb").mapInArrow(check, "a long, b long")

    return confirm


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, bands: int = 32, rows: int = 4) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row: the group of near-duplicates under similarity percent / 100 of k-word shingle sets.

    Words are runs without white space, A-Z in lower case. Fewer than k words: the
    whole sequence is the one shingle. Null, empty or blank texts have n_shingles
    0 and are linked with nothing. Equal ids are one document with the links of
    all its rows; each row is returned. A null id takes part in nothing:
    component_id null, kept true. Empty table: no rows. Other columns are left
    out. component_id is the smallest id of the group, kept marks that id.
    """
    spark = docs.sparkSession
    rows_in = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def sign(parts):
        for part in parts:
            for i, j in spans.batches(part.column("text")):
                x = part.slice(i, j - i)
                n, first, second, marks, keys, some = signatures(x.column("text"), k, bands, rows)
                offsets = np.r_[0, np.cumsum(some * bands)].astype(np.int32)
                yield pa.RecordBatch.from_arrays([x.column("id"), pa.array(n), pa.array(first.view(np.int64)), pa.array(second.view(np.int64)), pa.ListArray.from_arrays(pa.array(np.arange(0, marks.size + 1, MARK_BITS // 64, dtype=np.int32)), pa.array(marks.reshape(-1))), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[some].reshape(-1).view(np.int64)))], ["id", "n", "k1", "k2", "bits", "bands"])

    signed, _ = written(rows_in.mapInArrow(sign, "id long, n long, k1 long, k2 long, bits array<long>, bands array<long>"), "near-signed")
    whole = signed.where("id is not null and n > 0")
    heads = whole.groupBy("n", "k1", "k2").agg(F.min("id").alias("head"))
    copies, copies_path = written(whole.select("id", "n", "k1", "k2").join(heads, ["n", "k1", "k2"]).select("id", "head"), "near-copies")
    chosen = copies.where("id = head").select("id").distinct()
    # a repeated id has one row of buckets for each of its sets
    members = whole.join(chosen, "id").select(F.explode("bands").alias("bucket"), "id").distinct() if copies.groupBy("id").count().where("count > 1").limit(1).count() else whole.join(chosen, "id").select(F.explode("bands").alias("bucket"), "id")
    tables = []

    def prepare(ids: DataFrame):
        found, path = written(rows_in.join(ids, "id"), "near-texts")
        tables.append(path)
        return confirmer(found, k, percent)

    same = copies.where("id <> head").select(F.col("id").alias("a"), F.col("head").alias("b")).distinct()
    marks = whole.join(chosen, "id").select("id", F.struct("n", "bits").alias("mark")).distinct()
    comp = star_components(members, marks, close(percent), prepare, "near", same)
    drop_path(spark, copies_path, *tables)
    out = signed.select("id", "n").join(comp, "id", "left")
    group = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), group.alias("component_id"), F.coalesce(F.col("id") == group, F.lit(True)).alias("kept"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, k=2, percent=80)
