"""Importance resampling of a corpus towards a target distribution.

Features of a text are its words and its pairs of neighbouring words; each goes
to a bucket by CRC-32. Two passes over Arrow batches: the first counts buckets
with np.bincount, a vector a partition, and treeReduce merges the vectors. A
bucket's gain is the log of its target share over its corpus share. The second
pass gathers the gains, which are broadcast (a number a bucket), and sums them by
document with bincount's weights. Gumbel noise from a hash of the id makes the
highest scores a draw without replacement.

The order of all scores is a range exchange: a row's rank is its place in its
partition and the rows of the partitions before it.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import spans
from quarry.llm.common import drop_path, wide, written

BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 25, 7
#: Later bytes of a word are dealt with one word at a time.
LONG_WORD = 48
FULL = np.uint32(0xFFFFFFFF)


def _table() -> np.ndarray:
    """Steps of the reflected CRC-32 for each byte."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, np.uint32(0xEDB88320), np.uint32(0)) ^ (out >> np.uint32(1))
    return out


TABLE = _table()


def advanced(state: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32 registers after the bytes of each span, from the registers given."""
    order = np.argsort(-np.minimum(sizes, 255).astype(np.int16), kind="stable")
    now, at, size = state[order], starts[order], sizes[order]
    counts = np.cumsum(np.bincount(np.minimum(size, LONG_WORD + 1), minlength=LONG_WORD + 2)[::-1])[::-1]  # spans of so many bytes or more
    for j in range(LONG_WORD):
        n = counts[j + 1]
        if not n:
            break
        some = now[:n]
        now[:n] = TABLE[(some ^ data[at[:n] + j]) & np.uint32(255)] ^ (some >> np.uint32(8))
    for i in range(counts[LONG_WORD + 1]):
        now[i] = zlib.crc32(data[at[i] + LONG_WORD : at[i] + size[i]].tobytes(), int(now[i] ^ FULL)) ^ int(FULL)
    out = np.empty_like(now)
    out[order] = now
    return out


def features(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of words of each text, and of each feature its text's place and its bucket."""
    data, at = spans.flat(texts)
    data = spans.LOWER[data]
    starts, ends, own = spans.words(data, at, spans.PUNCT)
    n = np.diff(own)
    text = np.repeat(np.arange(len(n)), n)
    sizes = ends - starts
    one = advanced(np.full(len(starts), FULL), data, starts, sizes)
    first = np.flatnonzero(text[:-1] == text[1:]) if len(text) else np.zeros(0, np.int64)
    gap = one[first]
    gap = TABLE[(gap ^ np.uint32(0x20)) & np.uint32(255)] ^ (gap >> np.uint32(8))
    two = advanced(gap, data, starts[first + 1], sizes[first + 1])
    return n, np.concatenate([text, text[first]]), ((np.concatenate([one, two]) ^ FULL) % np.uint32(buckets)).astype(np.int64)


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def run(parts):
        total = np.zeros(buckets, np.int64)
        for part in parts:
            for i, j in spans.batches(part.column(0)):
                total += np.bincount(features(part.column(0).slice(i, j - i), buckets)[2], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    vectors = texts.select(F.col(text_col).cast("string")).mapInArrow(run, "counts binary").rdd
    if not vectors.getNumPartitions():
        return np.zeros(buckets, np.int64)
    return vectors.map(lambda r: np.frombuffer(r[0], np.int64)).treeReduce(lambda a, b: a + b)


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln(share in the target / share in the corpus)) of each bucket, one added to each count."""
    n, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * float(s_all + n) / ((s + 1) * float(t_all + n)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def noise(name: object, seed: int) -> int:
    """Gumbel noise in thousandths, from a hash of the seed and the id."""
    h = int(hashlib.sha256(f"{seed}:{'' if name is None else name}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, id_col: str, text_col: str, seed: int) -> DataFrame:
    """(id, n_words, n_features, weight, score) of each row."""
    sent, buckets = docs.sparkSession.sparkContext.broadcast(gain), len(gain)
    schema = docs.select(id_col).schema.add("n_words", "long").add("n_features", "long").add("weight", "long").add("score", "long")

    def run(parts):
        for part in parts:
            words, count, total = [], [], []
            for i, j in spans.batches(part.column("__text")):
                n, text, bucket = features(part.column("__text").slice(i, j - i), buckets)
                words.append(n)
                count.append(np.bincount(text, minlength=j - i))
                total.append(np.bincount(text, weights=sent.value[bucket], minlength=j - i).astype(np.int64))
            n_words, n, sums = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (words, count, total))
            weight = np.where(n > 0, sums // np.maximum(n, 1), 0)
            score = weight + np.array([noise(x, seed) for x in part.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, pa.int64()) for x in (n_words, n, weight, score))], schema.names)

    return docs.select(id_col, F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) of each row of docs; rank is null for rows that aren't drawn.

    Drawn are floor(percent * N / 100) rows of the N with least_words words or more:
    the highest scores, of equal ones the smaller id (a null id comes last). Null
    and empty texts have no features and weight 0. Repeated rows have equal scores
    and a rank each. An empty table gives an empty result, an empty target gains
    against a uniform distribution. Other columns of either table aren't read.
    """
    spark = docs.sparkSession
    gain = gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, target_col, buckets))
    rows, path = written(scored(docs, gain, id_col, text_col, seed), "resample-scores")
    able = F.col("n_words") >= least_words
    order = [F.col("score").desc(), F.col(id_col).asc_nulls_last(), "weight", "n_features"]
    place = F.monotonically_increasing_id()  # partition, then place in it
    sorted_ = rows.where(able).repartitionByRange(wide(spark), *order).sortWithinPartitions(*order)
    placed, placed_path = written(sorted_.select("*", F.shiftright(place, 33).alias("part"), place.bitwiseAND(F.lit(2**33 - 1)).alias("place")), "resample-order")
    sizes = sorted((r["part"], r["count"]) for r in placed.groupBy("part").count().collect())  # a row a partition
    before = list(itertools.accumulate((n for _, n in sizes), initial=0))
    starts = spark.createDataFrame([(part, at) for (part, _), at in zip(sizes, before, strict=False)], "part long, at long")
    rank = F.col("at") + F.col("place") + 1
    ranked = placed.join(F.broadcast(starts), "part").withColumn("rank", F.when(rank <= percent * before[-1] // 100, rank)).drop("part", "place", "at")
    out, _ = written(ranked.unionByName(rows.where(~able).withColumn("rank", F.lit(None).cast("long"))), "resample")
    drop_path(spark, path, placed_path)
    return out


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resample(docs.select("doc_id", "text"), target.select("text")).select("doc_id", "n_features", "weight", "score", "rank")
