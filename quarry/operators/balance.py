"""Sequences dealt to bins of about equal sums. Within one batch the work is sequential, so each batch is one group of an Arrow-backed call."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def differencing(sizes: list[int], bins: int, equal: bool = False) -> list[list[int]]:
    """Indices by bin: largest differencing. Partial partitions with the widest spread are merged first, the fullest bin of one with the emptiest of the other; equal: as many members in each bin."""
    order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
    if equal:
        if len(sizes) % bins:
            raise ValueError(f"{len(sizes)} sequences don't make {bins} bins of one size")
        starts = [[(sizes[i], [i]) for i in order[a : a + bins]] for a in range(0, len(order), bins)]
    else:
        starts = [[(sizes[i], [i])] + [(0, [])] * (bins - 1) for i in order]
    heap = []
    for n, parts in enumerate(starts):
        parts = sorted(parts, key=lambda p: -p[0])
        heapq.heappush(heap, (parts[-1][0] - parts[0][0], n, parts))
    n = len(starts)
    while len(heap) > 1:
        (_, _, a), (_, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        parts = sorted(((x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b), strict=True)), key=lambda p: -p[0])
        heapq.heappush(heap, (parts[-1][0] - parts[0][0], n, parts))
        n += 1
    return [sorted(p[1]) for p in heap[0][2]] if heap else [[] for _ in range(bins)]


def greedy(sizes: list[int], bins: int, equal: bool = False) -> list[list[int]]:
    """In the order given, each to the bin with the least so far, of equal ones the first; equal: as many members in each bin, as a member outweighs all sizes."""
    bias = sum(sizes) + 1 if equal else 0
    heap, out = [(0, b) for b in range(bins)], [[] for _ in range(bins)]
    for i, n in enumerate(sizes):
        least, b = heap[0]
        out[b].append(i)
        heapq.heapreplace(heap, (least + n + bias, b))
    if equal and len({len(p) for p in out}) > 1:
        raise ValueError(f"{len(sizes)} sequences don't make {bins} bins of one size")
    return out


def checked(parts: list[list[int]], n: int) -> list[list[int]]:
    """parts, if each has a member and all n are dealt out once; else an error."""
    if n < len(parts):
        raise ValueError(f"{n} sequences are fewer than {len(parts)} bins")
    if not all(parts) or sorted(i for p in parts for i in p) != list(range(n)):
        raise ValueError("a bin is empty, or a sequence isn't dealt out once")
    return parts


def balanced(df: DataFrame, batch: str, size: str, key: str, bins: int, how: str = "differencing", equal: bool = False, cap: int | None = None) -> DataFrame:
    """(batch, key, size, bin); with cap, as many bins as the batch's sum needs under it. A batch is what one step trains on: it is dealt out in one task, and must have a sequence for each bin."""

    def deal(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(key).reset_index(drop=True)
        sizes = [int(x) for x in rows[size]]
        k = max(1, -(-sum(sizes) // cap)) if cap else bins
        parts = checked((differencing if how == "differencing" else greedy)(sizes, k, equal), len(sizes))
        rows["bin"] = 0
        for b, members in enumerate(parts):
            rows.loc[members, "bin"] = b
        return rows[[batch, key, size, "bin"]]

    kinds = dict(df.dtypes)
    return df.select(batch, key, size).groupBy(batch).applyInPandas(deal, f"{batch} {kinds[batch]}, {key} {kinds[key]}, {size} {kinds[size]}, bin long")


def imbalance(df: DataFrame, batch: str, size: str, bin_: str, key: str, bins: int) -> DataFrame:
    """Of each batch the least and largest sum of a bin and their mean, balanced and as the rows come: in the order of key, an equal number of rows a bin."""
    place = F.row_number().over(Window.partitionBy(batch).orderBy(key)) - 1
    n = F.count("*").over(Window.partitionBy(batch))
    plain = df.withColumn("__plain", F.floor(place * bins / n))
    least_and_most = lambda c, *names: plain.groupBy(batch, c).agg(F.sum(size).alias("n")).groupBy(batch).agg(F.min("n").alias(names[0]), F.max("n").alias(names[1]), F.avg("n").alias("mean"))
    both = least_and_most("__plain", "least", "largest").drop("mean").join(least_and_most(bin_, "balanced_least", "balanced_largest"), batch)
    return both.withColumn("spread", F.col("largest") - F.col("least"))
