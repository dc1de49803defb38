"""Exact nearest neighbours by cosine: blocks of queries meet slices of rows as matrices, and few rows a query leave a task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Queries and rows that meet at once, queries that are multiplied at once.
BLOCK, SLICE, TILE = 2048, 16384, 128
#: A matrix product differs from the sum in order by less than this; places are told apart at 9 decimals.
MARGIN = 1e-8
#: Stands for a null similarity (below any) and for one that isn't a number (above any).
NULL, NAN = -2.0, 2.0


def _vectors(table: pa.Table, id_: str, vector: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids in ascending order, their vectors as doubles (zeros for null) and which are null."""
    table = table.sort_by(id_)
    lists = table.column(vector).combine_chunks()
    null = lists.is_null().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), int(lists.value_lengths().drop_null()[0].as_py()) if not null.all() else 0))
    out[~null] = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(int((~null).sum()), -1)
    return table.column(id_).to_numpy(), out, null


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each pair of rows, summed in order."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


def _best(asked: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """(query_id, vec_id, c): of these rows all that can be among a query's k nearest; of rows equally near the k smallest ids."""
    ask, v, ask_null = _vectors(asked, "query_id", "v")
    ids, e, null = _vectors(rows, "vec_id", "embedding")
    width = max(v.shape[1], e.shape[1])  # 0 where all are null
    v, e = (x if x.shape[1] else np.zeros((len(x), width)) for x in (v, e))
    found = []
    with np.errstate(divide="ignore", invalid="ignore"):
        unit = lambda x: x / np.sqrt((x * x).sum(1))[:, None]
        whole, squares = unit(e).T, _dots(e, e)
        for a in range(0, len(ask), TILE):
            q = v[a : a + TILE]
            c = unit(q) @ whole
            c[np.isnan(c)] = NAN
            c[:, null] = NULL
            c[ask_null[a : a + TILE]] = NULL
            own = np.searchsorted(ids, ask[a : a + TILE])
            same = np.flatnonzero(ids[np.minimum(own, len(ids) - 1)] == ask[a : a + TILE])
            c[same, own[same]] = -np.inf
            least = np.partition(c, max(0, c.shape[1] - k), axis=1)[:, max(0, c.shape[1] - k)]
            i, j = np.nonzero((c >= np.maximum(least, NULL)[:, None] - MARGIN) & (c > -np.inf))
            exact = _dots(q[i], e[j]) / np.sqrt(_dots(q, q)[i] * squares[j])
            exact = np.where(ask_null[a + i] | null[j], NULL, np.where(np.isnan(exact), NAN, exact))
            order = np.lexsort((j, -exact, i))
            i, j, exact = i[order], j[order], exact[order]
            new = np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (exact[1:] != exact[:-1])][: len(i)])
            keep = np.arange(len(i)) - np.repeat(new, np.diff(np.r_[new, len(i)])) < k
            found.append((ask[a + i[keep]], ids[j[keep]], exact[keep]))
    return pa.table([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["query_id", "vec_id", "c"])


def candidates(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, c) with the k nearest rows of each query and few others: every query (query_id, v) against every row (vec_id, embedding) but its own.

    c is the cosine, summed in order; null where a vector is, NaN for a vector of zeros.
    Vectors have one length. A task holds BLOCK queries and SLICE rows.
    """
    blocks, slices = (max(1, -(-df.count() // size)) for df, size in ((queries, BLOCK), (rows, SLICE)))
    place = lambda id_, n: F.pmod(F.xxhash64(id_), F.lit(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select("query_id", "v", place("query_id", blocks).alias("block"), spread(slices).alias("slice"))
    dealt = rows.select("vec_id", "embedding", place("vec_id", slices).alias("slice"), spread(blocks).alias("block"))
    asked, dealt = (x.repartition(blocks * slices, "block", "slice").groupBy("block", "slice") for x in (asked, dealt))

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64())], ["query_id", "vec_id", "c"])
        return _best(a, b, k)

    got = asked.cogroup(dealt).applyInArrow(best, "query_id long, vec_id long, c double")
    return got.withColumn("c", F.when(F.col("c") == NAN, F.lit(float("nan"))).when(F.col("c") != NULL, F.col("c")))
