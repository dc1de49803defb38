"""Best-fit packing of documents into sequences of bounded length, in bulk-synchronous steps.

Documents longer than a sequence are cut; every piece is then an item. Pieces of
one length made by neighbouring tasks are a run: (length, group of tasks, first,
count); sequences of one number after the other with equal room left are a run of
gaps. Steps work on runs, as rows of a table, and rows of pieces are read again
only at the end, when they are joined with where their runs went.

A step sorts the runs of items and of gaps by size into slices, ranges of sizes
with a bounded number of rows each, and sweeps every slice by itself: items, largest first,
go to their successors, the smallest gaps that hold them. Items that found none
in their slice are ranked, and so are the gaps left over; from a row for each
slice, ranks of items are matched with ranks of gaps in the nearest slices above,
so that no two claim one gap, and a second sweep lays them there. Gaps are
updated and the next step begins. Where no gap holds what is left, sequences are
opened: one for each item over half a sequence, else as many as the lengths add
up to. Nothing but a row for each slice and each size comes to the driver.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import spans
from quarry.llm.common import drop_path, written
from quarry.llm.tokens import Encoder

#: Pre-tokens kept by a worker and bytes of text taken at once: two workers share an executor with its JVM.
MOST_CACHED, TEXTS_AT_ONCE = 400_000, 512 << 10
PIECES = "{id} {kind}, piece int, start long, length long, ids_crc32 long{ids}"


#: Kinds of rows: a run of items (size: its length, a: its group of tasks), of gaps (size: room, a: first sequence), and where a run went.
ITEM, GAP, PLACED = 0, 1, 2
STATE = "kind int, size long, a long, first long, count long, sequence long, offset long, each long"
STEP = STATE + ", slice int, rank long"
#: Rows of runs in a slice, and tasks in a group.
SLICE_ROWS, TASKS = 20_000, 256


def best_fit(items: list[tuple], gaps: list[tuple], capacity: int) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """Runs of items (length, task, first, count), the largest first, into the smallest of the gaps (room, first sequence, count) that hold them.

    Returns where they went, the items left and the gaps left. Where they went:
    (length, task, first, count, sequence, offset, each): item first + j of the run
    lies in sequence + j // each, at offset + j % each * length.
    """
    free, placed, left = sorted(gaps), [], []
    for n, task, first, count in sorted(items, reverse=True):
        i = bisect_left(free, (n, -1, 0))
        while count and i < len(free):
            room, sequence, have = free.pop(i)
            each = room // n
            use = min(count, have * each)
            full, rest = divmod(use, each)
            placed.append((n, task, first, use, sequence, capacity - room, each))
            for size, at, many in ((room - each * n, sequence, full), (room - rest * n, sequence + full, rest > 0), (room, sequence + full + (rest > 0), have - full - (rest > 0))):
                if size and many:
                    insort(free, (size, at, int(many)))
            first, count = first + use, count - use
            i = bisect_left(free, (n, -1, 0))
        if count:
            left.append((n, task, first, count))
    return placed, left, free


def to_open(count: int, over_half: int, total: int, capacity: int) -> int:
    """How many sequences to open for items that no gap holds: no more than they need."""
    return over_half or (-(-total // capacity) if count else 0)


def sweep(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(length, first rank, count, first sequence, offset) of all items, and the number of sequences: the steps over one slice, for few items."""
    items, gaps, out, sequences = [(n, 0, 0, c) for n, c in counts.items() if c > 0], [], [], 0
    while items:
        placed, items, gaps = best_fit(items, gaps, capacity)
        out += [(n, first + j, 1, sequence + j // each, offset + j % each * n) for n, _, first, c, sequence, offset, each in placed for j in range(c)]
        more = to_open(len(items), sum(c for n, _, _, c in items if 2 * n > capacity), sum(n * c for n, _, _, c in items), capacity)
        if more:
            gaps.append((capacity, sequences, more))
            sequences += more
    return out, sequences


def rows_of(table: pa.Table | pa.RecordBatch) -> tuple[list[tuple], list[tuple]]:
    """Items and gaps of a table of STATE rows."""
    kind, size, a, first, count = (table.column(c).to_pylist() for c in ("kind", "size", "a", "first", "count"))
    return [(size[i], a[i], first[i], count[i]) for i, k in enumerate(kind) if k == ITEM], [(size[i], a[i], count[i]) for i, k in enumerate(kind) if k == GAP]


def state_of(placed: list[tuple], items: list[tuple], gaps: list[tuple], piece: int = 0) -> pa.RecordBatch:
    """STEP rows. Items are ranked from the largest down, gaps from the smallest up, by single items and gaps."""
    rows = [(PLACED, n, t, f, c, s, o, e, piece, 0) for n, t, f, c, s, o, e in placed]
    rank = 0
    for n, t, f, c in sorted(items, reverse=True):
        rows.append((ITEM, n, t, f, c, 0, 0, 0, piece, rank))
        rank += c
    rank = 0
    for g, s, c in sorted(gaps):
        rows.append((GAP, g, s, 0, c, 0, 0, 0, piece, rank))
        rank += c
    names = [x.split()[0] for x in STEP.split(", ")]
    kinds = [pa.int32() if x.endswith("int") else pa.int64() for x in STEP.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def claims(slices: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(slice, first rank, items, slice of gaps, first rank, gaps): which of a slice's items meet which gaps above, each gap once.

    slices: (number, items, largest item, gaps, smallest gap) in ascending order of size. Sweeps from the top down; the nearest gaps go first.
    """
    out, stack = [], []
    for number, items, largest, gaps, smallest in reversed(slices):
        rank = 0
        while items and stack:
            q, room, have, at = stack[-1]
            each = room // largest
            if not each:
                break
            use = min(items, have * each)
            taken = -(-use // each)
            out.append((number, rank, use, q, at, taken))
            rank, items, have, at = rank + use, items - use, have - taken, at + taken
            stack[-1] = (q, room, have, at)
            if not have:
                stack.pop()
        if gaps:
            stack.append((number, smallest, gaps, 0))
    return out


def slices_of(rows: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(size, first slice, slices) for (size, rows) in ascending order of size: slices rise with size and have about SLICE_ROWS rows; a size of more rows has several."""
    out, at, have = [], 0, 0
    for size, n in rows:
        if have and have + n > SLICE_ROWS:
            at, have = at + 1, 0
        many = -(-n // SLICE_ROWS)
        out.append((size, at, many))
        have += n
        if many > 1:
            at, have = at + many, 0
    return out


def swept(state: DataFrame, capacity: int) -> DataFrame:
    """A step's first half: every slice by itself. STEP rows."""
    sizes = sorted((r["size"], r["count"]) for r in state.groupBy("size").count().collect())  # at most capacity rows
    cut = state.sparkSession.createDataFrame(slices_of(sizes), "size long, low int, many int")
    dealt = state.join(F.broadcast(cut), "size").withColumn("slice", (F.col("low") + F.pmod(F.xxhash64("a", "first"), F.col("many"))).cast("int"))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([state_of(*best_fit(*rows_of(table), capacity), key[0].as_py())])

    return dealt.select("slice", "kind", "size", "a", "first", "count").groupBy("slice").applyInArrow(run, STEP)


def settled(step: DataFrame, claimed: list[tuple], capacity: int) -> DataFrame:
    """A step's second half: items that claimed gaps above meet them. STATE rows."""
    of_items: dict[int, list] = {}
    of_gaps: dict[int, list] = {}
    for i, (p, rank, use, q, at, taken) in enumerate(claimed):
        of_items.setdefault(p, []).append((rank, rank + use, i))
        of_gaps.setdefault(q, []).append((at, at + taken, i))

    def route(batches):
        for batch in batches:
            out = []
            for kind, size, a, first, count, piece, rank in zip(*(batch.column(c).to_pylist() for c in ("kind", "size", "a", "first", "count", "slice", "rank")), strict=True):
                spans_, done = (of_items if kind == ITEM else of_gaps).get(piece, []), 0
                # a run is cut where another claim begins; what nobody claims goes on by itself
                for lo, hi, i in spans_[max(0, bisect_left(spans_, (rank + 1,)) - 1) :]:
                    if lo >= rank + count:
                        break
                    s, e = max(lo, rank + done), min(hi, rank + count)
                    if s >= e:
                        continue
                    if s > rank + done:
                        out.append((kind, size, a + (done if kind == GAP else 0), first + (done if kind == ITEM else 0), s - rank - done, -1))
                    out.append((kind, size, a + (s - rank if kind == GAP else 0), first + (s - rank if kind == ITEM else 0), e - s, i))
                    done = e - rank
                if done < count:
                    out.append((kind, size, a + (done if kind == GAP else 0), first + (done if kind == ITEM else 0), count - done, -1))
            names = ["kind", "size", "a", "first", "count", "claim"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int32() if i == 0 else pa.int64()) for i in range(6)], names)

    def meet(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([state_of(*best_fit(*rows_of(table), capacity))]).drop_columns(["slice", "rank"])

    routed = step.where(F.col("kind") != PLACED).mapInArrow(route, "kind int, size long, a long, first long, count long, claim long")
    alone = routed.where("claim < 0").select("kind", "size", "a", "first", "count", *(F.lit(0).cast("long").alias(c) for c in ("sequence", "offset", "each")))
    return alone.unionByName(routed.where("claim >= 0").groupBy("claim").applyInArrow(meet, STATE))


def matched(items: DataFrame, capacity: int) -> list[DataFrame]:
    """Tables of STATE rows, whose PLACED rows tell where every run of items (STATE rows too) went."""
    spark, tables, sequences = items.sparkSession, [], 0
    state, path = written(items, "pack-items")
    path = [path]
    while True:
        step, _ = written(swept(state, capacity), "pack-step")
        drop_path(spark, *path)
        item, gap = F.col("kind") == ITEM, F.col("kind") == GAP
        of_kind = lambda c, f: F.coalesce(F.sum(F.when(c, f)), F.lit(0))
        told = step.groupBy("slice").agg(of_kind(item, F.col("count")).alias("items"), F.max(F.when(item, F.col("size"))).alias("largest"), of_kind(gap, F.col("count")).alias("gaps"), F.min(F.when(gap, F.col("size"))).alias("smallest"), of_kind(item & (2 * F.col("size") > capacity), F.col("count")).alias("over"), of_kind(item, F.col("count") * F.col("size")).alias("total"))
        slices = sorted(tuple(r) for r in told.collect())
        tables.append(step)
        if not any(s[1] for s in slices):
            return tables
        claimed = claims([s[:5] for s in slices])
        rest = step.where(~(F.col("kind") == PLACED)).select(*(x.split()[0] for x in STATE.split(", ")))
        if claimed:
            state, _ = written(settled(step, claimed, capacity), "pack-state")
            tables.append(state)
            state, path = state.where(F.col("kind") != PLACED), []  # where runs went is needed to the end
        else:
            more = to_open(1, sum(s[5] for s in slices), sum(s[6] for s in slices), capacity)
            opened = spark.createDataFrame([(GAP, capacity, sequences, 0, more, 0, 0, 0)], STATE)
            sequences += more
            state, path = rest.unionByName(opened), []


def pieces_of(docs: DataFrame, encoder: Encoder, end_id: int, capacity: int, id_col: str, text_col: str, keep_ids: bool) -> DataFrame:
    """Pieces of all rows, with the task that made them and their rank among its pieces of that length."""
    kind = dict(docs.dtypes)[id_col]

    def run(parts):
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for part in parts:
            for i, j in spans.batches(part.column("text"), TEXTS_AT_ONCE):
                x = part.slice(i, j - i)
                rows, end = ([], [], [], [], [], [], []), np.array([end_id], "<u4").tobytes()
                for d, ids in enumerate(encoder.encode(x.column("text").to_pylist())):
                    ids += end
                    for p, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        n = len(own) // 4
                        for col, v in zip(rows, (d, p, at // 4, n, zlib.crc32(own), seen[n], own), strict=True):
                            col.append(v)
                        seen[n] += 1
                cols = [x.column("id").take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()), *(pa.array(c, pa.int64()) for c in rows[2:5])]
                names = [id_col, "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    cols, names = [*cols, pa.array(rows[6], pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(np.full(len(rows[0]), task)), pa.array(rows[5], pa.int64())], [*names, "task", "local"])

    schema = PIECES.format(id=f"`{id_col}`", kind=kind, ids=", ids binary" if keep_ids else "") + ", task long, local long"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) for each piece of each row; ids too if asked for.

    A row's ids are those of its text (null: none) and end_id, so an empty text is
    a piece of one id. Only rows of more than `capacity` ids are cut. Repeated
    rows and null ids are rows like any other; an empty table gives no rows;
    other columns are left out. Sequences are numbered from 0 and filled from
    offset 0 without holes.
    """
    made, _ = written(pieces_of(docs, Encoder(tokenizer, MOST_CACHED, added=True), end_id, capacity, id_col, text_col, keep_ids), "pieces")
    zero = lambda *names: [F.lit(0).cast("long").alias(c) for c in names]
    per, _ = written(made.groupBy("length", "task").agg(F.count("*").alias("n")).withColumn("a", F.floor(F.col("task") / TASKS)), "piece-counts")
    runs = per.groupBy(F.col("length").alias("size"), "a").agg(F.sum("n").alias("count"))
    tables = matched(runs.select(F.lit(ITEM).alias("kind"), "size", "a", *zero("first"), "count", *zero("sequence", "offset", "each")), capacity)
    where = reduce(DataFrame.unionByName, [t.where(F.col("kind") == PLACED).select(F.col("size").alias("length"), "a", "first", "count", "sequence", F.col("offset").alias("at"), "each") for t in tables])
    # a task's pieces of a length lie one after the other in the run of its group
    based = per.withColumn("base", F.sum("n").over(Window.partitionBy("length", "a").orderBy("task")) - F.col("n"))
    low, high = F.greatest("first", "base"), F.least(F.col("first") + F.col("count"), F.col("base") + F.col("n"))
    own = based.join(where, ["length", "a"]).where(low < high).select("length", "task", (low - F.col("base")).alias("low"), (high - F.col("base")).alias("high"), (F.col("base") - F.col("first")).alias("shift"), "sequence", "at", "each")
    names = [c for c in made.columns if c not in ("task", "local")]
    both = made.join(own, ["length", "task"]).where((F.col("local") >= F.col("low")) & (F.col("local") < F.col("high")))
    j = F.col("local") + F.col("shift")
    return both.select(*(f"`{n}`" for n in names), (F.col("sequence") + F.floor(j / F.col("each"))).cast("long").alias("sequence_id"), (F.col("at") + j % F.col("each") * F.col("length")).cast("long").alias("offset"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
