"""Removal of repeated byte strings across documents, by suffix order.

A byte goes if it lies in a string of `width` bytes that also starts in a
document with a smaller id. Three passes, each over buckets of bounded size:

1. Each window of `width` bytes has an anchor (anchors.py). An anchor whose whole
   context also lies in a smaller document is settled: all its windows go. A task
   settles what it can and sends those windows straight to their documents; of
   each context only the anchors of its smallest document there go on, dealt out
   by their gram's hash, in packed columns, and are settled in the bucket against
   those of other tasks. Grams in one document only are done. What remains are
   contexts at the edges of repeats: grams in several documents with different
   contexts.
2. Those contexts' bytes are fetched from the texts and dealt out by gram.
   Windows whose hash no other document shares are cut off, and the rest is put
   in suffix order (suffix_groups.py); neighbours that agree in `width` bytes,
   compared byte by byte, are one string, and its smallest document keeps it.
3. Settled windows and those of pass 2 meet the texts again and are cut out.

Equal windows have equal grams, so a bucket decides alone. A gram of any
frequency adds to its bucket the anchors of one document for each context and
batch of about 4 MB of text, not those of every document that has it. Each pass
goes in turns (TURNS), pass 1 by gram and the others by document, so the disk holds
the shuffle files of one turn; texts are read, and anchors found, once a turn.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import spans
from quarry.llm.anchors import anchors
from quarry.llm.common import drop_path, wide, written
from quarry.llm.suffix_groups import suffix_array

LAST_ID = 2**63 - 1
#: Bytes put in suffix order at once; grams are not split, so a gram's contexts may exceed it.
BLOCK = 1 << 15
#: Grams, and then documents, are dealt out in so many turns: one turn's shuffle files are gone before the next.
TURNS = 3
#: Kinds of packed columns: document, row key, first window, windows; then the gram. SENT: gram, context (48 bits), first window, windows; ids and keys of the senders; for each anchor 1 if the next sender's begin, and 2 if its gram was in several documents of the task.
#: An anchor's number of windows is under `width`, at most 255; 32 bits of the gram, its bucket and 48 bits of the context name a context.
MARKS = (np.int64, np.int64, np.uint32, np.uint32)
ASKED = (*MARKS, np.uint32)
SENT = (np.uint32, np.uint32, np.uint16, np.uint32, np.uint8, np.int64, np.int64, np.uint8)


def packed(*columns: np.ndarray) -> bytes:
    return np.array([len(c) for c in columns], np.int64).tobytes() + b"".join(c.tobytes() for c in columns)


def unpacked(data: bytes, kinds) -> list[np.ndarray]:
    sizes, at, out = np.frombuffer(data, np.int64, len(kinds)), 8 * len(kinds), []
    for n, kind in zip(sizes, kinds, strict=True):
        out.append(np.frombuffer(data, kind, n, at))
        at += int(n) * np.dtype(kind).itemsize
    return out


def gathered(blobs, kinds) -> list[np.ndarray]:
    parts = [unpacked(b, kinds) for b in blobs]
    return [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, k) for i, k in enumerate(kinds)]


def dealt(numbers: np.ndarray, buckets: int) -> np.ndarray:
    return (spans.mix(numbers.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def send(target: np.ndarray, kind: int, columns: list[np.ndarray], extra=None):
    """Packed rows (bucket, kind, data): the entries of each target bucket together."""
    order = np.argsort(target, kind="stable")
    ends = np.flatnonzero(np.r_[target[order][1:] != target[order][:-1], True]) + 1 if len(order) else []
    a, out = 0, []
    for b in ends:
        mine = order[a:b]
        out.append((int(target[mine[0]]), kind, packed(*(c[mine] for c in columns), *(extra(mine) if extra else ()))))
        a = b
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.binary())], ["bucket", "kind", "data"])


ROWS = "bucket long, kind int, data binary"
SETTLED, ASK = 1, 2


def find_anchors(rows: DataFrame, width: int, buckets: int, turns: int = 1, turn: int = 0) -> DataFrame:
    """Settled windows by bucket of their document, and other anchors by bucket of their gram: the sending documents' ids and row keys, the anchors' columns, and whether the gram was in several documents. Of several turns, those of one's grams."""

    def run(parts):
        for part in parts:
            for i, j in spans.batches(part.column("text")):
                x = part.slice(i, j - i)
                doc, key = x.column("id").to_numpy(), x.column("of").to_numpy()
                text, first, last, _, gram, context = long_safe(x.column("text"), width)
                if turns > 1:
                    mine = (gram >> np.uint64(36)) % np.uint64(turns) == turn
                    text, first, last, gram, context = (c[mine] for c in (text, first, last, gram, context))
                if not len(text):
                    continue
                # the smallest document of each context in this batch speaks for it, the others' are settled
                order = np.lexsort((doc[text], context, gram))
                new_gram = np.r_[True, gram[order][1:] != gram[order][:-1]]
                new = new_gram | np.r_[True, context[order][1:] != context[order][:-1]]
                low = doc[text[order[np.flatnonzero(new)]]][np.cumsum(new) - 1]
                settled = np.zeros(len(text), bool)
                settled[order] = doc[text[order]] > low
                heads = np.flatnonzero(new_gram)
                several = np.zeros(len(text), np.uint8)
                several[order] = (np.minimum.reduceat(doc[text[order]], heads) != np.maximum.reduceat(doc[text[order]], heads))[np.cumsum(new_gram) - 1]
                many = last - first + 1
                at = np.flatnonzero(settled)
                if len(at):
                    yield send(dealt(doc[text[at]], buckets), SETTLED, [doc[text[at]], key[text[at]], first[at].astype(np.uint32), many[at].astype(np.uint32)])
                text, first, many, gram, context, several = (c[~settled] for c in (text, first, many, gram, context, several))

                def who(mine):
                    own = text[mine]  # ascending
                    new = np.r_[True, own[1:] != own[:-1]]
                    return doc[own[new]], key[own[new]], (new + 2 * several[mine]).astype(np.uint8)

                yield send(dealt(gram, buckets), 0, [gram.astype(np.uint32), context.astype(np.uint32), (context >> np.uint64(32)).astype(np.uint16), first.astype(np.uint32), many.astype(np.uint8)], who)

    return rows.mapInArrow(run, ROWS)


def long_safe(texts: pa.Array, width: int):
    """anchors() of a batch, with places counted from each text's start; a text beyond anchors()'s limit is cut into overlapping parts."""
    data, at = spans.flat(texts)
    if len(data) < (1 << 24):
        text, first, last, a, gram, context = anchors(data, at, width)
        return text, first - at[text], last - at[text], a, gram, context
    out, step = [], (1 << 23)
    for t in range(len(at) - 1):
        for s in range(int(at[t]), max(int(at[t]) + 1, int(at[t + 1]) - width + 1), step):
            own = data[s : min(s + step + width - 1, at[t + 1])]
            text, first, last, a, gram, context = anchors(own, np.array([0, len(own)]), width)
            out.append((text + t, first + s - at[t], last + s - at[t], a, gram, context))
    return tuple(np.concatenate([o[k] for o in out]) for k in range(6))


def settle(found: DataFrame, buckets: int) -> DataFrame:
    """Of each bucket of anchors: settled windows, and contexts to fetch, by bucket of their document."""

    def run(table: pa.Table) -> pa.Table:
        schema = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("data", pa.binary())])
        is_settled = table.column("kind").to_numpy() == SETTLED
        through = table.filter(pa.array(is_settled)).select(["bucket", "kind", "data"]).cast(schema)
        blobs = table.filter(pa.array(~is_settled)).column("data").to_pylist()
        if not blobs:
            return through
        cols: list[list] = [[] for _ in range(7)]
        for blob in blobs:
            gram, low, high, first, many, ids, keys, step = unpacked(blob, SENT)
            who = np.cumsum(step & 1) - 1
            context = low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32))
            for col, v in zip(cols, (gram, context, first, many.astype(np.uint32), step >> 1, ids[who], keys[who]), strict=True):
                col.append(v)
        gram, context, first, many, seen, doc, key = (np.concatenate(c) for c in cols)
        order = np.lexsort((doc, context, gram))
        gram, context, first, many, seen, doc, key = (c[order] for c in (gram, context, first, many, seen, doc, key))
        new_gram = np.r_[True, gram[1:] != gram[:-1]]
        new = new_gram | np.r_[True, context[1:] != context[:-1]]
        heads, grams = np.flatnonzero(new), np.flatnonzero(new_gram)
        of_gram, of_class = np.cumsum(new_gram) - 1, np.cumsum(new) - 1
        shared = ((np.minimum.reduceat(doc, grams) != np.maximum.reduceat(doc, grams)) | (np.maximum.reduceat(seen, grams) > 0))[of_gram]
        several = (np.add.reduceat(new.astype(np.int64), grams) > 1)[of_gram]
        settled = doc > doc[heads][of_class]
        # the smallest document of a context may have it at several places; each is asked for, as each may go
        ask = shared & several & ~settled
        out = []
        for pick, kind, extra in ((settled, SETTLED, ()), (ask, ASK, (gram,))):
            at = np.flatnonzero(pick)
            if len(at):
                out.append(send(dealt(doc[at], buckets), kind, [c[at] for c in (doc, key, first, many, *extra)]))
        return pa.concat_tables([through, pa.Table.from_batches(out, schema)])

    return found.groupBy("bucket").applyInArrow(run, ROWS)


def beside_texts(rows: DataFrame, marks: DataFrame, handle, schema: str, buckets: int, turns: int = 1, turn: int = 0) -> DataFrame:
    """handle(marks' blobs of a bucket, its texts as record batches) over all buckets, or those of a turn: both are dealt out by document and marks sorted before texts."""
    spark = rows.sparkSession

    def number(parts):
        for part in parts:
            to = dealt(part.column("id").to_numpy(), buckets)
            if turns > 1:
                mine = to % turns == turn
                to, part = to[mine], part.filter(pa.array(mine))
            yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(np.full(part.num_rows, 9, np.int32)), pa.nulls(part.num_rows, pa.binary()), part.column("id"), part.column("of"), part.column("raw"), part.column("text")], ["bucket", "kind", "data", "id", "of", "raw", "text"])

    texts = rows.select("id", "of", "raw", "text").mapInArrow(number, ROWS + ", id long, of long, raw long, text string")
    both = marks.where(F.pmod("bucket", F.lit(turns)) == turn).select("bucket", "kind", "data", *(F.lit(None).cast(t).alias(c) for c, t in (("id", "long"), ("of", "long"), ("raw", "long"), ("text", "string")))).unionByName(texts)
    both = both.repartition(wide(spark), "bucket").sortWithinPartitions("bucket", "kind")

    def run(parts):
        bucket, blobs = None, []
        for part in parts:
            number, kind = part.column("bucket").to_numpy(), part.column("kind").to_numpy()
            cuts = np.flatnonzero(np.r_[True, (number[1:] != number[:-1]) | ((kind[1:] == 9) != (kind[:-1] == 9))])
            for a, b in zip(cuts, np.r_[cuts[1:], len(number)], strict=True):
                if number[a] != bucket:
                    bucket, blobs = number[a], []
                if kind[a] != 9:
                    blobs += zip(kind[a:b].tolist(), part.column("data").slice(a, b - a).to_pylist(), strict=True)
                else:
                    yield from handle(blobs, part.slice(a, b - a))

    return both.mapInArrow(run, schema)


def fetch(rows: DataFrame, marks: DataFrame, width: int, buckets: int, turns: int = 1, turn: int = 0) -> DataFrame:
    """The bytes of the contexts asked for, by bucket of their gram; of several turns, those in one's documents."""

    def handle(blobs, texts):
        doc, key, first, many, gram = gathered([b for k, b in blobs if k == ASK], ASKED)
        order = np.lexsort((key, doc))
        doc, key, first, many, gram = (c[order] for c in (doc, key, first, many, gram))
        for i, j in spans.batches(texts.column("text")):
            x = texts.slice(i, j - i)
            data, at = spans.flat(x.column("text"))
            picks, places = [], []
            for t, (d, k) in enumerate(zip(x.column("id").to_numpy(), x.column("of").to_numpy(), strict=True)):
                a, b = np.searchsorted(doc, d, "left"), np.searchsorted(doc, d, "right")
                mine = a + np.flatnonzero(key[a:b] == k)
                picks.append(mine)
                places.append(at[t] + first[mine].astype(np.int64))
            picks, places = np.concatenate(picks), np.concatenate(places)
            if len(picks):
                size = many[picks].astype(np.int64) + width - 1
                raw = lambda mine: (data[np.repeat(places[mine] - np.r_[0, np.cumsum(size[mine])[:-1]], size[mine]) + np.arange(size[mine].sum())],)
                yield send(dealt(gram[picks], buckets), 0, [c[picks] for c in (doc, key, first, many, gram)], raw)

    return beside_texts(rows, marks.where(F.col("kind") == ASK), handle, ROWS, buckets, turns, turn)


def decide(contexts: DataFrame, width: int, buckets: int) -> DataFrame:
    """Windows of contexts whose string also lies in a smaller document, by bucket of their document."""

    def shared_windows(data: np.ndarray, own: np.ndarray, doc: np.ndarray):
        """(context, first, last window) of contexts that share a window, by hash, with another document."""
        n = len(data) - width + 1
        ok = np.arange(n) + width <= np.repeat(own[1:], np.diff(own))[:n]
        at = np.flatnonzero(ok)
        h = spans.hashes(spans.prefix_sums(data), at, at + width)
        which = np.searchsorted(own, at, "right") - 1
        order = np.lexsort((doc[which], h))
        h2, d2 = h[order], doc[which[order]]
        heads = np.flatnonzero(np.r_[True, h2[1:] != h2[:-1]])
        many = (np.minimum.reduceat(d2, heads) != np.maximum.reduceat(d2, heads))[np.cumsum(np.r_[True, h2[1:] != h2[:-1]]) - 1]
        keep = np.zeros(len(at), bool)
        keep[order] = many
        at, which = at[keep], which[keep]
        some, a = np.unique(which, return_index=True)
        return some, at[a] - own[some], at[np.r_[a[1:], len(at)] - 1] - own[some]

    def sorted_out(data: np.ndarray, own: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Whether each place of data begins a window that a smaller document has too."""
        symbols = np.ones(len(data) + len(own), np.int64)
        to = np.arange(len(data)) + np.repeat(np.arange(len(own) - 1), np.diff(own))
        symbols[to], symbols[-1] = data.astype(np.int64) + 2, 0
        back = np.full(len(symbols), -1)
        back[to] = np.arange(len(data))
        order = back[np.array(suffix_array(symbols))]
        order = order[order >= 0]
        which = np.searchsorted(own, order, "right") - 1
        fits = order + width <= own[which + 1]
        order, which = order[fits], which[fits]
        out = np.zeros(len(data), bool)
        if len(order):
            views = np.lib.stride_tricks.sliding_window_view(data, width)
            new = np.r_[True, (views[order[1:]] != views[order[:-1]]).any(1)]
            low = np.minimum.reduceat(doc[which], np.flatnonzero(new))[np.cumsum(new) - 1]
            out[order] = doc[which] > low
        return out

    def run(table: pa.Table) -> pa.Table:
        doc, key, first, many, gram, data = gathered(table.column("data").to_pylist(), (*ASKED, np.uint8))
        size = many.astype(np.int64) + width - 1
        own = np.r_[0, np.cumsum(size)]
        some, lo, hi = shared_windows(data, own, doc)
        some_order = np.argsort(gram[some], kind="stable")
        some, lo, hi = some[some_order], lo[some_order], hi[some_order]
        doc, key, gram, start, from_ = doc[some], key[some], gram[some], first[some].astype(np.int64) + lo, own[some] + lo
        size = hi - lo + width
        found: list[tuple] = []
        # of equal contexts those of larger documents are covered whole; only the smallest document's are put in suffix order
        heads: dict[bytes, int] = {}
        same = np.array([heads.setdefault(data[p : p + n].tobytes(), len(heads)) for p, n in zip(from_.tolist(), size.tolist(), strict=True)], np.int64)
        least = np.full(len(heads), LAST_ID, np.int64)
        np.minimum.at(least, same, doc)
        copy = doc > least[same]
        del heads
        if copy.any():
            found.append((doc[copy], key[copy], start[copy].astype(np.uint32), (size[copy] - width + 1).astype(np.uint32)))
            doc, key, gram, start, from_, size = (c[~copy] for c in (doc, key, gram, start, from_, size))
        ends = np.cumsum(size)
        a = 0
        while a < len(doc):
            b = int(np.searchsorted(ends, (ends[a - 1] if a else 0) + BLOCK, "right"))
            b = max(a + 1, b)
            while b < len(doc) and gram[b] == gram[b - 1]:
                b += 1
            cut = np.r_[0, np.cumsum(size[a:b])]
            bytes_ = data[np.repeat(from_[a:b] - cut[:-1], size[a:b]) + np.arange(cut[-1])]
            gone = sorted_out(bytes_, cut, doc[a:b])
            at = np.flatnonzero(gone)
            if len(at):
                c = np.searchsorted(cut, at, "right") - 1
                runs = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (c[1:] != c[:-1])])
                c, length = c[runs], np.diff(np.r_[runs, len(at)])
                found.append((doc[a:b][c], key[a:b][c], (start[a:b][c] + at[runs] - cut[c]).astype(np.uint32), length.astype(np.uint32)))
            a = b
        schema = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("data", pa.binary())])
        if not found:
            return schema.empty_table()
        cols = [np.concatenate([f[i] for f in found]) for i in range(4)]
        return pa.Table.from_batches([send(dealt(cols[0], buckets), SETTLED, cols)], schema)

    return contexts.groupBy("bucket").applyInArrow(run, ROWS)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50, with_text: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of each row; with_text adds `kept_bytes`.

    Texts are UTF-8 bytes, a null text has none. Rows of equal id don't match each
    other; rows of null id come after all others and don't match each other. Texts
    shorter than width stay whole; an empty table gives no rows; other columns are
    left out. What is left of a text may begin or end within a character.
    """
    spark = docs.sparkSession
    buckets = wide(spark, 16)
    kind = dict(docs.dtypes)[id_col]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    raw = F.col(id_col).cast("long")
    rows = docs.select(F.coalesce(raw, F.lit(LAST_ID)).alias("id"), F.xxhash64(text).alias("of"), raw.alias("raw"), text.alias("text"))

    def in_turns(one, what: str) -> tuple[DataFrame, list[str]]:
        tables = [written(one(TURNS, turn), what) for turn in range(TURNS)]
        return reduce(DataFrame.unionByName, (table for table, _ in tables)), [path for _, path in tables]

    marks, marks_paths = in_turns(lambda n, i: settle(find_anchors(rows, width, buckets, n, i), buckets), "anchor-marks")
    contexts, contexts_paths = in_turns(lambda n, i: fetch(rows, marks, width, buckets, n, i), "contexts")
    more, more_path = written(decide(contexts, width, buckets), "suffix-marks")
    drop_path(spark, *contexts_paths)

    def handle(blobs, texts):
        doc, key, first, many = gathered([b for _, b in blobs], MARKS)
        order = np.argsort(doc, kind="stable")
        doc, key, first, many = (c[order] for c in (doc, key, first, many))
        for i, j in spans.batches(texts.column("text")):
            x, out = texts.slice(i, j - i), []
            data, at = spans.flat(x.column("text"))
            for t, (d, k) in enumerate(zip(x.column("id").to_numpy(), x.column("of").to_numpy(), strict=True)):
                own = data[at[t] : at[t + 1]]
                a, b = np.searchsorted(doc, d, "left"), np.searchsorted(doc, d, "right")
                mine = a + np.flatnonzero(key[a:b] == k)
                if not len(mine):
                    out.append((len(own), 0, 0, own.tobytes()))
                    continue
                step = np.zeros(len(own) + 1, np.int64)
                np.add.at(step, first[mine].astype(np.int64), 1)
                np.add.at(step, first[mine].astype(np.int64) + many[mine] + width - 1, -1)
                gone = np.cumsum(step[:-1]) > 0
                out.append((len(own), int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum()), own[~gone].tobytes()))
            cols = [x.column("raw"), *(pa.array([o[n] for o in out], pa.int64()) for n in range(3)), pa.array([hashlib.sha256(o[3]).hexdigest() for o in out])]
            names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                cols, names = [*cols, pa.array([o[3] for o in out], pa.binary())], [*names, "kept_bytes"]
            yield pa.RecordBatch.from_arrays(cols, names)

    done = marks.where(F.col("kind") == SETTLED).unionByName(more)
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_bytes binary" * with_text
    if with_text:  # a table of the texts would be as large as their shuffle files
        out = beside_texts(rows, done, handle, schema, buckets)
    else:
        out, _ = in_turns(lambda n, i: beside_texts(rows, done, handle, schema, buckets, n, i), "cut")
        drop_path(spark, *marks_paths, more_path)
    return out.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
