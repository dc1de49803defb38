"""A content-addressed store of token ids.

Layout, below one path:

segments/   Parquet, in ascending id order. A row is a run of documents of about
            2 MB of text: their ids and lengths, the place of its first token
            (`start`), the digests of the chunks it refers to, for each document
            the chunks in order (recipe), and the payload of the chunks that the
            segment owns. A chunk that several segments refer to is owned by the
            first of them; `owners` tells the others where it is.
manifest/   one row for each writing task (its segments, tokens, and the hash of
            its segments' Merkle roots) in order; `root` of the store is the hash
            of those.

A document's ids are cut where a rolling hash of the last eight ids is 0 modulo
256, so equal passages give equal chunks wherever they stand. A segment's
Merkle root is over the chunk digests in recipe order and the documents'
lengths. Readers check digests and roots while they rebuild documents, and the
manifest before: its rows against its own root, and the segments that are there,
with their counts and roots, against each row. So a segment that is lost, changed
or stands in for another is seen.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import spans
from quarry.llm.common import drop_path, frequent, join_spread, new_path, written
from quarry.llm.tokens import Encoder

WINDOW, MEAN, LONGEST = 8, 256, 2048
DIGEST = 16
STAGED = "segment long, docs array<{kind}>, tokens array<long>, counts array<int>, recipe array<int>, digests array<binary>, sizes array<int>, payload binary"
INFO = "start long, found array<struct<digest:binary,owner:long>>"
MANIFEST = "task long, segments long, docs long, tokens long, hash string, root string"
SEGMENTS = STAGED + ", start long, owners array<long>, shared array<boolean>, root binary"


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary tree of hashes; an odd node moves up as it is."""
    level = [digest(b"\0" + x) for x in leaves] or [digest(b"")]
    while len(level) > 1:
        level = [digest(b"\1" + level[i] + level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def segment_root(digests: list[bytes], recipe, counts, tokens) -> bytes:
    return merkle([*(digests[i] for i in recipe), *(f"{c},{t}".encode() for c, t in zip(counts, tokens, strict=True))])


def cuts(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Ends of the chunks of documents whose ids lie one after the other, from at[i] to at[i + 1]; none is empty."""
    n = len(ids)
    ends = at[1:]
    if n > WINDOW:
        up, down = spans.powers(n + 1)
        sums = np.r_[np.uint64(0), np.cumsum((ids.astype(np.uint64) + np.uint64(1)) * up[:n])]
        h = spans.mix((sums[WINDOW:] - sums[:-WINDOW]) * down[: n - WINDOW + 1])
        hit = np.flatnonzero(h & np.uint64(MEAN - 1) == 0)  # MEAN is a power of two
        of = np.searchsorted(at, hit, "right") - 1
        inside = (of < len(at) - 1) & (hit + WINDOW < at[np.minimum(of + 1, len(at) - 1)])
        ends = np.sort(np.r_[hit[inside] + WINDOW, ends])
    starts = np.r_[0, ends[:-1]]
    if n and (ends - starts).max() > LONGEST:
        ends = np.concatenate([np.r_[np.arange(a + LONGEST, b, LONGEST), b] for a, b in zip(starts, ends, strict=True)])
    return ends


def stage(docs: DataFrame, encoder: Encoder, end_id: int, kind: str) -> DataFrame:
    def encoded(part):
        """Slices of 2 MB, their ids and where each document's begin; encoded 8 MB at once, as words repeat."""
        for i, j in spans.batches(part.column("text"), 8 << 20):
            x = part.slice(i, j - i)
            ids, at = encoder.encode_flat(x.column("text"))
            for k, m in spans.batches(x.column("text"), 2 << 20):
                yield x.slice(k, m - k), ids[at[k] : at[m]], at[k : m + 1] - at[k]

    def run(parts):
        task, seq = TaskContext.get().partitionId(), 0
        pack = zstandard.ZstdCompressor(level=1)
        for part in parts:
            for x, ids, at in encoded(part):
                where: dict[bytes, int] = {}
                recipe, sizes, payload = [], [], []
                # the end id after each document
                ids, at = np.insert(ids, at[1:], end_id).astype("<u4", copy=False), at + np.arange(len(at))
                ends, data, a = cuts(ids, at), memoryview(ids.tobytes()), 0
                tokens, counts = np.diff(at), np.diff(np.searchsorted(ends, at, "right"))
                for b in ends.tolist():
                    own = data[4 * a : 4 * b]
                    key = digest(own)
                    if key not in where:
                        where[key] = len(where)
                        sizes.append(b - a)
                        payload.append(own)
                    recipe.append(where[key])
                    a = b
                one = lambda v, t: pa.array([v], pa.list_(t))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([(task << 32) + seq]), pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x.column("id")), one(tokens, pa.int64()), one(counts, pa.int32()), one(recipe, pa.int32()), one(list(where), pa.binary()), one(sizes, pa.int32()), pa.array([pack.compress(b"".join(payload))], pa.binary())],
                    ["segment", "docs", "tokens", "counts", "recipe", "digests", "sizes", "payload"],
                )
                seq += 1

    return docs.mapInArrow(run, STAGED.format(kind=kind))


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the ids of all rows of docs, each followed by end_id, in ascending id order; null ids come first, rows of equal ids in the order of a hash of their text.

    A null or empty text is a document of end_id alone. Every row is kept, repeated ones too (their chunks are stored once); an empty table gives a store without segments. Other columns are left out.
    """
    spark, kind = docs.sparkSession, dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    dealt = rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    staged, staged_path = written(stage(dealt, Encoder(tokenizer, added=True), end_id, kind), "staged")
    # places: totals by task are as many as tasks; within a task by a window over its segments
    totals = staged.select("segment", F.aggregate("tokens", F.lit(0).cast("long"), lambda a, v: a + v).alias("n"), F.shiftright("segment", 32).alias("task"))
    by_task = sorted((r["task"], r["n"]) for r in totals.groupBy("task").agg(F.sum("n").alias("n")).collect())
    base, at = [], 0
    for task, n in by_task:
        base.append((task, at))
        at += n
    tasks = spark.createDataFrame(base, "task long, base long")
    starts = totals.join(tasks, "task").select("segment", (F.col("base") + F.sum("n").over(Window.partitionBy("task").orderBy("segment")) - F.col("n")).alias("start"))
    refs = staged.select("segment", F.explode("digests").alias("digest"))
    owner = refs.groupBy("digest").agg(F.min("segment").alias("owner"), F.count("*").alias("n")).where("n > 1").select("digest", "owner")
    found = refs.join(owner, "digest").groupBy("segment").agg(F.collect_list(F.struct("digest", "owner")).alias("found"))
    info, info_path = written(starts.join(found, "segment", "left"), "store-info")
    names = [x.split()[0] for x in STAGED.split(", ")]
    both = staged.select(*names, F.lit(None).cast("long").alias("start"), F.lit(None).cast("array<struct<digest:binary,owner:long>>").alias("found")).unionByName(info, allowMissingColumns=True)
    dealt = both.repartitionByRange("segment").sortWithinPartitions("segment", F.col("start").isNull())

    def settle(parts):
        last, pack, unpack = None, zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        for part in parts:
            for r in range(part.num_rows):
                row = {n: part.column(n)[r] for n in part.schema.names}
                if row["payload"].as_py() is None:
                    last = row
                    continue
                segment = row["segment"].as_py()
                assert last is not None and last["segment"].as_py() == segment
                owner_of = {x["digest"]: x["owner"] for x in last["found"].as_py() or []}
                digests, sizes = row["digests"].as_py(), row["sizes"].as_py()
                payload = row["payload"].as_py()
                if any(owner_of.get(d, segment) != segment for d in digests):
                    data, own, at = unpack.decompress(payload), [], 0
                    for d, n in zip(digests, sizes, strict=True):
                        if owner_of.get(d, segment) == segment:
                            own.append(data[4 * at : 4 * (at + n)])
                        at += n
                    payload = pack.compress(b"".join(own))
                one = lambda v, t: pa.array([v], pa.list_(t))
                cols = {n: part.column(n).slice(r, 1) for n in names if n != "payload"}
                cols |= {"payload": pa.array([payload], pa.binary()), "start": pa.array([last["start"].as_py()], pa.int64())}
                cols |= {"owners": one([owner_of.get(d, segment) for d in digests], pa.int64()), "shared": one([d in owner_of for d in digests], pa.bool_()), "root": pa.array([segment_root(digests, row["recipe"].as_py(), row["counts"].as_py(), row["tokens"].as_py())], pa.binary())}
                yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    dealt.mapInArrow(settle, SEGMENTS.format(kind=kind)).write.option("compression", "zstd").parquet(f"{path}/segments")
    parts = sorted(tuple(r) for r in summary(spark, path).collect())
    spark.createDataFrame([(*p, root_of(parts)) for p in parts], MANIFEST).coalesce(1).write.parquet(f"{path}/manifest")
    drop_path(spark, staged_path, info_path)


def summary(spark: SparkSession, path: str) -> DataFrame:
    """A row for each writing task: its segments, documents, tokens and the hash of its segments' roots, from the segments themselves."""
    tokens = F.aggregate("tokens", F.lit(0).cast("long"), lambda a, v: a + v)
    rows = spark.read.parquet(f"{path}/segments").select(F.shiftright("segment", 32).alias("task"), "segment", "root", F.size("docs").alias("docs"), tokens.alias("tokens"))
    hashed = F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("segment", "root"))), lambda s: F.hex(s["root"]))), 256)
    return rows.groupBy("task").agg(F.count("*").alias("segments"), F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"), hashed.alias("hash"))


def root_of(parts: list[tuple]) -> str:
    """The root of a store, over the sorted rows of its manifest."""
    return hashlib.sha256("".join(f"{task},{segments},{docs},{tokens},{hashed};" for task, segments, docs, tokens, hashed in parts).encode()).hexdigest()


def check_manifest(spark: SparkSession, path: str) -> None:
    """An error if the store isn't what its manifest says. Both have a row for each writing task."""
    told = sorted(tuple(r) for r in spark.read.schema(MANIFEST).parquet(f"{path}/manifest").collect())
    rows = [t[:-1] for t in told]
    if any(t[-1] != root_of(rows) for t in told):
        raise ValueError("the manifest isn't what was stored")
    if rows != sorted(tuple(r) for r in summary(spark, path).collect()):
        raise ValueError("the segments aren't those of the manifest")


def opened(row: dict) -> dict[bytes, bytes]:
    """The chunks that a segment row owns, checked against their digests."""
    data, at, out = zstandard.ZstdDecompressor().decompress(row["payload"]), 0, {}
    for d, n, owner in zip(row["digests"], row["sizes"], row["owners"], strict=True):
        if owner == row["segment"]:
            out[d] = data[at : at + 4 * n]
            if digest(out[d]) != d:
                raise ValueError(f"a chunk of segment {row['segment']} isn't what was stored")
            at += 4 * n
    return out


def rebuilt(row: dict):
    """(number in its segment, place, recipe digests, owners) of each document of a segment row; checks the Merkle root."""
    if segment_root(row["digests"], row["recipe"], row["counts"], row["tokens"]) != row["root"]:
        raise ValueError(f"the recipes of segment {row['segment']} aren't what was stored")
    at, place = 0, row["start"]
    for k, (c, t) in enumerate(zip(row["counts"], row["tokens"], strict=True)):
        refs = row["recipe"][at : at + c]
        yield k, place, [row["digests"][i] for i in refs], [row["owners"][i] for i in refs]
        at += c
        place += t


def read_store(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(id, start, n_tokens, ids_crc32 and, if asked for, ids: unsigned 32-bit little-endian) of every document, rebuilt from the files; an error at once if they aren't those of the manifest.

    Documents whose chunks lie in their own segment are rebuilt where they are
    read; only those that refer to other segments' chunks meet them by a join.
    """
    check_manifest(spark, path)
    segments = spark.read.parquet(f"{path}/segments")
    kind = dict(segments.dtypes)["docs"].removeprefix("array<").removesuffix(">")
    needs = ["segment", "docs", "tokens", "counts", "recipe", "digests", "sizes", "owners", "shared", "payload", "start", "root"]
    arrow = segments.limit(0).select(F.col("docs")).toArrow().schema.field("docs").type.value_type
    extra = ["ids"] if with_ids else []
    schema = f"id {kind}, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def done(rows):
        cols = [pa.array([r[0] for r in rows], arrow), *(pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2, 3))]
        if with_ids:
            cols.append(pa.array([r[4] for r in rows], pa.binary()))
        return pa.RecordBatch.from_arrays(cols, ["id", "start", "n_tokens", "ids_crc32", *extra])

    def told(doc, place, ids):
        return (doc, place, len(ids) // 4, zlib.crc32(ids), ids)

    def local(parts):
        for part in parts:
            for row in part.to_pylist():
                own = opened(row)
                yield done([told(row["docs"][k], place, b"".join(own[d] for d in refs)) for k, place, refs, owners in rebuilt(row) if all(o == row["segment"] for o in owners)])

    def scattered(parts):
        for part in parts:
            for row in part.to_pylist():
                if all(o == row["segment"] for o in row["owners"]):
                    continue
                own = opened(row)
                out = [(row["docs"][k], place, n, d, own.get(d)) for k, place, refs, owners in rebuilt(row) if any(o != row["segment"] for o in owners) for n, d in enumerate(refs)]
                types = (arrow, pa.int64(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], ["id", "start", "n", "digest", "own"])

    def shared(parts):
        for part in parts:
            for row in part.to_pylist():
                asked = {d for d, s in zip(row["digests"], row["shared"], strict=True) if s}
                if asked:
                    out = [(d, x) for d, x in opened(row).items() if d in asked]
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.binary()) for i in (0, 1)], ["digest", "chunk"])

    def joined(parts):
        for part in parts:
            rows = []
            for r in part.to_pylist():
                pieces = [x["chunk"] for x in sorted(r["pieces"], key=lambda x: x["n"])]
                if any(x["chunk"] is None or digest(x["chunk"]) != x["digest"] for x in r["pieces"]):
                    raise ValueError("a chunk of another segment isn't what was stored")
                rows.append(told(r["id"], r["start"], b"".join(pieces)))
            yield done(rows)

    segments = segments.select(*needs)
    first = segments.mapInArrow(local, schema)
    parts = segments.mapInArrow(scattered, f"id {kind}, start long, n int, digest binary, own binary")
    lent = segments.mapInArrow(shared, "digest binary, chunk binary")
    # a chunk that very many recipes refer to is sent to them, the others are met by exchange
    refs = segments.where(F.exists("owners", lambda o: o != F.col("segment"))).select(F.explode(F.transform("recipe", lambda i: F.get("digests", i))).alias("digest"))
    hot = frequent(refs.groupBy("digest").agg(F.count("*").alias("n")), "digest", "n")
    met = join_spread(parts.where("own is null").drop("own"), lent, "digest", hot).select("id", "start", "n", "digest", "chunk").unionByName(parts.where("own is not null").withColumnRenamed("own", "chunk"))
    rest = met.groupBy("id", "start").agg(F.collect_list(F.struct("n", "digest", "chunk")).alias("pieces")).mapInArrow(joined, schema)
    return first.unionByName(rest)


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "store")
    write_store(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_store(spark, path).withColumnRenamed("id", "doc_id")
