"""Language by compression: the dictionary under which a text compresses best names its language.

Each language's dictionary is raw text of a bounded sample of labelled rows,
used by zstandard as content to refer back to. A text is cut into blocks of
bytes, every block is compressed under every dictionary, and the smallest total
wins. The margin to the second smallest, per byte, is the evidence; documents
whose margin is narrow are rejected.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bounds of the fitted model: labelled rows read to the driver for each language, dictionary bytes, languages. Rows of up to USUAL characters are taken before longer ones.
ROWS_A_LANGUAGE, USUAL, DICTIONARY_BYTES, MOST_LANGUAGES = 200, 4000, 96 << 10, 200
BLOCK = 1024
#: Short matches carry the evidence, so four bytes match and the search looks at a few candidates.
SEARCH = {"window_log": 18, "hash_log": 16, "chain_log": 16, "search_log": 2, "min_match": 4, "target_length": 8, "strategy": zstandard.STRATEGY_GREEDY, "write_content_size": 0, "write_checksum": 0, "write_dict_id": 0}
APART = re.compile(r"[\W\d_]+")
#: Bytes saved for each byte of text (at least), and bytes saved in all, below which a margin is narrow.
NARROW_SHARE, NARROW_BYTES = 0.001, 1


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; null keys count as an empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def labelled_sample(rows: DataFrame, label: str, key: list[str], per_label: int, most_labels: int, payload: list[Column]) -> list:
    """At most per_label rows, of different keys, of each of the most_labels commonest labels, by the order of a hash of key; labels counted over all rows.

    Keys are thinned by hash before anything is sorted and copies of a key fall together within tasks, so a label or a key of any size costs one pass; the result is bounded by per_label * most_labels rows.
    """
    order = F.xxhash64(*key)
    counts = rows.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"), F.approx_count_distinct(order).alias("keys")).orderBy(F.desc("n"), label).limit(most_labels).collect()
    if not counts:
        return []
    shares = F.create_map(*(F.lit(x) for r in counts for x in (r[label], min(1.0, 1.5 * per_label / max(1, r["keys"])))))
    thin = rows.select(label, order.alias("__at"), *payload).where((F.shiftrightunsigned("__at", 11).cast("double") / 2.0**53) < F.try_element_at(shares, F.col(label)))
    once = thin.dropDuplicates([label, "__at"]).withColumn("__n", F.row_number().over(Window.partitionBy(label).orderBy("__at"))).where(F.col("__n") <= per_label)
    return sorted(once.collect(), key=lambda r: (str(r[label]), r["__n"]))


def plain(text: str) -> bytes:
    """The letters of a text in lower case, words apart by one space."""
    return (" " + APART.sub(" ", text.lower())).encode()


class Dictionaries:
    """Fitted dictionaries by language; small enough for a task's closure."""

    def __init__(self, content: dict[str, bytes]):
        self.content, self._tools = content, None

    def __getstate__(self):
        return {"content": self.content, "_tools": None}

    @classmethod
    def fit(cls, rows: DataFrame, text: str = "text", lang: str = "lang") -> Dictionaries:
        """rows: labelled rows; null labels and empty texts teach nothing. Whole texts of the sample are laid one after the other until a dictionary is full; one that is longer than that fills it alone."""
        rows = rows.select(F.col(text).alias("t"), F.col(lang).cast("string").alias("l")).where("t <> ''")
        got: dict[str, bytearray] = {}
        for some in (rows.where(F.length("t") <= USUAL), rows.where(F.length("t") > USUAL)):
            per = max(1, DICTIONARY_BYTES // USUAL) if got else ROWS_A_LANGUAGE
            for r in labelled_sample(some, "l", ["t"], per, MOST_LANGUAGES, [F.substring("t", 1, DICTIONARY_BYTES).alias("t")]):
                kept = got.setdefault(r["l"], bytearray())
                if len(kept) < DICTIONARY_BYTES:
                    kept += plain(r["t"])
        names = sorted(got)[:MOST_LANGUAGES]
        return cls({k: bytes(got[k][:DICTIONARY_BYTES]) for k in names})

    def sizes(self, blocks: list[bytes]) -> np.ndarray:
        """Compressed bytes of blocks (rows) under each language (columns)."""
        if self._tools is None:
            self._tools = []
            for x in self.content.values():
                d = zstandard.ZstdCompressionDict(x, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                how = zstandard.ZstdCompressionParameters(**SEARCH)
                d.precompute_compress(compression_params=how)
                self._tools.append(zstandard.ZstdCompressor(dict_data=d, compression_params=how))
        return np.array([[len(c.compress(b)) for c in self._tools] for b in blocks], np.int64).reshape(len(blocks), len(self.content))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language or und, score, rejected) of a text, all of it."""
        if not text or not self.content or not any(map(str.isalpha, text)):
            return "und", 0.0, True
        data = plain(text)
        total = self.sizes([data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]).sum(0)
        order = np.argsort(total, kind="stable")
        names = list(self.content)
        if len(names) == 1:
            return names[0], 1.0, False
        margin = int(total[order[1]] - total[order[0]])
        weight = np.exp2(-np.minimum((total - total[order[0]]) * 0.5, 200))
        return names[order[0]], float(weight[order[0]] / weight.sum()), margin < max(NARROW_BYTES, math.ceil(NARROW_SHARE * len(data)))


def identify(docs: DataFrame, model: Dictionaries, text_col: str = "text", prefix: str = "") -> DataFrame:
    """docs and <prefix>lang_pred, <prefix>score, <prefix>rejected; columns of docs of those names (whatever their case) are replaced.

    lang_pred: a learned language, `und` (score 0, rejected) for a null text, one without a letter, or a model that has learned nothing.
    Equal sizes: the first language in alphabetical order, rejected. Each row is judged alone, so repeated rows agree; an empty table stays empty.
    """
    new = [f"{prefix}lang_pred", f"{prefix}score", f"{prefix}rejected"]
    kept = [f for f in docs.schema.fields if f.name.lower() not in new]
    names = [f.name for f in kept]
    # texts are the bulk of a batch: they are sent once, and only one at a time is a Python string
    sent = text_col if text_col in names and docs.schema[text_col].dataType.simpleString() == "string" else "__text"

    def run(parts):
        for part in parts:
            out = [model.predict(x.as_py()) for x in part.column(sent)]
            pa.default_memory_pool().release_unused()
            lang, score, rejected = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], [*names, *new])

    schema = docs.select(*(F.col(f"`{n}`") for n in names)).schema
    for n, kind in zip(new, ("string", "double", "boolean"), strict=True):
        schema = schema.add(n, kind)
    own = [] if sent == text_col else [F.col(text_col).cast("string").alias("__text")]
    return docs.select(*(F.col(f"`{n}`") for n in names), *own).mapInArrow(run, schema)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fold = crc_mod(F.col("doc_id"), 4)
    model = Dictionaries.fit(docs.where((fold != 2) & F.col("lang").isNotNull()))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold == 2).alias("held_out"), "lang_pred", "score", "rejected")
