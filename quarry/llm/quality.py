"""Quality rules: repetition within a document, and lines too frequent across the documents of a host.

DataFrame functions only. One pass over the texts makes a narrow table (counts,
hashes of lines); frequencies, limits and verdicts work on that table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import written

WHITE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: A line in more documents of a host than this is boilerplate; a document that keeps less than this percentage of its words is depleted.
MOST_DOCUMENTS, LEAST_LEFT_PERCENT = 25, 30
#: From here on the windows of a text are counted as rows instead of within one array.
LONG_TEXT_BYTES = 2 << 20


def let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def windows(w: Column) -> Column:
    return F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.array().cast("array<bigint>"))


def repeated_words(w: Column) -> Column:
    """Words of w that lie in a 3-word window found twice or more. Windows are sorted by hash, so equal ones are neighbours: a text of n words takes n log n steps, however much of it repeats."""
    again = lambda s: F.exists(F.sequence(F.lit(1), F.size(s) - 1), lambda i: F.get(s, i) == F.get(s, i - 1))
    placed = lambda t: F.sort_array(F.transform(t, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = lambda s: F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]))
    words = lambda s: F.size(F.array_distinct(F.flatten(F.transform(twice(s), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))
    return let(windows(w), lambda t: F.when(F.size(t) < 2, 0).when(let(F.sort_array(t), again), let(placed(t), words)).otherwise(0))


def line_key(line: Column) -> Column:
    return F.xxhash64(F.lower(F.btrim(line, F.lit(" \t\x0b\x0c\r"))))


def measured(rows: DataFrame, long_text: int, whole: bool) -> DataFrame:
    """rows (row, id, host, text) -> (row, id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines: array of (key, words), text if whole, else only the long ones)."""
    text = F.coalesce("text", F.lit(""))
    words = F.array_remove(F.split(text, WHITE + "+"), "")
    of_words = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.concat_ws("", w)).cast("long").alias("word_chars"), F.when(F.octet_length(text) <= long_text, repeated_words(w)).alias("n_repeat_words")))
    full = lambda: F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    raw = let(full(), lambda x: (F.size(x) - F.size(F.array_distinct(F.transform(x, lambda y: F.xxhash64(y))))).cast("long"))
    lines = F.transform(full(), lambda x: F.struct(line_key(x).alias("key"), F.regexp_count(x, F.lit(WORD)).alias("words")))
    symbols = F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long")
    made = rows.select("row", "id", "host", "text", of_words.alias("w"), symbols.alias("n_symbols"), raw.alias("n_dup_lines"), lines.alias("lines"))
    return made.select("row", "id", "host", F.col("w.n_words"), F.col("w.word_chars"), "n_symbols", "n_dup_lines", F.col("w.n_repeat_words").cast("long").alias("n_repeat_words"), "lines", (F.col("text") if whole else F.when(F.octet_length("text") > long_text, F.col("text"))).alias("text"))


def repeated_by_rows(rows: DataFrame) -> DataFrame:
    """(row, n_long) for texts too long for one array of windows: the same count, by aggregation."""
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), WHITE + "+"), "")
    at = rows.select("row", F.posexplode(let(words, windows)).alias("i", "h"))
    twice = at.groupBy("row", "h").agg(F.count("*").alias("n")).where("n > 1").select("row", "h")
    return at.join(twice, ["row", "h"]).select("row", F.explode(F.array(F.col("i"), F.col("i") + 1, F.col("i") + 2)).alias("j")).distinct().groupBy("row").agg(F.count("*").alias("n_long"))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", most_documents: int = MOST_DOCUMENTS, least_left: int = LEAST_LEFT_PERCENT, with_text: bool = False, long_text: int = LONG_TEXT_BYTES) -> DataFrame:
    """Counts and verdict of each row; with_text adds `text_left`, the text without lines above the limit.

    Lines are compared in lower case without white space at their ends; each row is
    a document of its host, so repeated rows count each. Null hosts are one host;
    a null text has no words and fails; null ids are kept as they are; ties don't
    arise; an empty table gives no rows; other columns are left out.
    base_failed: under 50 words, or over half of the words repeated. kept: not
    base_failed, and the lines that aren't above the limit hold at least
    least_left percent of the words.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.col(text_col).cast("string").alias("text"))
    base, _ = written(measured(rows, long_text, with_text), "quality")
    if base.where("n_repeat_words is null").limit(1).count():
        base = base.join(repeated_by_rows(base.where("n_repeat_words is null")), "row", "left").withColumn("n_repeat_words", F.coalesce("n_repeat_words", "n_long", F.lit(0))).drop("n_long")
    counts = base.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: x["key"]))).alias("key")).groupBy("host", "key").agg(F.count("*").alias("n")).where(F.col("n") > most_documents).select("host", "key")
    each = base.select("row", "host", F.explode("lines").alias("line")).select("row", "host", F.col("line.key").alias("key"), F.col("line.words").alias("words"))
    gone = each.join(counts, ["host", "key"]).groupBy("row").agg(F.sum("words").alias("gone"), *([F.collect_set("key").alias("keys")] if with_text else []))
    out = base.join(gone, "row", "left").withColumn("n_removed_words", F.coalesce("gone", F.lit(0)).cast("long"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    kept = ~failed & (100 * (F.col("n_words") - F.col("n_removed_words")) >= least_left * F.col("n_words"))
    left = []
    if with_text:
        left = [F.array_join(F.filter(F.split("text", "\n", -1), lambda x: F.coalesce(~F.array_contains("keys", line_key(x)), F.lit(True))), "\n").alias("text_left")]
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), kept.alias("kept"), "n_removed_words", *left)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))


OP10_SQL = r"""
with d as (select row_number() over () as r, doc_id, coalesce(source, '') as host, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
win as (select r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as g from (select r, ws, unnest(range(1, len(ws) - 1)) as i from w where len(ws) > 2)),
rep as (select r, count(distinct j) as n from (select r, unnest([i, i + 1, i + 2]) as j from (select *, count(*) over (partition by r, g) as c from win) where c > 1) group by r),
l as (select r, host, lower(trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13))) as k, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) as n from (select r, host, unnest(ls) as x from w)),
bad as (select host, k from l group by host, k having count(distinct r) > 25),
gone as (select r, sum(n) as g from l join bad using (host, k) group by r),
m as (select doc_id, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words, coalesce(gone.g, 0)::bigint as n_removed_words from w left join rep using (r) left join gone using (r)),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and 100 * (n_words - n_removed_words) >= 30 * n_words as kept, n_removed_words from f
"""
