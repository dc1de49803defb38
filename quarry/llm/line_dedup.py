"""Fuzzy line dedup: sketches of normalised lines, joined on blocks, verified by edit similarity.

DataFrame functions only. The method dealt was SimHash with pigeonhole blocks. It
can't give right results here: lines of edit similarity 0.8 differ in 7 to 13 of
64 SimHash bits, so blocks of which one must agree in full would have five bits
(README has the figures). A bottom sketch, the smallest hashes of a line's
features, takes the place of SimHash's bits, and blocks of two of them that of
the pigeonhole blocks; the rest is the method's.

A line's features are its pairs of neighbouring words; a short line's, or one of
very long or short words, its 6-grams of characters; near the border it has a
sketch of each kind. A block holds the lines that have two hashes alike among
their smallest few. Candidates are stars within blocks (common.star_components);
pairs whose sketches have too little in common are left out; a link needs an edit
similarity of 0.8. Of each connected group the occurrence with the smallest
(document id, line number) stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import drop_path, frequent, join_spread, star_components, written

#: Shorter lines (normalised characters) are compared exactly only.
LEAST_CHARS = 20
LEAST_SIMILARITY = 0.8
#: Characters of a gram; hashes that a sketch keeps.
GRAM, KEPT = 6, 16
#: Kind 0 has character grams, kind 1 pairs of words (n characters, m words). Where both hold, a line has both sketches: lines of similarity 0.8 differ by a quarter in length at most.
KINDS = {0: "n <= 125 or 16 * m < n or 4.5 * m > n", 1: "n >= 100 and 24 * m >= n and 4 * m <= n"}
#: Of so many smallest hashes any two make a block: by kind, for lines up to 64 characters and longer ones. An edit costs a short line more.
AMONG = {0: (7, 5), 1: (5, 5)}
#: A pair of lines isn't looked at if they have less than this share of the smaller sketch in common.
LEAST_COMMON = {0: 0.35, 1: 0.45}
#: Share of the words of a long line in which a similar one may differ: a line of similarity 0.8 has more only if most edits are misspellings.
MOST_WORDS = 0.35
#: Blocks and marks are dealt out in so many turns, so that one turn's exchanges are gone before the next.
TURNS = 3
#: Ids of candidate lines, 8 bytes each, that are sent to all executors instead of shuffling every line.
MOST_SENT = 1 << 18


def row_key(id_col: str, text_col: str) -> list[Column]:
    """(id, of): the same for equal rows, in whatever order and partition they are read again."""
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias("id"), F.xxhash64(F.col(text_col)).alias("of")]


def bound(value: Column, body) -> Column:
    """body(value), where value is worked out once however often body has it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def smallest(hashes: Column) -> Column:
    return F.slice(F.array_distinct(F.slice(F.sort_array(hashes), 1, 3 * KEPT)), 1, KEPT)


def sketch(kind: int) -> Column:
    """The smallest hashes of a line's features, null if the line isn't of the kind."""
    if kind == 1:
        found = bound(F.split("line", " "), lambda w: F.zip_with(w, F.slice(w, 2, F.size(w)), lambda x, y: F.hash(x, y)))
    else:
        last = F.greatest(F.col("n") - (GRAM - 1), F.lit(1))
        short = F.transform(F.sequence(F.lit(1), last), lambda i: F.hash(F.substring("line", i, GRAM)))
        # finding a place in a string takes time by its length, so a long line is cut into characters first
        long_ = bound(F.split("line", ""), lambda c: F.transform(F.sequence(F.lit(0), last - 1), lambda i: F.hash(*(F.get(c, i + j) for j in range(GRAM)))))
        found = F.when(F.col("n") <= 125, short).otherwise(long_)
    return F.when(F.expr(KINDS[kind]), smallest(found))


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, of, pos, key, line) of the lines that take part; of names the text of the row, line is normalised: letters and digits in lower case, single spaces."""
    plain = F.regexp_replace(F.lower(F.col(text_col).cast("string")), r"[^\p{L}\p{N}\n]++", " ")
    cut = docs.select(*row_key(id_col, text_col), F.posexplode(F.split(plain, "\n", -1)).alias("pos", "line"))
    return cut.withColumn("line", F.trim("line")).where(F.col("line") != "").select("id", "of", "pos", F.xxhash64("line").alias("key"), "line")


def sketches(lines: DataFrame) -> DataFrame:
    """(key, n, k0, k1, by_words, shape, b0, b1) of each line: its characters, its sketches, what close() compares, and the sketches folded to bits."""
    counted = lines.withColumn("n", F.length("line")).withColumn("m", F.col("n") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1)
    by_words = (F.col("n") > 150) & ((16 * F.col("m") >= F.col("n")) | (F.col("n") > 6000))
    found = counted.select("key", "n", sketch(0).alias("k0"), sketch(1).alias("k1"), by_words.alias("by_words"), F.when(by_words, coded(F.col("line"))).otherwise(F.col("line")).alias("shape"))
    return found.select("*", *(F.when(F.col(f"k{k}").isNotNull(), F.struct(*(folded(f"k{k}", half).alias(f"h{half}") for half in (0, 1)))).alias(f"b{k}") for k in KINDS))


def folded(hashes: str, half: int) -> Column:
    """A bit for each hash of an array: of the 128 that its last seven bits choose, the first or second 64."""
    return F.expr(f"aggregate({hashes}, 0L, (a, h) -> if((h & 64) = {64 * half}, a | shiftleft(1L, h & 63), a))")


def may_share(a, b) -> Column:
    """False only where sketches of neither kind have enough in common: a bit that one line has and the other hasn't stands for a hash, at least, that only the one has."""
    shared = []
    for kind, share in LEAST_COMMON.items():
        x, y = a[f"b{kind}"], b[f"b{kind}"]
        sizes = [F.size(m[f"k{kind}"]) for m in (a, b)]
        only = [sum(F.bit_count(p[f"h{half}"].bitwiseAND(F.bitwise_not(q[f"h{half}"]))) for half in (0, 1)) for p, q in ((x, y), (y, x))]
        shared.append(F.coalesce(F.least(*(s - o for s, o in zip(sizes, only, strict=True))) >= share * F.least(*sizes), F.lit(False)))
    return shared[1] | shared[0]


def fewest(mark, kind: int) -> Column:
    """The hashes of a line of which any two make a block."""
    short, longer = AMONG[kind]
    return F.slice(mark[f"k{kind}"], 1, F.when(mark["n"] <= 64, short).otherwise(longer))


def home(a: Column, b: Column) -> Column:
    """Of the blocks that two lines share, that of the smallest hashes of the first kind; null where lengths or folded sketches rule a link out."""
    first = lambda kind, else_: bound(F.array_intersect(fewest(a, kind), fewest(b, kind)), lambda s: F.when(F.size(s) > 1, F.xxhash64(F.lit(kind), F.get(s, F.lit(1)), F.get(s, F.lit(0)))).otherwise(else_))
    return F.when((F.abs(a["n"] - b["n"]) <= most_edits(a["n"], b["n"])) & may_share(a, b), first(0, first(1, F.lit(None).cast("long"))))


def blocks(found: DataFrame) -> DataFrame:
    """(bucket, id): each line in its blocks."""

    def pairs(kind: int) -> Column:
        twos = bound(fewest(found, kind), lambda s: F.flatten(F.transform(s, lambda x, i: F.transform(F.slice(s, 1, i), lambda y: F.xxhash64(F.lit(kind), x, y)))))
        return F.coalesce(twos, F.array().cast("array<long>"))

    return found.select(F.explode(F.concat(*(pairs(k) for k in AMONG))).alias("bucket"), F.col("key").alias("id"))


def close(a: Column, b: Column) -> Column:
    """close() of star_components: lengths allow the edit similarity, sketches of one kind have enough in common, and so do the shapes: a short line itself, or a long one's words, of which MOST_WORDS may differ."""
    near = []
    for kind, share in LEAST_COMMON.items():
        x, y = a[f"k{kind}"], b[f"k{kind}"]
        near.append(F.coalesce(F.size(F.array_intersect(x, y)) >= share * F.least(F.size(x), F.size(y)), F.lit(False)))
    most = F.when(a["by_words"], MOST_WORDS).otherwise(round(1 - LEAST_SIMILARITY, 6)) * F.greatest(F.length(a["shape"]), F.length(b["shape"])) + 1e-9
    # literals only are taken for the most edits by F.levenshtein, so the SQL function is called
    alike = F.call_function("levenshtein", a["shape"], b["shape"], F.floor(most).cast("int")) >= 0
    return (F.abs(a["n"] - b["n"]) <= most_edits(a["n"], b["n"])) & may_share(a, b) & (near[1] | near[0]) & ((a["by_words"] != b["by_words"]) | alike)


def most_edits(a: Column, b: Column, similarity: float = LEAST_SIMILARITY) -> Column:
    return F.floor(F.lit(round(1 - similarity, 6)) * F.greatest(a, b) + 1e-9).cast("int")


def coded(line: Column) -> Column:
    """A character for each word: by its hash, so that lines can be compared word by word."""
    return F.array_join(F.transform(F.split(line, " "), lambda w: F.chr(F.pmod(F.hash(w), F.lit(223)).cast("long") + 33)), "")


def similar(a: str, b: str, coded_a: str, coded_b: str) -> Column:
    """Whether two lines have the edit similarity.

    Comparing characters takes time by the square of the length. So lines over 150
    characters are compared word by word first: those with a tenth of the words
    edited are similar, those with over MOST_WORDS aren't, and only those between are
    compared by characters. Over 1500 characters the words alone decide, over 6000 also
    where there are few words (16 characters a word or more).
    """
    chars, words = f"greatest(length({a}), length({b}))", f"greatest(length({coded_a}), length({coded_b}))"
    within = lambda x, y, size, share: f"levenshtein({x}, {y}, cast(floor({share:.6f} * {size} + 1e-9) as int)) >= 0"
    least = 1 - LEAST_SIMILARITY
    by_chars, by_words = within(a, b, chars, least), within(coded_a, coded_b, words, least)
    return F.expr(f"""case when {chars} <= 150 or (16 * {words} < {chars} and {chars} <= 6000) then {by_chars}
        when {within(coded_a, coded_b, words, least / 2)} then true
        when {chars} > 1500 then {by_words}
        when not {within(coded_a, coded_b, words, MOST_WORDS)} then false
        else {by_chars} end""")


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, of, pos) of the line occurrences to remove; id and of as in row_key."""
    spark = docs.sparkSession
    lines, path = written(lines_of(docs, id_col, text_col), "lines")
    occ = F.col("id").cast("decimal(38,0)") * F.lit(10**10).cast("decimal(11,0)") + F.col("pos")
    each = lines.select("id", "of", "pos", "key", occ.cast("decimal(38,0)").alias("occ"))
    per, per_path = written(each.groupBy("key").agg(F.min("occ").alias("occ"), F.count("*").alias("n")), "line-keys")
    hot = frequent(per, "key", "n")
    made = [path, per_path]
    few = lines.where(F.length("line") >= LEAST_CHARS).select("key", "line")
    if hot:  # lines of very many occurrences are put together before the exchange
        among = F.col("key").isin(hot)
        few = few.where(~among).unionByName(few.where(among).dropDuplicates(["key"]))
    # each line takes part once: rows of one line would meet each other, and the others, in every block
    once = few.repartition("key").groupBy("key").agg(F.first("line").alias("line"))
    found, found_path = written(sketches(once), "line-sketches")
    marks = found.select(F.col("key").alias("id"), F.struct("n", "k0", "k1", "b0", "b1", "by_words", "shape").alias("mark"))

    candidates: list[str] = []

    def prepare(ids: DataFrame):
        drop_path(spark, *candidates)  # of the round before
        # few ids, as in nearly all rounds, go to the lines; more meet them by an exchange
        how = "broadcast" if ids.count() <= MOST_SENT else "shuffle_hash"
        chosen = few.join(ids.select(F.col("id").alias("key")).hint(how), "key", "left_semi")
        table, chosen_path = written(chosen.groupBy("key").agg(F.max("line").alias("line")).withColumn("coded", coded(F.col("line"))), "line-candidates")
        candidates[:] = [chosen_path]

        def confirm(pairs: DataFrame) -> DataFrame:
            for side in ("a", "b"):
                pairs = pairs.join(table.select(F.col("key").alias(side), F.col("line").alias(f"line_{side}"), F.col("coded").alias(f"coded_{side}")), side)
            return pairs.where(similar("line_a", "line_b", "coded_a", "coded_b")).select("a", "b")

        return confirm

    members, members_path = written(blocks(found), "line-blocks")
    groups = star_components(members, marks, close, prepare, "lines", turns=TURNS, spent=(found_path,), dealt_from=(members_path,), careful=2, home=home)
    grouped = per.join(groups.withColumnRenamed("id", "key"), "key", "left").where("component is not null or n > 1").select("key", "occ", F.coalesce("component", "key").alias("component"))
    heads = grouped.groupBy("component").agg(F.min("occ").alias("head"))
    judged, judged_path = written(grouped.join(heads, "component").select("key", "head"), "line-heads")
    gone, _ = written(join_spread(each, judged, "key", hot).where("occ <> head").select("id", "of", "pos"), "line-gone")
    drop_path(spark, *made, *candidates, judged_path)
    return gone


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with fuzzy repeats of lines taken out of the text column, and n_lines_removed.

    Every row stays, with all its columns (an own column n_lines_removed, whatever
    its case, is replaced). Of lines shorter than LEAST_CHARS after normalisation only
    exact repeats go; lines without a letter or digit stay. A null text stays null, an empty one empty. Rows of one
    id are one document: the same line at the same place stays in each; null ids
    are one document that comes last. Of equal lines the smallest (id, place) stays.
    An empty table stays empty.
    """
    gone = duplicates(docs, id_col, text_col).groupBy(F.col("id").alias("__id"), F.col("of").alias("__of")).agg(F.sort_array(F.collect_set("pos")).alias("__gone"))
    name, of = row_key(id_col, text_col)
    rows = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() != "n_lines_removed"), name.alias("__id"), of.alias("__of"))
    # what lies between removed lines, a slice for each
    start = lambda x, i: F.when(i == 0, 0).otherwise(F.get(x["g"], i - 1) + 1)
    end = lambda x, i: F.when(i == F.size(x["g"]), F.size(x["l"])).otherwise(F.get(x["g"], i))
    cut = lambda x: F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(x["g"])), lambda i: F.slice(x["l"], start(x, i) + 1, end(x, i) - start(x, i)))), "\n")
    left = bound(F.struct(F.split(F.col(text_col), "\n", -1).alias("l"), F.col("__gone").alias("g")), cut)
    both = rows.join(gone.hint("shuffle_hash"), ["__id", "__of"], "left")
    return both.withColumn(text_col, F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(left)).withColumn("n_lines_removed", F.coalesce(F.size("__gone"), F.lit(0))).drop("__id", "__of", "__gone")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, those removed, and a digest of the text that is left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    left = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return dedup_lines(docs).select("doc_id", (left + F.col("n_lines_removed")).cast("long").alias("n_lines"), F.col("n_lines_removed").cast("long").alias("n_removed"), F.sha2(text.cast("binary"), 256).alias("kept_sha256"))
