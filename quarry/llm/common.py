"""What the operators of this subpackage share: shared folders, written tables, graph components.

Failure model: every iterative or multi-pass operator cuts its lineage with a
Parquet table below the folder named by ``spark.checkpoint.dir``, which all
executors see. A lost executor costs the tasks of the current stage only.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that carry marks in one exchange of the star search, at least; beyond that as many as there are marks, so an exchange doesn't outgrow the input.
ROWS_AN_EXCHANGE = 1 << 20

_OWN: dict[str, str] = {}
_MADE: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; in a session without one (tests), a folder of ours."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if "dir" not in _OWN:
        _OWN["dir"] = "file://" + tempfile.mkdtemp(prefix="quarry-")
        atexit.register(lambda path=_OWN["dir"][7:]: __import__("shutil").rmtree(path, ignore_errors=True))
    return _OWN["dir"]


def new_path(spark: SparkSession, what: str) -> str:
    path = f"{shared_dir(spark)}/quarry/{what}-{uuid.uuid4().hex}"
    for made in _MADE:
        made.append(path)
    return path


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession):
    """Within, a query's shuffle files are deleted as it ends: what is kept lies in written tables."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def written(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """The rows of df as a table in the shared folder, and its path."""
    spark, path = df.sparkSession, new_path(df.sparkSession, what)
    with shuffles_freed(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_path(spark: SparkSession, *paths: str) -> None:
    """Deletes tables of ours that nothing reads any more."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Deletes, at its end, every table written within: for a caller that has stored the result by then."""
    made: list[str] = []
    _MADE.append(made)
    try:
        yield
    finally:
        _MADE.remove(made)
        drop_path(spark, *made)


def wide(spark: SparkSession, least: int = 1) -> int:
    """Partitions for an exchange: the session's setting, which the deployment sizes by its input."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def frequent(counts: DataFrame, key: str, n: str, share: int = 256) -> list:
    """The values of key that hold over 1 / share of all rows: fewer than share, so the driver can hold them. counts has a row for each value."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    return [r[0] for r in counts.where(F.col(n) * share > total).select(key).collect()]


def join_spread(rows: DataFrame, small: DataFrame, key: str, hot: list, how: str = "inner") -> DataFrame:
    """rows.join(small, key), where rows of the frequent values (see frequent) aren't shuffled but meet a broadcast of fewer than 256 rows of small; small has a row for each value."""
    if not hot:
        return rows.join(small, key, how)
    among = F.col(key).isin(hot)
    return rows.where(~among).join(small.where(~among), key, how).unionByName(rows.where(among).join(F.broadcast(small.where(among)), key, how))


def is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether each a of edges (a, b) has one b, and no b is an a."""
    many = edges.groupBy("a").count().where("count > 1").select("a")
    inner = edges.select(F.col("b").alias("a")).join(edges.select("a"), "a", "left_semi")
    return not many.unionByName(inner).limit(1).count()


def components(edges: DataFrame, what: str = "components") -> DataFrame:
    """(id, component): the smallest id reachable from each end of edges (a, b); ids without an edge aren't returned.

    Alternating large-star and small-star contraction: each round is two
    aggregations and joins on ids, so no vertex gathers its neighbours in one
    row, and the number of rounds grows with the logarithm of the longest path.
    It ends when the edges are stars around their smallest ids. Rounds are
    written to the shared folder and the last but one deleted.
    """
    spark = edges.sparkSession
    now, path = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), what)
    while not is_forest_of_stars(now):
        # large star: each larger neighbour of u, and u itself's smaller ones, point at u's smallest neighbour
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: u and its smaller neighbours point at the smallest of them
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low2, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        after, new = written(small, what)
        drop_path(spark, path)
        now, path = after, new
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def joined_components(known: DataFrame | None, links: DataFrame, what: str) -> tuple[DataFrame, str]:
    """known (id, component) after further links (a, b) are taken in, as a written table. Only links between different components are contracted anew."""
    if known is None:
        return written(components(links, what), what)
    named = links
    for side in ("a", "b"):
        named = named.join(known.select(F.col("id").alias(side), F.col("component").alias(f"c_{side}")), side, "left")
    named = named.select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))
    merged = components(named, what)
    all_ = known.select(F.col("id"), F.col("component").alias("old")).unionByName(merged.select("id", F.col("id").alias("old")).join(known, "id", "left_anti"))
    return written(all_.join(merged.select(F.col("id").alias("old"), "component"), "old", "left").select("id", F.coalesce("component", "old").alias("component")), what)


def star_components(members: DataFrame, *args, **options) -> DataFrame:
    """_star_components, in which every action's shuffle files go as it ends."""
    with shuffles_freed(members.sparkSession):
        return _star_components(members, *args, **options)


def _star_components(members: DataFrame, marks: DataFrame, close, prepare, what: str, also: DataFrame | None = None, spend: int = 256, turns: int = 1, spent: tuple[str, ...] = (), dealt_from: tuple[str, ...] = (), careful: int = 0, home=None) -> DataFrame:
    """(id, component) under the links that are accepted among ids sharing a bucket, without emitting all pairs.

    members: (bucket, id), ids may be in many buckets; they are dealt out in `turns`
    parts, by bucket, one after the other. marks: (id, mark), a few
    bytes that tell most pairs apart; close: gets two marks, false only where a
    link is impossible. prepare: gets the ids of candidate pairs, returns confirm:
    candidate pairs (a, b) in, the accepted ones out. also: further links (a, b).
    Ids without a link aren't returned. spent, dealt_from: tables of marks and of members,
    which are deleted once they aren't needed any more.

    The first round pairs each bucket's smallest id, its centre, with its other
    members (a star: fewer pairs than members). Two ids of one component need no
    further test, and a centre has met its whole bucket, so later rounds look
    only at buckets whose other members still lie in several components: those
    outside a bucket's largest component become centres, each against the members
    of other components. Marks are compared before anything else of a pair is
    read. A round compares about `spend` marks a member at most, and the first
    `careful` ones about one: a few centres join most of a large group, so that pairs within it
    need no test. If more are left, a share of the centres chosen by hash is taken,
    the smallest of each bucket with it. A bucket with many comparisons is dealt over many tasks, and
    the rows that meet, each with its mark, over actions of about as many rows as there are marks, whose
    shuffle files go one after the other (ROWS_AN_EXCHANGE). It
    ends when every pair in a bucket is tested or within one component: no link
    that a bucket could show is lost. home: gets the marks of two ids and returns one
    of the buckets that they share, so that rounds after the careful ones compare them there only:
    members of different components are compared in each bucket that has both.
    """
    spark, held = members.sparkSession, []
    for turn in range(turns):
        part = members.where(F.pmod("bucket", F.lit(turns)) == turn) if turns > 1 else members
        shared = part.groupBy("bucket").agg(F.min("id").alias("centre"), F.max("id").alias("last")).where("centre < last").select("bucket", "centre")
        held.append(written(part.join(shared.hint("shuffle_hash"), "bucket"), what + "-buckets"))
    drop_path(spark, *dealt_from)
    all_ = reduce(DataFrame.unionByName, (table for table, _ in held))
    volume = all_.count()
    if not volume:
        drop_path(spark, *(path for _, path in held), *spent)
        return joined_components(None, also if also is not None else spark.createDataFrame([], "a long, b long"), what)[0]
    told = []
    for turn in range(turns):
        mine = F.pmod("id", F.lit(turns)) == turn
        told.append(written(marks.where(mine).join(all_.where(mine).select("id").distinct().hint("shuffle_hash"), "id", "left_semi").dropDuplicates(["id"]), what + "-marks"))
    mark, mark_paths = reduce(DataFrame.unionByName, (table for table, _ in told)), [path for _, path in told]
    drop_path(spark, *spent)
    at_once = max(ROWS_AN_EXCHANGE, mark.count())

    def in_turns(rows: int, pairs) -> tuple[DataFrame, list[str]]:
        """pairs(n, i) for each i of n, a table each where there are several: n is as many as keep rows to at_once a turn."""
        n = max(1, -(-rows // at_once))
        if n == 1:
            return pairs(1, 0), []
        tables = [written(pairs(n, i), what + "-part") for i in range(n)]
        return reduce(DataFrame.unionByName, (table for table, _ in tables)).distinct(), [path for _, path in tables]

    def taken_in(known: DataFrame | None, pairs: DataFrame, more: DataFrame | None = None) -> tuple[DataFrame, str]:
        """known after the pairs that are confirmed, and more links. Nothing else that is written for it stays."""
        near, near_path = written(pairs, what + "-near")
        confirm = prepare(near.select(F.col("a").alias("id")).unionByName(near.select(F.col("b").alias("id"))).distinct())
        links, links_path = written(confirm(near), what + "-links")
        drop_path(spark, near_path)
        out = joined_components(known, links if more is None else links.unionByName(more), what)
        drop_path(spark, links_path)
        return out

    def stars(n: int, i: int) -> DataFrame:
        star = all_.where("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b"))
        star = star.where(F.pmod(F.xxhash64("a", "b"), F.lit(n)) == i).distinct()
        for side in ("a", "b"):
            star = star.join(mark.select(F.col("id").alias(side), F.col("mark").alias(f"mark_{side}")), side)
        return star.where(close(F.col("mark_a"), F.col("mark_b"))).select("a", "b")

    first, paths = in_turns(volume, stars)
    comp, comp_path = taken_in(None, first, also)
    drop_path(spark, *paths)
    # (bucket, id) still to be compared, in parts of whole buckets, each with the tables that it is read from
    left, rounds = [(table.where("id <> centre").select("bucket", "id"), [path]) for table, path in held], 0
    while True:
        opened = []
        for rows, read in left:
            named, named_path = written(rows.join(comp, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("component")), what + "-named")
            drop_path(spark, *read)
            per = named.groupBy("bucket", "component").agg(F.count("*").alias("n"))
            most = per.groupBy("bucket").agg(F.max(F.struct("n", "component"))["component"].alias("main"), F.count("*").alias("parts"), F.sum("n").alias("total")).where("parts > 1").select("bucket", "main", "total")
            opened.append(written(named.join(most, "bucket"), what + "-open"))
            drop_path(spark, named_path)
        open_ = reduce(DataFrame.unionByName, (table for table, _ in opened))
        open_paths = [path for _, path in opened]
        outside = open_.where("component <> main")
        todo = outside.agg(F.count("*").alias("n"), F.sum("total").alias("pairs")).first()
        if not todo["n"]:
            drop_path(spark, *open_paths, *mark_paths)
            return comp
        most, rounds = volume * (min(spend, 1) if rounds < careful else spend), rounds + 1
        if todo["pairs"] > most:
            share = int(most / todo["pairs"] * 2**30)
            least = outside.groupBy("bucket").agg(F.min("id").alias("least"))
            outside = outside.join(least, "bucket").where((F.col("id") == F.col("least")) | (F.pmod(F.xxhash64("id"), F.lit(2**30)) < share))
        centres, path = written(outside.select("bucket", F.col("id").alias("centre"), F.col("component").alias("own"), "total").join(mark.select(F.col("id").alias("centre"), F.col("mark").alias("own_mark")), "centre"), what + "-centres")
        work, work_path = written(centres.groupBy("bucket").agg(F.ceil(F.sum("total") / F.lit(2.0**18)).alias("deals"), F.max("total").alias("each")), what + "-work")
        lone, split = work.where("deals = 1").select("bucket"), work.where("deals > 1").select("bucket", "deals")
        apart = F.col("own") != F.col("component")
        if home is not None and rounds > careful:
            apart = apart & (home(F.col("own_mark"), F.col("mark")) == F.col("bucket"))

        def met(n: int, i: int) -> DataFrame:
            now = F.pmod(F.xxhash64("bucket", "deal"), F.lit(n)) == i
            # nearly all buckets have the one deal 0: their rows are chosen before anything is joined
            whole = lambda x: x.withColumn("deal", F.lit(0).cast("long")).where(now).join(lone, "bucket", "left_semi")
            spots = split.select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals") - 1)).alias("deal")).where(now)
            dealt = whole(centres).unionByName(centres.join(split, "bucket").withColumn("deal", F.pmod(F.xxhash64("centre"), "deals")).where(now).drop("deals"))
            rows = open_.select("bucket", "id", "component")
            others = whole(rows).unionByName(rows.join(spots, "bucket")).join(mark, "id")
            # a fixed number of partitions: few bytes stand for much work here, and would be put together in one task
            dealt, others = (x.repartition(wide(spark, 32), "bucket", "deal") for x in (dealt, others))
            return dealt.hint("merge").join(others, ["bucket", "deal"]).where(apart & close(F.col("own_mark"), F.col("mark"))).select(F.least("centre", "id").alias("a"), F.greatest("centre", "id").alias("b")).distinct()

        pairs, paths = in_turns(work.agg(F.sum(F.col("deals") * F.col("each"))).first()[0], met)
        newer, newer_path = taken_in(comp, pairs)
        drop_path(spark, *paths, work_path, comp_path)
        comp, comp_path = newer, newer_path
        left = [(open_.select("bucket", "id").join(centres.select("bucket", F.col("centre").alias("id")), ["bucket", "id"], "left_anti"), [*open_paths, path])]
