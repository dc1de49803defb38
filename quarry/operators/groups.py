"""Group-relative operators: everything about a group comes from one window over its key, so one exchange serves all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.tables import dealt_out


def grpo_advantage(df: DataFrame, group: str = "uid", score: str = "score", by_std: bool = True, eps: float = 1e-6) -> DataFrame:
    """(score - mean) / (sample std + eps) within the group; a group of one has mean 0 and std 1."""
    w = Window.partitionBy(group)
    alone = F.count("*").over(w) == 1
    mean, std = F.when(alone, 0.0).otherwise(F.avg(score).over(w)), F.when(alone, 1.0).otherwise(F.stddev_samp(score).over(w))
    return df.withColumn("advantage", (F.col(score) - mean) / (std + eps) if by_std else F.col(score) - mean)


def rloo_advantage(df: DataFrame, group: str = "uid", score: str = "score") -> DataFrame:
    """score minus the mean of the others; a group of one keeps its score."""
    w = Window.partitionBy(group)
    n = F.count("*").over(w)
    return df.withColumn("advantage", F.when(n == 1, F.col(score)).otherwise(F.try_divide(n * (F.col(score) - F.avg(score).over(w)), n - 1)))


def informative_groups(df: DataFrame, group: str = "uid", metric: str = "score") -> DataFrame:
    """Rows of groups whose metric varies, or of one row."""
    w = Window.partitionBy(group)
    return df.withColumn("__keep", (F.min(metric).over(w) < F.max(metric).over(w)) | (F.count("*").over(w) == 1)).where("__keep").drop("__keep")


def majority(df: DataFrame, group: str, pred: str, value: str, order: str) -> DataFrame:
    """(group, pred, value): the commonest prediction, of ties the one seen first, with the value of its first row."""
    per = df.groupBy(group, pred).agg(F.count("*").alias("n"), F.min(F.struct(order, value)).alias("first"))
    best = per.groupBy(group).agg(F.max_by(F.struct(pred, F.col("first")[value].alias(value), "n"), F.struct("n", -F.col("first")[order])).alias("b"))
    return best.select(group, F.col("b")[pred].alias(pred), F.col("b")[value].alias(value), F.col("b.n").alias("n"))


def best_of(df: DataFrame, group: str, value: str, k: int, order: str) -> DataFrame:
    """Exact expectation of the best and worst of k draws with replacement from each group's values."""
    w = Window.partitionBy(group)
    i, n = F.row_number().over(w.orderBy(value, order)), F.count("*").over(w)
    p = lambda x: F.pow(x / n, F.lit(k))
    rows = df.select(group, value, (p(i) - p(i - 1)).alias("up"), (p(n - i + 1) - p(n - i)).alias("down"))
    return rows.groupBy(group).agg(F.sum(F.col(value) * F.col("up")).alias("best"), F.sum(F.col(value) * F.col("down")).alias("worst"))


def preference_accuracy(df: DataFrame, group: str, score: str, acc: str, order: str | None = None) -> DataFrame:
    """(group, accuracy): pairs of a group weighted by their difference in acc; right when score differs the same way; 0.5 when acc is equal all over.

    Of two equal scores the pair is right if the worse row comes first in `order`, and
    never without an order. A difference in acc is the sum of the steps between its
    levels, so at each level rows above it count the rows below that stand before them in
    the order of scores: rows times levels less one (one for right and wrong), no pairs.
    Their number is counted first, and the groups are dealt out by it.
    """
    per_level = df.groupBy(group, acc).agg(F.count("*").alias("__n"))
    pairs = per_level.groupBy(group).agg((F.sum("__n") * F.count("*")).alias("__pairs")).agg(F.sum("__pairs")).first()[0] or 0
    df = dealt_out(df, int(pairs), group)
    levels = df.where(F.col(acc).isNotNull()).select(group, F.col(acc).cast("double").alias("__t")).distinct()
    steps = levels.withColumn("__gap", F.lead("__t").over(Window.partitionBy(group).orderBy("__t")) - F.col("__t")).where("__gap is not null")
    at = df.select(group, score, F.col(acc).alias("__acc"), *([order] if order else [])).join(steps, group)
    below = F.when(F.col("__acc") <= F.col("__t"), 1).otherwise(0)
    own = Window.partitionBy(group, "__t")
    if order:
        before = F.coalesce(F.sum(below).over(own.orderBy(score, order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    else:
        before = F.sum(below).over(own.orderBy(score).rangeBetween(Window.unboundedPreceding, Window.currentRow)) - F.sum(below).over(Window.partitionBy(group, "__t", score))
    counted = at.withColumn("__below", below).withColumn("__before", before)
    per = counted.groupBy(group, "__t").agg(F.max("__gap").alias("gap"), F.sum(F.when(F.col("__below") == 0, F.col("__before")).otherwise(0)).alias("hit"), (F.sum("__below") * F.sum(1 - F.col("__below"))).alias("pairs"))
    got = per.groupBy(group).agg(F.sum(F.col("gap") * F.col("hit")).alias("hit"), F.sum(F.col("gap") * F.col("pairs")).alias("all"))
    return df.select(group).distinct().join(got, group, "left").select(group, F.coalesce(F.try_divide("hit", "all"), F.lit(0.5)).alias("accuracy"))


def tool_bonus(df: DataFrame, group: str, acc: str, calls: str, few: float = 0.26) -> DataFrame:
    """df with tool_bonus, which depends on the group: where few are right, calls are rewarded by their share of the most; else few calls are, between the least and the most of those that are right. Without a right one all get it, else only the right ones. Summed by group and joined back."""
    right = F.col(acc) > 0
    of = df.groupBy(group).agg(F.avg(acc).alias("__rate"), F.max(calls).alias("__most"), F.coalesce(F.max(F.when(right, F.col(calls))), F.lit(0)).alias("__high"), F.coalesce(F.min(F.when(right, F.col(calls))), F.lit(100)).alias("__low"), F.sum(acc).alias("__right"))
    explore = 2 * F.col(calls) / F.greatest(F.lit(1), F.col("__most"))
    thrift = (F.greatest("__high", F.lit(0)) - F.col(calls)) / (F.greatest("__high", F.lit(0)) - F.least("__low", F.lit(100)) + 1e-6)
    bonus = F.when(F.col("__rate") < few, explore).otherwise(thrift)
    both = df.join(of, group)
    return both.withColumn("tool_bonus", F.when(F.col("__right") == 0, bonus).otherwise(bonus * F.col(acc))).drop("__rate", "__most", "__high", "__low", "__right")


def preference_losses(df: DataFrame, group: str, score: str, acc: str, beta: float) -> DataFrame:
    """df with ce (cross entropy of the score's sigmoid against acc), detached (against the mean score of the others of its group that are worse, for a wrong row better), by_score and by_acc (its weight as the best of its group by either).

    Means of the better and worse are running sums by acc, less a row's equals: no pairs.
    """
    to_here = Window.partitionBy(group).orderBy(acc).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    equal, whole = Window.partitionBy(group, acc), Window.partitionBy(group)
    q, good = F.col(score) * beta, F.col(acc) > 0
    at_most = {f: f(score).over(to_here) for f in (F.sum, F.count)}
    below = {f: at_most[f] - f(score).over(equal) for f in at_most}
    above = {f: f(score).over(whole) - at_most[f] for f in at_most}
    other = F.coalesce(F.when(good, F.try_divide(below[F.sum], below[F.count])).otherwise(F.try_divide(above[F.sum], above[F.count])), F.lit(0.0)) * beta
    softplus = lambda x: F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))
    n = F.count("*").over(whole)
    best = lambda c: n * F.pow(F.cume_dist().over(Window.partitionBy(group).orderBy(c)), n - 1)
    ce = F.col(acc) * softplus(-q) + (1 - F.col(acc)) * softplus(q)
    return df.select("*", ce.alias("ce"), softplus(-(q - other) * F.when(good, 1.0).otherwise(-1.0)).alias("detached"), best(score).alias("by_score"), best(acc).alias("by_acc"))
