"""Ordered scans along a trajectory: windows where the step is linear, a fold over the sorted tokens where it carries state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Steps of a block in discounted(): rate**BLOCK stays well within a double's range.
BLOCK = 512


def suffix_sum(value: Column, traj: str = "traj_id", pos: str = "pos") -> Column:
    """Sum from a token to the end. In descending order the frame only grows, so a trajectory takes one pass."""
    return F.sum(value).over(Window.partitionBy(traj).orderBy(F.desc(pos)).rowsBetween(Window.unboundedPreceding, Window.currentRow))


def discounted(df: DataFrame, value: Column, steps: Column, rate: float, name: str, traj: str = "traj_id", pos: str = "pos") -> DataFrame:
    """df with name: the sum over k >= t of value_k * rate**(c_k - c_t), c the running count of steps (0 or 1 a token) before a token."""
    return discounted_all(df, {name: (value, rate)}, steps, traj, pos)


def discounted_all(df: DataFrame, sums: dict[str, tuple[Column, float]], steps: Column, traj: str = "traj_id", pos: str = "pos") -> DataFrame:
    """df with a discounted sum of each name's value at its rate: counts, windows and the join are shared.

    Sums run within blocks of BLOCK steps, where powers can't underflow; what lies
    after a block comes in through the blocks' totals, one for each BLOCK steps of a trajectory.
    """
    for name, (value, rate) in sums.items():
        if rate == 1.0:
            df = df.withColumn(name, suffix_sum(value, traj, pos))
    some = [(name, value, rate) for name, (value, rate) in sums.items() if rate != 1.0]
    if not some:
        return df
    w = Window.partitionBy(traj).orderBy(pos)
    before = F.coalesce(F.sum(steps).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = df.withColumn("__c", before).withColumn("__b", F.floor(F.col("__c") / BLOCK))
    into = F.col("__c") - F.col("__b") * BLOCK
    parts = own.withColumns({f"__p{i}": value * F.pow(F.lit(rate), into) for i, (_, value, rate) in enumerate(some)})
    n = range(len(some))
    totals = parts.groupBy(traj, "__b").agg(*(F.sum(f"__p{i}").alias(f"s{i}") for i in n)).groupBy(traj).agg(F.sort_array(F.collect_list(F.struct(F.col("__b").alias("b"), *(f"s{i}" for i in n))), asc=False).alias("__t"))
    # after block b: its successor's total and, discounted by a block, what lies after that
    none = F.array().cast("array<struct<b:bigint," + ",".join(f"after{i}:double,next{i}:double" for i in n) + ">>")

    def step(a: Column, x: Column) -> Column:
        after = [F.coalesce(F.get(a, F.size(a) - 1)[f"next{i}"], F.lit(0.0)) for i in n]
        return F.concat(a, F.array(F.struct(x["b"].alias("b"), *(c for i in n for c in (after[i].alias(f"after{i}"), (x[f"s{i}"] + some[i][2] ** BLOCK * after[i]).alias(f"next{i}"))))))

    afters = totals.select(traj, F.explode(F.aggregate("__t", none, step)).alias("x")).select(traj, F.col("x.b").alias("__b"), *(F.col(f"x.after{i}").alias(f"__after{i}") for i in n))
    inner = Window.partitionBy(traj, "__b").orderBy(F.desc(pos)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = parts.withColumns({f"__l{i}": F.sum(f"__p{i}").over(inner) for i in n})
    both = local.join(afters, [traj, "__b"])
    left = (F.col("__b") + 1) * BLOCK - F.col("__c")
    out = both.withColumns({name: F.col(f"__l{i}") / F.pow(F.lit(rate), into) + F.pow(F.lit(rate), left) * F.col(f"__after{i}") for i, (name, _, rate) in enumerate(some)})
    return out.drop("__c", "__b", *(f"__{c}{i}" for c in ("p", "l", "after") for i in n))


def whiten(df: DataFrame, value: str | list[str], mask: str, batch: list[str] | None = None, eps: float = 1e-8) -> DataFrame:
    """(value - mean) * rsqrt(var + eps), mean and Bessel-corrected variance over masked tokens of a batch; one small row a batch is joined back. Several columns share it, each with its own moments."""
    batch, values = batch or [], [value] if isinstance(value, str) else value
    on, n = F.col(mask) > 0, range(len(values))
    stats = df.groupBy(*batch).agg(*(f(F.when(on, F.col(v))).alias(f"__{c}{i}") for i, v in enumerate(values) for c, f in (("m", F.avg), ("v", F.var_samp))))
    both = df.join(stats, batch) if batch else df.crossJoin(F.broadcast(stats))
    return both.withColumns({v: (F.col(v) - F.col(f"__m{i}")) / F.sqrt(F.col(f"__v{i}") + eps) for i, v in enumerate(values)}).drop(*(f"__{c}{i}" for c in "mv" for i in n))


def differences(gamma: float) -> Column:
    """A masked token's reward and discounted next value, less its value; 0 for others."""
    w = Window.partitionBy("traj_id").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    on = F.col("mask") > 0
    after = F.coalesce(F.last(F.when(on, F.col("value")), ignorenulls=True).over(w), F.lit(0.0))
    return F.when(on, F.col("reward") + gamma * after - F.col("value")).otherwise(0.0)


def gae(df: DataFrame, gamma: float, lam: float) -> DataFrame:
    """advantage and return of each token of (traj_id, pos, reward, value, mask).

    A masked-off token neither adds a difference nor takes a step: the next value and the running advantage pass over it. Returns are discounted sums of rewards, not advantage plus value.
    """
    on = F.col("mask") > 0
    out = df.withColumn("__d", differences(gamma))
    return discounted_all(out, {"advantage": (F.col("__d"), gamma * lam), "return": (F.when(on, F.col("reward")).otherwise(0.0), gamma)}, F.col("mask")).drop("__d")


def until_eos(token: Column, eos: Column, traj: str = "traj_id", pos: str = "pos") -> Column:
    """1 up to and with the first end token."""
    seen = F.sum(F.when(token == eos, 1).otherwise(0)).over(Window.partitionBy(traj).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1))
    return F.when(F.coalesce(seen, F.lit(0)) == 0, 1).otherwise(0)


def kl_penalty(kind: str, logp: Column, ref: Column) -> Column:
    d = logp - ref
    if kind == "low_var_kl":
        return F.greatest(F.least(F.exp(-d) + d - 1, F.lit(10.0)), F.lit(-10.0))
    return {"kl": d, "abs": F.abs(d), "mse": 0.5 * d * d}[kind]


#: Ratios are kept in ten-thousandths: rounding to four decimals at each step changes nothing then.
UNIT = 10_000
FAR = 2**60


def in_units(value: float) -> int:
    units = round(value * UNIT)
    if abs(units - value * UNIT) > 1e-6:
        raise ValueError(f"{value} has more than four decimals")
    return units


def ratio_curriculum(df: DataFrame, run: str = "run", step: str = "step", passed: str = "pass_rate", start: float = 0.2, least: float = 0.2, most: float = 0.2, alpha: float = 0.02) -> DataFrame:
    """(run, step, ratio) after each step: down by alpha after a pass rate over a half, else up, and within least and most.

    A null pass rate counts as none passed. A step's move and clamp is a function of the
    ratio, x to min(max(x + a, l), u), and so are several one after the other: blocks of
    BLOCK steps are composed for themselves, then a run's blocks in order (a row holds a
    number a block), then each block is unrolled from its own start.
    """
    first, low, high, move = (in_units(v) for v in (start, least, most, alpha))
    clamp = lambda c: F.greatest(F.lit(low), F.least(F.lit(high), c))
    number = lambda v: F.lit(v).cast("long")
    moved = F.when(F.coalesce(F.col(passed), F.lit(0.0)) > 0.5, number(-move)).otherwise(number(move))
    each = df.select(F.col(run), F.col(step), F.floor(F.col(step) / BLOCK).alias("__block"), moved.alias("__move"))
    blocks = each.groupBy(run, "__block").agg(F.array_sort(F.collect_list(F.struct(F.col(step).alias("step"), F.col("__move").alias("move")))).alias("__steps"))
    same = F.struct(number(0).alias("a"), number(-FAR).alias("l"), number(FAR).alias("u"))
    then = lambda s, a, l, u: F.struct((s["a"] + a).alias("a"), F.greatest(l, F.least(u, s["l"] + a)).alias("l"), F.greatest(l, F.least(u, s["u"] + a)).alias("u"))  # noqa: E731, E741
    composed = blocks.withColumn("__f", F.aggregate("__steps", same, lambda s, x: then(s, x["move"], number(low), number(high))))
    ordered = composed.groupBy(run).agg(F.array_sort(F.collect_list(F.struct("__block", "__f"))).alias("__fs"))
    seed = F.struct(number(first).alias("at"), F.array().cast("array<bigint>").alias("starts"))
    applied = lambda x, f: F.least(f["u"], F.greatest(f["l"], x + f["a"]))
    starts = ordered.select(run, F.explode(F.arrays_zip(F.col("__fs.__block").alias("__block"), F.aggregate("__fs", seed, lambda s, x: F.struct(applied(s["at"], x["__f"]).alias("at"), F.concat(s["starts"], F.array(s["at"])).alias("starts")))["starts"].alias("__start"))).alias("__at"))
    begun = composed.join(starts.select(run, "__at.__block", "__at.__start"), [run, "__block"])
    unrolled = F.aggregate("__steps", F.struct(F.col("__start").alias("at"), F.array().cast("array<bigint>").alias("all")), lambda s, x: F.struct(clamp(s["at"] + x["move"]).alias("at"), F.concat(s["all"], F.array(clamp(s["at"] + x["move"]))).alias("all")))["all"]
    rows = begun.select(run, F.explode(F.arrays_zip(F.col("__steps.step").alias("step"), unrolled.alias("units"))).alias("__x"))
    return rows.select(run, F.col("__x.step").alias(step), (F.col("__x.units") / F.lit(float(UNIT))).alias("ratio"))
