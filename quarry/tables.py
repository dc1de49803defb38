"""The driver's tables, and the trajectory view that the group and scan operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TOKENS_SQL = """tokens as (select o_custkey as uid, o_orderkey as traj_id, row_number() over (partition by o_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as pos,
 l_quantity as reward, l_discount * 10 as value, case when l_returnflag <> 'R' then 1 else 0 end as mask, l_tax as kl from orders join lineitem on o_orderkey = l_orderkey)"""


#: Rows that a task sorts: partitions are counted by the input, so that a task's memory doesn't grow with it.
ROWS_A_TASK = 1 << 18


def dealt_out(df: DataFrame, rows: int, key: str) -> DataFrame:
    """df by its key in partitions of about ROWS_A_TASK of the rows that come of it; few are left to Spark's own sizes."""
    n = -(-rows // ROWS_A_TASK)
    return df.repartition(n, key) if n > 8 else df


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(uid, traj_id, pos, reward, value, mask, kl): a lineitem is a token, an order a trajectory, a customer a prompt. Dealt out by trajectory, which serves scans along it too."""
    at = Window.partitionBy("o_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    orders, items = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), table(spark, sf_dir, "lineitem")
    n = max(orders.count(), items.count())  # from the files' footers
    items = items.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_tax")
    both = dealt_out(orders, n, "o_orderkey").join(dealt_out(items, n, "l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    return both.select(F.col("o_custkey").alias("uid"), F.col("o_orderkey").alias("traj_id"), F.row_number().over(at).cast("long").alias("pos"), F.col("l_quantity").alias("reward"), (F.col("l_discount") * 10).alias("value"), F.when(F.col("l_returnflag") != "R", 1).otherwise(0).alias("mask"), F.col("l_tax").alias("kl"))


SCORES_SQL = "scores as (select o_custkey as uid, o_orderkey as traj_id, sum(l_quantity) as score from orders join lineitem on o_orderkey = l_orderkey group by all)"


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(uid, traj_id, score): the summed rewards of each trajectory, aggregated before the join."""
    sums = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("score"))
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("uid"), F.col("o_orderkey").alias("traj_id")).join(sums, F.col("traj_id") == F.col("l_orderkey")).drop("l_orderkey")
