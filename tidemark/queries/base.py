"""Registration of queries, and the panel of prices that many of them read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import NUDGE, rounded

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql.replace("round(", f"round({NUDGE} + ")  # as rounded() does
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


#: Rows that a task is given of a table that is dealt by key.
TASK_ROWS = 250_000


def dealt(rows: DataFrame, *keys: str, size: int | None = None) -> DataFrame:
    """The rows shuffled by keys into as many partitions as their number asks for, so that a task holds no more of a larger table.

    What is grouped or windowed by the keys, alone or with others, is not shuffled again. `size` is the number of rows if it is known.
    """
    wanted = (rows.count() if size is None else size) // TASK_ROWS
    return rows.repartition(max(wanted, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily prices by part: entity_id, date, close (average price), high, low, volume, delivery_qty, turnover.

    Lines are dealt by part once, and all that follows by part stays in its partition.
    """
    price = F.col("l_extendedprice") / F.col("l_quantity")
    kept = F.sum(F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).otherwise(0.0))
    lines = table(spark, sf_dir, "lineitem")
    needed = lines.select(F.col("l_partkey").alias("entity_id"), F.to_date("l_shipdate").alias("date"), "l_extendedprice", "l_quantity", "l_returnflag")
    return (
        dealt(needed, "entity_id", size=lines.count())
        .groupBy("entity_id", "date")
        .agg(
            (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.sum("l_quantity").alias("volume"),
            kept.alias("delivery_qty"),
            rounded(F.sum("l_extendedprice"), 2).alias("turnover"),
        )
    )


#: The same panel in SQL, to stand first in a WITH clause.
PANEL = """panel AS (
  SELECT l_partkey AS entity_id, CAST(l_shipdate AS DATE) AS date,
         sum(l_extendedprice) / sum(l_quantity) AS close,
         max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
         sum(l_quantity) AS volume, sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE 0 END) AS delivery_qty,
         round(sum(l_extendedprice), 2) AS turnover
  FROM lineitem GROUP BY 1, 2)"""


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as filings: entity_id (customer), filed (date), amount, kind, order key."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("entity_id"), F.to_date("o_orderdate").alias("filed"), F.col("o_totalprice").alias("amount"),
        F.col("o_orderpriority").alias("kind"), F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"),
    )


ORDERS = """filings AS (
  SELECT o_custkey AS entity_id, CAST(o_orderdate AS DATE) AS filed, o_totalprice AS amount,
         o_orderpriority AS kind, o_orderkey AS key, o_orderstatus AS status FROM orders)"""
