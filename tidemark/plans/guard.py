"""Ad-hoc SQL within bounds."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession

#: First words of the statements that may run. Fixed list.
READING = ("select", "with", "values", "table", "from")


def guarded_sql(spark: SparkSession, statement: str, limit: int = 200) -> DataFrame:
    """The rows of one reading statement, one more than `limit` at most, so that a caller sees if there were more.

    Spark parses the statement: a second statement or a command raises before anything runs.
    """
    bare = statement.strip().rstrip(";").strip()
    first = bare.split(None, 1)[0].lower().lstrip("(") if bare else ""
    if first not in READING:
        raise ValueError("only a single reading statement runs here")
    return spark.sql(f"SELECT * FROM (\n{bare}\n)").limit(limit + 1)


def with_deadline(df: DataFrame, seconds: float) -> list:
    """The rows of a bounded result, cancelled if they aren't there in time."""
    context, group = df.sparkSession.sparkContext, f"deadline-{threading.get_ident()}"
    context.setJobGroup(group, "bounded query", interruptOnCancel=True)
    timer = threading.Timer(seconds, lambda: context.cancelJobGroup(group))
    timer.start()
    try:
        return df.collect()
    finally:
        timer.cancel()
        context.setLocalProperty("spark.jobGroup.id", None)


def catalog(tables: dict[str, DataFrame]) -> list[tuple[str, str, str]]:
    """(table, column, type) of every column."""
    return [(name, f.name, f.dataType.simpleString()) for name, df in tables.items() for f in df.schema.fields]
