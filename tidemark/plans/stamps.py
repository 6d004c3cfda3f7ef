"""SQL functions that queries share: stamps of mixed precision, and a table function over a view."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Minutes that the local clock is ahead of UTC.
AHEAD = 330

_SCALARS = {
    # a local stamp in UTC; a day alone is known at its last second
    "local_to_utc": f"""(s STRING) RETURNS TIMESTAMP_NTZ RETURN CASE WHEN trim(s) = '' THEN NULL
        WHEN length(trim(s)) <= 10 THEN CAST(try_cast(trim(s) AS DATE) AS TIMESTAMP_NTZ) + make_dt_interval(1, 0, -{AHEAD}, -1)
        ELSE try_cast(replace(left(trim(s), 19), 'T', ' ') AS TIMESTAMP_NTZ) - make_dt_interval(0, 0, {AHEAD}, 0) END""",
    "stamp_to_utc": """(s STRING) RETURNS TIMESTAMP_NTZ RETURN CASE WHEN trim(s) = '' THEN NULL ELSE try_cast(replace(left(trim(s), 19), 'T', ' ') AS TIMESTAMP_NTZ) END""",
    "stamp_precision": """(s STRING) RETURNS STRING RETURN CASE WHEN s IS NULL OR trim(s) = '' THEN 'unknown' WHEN length(trim(s)) <= 10 THEN 'day' WHEN length(trim(s)) <= 16 THEN 'minute' ELSE 'second' END""",
}


def register_stamps(spark: SparkSession) -> None:
    """The scalar functions as temporary SQL functions: the optimiser puts their bodies in place of the calls."""
    for name, body in _SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")


def register_table_function(spark: SparkSession, name: str, parameters: str, returns: str, body: str) -> None:
    """A temporary table function; `body` is a query over views that may name the parameters."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE({returns}) RETURN {body}")
