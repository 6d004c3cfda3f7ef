"""Reading files of every format with a given schema, and keyed writing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FORMATS = ("parquet", "orc", "csv", "json", "text", "xml", "binaryFile")


def read(spark: SparkSession, path: str, kind: str, schema: StructType | str | None = None, **options: str) -> DataFrame:
    """A folder or file of one of FORMATS. Rows that don't fit a given CSV or JSON schema have nulls, none stops the read."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}; known are {', '.join(FORMATS)}")
    reader = spark.read.format(kind).options(**options)
    if kind == "csv":
        reader = reader.option("header", options.get("header", "true"))
    return (reader.schema(schema) if schema is not None and kind not in ("text", "binaryFile") else reader).load(path)


def upsert(current: DataFrame, new: DataFrame, key: Sequence[str], order: Column) -> DataFrame:
    """The current rows whose key is not among the new ones, and of the new ones the last in order for each key."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(order.desc()))
    last = new.withColumn("_place", place).where("_place = 1").drop("_place")
    return current.join(last.select(*key), list(key), "left_anti").unionByName(last)


def new_vintages(current: DataFrame, new: DataFrame, key: Sequence[str], value: str, known: str) -> DataFrame:
    """The new rows that say something new: their key is unknown or its last value another; rows known before it are refused."""
    last = current.groupBy(*key).agg(F.max_by(F.struct(F.col(value).alias("v")), known).alias("_last"), F.max(known).alias("_known"))
    joined = new.join(last, list(key), "left")
    return joined.where(F.col("_last").isNull() | (~F.col(value).eqNullSafe(F.col("_last.v")) & (F.col(known) > F.col("_known")))).drop("_last", "_known")


def by_content(files: DataFrame, content: str = "content") -> DataFrame:
    """One row per distinct content: sha256, the first path, and how many files hold it."""
    return files.groupBy(F.sha2(content, 256).alias("sha256")).agg(F.min("path").alias("path"), F.count("*").alias("copies"))


def contract(rows: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that keep all rules, and the others with the names of those they break; an unknown outcome breaks a rule."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()]))
    checked = rows.withColumn("broken", broken)
    return checked.where(F.size("broken") == 0).drop("broken"), checked.where(F.size("broken") > 0)


def older_than(rows: DataFrame, day: str, months: int, today: Column) -> DataFrame:
    """The rows for the cold tier."""
    return rows.where(F.months_between(today, F.col(day)) > months)
