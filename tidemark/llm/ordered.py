"""Running totals along an order that no single task has to hold: sorted ranges, and what each carries into the next."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import stage


def _runner(key: str, adds: tuple[str, ...], xors: tuple[str, ...], names: list[str]):
    """Within one sorted range: the inclusive running sums and exclusive-ors of each key."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last = TaskContext.get().partitionId(), None
        held = {c: 0 for c in (*adds, *xors)}
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
            first = np.concatenate([[True], keys[1:] != keys[:-1]])
            begins = np.flatnonzero(first)
            run_of = np.cumsum(first) - 1
            goes_on = last is not None and keys[0] == last
            out = []
            for c in (*adds, *xors):
                values = batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64)
                running = np.cumsum(values) if c in adds else np.bitwise_xor.accumulate(values)
                before = np.concatenate([[0], running])[begins]
                into = np.zeros(len(begins), np.int64)
                into[0] = held[c] if goes_on else 0
                if c in adds:
                    running = running - before[run_of] + into[run_of]
                else:
                    running = running ^ before[run_of] ^ into[run_of]
                held[c] = int(running[-1])
                out.append(pa.array(running))
            last = keys[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, *out, pa.array(np.full(batch.num_rows, part, np.int32))], names)

    return run


def running(df: DataFrame, key: str, by: list[str], then: list[Column], kept: list[Column], adds: tuple[str, ...], xors: tuple[str, ...], folder: str) -> DataFrame:
    """Adds run_<c>, the inclusive running total of each column of `adds` (sum) and `xors` (exclusive or) along every key.

    Ranges of `by` are dealt to tasks, so a key with any share of the rows spans several; inside a range rows are sorted
    by `by` and `then` and go by in Arrow batches. What a range hands on to the next is one row a range, gathered and
    sent out again: the number of partitions bounds it. Keys aren't null. `kept` are the columns to go on.
    """
    spark = df.sparkSession
    asc = [F.col(c).asc_nulls_first() for c in by]
    ranged = df.repartitionByRange(*asc).sortWithinPartitions(*asc, *then).select(*kept)
    names = [*ranged.columns, *(f"run_{c}" for c in (*adds, *xors)), "part"]
    schema = StructType([*ranged.schema.fields, *(StructField(f"run_{c}", LongType()) for c in (*adds, *xors)), StructField("part", IntegerType())])
    local = stage(ranged.mapInArrow(_runner(key, adds, xors, names), schema), folder)
    # the key is sorted within a range: its last is the greatest, and with that key the totals of its last row
    count = adds[0]
    ends = (
        local.groupBy("part")
        .agg(F.min(key).alias("first"), F.max(key).alias("last"), F.max_by(F.struct(*(f"run_{c}" for c in (*adds, *xors))), F.struct(key, f"run_{count}")).alias("held"))
        .collect()
    )
    carried, open_key, held = [], None, {}
    for row in sorted(ends, key=lambda r: r["part"]):
        into = held if row["first"] == open_key else {}
        if into:
            carried.append((row["part"], row["first"], *(into[c] for c in (*adds, *xors))))
        if row["last"] != row["first"]:
            into = {}
        open_key = row["last"]
        held = {c: row["held"][f"run_{c}"] + into.get(c, 0) if c in adds else row["held"][f"run_{c}"] ^ into.get(c, 0) for c in (*adds, *xors)}
    carry = spark.createDataFrame(
        carried, StructType([StructField("part", IntegerType()), StructField(key, ranged.schema[key].dataType), *(StructField(f"in_{c}", LongType()) for c in (*adds, *xors))])
    )
    joined = local.join(F.broadcast(carry), ["part", key], "left")
    whole = {f"run_{c}": F.col(f"run_{c}") + F.coalesce(f"in_{c}", F.lit(0)) for c in adds}
    whole |= {f"run_{c}": F.col(f"run_{c}").bitwiseXOR(F.coalesce(f"in_{c}", F.lit(0))) for c in xors}
    return joined.withColumns(whole).drop("part", *(f"in_{c}" for c in (*adds, *xors)))
