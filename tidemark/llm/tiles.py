"""Work within groups of any size: groups are cut into tiles, and pairs of tiles are the tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def grouped(df: DataFrame, keys: list[str], work: Callable[[pa.Table], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """`work` on the rows of each value of `keys` (whole numbers, never null), a group at a time.

    Rows are dealt out by the keys and sorted within partitions, so Python reads many small groups from
    one Arrow batch and holds one group.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        current = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            values = np.column_stack([batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys])
            edges = np.concatenate([[0], np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1, [len(values)]])
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                key = tuple(values[a].tolist())
                if held and key != current:
                    yield from work(pa.Table.from_batches(held))
                    held = []
                current = key
                held.append(batch.slice(a, b - a))
        if held:
            yield from work(pa.Table.from_batches(held))

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def tile_pairs(rows: DataFrame, group: list[str], ident: str, weight: str, most_weight: int, most_rows: int) -> DataFrame:
    """The rows with columns tile, lo and hi: every two rows of a group meet in one (group, lo, hi) at least.

    A group gets as many tiles as keep about most_weight and most_rows in each; a row goes to the pairs of
    its tile with every tile of the group. A group within the bounds is one tile and its rows go out once.
    The sizes are dealt out anew so that adaptive execution can split a hot group's side of the join.
    """
    sizes = (
        rows.groupBy(*group)
        .agg(F.sum(weight).alias("w"), F.count("*").alias("n"))
        .where("n > 1")
        .select(*group, F.greatest(F.ceil(F.col("w") / most_weight), F.ceil(F.col("n") / most_rows), F.lit(1)).cast("int").alias("tiles"))
        .repartition("tiles", *group[::-1])
    )
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    return (
        rows.join(sizes, group)
        .withColumn("tile", F.pmod(F.xxhash64(ident), F.col("tiles")).cast("int"))
        .withColumn("other", other)
        .withColumns({"lo": F.least("tile", "other"), "hi": F.greatest("tile", "other")})
        .drop("tiles", "other")
    )


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For links between n things, the smallest thing that each is connected with."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = np.minimum(new, new[new])
        if (new == root).all():
            return root
        root = new


class Linker:
    """Union-find over a tile pair, to skip pairs that are connected already."""

    def __init__(self, n: int):
        self.above = list(range(n))

    def top(self, i: int) -> int:
        above = self.above
        while above[i] != i:
            above[i] = above[above[i]]
            i = above[i]
        return i

    def join(self, i: int, j: int) -> bool:
        """Connect the two; False if they were."""
        i, j = self.top(i), self.top(j)
        if i == j:
            return False
        self.above[max(i, j)] = min(i, j)
        return True
