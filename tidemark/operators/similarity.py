"""Joins of sets that have much in common, by prefixes of their rarest members."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import staged

#: A member that makes up this share of all memberships is known as common; there are fewer than its inverse of them.
COMMON = 1 / 4096
#: Sets of a group that one task compares with as many others.
TILE = 400
#: Members that sets are compared by at once.
COLUMNS = 2048
#: Rows that a task of pairs of tiles is given.
TASK_ROWS = 50_000


def prefixes(sets: DataFrame, overlap: int, jaccard: float) -> DataFrame:
    """(grp, member, id, members, n): each set once for every member of its prefix, rarest first.

    sets: (id, grp, members), members without repeats. Two sets of a group that have enough in common share a member of both
    prefixes, whatever the order of members is, as long as it is one for all: here common members come last by how common they are,
    and the others in an order of their own. So a member that all sets have is in no prefix but of sets that have nothing rarer.
    """
    each = sets.select("id", "grp", F.explode("members").alias("member"))
    total = each.count()
    common = each.groupBy("grp", "member").agg(F.count("*").alias("often")).where(F.col("often") >= max(2.0, total * COMMON))
    ranked = each.join(F.broadcast(common), ["grp", "member"], "left").select("id", "grp", F.struct(F.coalesce("often", F.lit(0)).alias("often"), F.xxhash64("member").alias("h"), "member").alias("m"))
    whole = ranked.groupBy("id", "grp").agg(F.transform(F.array_sort(F.collect_list("m")), lambda m: m["member"]).alias("members"))
    needed = F.greatest(F.lit(overlap), F.ceil(F.lit(jaccard) * F.size("members") - 1e-9))
    sized = whole.withColumn("n", F.size("members")).withColumn("first", (F.col("n") - needed + 1).cast("int")).where("first > 0")
    return sized.select("grp", "id", "members", "n", F.explode(F.slice("members", F.lit(1), F.col("first"))).alias("member"))


def _compare(overlap: int, jaccard: float, forest: bool):
    """Pairs of the sets of one (grp, member, lo, hi) after another; rows come sorted by those, a set's members in the order of all.

    A pair is given under the first member that both have, which is in both prefixes, and nowhere else.
    """

    def products(sets: list[list], place: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many members each left set has in common with each right one, and how many of those stand before `place` in the left one."""
        names: dict[object, int] = {}
        codes = np.array([names.setdefault(m, len(names)) for s in sets for m in s])
        size = np.array([len(s) for s in sets])
        row = np.repeat(np.arange(len(sets)), size)
        early = np.arange(len(codes)) - np.repeat(np.cumsum(size) - size, size) < np.repeat(place, size)
        order = np.argsort(codes, kind="stable")
        common, before = (np.zeros((len(left), len(right)), np.int64) for _ in range(2))
        for first in range(0, len(names), COLUMNS):  # so that what is held is bounded by the sets
            part = order[slice(*np.searchsorted(codes, [first, first + COLUMNS], sorter=order))]
            cells, head = (np.zeros((len(sets), COLUMNS), np.float32) for _ in range(2))
            cells[row[part], codes[part] - first] = 1
            head[row[part], codes[part] - first] = early[part]
            common += (cells[left] @ cells[right].T).astype(np.int64)
            before += (head[left] @ cells[right].T).astype(np.int64)
        return common, before

    def work(rows: list[tuple], member: object) -> pa.RecordBatch | None:
        ids = np.array([r[3] for r in rows], np.int64)
        tile = np.array([r[2] for r in rows])
        sets = [r[4] for r in rows]
        size = np.array([len(s) for s in sets])
        place = np.array([s.index(member) for s in sets])
        left = np.flatnonzero(tile == rows[0][0])
        right = left if rows[0][0] == rows[0][1] else np.flatnonzero(tile == rows[0][1])
        if not len(left) or not len(right):
            return None
        common, before = products(sets, place, left, right)
        n, m = size[left][:, None], size[right][None, :]
        near = (before == 0) & (common >= overlap) & (common >= jaccard * (n + m - common) - 1e-9) & (ids[left][:, None] != ids[right][None, :])
        if rows[0][0] == rows[0][1]:
            near &= ids[left][:, None] < ids[right][None, :]
        i, j = np.nonzero(near)
        if forest:
            above = list(range(len(rows)))

            def top(k: int) -> int:
                while above[k] != k:
                    above[k] = above[above[k]]
                    k = above[k]
                return k

            linking = []
            for k, (x, y) in enumerate(zip(left[i].tolist(), right[j].tolist(), strict=True)):
                one, other = top(x), top(y)
                if one != other:
                    above[max(one, other)] = min(one, other)
                    linking.append(k)
            i, j = i[linking], j[linking]
        if not len(i):
            return None
        one, other = ids[left[i]], ids[right[j]]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(one, other)), pa.array(np.maximum(one, other)), pa.array(common[i, j])], ["a", "b", "common"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def put() -> Iterator[pa.RecordBatch]:
            found = work(held, key[1]) if len(held) > 1 else None
            if found is not None:
                yield found

        for batch in batches:
            for row in batch.to_pylist():
                now = (row["grp"], row["member"], row["lo"], row["hi"])
                if now != key:
                    yield from put()
                    key, held = now, []
                held.append((row["lo"], row["hi"], row["tile"], row["id"], row["members"]))
        yield from put()

    return run


def similar_sets(sets: DataFrame, overlap: int = 1, jaccard: float = 0.0, forest: bool = False, tile: int = TILE) -> DataFrame:
    """(a, b, common): pairs of sets of one group with at least `overlap` members in common and that Jaccard similarity, a < b.

    sets: (id (long), grp, members), one row an id; nulls are left out. Sets meet only in the prefixes of both. A member that
    very many prefixes hold is cut into tiles whose pairs are the tasks, dealt to as many partitions as their rows ask for. A pair comes out of one
    task only, so pairs are neither shuffled nor held. With `forest` a pair that is connected already within a task isn't given: enough links for components.
    """
    given = sets.where("id is not null and grp is not null and members is not null").select(F.col("id").cast("long").alias("id"), "grp", F.array_distinct(F.array_compact("members")).alias("members"))
    rows = staged(prefixes(given, overlap, jaccard))
    large = rows.groupBy("grp", "member").agg(F.count("*").alias("c")).where("c > 1").select("grp", "member", "c", F.ceil(F.col("c") / tile).cast("int").alias("tiles"))
    cut = rows.join(large, ["grp", "member"]).withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumns({"lo": F.least("tile", "other"), "hi": F.greatest("tile", "other")})
    key = ["grp", "member", "lo", "hi"]
    # a row meets all tiles of its member
    met_rows = large.agg(F.sum(F.col("c") * F.col("tiles"))).first()[0] or 0
    partitions = max(met_rows // TASK_ROWS, int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = cut.select(*key, "tile", "id", "members").repartition(partitions, *key).sortWithinPartitions(*key)
    return dealt.mapInArrow(_compare(overlap, jaccard, forest), "a long, b long, common long")
