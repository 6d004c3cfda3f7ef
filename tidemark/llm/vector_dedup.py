"""Near-duplicate vectors by a pivot-permutation index."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint
from .components import connected_components
from .tiles import forest, grouped, tile_pairs

COSINE = 0.98
#: Nearest pivots that describe a vector, and how many of them two candidates share at least.
NEAREST = 8
SHARED = 2
#: Pivots: twice the root of the number of distinct vectors within these bounds, so that lists grow with the root too. The most
#: are reached at 67 million vectors and take some MB; lists of any length are verified whole beyond that.
FEWEST, MOST = 64, 1 << 14
#: Vectors that are compared with all pivots in one go.
BLOCK = 256
TILE_ROWS = 700


def numbers(embeddings: DataFrame) -> Column:
    """The embedding as 32-bit floats if the table holds such, which lose nothing, else as double ones."""
    own = embeddings.schema["embedding"].dataType.simpleString() == "array<float>"
    return F.col("embedding") if own else F.col("embedding").cast("array<double>")


def distinct_vectors(embeddings: DataFrame) -> DataFrame:
    """One row per label and distinct usable vector: label, vector, rep (smallest vec_id), copies."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = finite & F.exists("embedding", lambda x: x != 0)
    return (
        embeddings.where("label is not null and vec_id is not null and embedding is not null")
        .where(usable)
        .groupBy(F.col("label").cast("long").alias("label"), numbers(embeddings).alias("vector"))
        .agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    )


def index(vectors: DataFrame, pivots: np.ndarray, nearest: int) -> DataFrame:
    """The inverted lists: a row (label, dim, pivot, rep, copies, near, vector) for each of a vector's nearest pivots."""
    pivots = pivots / np.linalg.norm(pivots, axis=1, keepdims=True)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vector = batch.column(3)
            sizes = np.asarray(vector.value_lengths())
            flat = vector.flatten().to_numpy(zero_copy_only=False)
            at = np.concatenate([[0], np.cumsum(sizes)])
            near = np.zeros((len(sizes), nearest), np.int32)
            for dim in np.unique(sizes):
                mine = np.flatnonzero(sizes == dim)
                x = flat[at[mine][:, None] + np.arange(dim)].astype(np.float64)
                x = x / np.linalg.norm(x / np.abs(x).max(axis=1, keepdims=True), axis=1, keepdims=True)
                width = min(dim, pivots.shape[1])  # vectors of another length are described by what they have
                for a in range(0, len(mine), BLOCK):
                    far = -(x[a : a + BLOCK, :width] @ pivots[:, :width].T)
                    near[mine[a : a + BLOCK]] = np.argpartition(far, nearest - 1, axis=1)[:, :nearest]
            count = len(sizes) * nearest
            lists = pa.FixedSizeListArray.from_arrays(pa.array(np.repeat(np.sort(near, axis=1), nearest, axis=0).ravel()), nearest)
            again = pa.array(np.repeat(np.arange(len(sizes)), nearest))
            columns = [batch.column(0), pa.array(sizes, pa.int32()), None, batch.column(1), batch.column(2), None, vector]
            arrays = [c.take(again) if c is not None else None for c in columns]
            arrays[2], arrays[5] = pa.array(near.ravel()), lists.cast(pa.list_(pa.int32()))
            assert len(arrays[2]) == count
            yield pa.RecordBatch.from_arrays(arrays, names=["label", "dim", "pivot", "rep", "copies", "near", "vector"])

    kind = vectors.schema["vector"].dataType.simpleString()
    return vectors.select("label", "rep", "copies", "vector").mapInArrow(
        run, f"label long, dim int, pivot int, rep long, copies long, near array<int>, vector {kind}"
    )


def _verify(cosine: float, shared: int):
    """Links of one pair of tiles of one list: rows (rep, other, links).

    A pair belongs to the smallest pivot that both vectors have, so it is counted once over all lists.
    Rows with links say how many vectors a vector is linked with here; the others are edges of a forest.
    """

    def work(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        column = lambda name: rows.column(name).to_numpy()
        lo, hi, tile = int(column("lo")[0]), int(column("hi")[0]), column("tile")
        pivot, rep, copies = int(column("pivot")[0]), column("rep"), column("copies")
        order = np.lexsort((rep, tile))
        rep, copies, tile = rep[order], copies[order], tile[order]
        flatten = lambda name: rows.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(order), -1)[order]
        x, near = flatten("vector").astype(np.float64), flatten("near")
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        names, place = np.unique(near, return_inverse=True)
        held = np.zeros((len(x), len(names)), np.float32)
        held[np.arange(len(x))[:, None], place.reshape(near.shape)] = 1
        earlier = held[:, names < pivot]
        first = np.flatnonzero(tile == lo)
        second = first if lo == hi else np.flatnonzero(tile == hi)
        links = np.zeros(len(x), np.int64)
        left, right = [], []
        for a in range(0, len(first), 256):
            mine = first[a : a + 256]
            found = held[mine] @ held[second].T >= shared
            if earlier.shape[1]:
                found &= earlier[mine] @ earlier[second].T == 0
            if lo == hi:
                found &= mine[:, None] < second[None, :]
            if not found.any():
                continue
            found &= x[mine] @ x[second].T >= cosine
            i, j = np.nonzero(found)
            i, j = mine[i], second[j]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            left.append(i)
            right.append(j)
        if not left:
            return
        root = forest(len(x), np.concatenate(left), np.concatenate(right))
        linked, child = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(x)))
        names = ["rep", "other", "links"]
        yield pa.RecordBatch.from_arrays([pa.array(rep[linked]), pa.nulls(len(linked), pa.int64()), pa.array(links[linked])], names=names)
        yield pa.RecordBatch.from_arrays([pa.array(rep[child]), pa.array(rep[root[child]]), pa.array(np.zeros(len(child), np.int64))], names=names)

    return work


def link_vectors(embeddings: DataFrame, cosine: float = COSINE, nearest: int = NEAREST, shared: int = SHARED) -> DataFrame:
    """One row per row of the table: vec_id, n_links, component_id, kept.

    Equal vectors of a label are one class; only classes are compared, and n_links counts the vectors behind them.
    Pivots are a bounded sample, every class is indexed in the lists of its nearest pivots, and two
    classes of a list that share `shared` pivots are verified by cosine in double precision. Lists of any
    length are verified in tiles. Vectors that are null or zero, or hold null or non-finite parts, that
    have no label or another length link with nothing, as do rows without a vec_id (component null, not
    kept). An empty table gives no row.
    """
    vectors = checkpoint(distinct_vectors(embeddings))
    wanted = int(min(max(FEWEST, 2 * vectors.count() ** 0.5), MOST))
    sample = vectors.orderBy(F.xxhash64("rep", F.lit(6)), "rep").limit(wanted).select("vector").collect()
    if not sample:
        return embeddings.select(
            "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept")
        )
    width = max(len(r["vector"]) for r in sample)
    pivots = np.array([r["vector"] for r in sample if len(r["vector"]) == width])
    nearest = min(nearest, len(pivots))
    lists = index(vectors, pivots, nearest)
    group = ["label", "dim", "pivot"]
    tiled = tile_pairs(lists.withColumn("one", F.lit(1)), group, "rep", "one", TILE_ROWS, TILE_ROWS).drop("one")
    found = checkpoint(grouped(tiled, [*group, "lo", "hi"], _verify(cosine, min(shared, nearest)), "rep long, other long, links long"))

    links = found.where("other is null").groupBy("rep").agg(F.sum("links").alias("links"))
    components = connected_components(found.where("other is not null"), "rep", "other")
    classes = (
        vectors.join(links, "rep", "left")
        .join(components.select(F.col("node").alias("rep"), "component"), "rep", "left")
        .select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
        .repartition("component_id", "vector")
    )
    rows = embeddings.select("vec_id", F.col("label").cast("long").alias("label"), numbers(embeddings).alias("vector"))
    rows = rows.withColumn("vector", F.when(F.col("vec_id").isNotNull(), F.col("vector")))
    component = F.coalesce("component_id", "vec_id")
    return rows.join(classes, ["label", "vector"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"),
    )
