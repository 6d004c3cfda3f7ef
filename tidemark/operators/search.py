"""Lexical and vector search."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens

K1, B = 1.5, 0.75
#: Most rows of query and term that are sent to all executors; more are joined by a shuffle.
BROADCAST_TERMS = 100_000
#: Most query vectors that a block of vectors meets in a task.
BROADCAST_VECTORS = 20_000
#: Vectors of a block, and queries that are compared with it at once.
VECTORS_BLOCK, QUERY_ROWS = 20_000, 128
#: Norms between which products of two neither overflow nor lose digits; how far cosines summed in another order may be apart, and more.
SAFE, MARGIN = (1e-100, 1e100), 1e-9


def bm25(docs: DataFrame, queries: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """Rows (query_id, doc_id, score) for documents that share a term with a query.

    docs: doc_id, text; queries: query_id, text. Frequencies are counted over all documents, but only
    terms that some query has are ever shuffled, summed by document where they are read.
    """
    wanted = queries.select("query_id", F.explode(F.array_distinct(tokens("text"))).alias("term"))
    terms = wanted.select("term").distinct()
    few = wanted.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    if few:
        terms, wanted = F.broadcast(terms), F.broadcast(wanted)
    split = docs.select("doc_id", tokens("text").alias("w"))
    size = split.agg(F.count("*").alias("docs"), F.avg(F.size("w")).alias("mean")).first()
    if not size["docs"]:
        return docs.sparkSession.createDataFrame([], "query_id long, doc_id long, score double")
    found = split.select("doc_id", F.size("w").alias("len"), F.explode("w").alias("term")).join(terms, "term")
    tf = found.groupBy("doc_id", "len", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (size["docs"] - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / size["mean"]))
    scored = tf.join(F.broadcast(df) if few else df, "term").select("doc_id", "term", weight.alias("weight"))
    return scored.join(wanted, "term").groupBy("query_id", "doc_id").agg(F.sum("weight").alias("score"))


def reciprocal_rank_fusion(lists: list[DataFrame], k: int = 60) -> DataFrame:
    """Rows (query_id, doc_id, fused) from lists with a rank: the sum of 1 / (k + rank)."""
    both = lists[0].select("query_id", "doc_id", "rank")
    for other in lists[1:]:
        both = both.union(other.select("query_id", "doc_id", "rank"))
    return both.groupBy("query_id", "doc_id").agg(F.sum(1 / (k + F.col("rank"))).alias("fused"))


def ranked(scores: DataFrame, score: str, top: int) -> DataFrame:
    """The best documents of each query with their rank; ties go by doc_id."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col(score).desc(), "doc_id"))
    return scores.withColumn("rank", place).where(F.col("rank") <= top)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def _nearest(k: int):
    """The k best of one block of vectors for each query of one part, by (cosine, NaN first and null last, then vec_id).

    A matrix product finds what can be among the best; cosines that are returned are summed up in the order of `dot`, so they don't
    depend on blocks. Of equal vectors only those that may be among the best are compared.
    """

    def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All values one after another, where each row's begin (with an end), and its length: -1 if it or one of its values is null."""
        size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        flat = pc.list_flatten(column)
        at = np.concatenate([[0], np.cumsum(size)])
        holes = np.concatenate([[0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))])
        whole = column.is_valid().to_numpy(zero_copy_only=False) & (holes[at[1:]] == holes[at[:-1]])
        return pc.fill_null(flat, 0).to_numpy(zero_copy_only=False).astype(np.float64), at, np.where(whole, size, -1)

    def sums(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        total = np.zeros(np.broadcast_shapes(a.shape[:-1], b.shape[:-1]))
        for j in range(a.shape[-1]):
            total += a[..., j] * b[..., j]
        return total

    def work(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        none = pa.table({"query_id": queries.column("query_id").slice(0, 0), "vec_id": vectors.column("vec_id").slice(0, 0), "cosine": pa.array([], pa.float64())})
        if not queries.num_rows or not vectors.num_rows:
            return none
        vectors = vectors.sort_by("vec_id").combine_chunks()
        names = pc.unique(vectors.column("vec_id"))
        code = pc.index_in(vectors.column("vec_id"), value_set=names).to_numpy()
        own = pc.fill_null(pc.index_in(queries.column("query_id"), value_set=names), -1).to_numpy()
        copies = k + int(np.bincount(code).max())  # as many of equal vectors may come before one that is among the best
        values, at, size = matrix(vectors.column("v").combine_chunks())
        asked, from_, wide = matrix(queries.column("q").combine_chunks())
        found = []

        def best(query: int, rows: np.ndarray, cosine: np.ndarray, known: np.ndarray) -> None:
            keep = code[rows] != own[query]
            rows, cosine, known = rows[keep], cosine[keep], known[keep]
            kind = np.where(known, np.where(np.isnan(cosine), 0, 1), 2)
            order = np.lexsort((rows, -np.where(kind == 1, cosine, 0), kind))[:k]
            found.append((np.full(len(order), query), rows[order], cosine[order], known[order]))

        with np.errstate(all="ignore"):
            for d in np.unique(wide).tolist():
                mine = np.flatnonzero(wide == d)
                comparable = np.flatnonzero(size == d) if d >= 0 else np.zeros(0, np.int64)
                nothing = np.flatnonzero(size != d)[:copies] if d >= 0 else np.arange(min(len(size), copies))
                v = values[at[comparable][:, None] + np.arange(max(d, 0))]
                if d > 0 and len(v):  # equal vectors have equal cosines, so the first of them by vec_id are enough
                    same = np.unique(v.view(np.dtype((np.void, 8 * d))).ravel(), return_inverse=True)[1]
                    order = np.argsort(same, kind="stable")
                    starts = np.flatnonzero(np.concatenate([[True], np.diff(same[order]) > 0]))
                    nth = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
                    kept = np.sort(order[nth < copies])
                    comparable, v = comparable[kept], v[kept]
                vn = np.sqrt(sums(v, v))
                plain = (vn > SAFE[0]) & (vn < SAFE[1])
                regular, odd = np.flatnonzero(plain), np.flatnonzero(~plain)
                unit = v[regular] / vn[regular, None]
                for begin in range(0, len(mine), QUERY_ROWS):
                    part = mine[begin : begin + QUERY_ROWS]
                    q = asked[from_[part][:, None] + np.arange(max(d, 0))]
                    qn = np.sqrt(sums(q, q))
                    usual = (qn > SAFE[0]) & (qn < SAFE[1])
                    near = np.where(usual[:, None], q / qn[:, None], 0) @ unit.T
                    own_row = own[part][:, None] == code[comparable[regular]] if len(regular) else np.zeros((len(part), 0), bool)
                    near[own_row] = -np.inf
                    least = np.partition(near, -k, axis=1)[:, -k] if len(regular) > k else np.full(len(part), -np.inf)
                    for i, query in enumerate(part.tolist()):
                        # what is short of the k-th by more than sums can err is not among the best
                        some = regular[near[i] >= least[i] - MARGIN] if usual[i] else regular
                        rows = np.concatenate([some, odd])
                        divisor = vn[rows] * qn[i]
                        cosine = sums(v[rows], q[i][None, :]) / divisor
                        best(query, np.concatenate([comparable[rows], nothing]), np.append(cosine, np.zeros(len(nothing))), np.append(divisor != 0, np.zeros(len(nothing), bool)))
        which, rows, cosine, known = (np.concatenate(c) for c in zip(*found, strict=True))
        return pa.table({"query_id": queries.column("query_id").take(pa.array(which)), "vec_id": vectors.column("vec_id").take(pa.array(rows)), "cosine": pa.array(cosine, mask=~known)})

    return work


def cosine_top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Rows (query_id, vec_id, cosine, rank): the k nearest vectors of each query, without the one of its own id.

    queries: query_id, q; vectors: vec_id, v; rows without an id are left out. Both are dealt to blocks of VECTORS_BLOCK and BROADCAST_VECTORS rows, every
    two blocks meet once in a task, which holds these two, and only the k best of each are shuffled on. A cosine is null where a vector is null,
    holds null, is zero or of another length, and comes last.
    """
    left, right = queries.where("query_id is not null").select("query_id", "q"), vectors.where("vec_id is not null").select("vec_id", "v")
    blocks, parts = (max(1, -(-side.count() // most)) for side, most in ((right, VECTORS_BLOCK), (left, BROADCAST_VECTORS)))
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = left.withColumn("_part", F.pmod(F.xxhash64("query_id"), F.lit(parts))).withColumn("_block", all_of(blocks))
    right = right.withColumn("_block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).withColumn("_part", all_of(parts))
    tasks = max(blocks * parts, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = [side.repartition(tasks, "_block", "_part").groupBy("_block", "_part") for side in (left, right)]
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    scored = dealt[0].cogroup(dealt[1]).applyInArrow(_nearest(k), f"query_id {kind(left, 'query_id')}, vec_id {kind(right, 'vec_id')}, cosine double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("cosine").desc(), "vec_id"))
    return scored.withColumn("rank", place).where(F.col("rank") <= k)


def distinctive_terms(docs: DataFrame, group: str, most_share: float, top: int) -> DataFrame:
    """The terms of highest TF-IDF of each group, without those that more than a share of all documents have."""
    # a document's words meet before they are cut apart, so that its text is shuffled and not its words
    whole = docs.groupBy(group, "doc_id").agg(F.flatten(F.collect_list(tokens("text"))).alias("w"))
    words = F.explode(F.concat(F.transform("w", lambda t: F.struct(t.alias("term"), F.lit(1).alias("tf"), F.lit(0).alias("docs"))), F.transform(F.array_distinct("w"), lambda t: F.struct(t.alias("term"), F.lit(0).alias("tf"), F.lit(1).alias("docs")))))
    per_group = whole.select(group, words.alias("e")).groupBy(group, "e.term").agg(F.sum("e.tf").alias("tf"), F.sum("e.docs").alias("docs"))
    n = docs.count()
    df = per_group.groupBy("term").agg(F.sum("docs").alias("df")).where(F.col("df") <= most_share * n)
    score = F.col("tf") * F.log(F.lit(float(n)) / F.col("df"))
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.col("score").desc(), "term"))
    return per_group.join(df, "term").withColumn("score", score).withColumn("place", place).where(F.col("place") <= top)
