"""Bounded walks over causal edges, trees, beams and components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def walk(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """Paths of at most `hops` edges without a node twice: start, node, hop, effect (product of strengths), path.

    edges: source, target, strength; starts: node. Each hop is a join; a walk is bounded by its hops, and the
    strongest edges of a node should have been chosen before.
    """
    front = starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("hop"), F.lit(1.0).alias("effect"), F.array("node").alias("path"))
    found = None
    for hop in range(1, hops + 1):
        step = front.join(edges, F.col("node") == F.col("source")).where(~F.array_contains("path", F.col("target")))
        front = step.select(
            "start", F.col("target").alias("node"), F.lit(hop).alias("hop"), (F.col("effect") * F.col("strength")).alias("effect"), F.concat("path", F.array("target")).alias("path")
        )
        found = front if found is None else found.union(front)
    return found


def ripples(paths: DataFrame, magnitude: float, months_per_hop: float, least_probability: float, least_significance: float) -> DataFrame:
    """Significance of every path: magnitude by effect, damped by lag, without what is improbable or faint."""
    significance = F.abs(F.lit(magnitude) * F.col("effect")) * 20 / (1 + F.log1p(F.col("hop") * F.lit(months_per_hop)))
    rows = paths.withColumn("significance", significance)
    return rows.where((F.abs("effect") >= least_probability) & (F.col("significance") >= least_significance))


def tree(nodes: DataFrame, depth: int, lag_weight: float = 1.0) -> DataFrame:
    """All descendants of the roots of a forest, at most `depth` levels down: what reaches each, and when.

    nodes: node, parent (null for a root), magnitude, probability, lag, elasticity (null counts 1). Gives node, root, level, chance
    (product of probabilities), delay (sum of lags), effect and significance. One recursive query, whose steps are joins on the
    parent; the session's limit on the rows of a recursion is lifted, as a result cut short would be wrong.
    """
    spark = nodes.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    return spark.sql(
        f"""WITH RECURSIVE below(node, root, level, chance, delay, effect) MAX RECURSION LEVEL {int(depth) + 1} AS (
            SELECT node, node, 1, probability, lag, magnitude * probability * coalesce(elasticity, 1D) FROM {{nodes}} WHERE parent IS NULL
            UNION ALL
            SELECT n.node, b.root, b.level + 1, b.chance * n.probability, b.delay + n.lag, n.magnitude * b.chance * n.probability * coalesce(n.elasticity, 1D)
            FROM {{nodes}} n JOIN below b ON n.parent = b.node WHERE b.level < {int(depth)})
        SELECT *, abs(effect) * 20 / (1 + ln(1 + {float(lag_weight)}D * delay)) AS significance FROM below""",
        nodes=nodes,
    )


#: Scores that differ beyond these digits are equal in a beam; the lesser node comes first.
FINE = 1e15


def beam(edges: DataFrame, starts: DataFrame, hops: int, width: int) -> DataFrame:
    """(start, hop, node, score, place): after every hop the `width` best nodes of each start, which alone go on.

    A node's score is the sum over the beam before of score times strength. edges: source, target, strength; starts: node. So the
    front is bounded by starts times width, however many edges a node has. Edges and what each hop gives are written to the shared folder, so
    that a hop doesn't walk those before it again.
    """
    edges = staged(edges.select("source", "target", "strength"))
    place = F.row_number().over(Window.partitionBy("start").orderBy(F.floor(F.col("score") * FINE + 0.5).desc(), "node"))
    front = starts.select(F.col("node").alias("start"), "node", F.lit(1.0).alias("score"))
    found = None
    for hop in range(1, hops + 1):
        step = front.join(edges, F.col("node") == F.col("source")).groupBy("start", F.col("target").alias("node")).agg(F.sum(F.col("score") * F.col("strength")).alias("score"))
        best = staged(step.withColumn("place", place).where(F.col("place") <= width))
        front = best.select("start", "node", "score")
        kept = best.select("start", F.lit(hop).alias("hop"), "node", "score", "place")
        found = kept if found is None else found.unionAll(kept)
    return found


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node that it is connected with.

    Stars by turns: neighbours above a node are hung on the smallest around it, then those below it. A minimum is folded where
    edges are read, so a node may have any number of them. Each round is a checkpoint in the shared folder.
    """
    rows = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    rows, held = checkpointed(rows), -1
    for _ in range(most_rounds):
        both = rows.unionAll(rows.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        rows = checkpointed(small)
        # done when every node hangs on one that hangs on nothing
        size = rows.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (size["n"], size["h"]) == held:
            break
        held = (size["n"], size["h"])
    else:
        raise RuntimeError(f"not settled after {most_rounds} rounds")
    tops = rows.select(F.col("v").alias("node")).distinct()
    return rows.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(tops.select("node", F.col("node").alias("component")))


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints that the session names; a local session without one gets a folder of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Lineage cut in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def staged(df: DataFrame) -> DataFrame:
    """Lineage cut by a table written to the shared folder: computed once, where a checkpoint computes its last stage twice."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
