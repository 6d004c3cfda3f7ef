"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def _contract(edges: DataFrame, folder: str | None) -> tuple[DataFrame, DataFrame]:
    """A step down: every node (u) with one not larger than it that it is connected with (p), and the edges between those.

    A node takes its smallest neighbour, and then what that one took. The minimum is summed where the edges
    are read, so it doesn't matter how many a node has; the tables between are written, so that
    each side of a join has an exchange of its own and adaptive execution can split one of a node with very many edges.
    """
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    taken = stage(both.groupBy("u").agg(F.min("v").alias("p")).select("u", F.least("u", "p").alias("p")), folder)
    then = taken.select(F.col("u").alias("p"), F.col("p").alias("pp"))
    parent = stage(taken.join(then, "p").select("u", F.col("pp").alias("p")), folder)
    moved = edges.join(parent.withColumnRenamed("p", "pu"), "u").join(parent.select(F.col("u").alias("v"), F.col("p").alias("pv")), "v")
    left = moved.where("pu <> pv").select(F.greatest("pu", "pv").alias("u"), F.least("pu", "pv").alias("v")).distinct()
    return parent, stage(left, folder)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, folder: str | None = None) -> DataFrame:
    """Rows (node, component) for every node of an edge; component is its smallest reachable node.

    The graph is contracted until no edge is left, each time to half of its nodes at most; the smallest node of a
    component always stays. Then what every node was contracted to is looked up from the last step back to
    the first. The tables between go to `folder` if one is given. Null ends and loops are ignored; no edge gives no row.
    """
    edges = stage(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
        .distinct(),
        folder,
    )
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).limit(0)
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        if len(steps) == max_rounds:
            raise RuntimeError(f"edges are left after {max_rounds} rounds")
        parent, edges = _contract(edges, folder)
        steps.append(parent)
    for k, step in enumerate(reversed(steps)):
        if k == 0:
            found = step.select(F.col("u").alias("node"), F.col("p").alias("component"))
        else:
            last = found.select(F.col("node").alias("p"), "component")
            found = step.join(last, "p", "left").select(F.col("u").alias("node"), F.coalesce("component", "p").alias("component"))
    return found
