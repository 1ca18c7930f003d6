"""Graph operators on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.storage import materialize, remove


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(vertex, component) for every vertex of an undirected edge table.

    ``component`` is the smallest vertex reachable.  Each round points every
    vertex at the smallest vertex next to it, follows the pointers twice, and
    contracts the edges to the vertices pointed at, so the graph shrinks
    geometrically and even a long path takes a logarithmic number of rounds.
    The minimum is a combinable aggregate and the joins are plain equi-joins that
    adaptive execution can split, so a vertex with very many edges is no hot
    task.  Nothing is collected; every round is a table in the shared folder, so
    a lost executor costs one round at most.  Null endpoints are ignored; a
    self-loop makes its vertex known.  An empty table gives an empty one."""
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    current = materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    vertices = materialize(current.select(F.explode(F.array("a", "b")).alias("vertex")).distinct(), "vertices")
    current_loops_free = current.filter("a <> b")
    rounds: list[DataFrame] = []
    spent = [current]
    live = current_loops_free
    while not live.isEmpty():
        both = live.select("a", "b").unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("p"))
        parent = materialize(parent, "parents")
        spent.append(parent)
        for _ in range(2):
            up = parent.select(F.col("v").alias("p"), F.col("p").alias("pp"))
            parent = parent.join(up, "p", "left").select("v", F.coalesce("pp", "p").alias("p"))
        parent = materialize(parent, "parents")
        rounds.append(parent)
        left = parent.select(F.col("v").alias("a"), F.col("p").alias("pa"))
        right = parent.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        moved = live.join(left, "a").join(right, "b").filter("pa <> pb")
        shrunk = materialize(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
        spent.append(shrunk)
        live = shrunk
    labels = vertices.select("vertex", F.col("vertex").alias("component"))
    for parent in rounds:
        step = parent.select(F.col("v").alias("component"), F.col("p").alias("_next"))
        labels = labels.join(step, "component", "left").select("vertex", F.coalesce("_next", "component").alias("component"))
    out = materialize(labels, "components")
    for df in [*spent, *rounds, vertices]:
        remove(df.sparkSession, df)
    return out
