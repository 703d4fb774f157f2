"""Connected components of an edge list, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize


#: Rows of a stored part; small tables are one file, not one for each shuffle partition.
PART = 250_000


def _stored(df: DataFrame, name: str, rows: int) -> DataFrame:
    return materialize(df.coalesce(max(1, -(-rows // PART))), name)


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every endpoint of the edges (a, b): label is the least node of its
    component. Each round hooks every node to its neighbour of the least hash, drawn anew each round,
    follows the hooks twice and contracts the graph: whatever its shape, at most half of the nodes with
    edges are expected to remain. It ends when no edge is left."""
    live = _stored(edges.select("a", "b").filter("a <> b").distinct(), "edges", edges.count())
    found: DataFrame | None = None
    nodes = turn = 0
    while n := live.count():
        nodes, turn = nodes or 2 * n, turn + 1
        drawn = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("node"))  # noqa: E731, B023
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min(drawn("b")).alias("least")).select(F.col("a").alias("node"), F.least("least", drawn("a"))["node"].alias("to"))
        hook = _stored(hook, "hooks", 2 * n)
        for _ in range(2):
            up = hook.select(F.col("node").alias("to"), F.col("to").alias("next"))
            hook = _stored(hook.join(up, "to", "left").select("node", F.coalesce("next", "to").alias("to")), "hooks", 2 * n)
        if found is None:
            found = hook.withColumnRenamed("to", "label")
        else:
            step = hook.select(F.col("node").alias("label"), "to")
            found = found.join(step, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        found = _stored(found, "labels", nodes)
        left, right = hook.select(F.col("node").alias("a"), F.col("to").alias("x")), hook.select(F.col("node").alias("b"), F.col("to").alias("y"))
        live = _stored(live.join(left, "a").join(right, "b").select(F.col("x").alias("a"), F.col("y").alias("b")).filter("a <> b").distinct(), "edges", n)
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("label")).limit(0)
    least = found.groupBy("label").agg(F.min("node").alias("least"))
    return found.join(least, "label").select("node", F.col("least").alias("label"))
