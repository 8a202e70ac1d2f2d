"""Connected components of an edge table by rounds of contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); nodes of one component get one root.

    Each round every node hooks onto the neighbour (or itself) of least hashed rank, edges are rewritten to
    the hooks and loops and repeats are dropped. Ranks are hashed anew each round, so a constant share of the
    nodes goes, whatever the shape of the graph. Only minima by node are gathered, so a hub with very many
    edges is pre-aggregated like any other. Hooks of all rounds are composed from the last to the first.
    """
    live = written(edges.where("a <> b").select("a", "b").distinct(), "edges")
    hooks: list[DataFrame] = []
    while not live.isEmpty():
        if len(hooks) == rounds:
            raise RuntimeError("components did not settle")
        salt = F.lit(len(hooks))
        rank = lambda c: F.struct(F.xxhash64(F.col(c), salt).alias("r"), F.col(c).alias("n"))
        both = live.select("a", "b").unionAll(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(rank("b")).alias("m"))
        hook = written(least.select(F.col("a").alias("node"), F.least(F.col("m"), rank("a"))["n"].alias("to")), "hooks")
        hooks.append(hook)
        at = lambda c: hook.select(F.col("node").alias(c), F.col("to").alias(f"{c}2"))
        moved = live.join(at("a"), "a").join(at("b"), "b").where("a2 <> b2")
        live = written(moved.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), "edges")
    if not hooks:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).where("false")
    roots = hooks[-1].select("node", F.col("to").alias("root"))
    for hook in reversed(hooks[:-1]):
        later = roots.select(F.col("node").alias("to"), F.col("root").alias("later"))
        roots = hook.join(later, "to", "left").select("node", F.coalesce("later", "to").alias("root"))
    return roots
