"""Connected components by hooking, pointer jumping and contraction, all as joins of small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise, salted_join


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable.

    Each round every node hooks to its smallest neighbour if that is smaller, chains of hooks are
    followed to their ends, and the edges between the ends are the next round's graph, which has at
    most half of its nodes left. Loops, repeated and null edges are ignored. Joins on roots and on ends are
    salted, as most nodes of a giant component have one root.
    """
    live = edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).filter("lo <> hi").distinct()
    live = materialise(live)
    labels = None
    while not live.isEmpty():
        both = live.select(F.col("lo").alias("node"), F.col("hi").alias("near")).unionByName(live.select(F.col("hi").alias("node"), F.col("lo").alias("near")))
        hooks = materialise(both.groupBy("node").agg(F.least("node", F.min("near")).alias("root")))
        while True:
            ends = hooks.select(F.col("node").alias("root"), F.col("root").alias("_r"))
            jumped = materialise(salted_join(hooks, ends, "root").select("node", F.col("_r").alias("root"), (F.col("_r") != F.col("root")).alias("moved")))
            hooks = jumped.select("node", "root")
            if jumped.filter("moved").isEmpty():
                break
        if labels is None:
            labels = hooks
        else:
            later = hooks.select(F.col("node").alias("root"), F.col("root").alias("_r"))
            labels = materialise(salted_join(labels, later, "root", "left").select("node", F.coalesce("_r", "root").alias("root")))
        low = hooks.select(F.col("node").alias("lo"), F.col("root").alias("_a"))
        high = hooks.select(F.col("node").alias("hi"), F.col("root").alias("_b"))
        live = salted_join(materialise(salted_join(live, low, "lo")), high, "hi").filter("_a <> _b").select(F.least("_a", "_b").alias("lo"), F.greatest("_a", "_b").alias("hi")).distinct()
        live = materialise(live)
    if labels is None:
        return live.select(F.col("lo").alias("node"), F.col("hi").alias("component"))
    return labels.select("node", F.col("root").alias("component"))
