"""Connected components of an edge table by rounds of contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Stage, spread_join


def connected_components(links: DataFrame, stage: Stage) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): component is the smallest node reachable.

    Nodes get a random order (a bijective hash of their ids). In every round each node names the first node
    around it, itself included, and goes on to what that one names; edges are then drawn between the named nodes,
    and loops and repeats fall away. Random order makes long chains and wide stars alike shrink by a factor each
    round. Every round is written as stage tables; only the number of edges left comes to the driver. A hub's
    edges are dealt to several tasks. Nulls are not nodes; loops and repeated edges do no harm; no edges give no rows.
    """
    pairs = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    nodes = stage.keep(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("at", F.xxhash64("node")), "nodes")
    edges = stage.keep(pairs.select(*_ordered(F.xxhash64("a"), F.xxhash64("b"))).distinct(), "edges")
    rounds = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        named = stage.keep(both.groupBy("u").agg(F.least("u", F.min("v")).alias("to")), "named")
        onward = spread_join(named, named.select(F.col("u").alias("to"), F.col("to").alias("next")), "to", "u").select("u", F.col("next").alias("to"))
        onward = stage.keep(onward, "onward")
        half = stage.keep(spread_join(edges, onward, "u", "v").select(F.col("to").alias("x"), F.col("v").alias("u")), "half")
        less = spread_join(half, onward, "u", "x").where("x <> to").select(*_ordered(F.col("x"), F.col("to"))).distinct()
        less = stage.keep(less, "edges")
        stage.drop(named, half, edges)
        rounds.append(onward)
        edges = less
    # where each node ends
    for k, onward in enumerate(rounds):
        nodes = nodes.join(onward.select(F.col("u").alias("at"), F.col("to").alias(f"to{k}")), "at", "left").select("node", F.coalesce(f"to{k}", "at").alias("at"))
    ended = stage.keep(nodes, "ended")
    least = ended.groupBy("at").agg(F.min("node").alias("component"))
    labels = stage.keep(spread_join(ended, least, "at", "node").select("node", "component"), "labels")
    stage.drop(ended, edges, *rounds)
    return labels


def _ordered(x, y):
    return F.least(x, y).alias("u"), F.greatest(x, y).alias("v")
