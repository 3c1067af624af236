"""Bounded walks over an edge table ``(src, dst)`` and components by least label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrain.session import cut_lineage
from loomgrain.skew import hot_join, hot_keys


def reach(edges: DataFrame, seeds: DataFrame, depth: int, keep_every: int = 3) -> DataFrame:
    """``(seed, node, hops)``: nodes within ``depth`` steps of each seed, with the fewest hops; the seed itself has 0.

    One join per step with the front of newly met nodes only; it ends early when the front is empty.
    """
    found = seeds.select(F.col("node").alias("seed"), "node").distinct().withColumn("hops", F.lit(0).cast("long"))
    front = found
    steps = edges.select(F.col("src").alias("node"), F.col("dst").alias("next")).where("node is not null and next is not null").distinct()
    for hop in range(1, depth + 1):
        met = front.join(steps, "node").select("seed", F.col("next").alias("node")).distinct()
        front = met.join(found.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("hops", F.lit(hop).cast("long"))
        front = cut_lineage(front)
        if front.isEmpty():
            break
        found = found.unionByName(front)
        if hop % keep_every == 0:
            found = cut_lineage(found)
    return found


def forward_propagate(edges: DataFrame, sources: DataFrame, depth: int = 5) -> DataFrame:
    """``(node, origin, hops)``: nodes that a source reaches, with the nearest source's origin (ties: the least seed).

    ``sources(node, origin)``. One front for all sources together: a node is met once, so rows never exceed nodes.
    """
    steps = edges.select(F.col("src").alias("node"), F.col("dst").alias("next")).where("node is not null and next is not null").distinct()
    front = sources.where("node is not null").groupBy("node").agg(F.min(F.struct(F.col("node").alias("seed"), "origin")).alias("by"))
    front = found = cut_lineage(front.withColumn("hops", F.lit(0).cast("long")))
    for hop in range(1, depth + 1):
        met = front.join(steps, "node").groupBy(F.col("next").alias("node")).agg(F.min("by").alias("by"))
        front = cut_lineage(met.join(found.select("node"), "node", "left_anti").withColumn("hops", F.lit(hop).cast("long")))
        if front.isEmpty():
            break
        found = found.unionByName(front)
        if hop % 3 == 0:
            found = cut_lineage(found)
    return found.select("node", F.col("by.origin").alias("origin"), "hops")


def backward_resolve(edges: DataFrame, sinks: DataFrame, sources: DataFrame, depth: int = 10) -> DataFrame:
    """``(sink, source, origin, path_length)``: sources within fewer than ``depth`` calls above each sink."""
    turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    met = reach(turned, sinks, depth - 1)
    hit = met.join(sources, "node")
    return hit.select(F.col("seed").alias("sink"), F.col("node").alias("source"), "origin", (F.col("hops") + 1).alias("path_length"))


def path_exists(edges: DataFrame, asked: DataFrame, depth: int = 10) -> DataFrame:
    """``(a, b, connected)`` for each asked pair, within ``depth`` steps."""
    met = reach(edges, asked.select(F.col("a").alias("node")), depth)
    hit = met.select(F.col("seed").alias("a"), F.col("node").alias("b"), F.lit(True).alias("hit"))
    return asked.join(hit, ["a", "b"], "left").select("a", "b", F.coalesce("hit", F.lit(False)).alias("connected"))


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)``: the least node connected with each. Labels jump to their label's label, so rounds are few."""
    both = edges.where("src is not null and dst is not null").select("src", "dst")
    both = cut_lineage(both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    labels = cut_lineage(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("label")))
    hubs = hot_keys(both, "dst")
    while True:
        # a hub, and the label of a giant group, are met by broadcast of their few rows
        seen = hot_join(both, labels.withColumnRenamed("node", "dst"), "dst", hot=hubs).groupBy("src").agg(F.min("label").alias("seen"))
        step = cut_lineage(labels.join(seen, labels.node == seen.src).select("node", F.least("label", "seen").alias("new"), F.col("label").alias("old")))
        jump = step.select(F.col("node").alias("new"), F.col("new").alias("far"))
        step = cut_lineage(hot_join(step, jump, "new", "left").select("node", "old", F.least("new", F.coalesce("far", "new")).alias("label")))
        changed = step.where("old != label").limit(1).count()
        labels = step.select("node", "label")
        if not changed:
            return labels


def merge_graphs(nodes: DataFrame, edges: DataFrame, more_nodes: DataFrame, more_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two graphs as one: ``nodes(id, key, ...)`` and ``edges(src, dst, kind)`` by id. Nodes of one key become the first graph's node, others
    get ids above its greatest, and the edges follow; equal edges count once."""
    base = nodes.agg(F.coalesce(F.max("id"), F.lit(-1))).scalar()
    lowest = more_nodes.agg(F.coalesce(F.min("id"), F.lit(0))).scalar()
    known = nodes.groupBy("key").agg(F.min("id").alias("known"))
    named = more_nodes.groupBy("key").agg(F.min("id").alias("own"))
    target = named.join(known, "key", "left").select("key", F.coalesce("known", F.col("own") - lowest + base + 1).alias("to"), F.col("known").isNull().alias("fresh"))
    renamed = cut_lineage(more_nodes.join(target, "key"))
    ids = renamed.select(F.col("id").alias("old"), "to")
    extra = renamed.where("fresh").drop("id", "fresh").withColumnRenamed("to", "id").dropDuplicates(["id"]).select(*nodes.columns)
    moved = more_edges.join(ids.withColumnsRenamed({"old": "src", "to": "_s"}), "src").join(ids.withColumnsRenamed({"old": "dst", "to": "_d"}), "dst").select(F.col("_s").alias("src"), F.col("_d").alias("dst"), "kind")
    return nodes.unionByName(extra), edges.select("src", "dst", "kind").unionByName(moved).distinct()
