"""Exact joins of sets by overlap: rarest members first, so common ones form no pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrain.functions import similarity as M
from loomgrain.session import cut_lineage
from loomgrain.skew import FLOOR, cell_pairs, hot_join, with_stats


def similar_sets(rows: DataFrame, key: str, items: str, limit: float = 0.8, least: int = 1, block: int = 2048, floor: int = FLOOR) -> tuple[DataFrame, DataFrame]:
    """Members ``(key, class_id)`` of classes of equal sets, and class pairs ``(a, b, overlap)``, a < b, of |common| / |all| >= ``limit``.

    Two such sets share one of the rarest n - ceil(limit n) + 1 members of each. Only those are joined, with sets whose size is within
    the limit; full buckets are cut into cells. Sets of fewer than ``least`` members have no class. ``class_id`` is the least key.
    """
    base = rows.select(F.col(key).alias("key"), F.sort_array(M.members(items)).alias("s")).where(F.size("s") >= max(least, 1))
    hashed = cut_lineage(base.withColumn("h", F.unhex(F.md5(F.to_json(F.array(F.to_json("s")))))))
    members = cut_lineage(with_stats(hashed.select("key", "h"), "h", {"class_id": F.min("key")}, floor=floor).select("key", "class_id"))
    classes = cut_lineage(hashed.join(members.where("key = class_id"), "key").select("class_id", "s", F.size("s").alias("n")))
    held = classes.select("class_id", "n", F.explode("s").alias("i"))
    freq = cut_lineage(held.groupBy("i").agg(F.count("*").alias("f")))
    ranked = hot_join(held, freq, "i", floor=floor).groupBy("class_id", "n").agg(F.sort_array(F.collect_list(F.struct("f", "i"))).alias("o"))
    prefix = F.slice("o", 1, (F.col("n") - F.ceil(F.col("n") * limit - 1e-9) + 1).cast("int"))
    probes = cut_lineage(ranked.select("class_id", "n", F.explode(F.filter(prefix, lambda x: x.f > 1)).alias("p")).select("class_id", "n", F.col("p.i").alias("k")))
    near = F.least("n_a", "n_b") >= limit * F.greatest("n_a", "n_b") - 1e-9
    pairs = cell_pairs(probes, "k", "class_id", near, ("n",), block, floor).select("a", "b").distinct()
    at = lambda x: classes.select(F.col("class_id").alias(x), F.col("s").alias(f"s{x}"))
    common = F.size(F.array_intersect("sa", "sb"))
    overlap = common / (F.size("sa") + F.size("sb") - common)
    return members, pairs.join(at("a"), "a").join(at("b"), "b").select("a", "b", overlap.alias("overlap")).where(F.col("overlap") >= limit)
