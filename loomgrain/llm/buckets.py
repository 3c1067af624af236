"""Pairs of records that share a bucket. A bucket is cut into a grid of blocks by its own row count before its rows meet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrain.llm.components import connected_groups
from loomgrain.session import cut_lineage
from loomgrain.skew import FLOOR, cell_pairs, hot_join, with_stats

BLOCK = 2048


def _block_of(member: str, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(7), member), blocks).cast("int")


def bucket_pairs(rows: DataFrame, bucket: str, member: str, allowed: Column | None = None, carry: tuple[str, ...] = (), block: int = BLOCK, floor: int = FLOOR) -> DataFrame:
    """Distinct pairs ``(a, b)``, a < b, of members that share any bucket.

    ``allowed`` may restrict pairs by the columns ``carry`` (named ``x_a`` and ``x_b``) before they are made distinct.
    """
    return cell_pairs(rows, bucket, member, allowed, carry, block, floor).select("a", "b").distinct()


def unique_items(records: DataFrame, record: str, items: str) -> DataFrame:
    """``(record, uniques)``: how many of its items no other record holds. Items combine before they move."""
    held = records.select(record, F.explode(items).alias("_i"))
    alone = held.groupBy("_i").agg(F.count("*").alias("n"), F.min(record).alias(record)).where("n = 1")
    return alone.groupBy(record).agg(F.count("*").alias("uniques"))


def bucket_groups(rows: DataFrame, bucket: str, member: str, verify: Callable[[DataFrame], DataFrame], asks: str | None = None, block: int = BLOCK, floor: int = FLOOR) -> DataFrame:
    """Groups ``(id, group_id)`` of members that ``verify`` links, among all that share a bucket.

    ``verify`` keeps the true ones of the pairs ``(a, b)`` it is given. The result is that of verifying every pair of
    every bucket, at much less cost where a bucket is full of alike members: first each is held against two heads
    of its bucket only. Pairs within a group so found need no look; only those of a bucket whose members are still in
    different groups are verified: every member outside the largest group against all of another group, in cells of
    at most ``block`` members on either side. Where the boolean column ``asks`` is named, a bucket counts only if some
    member asks in it.
    """
    asking = F.col(asks) if asks else F.lit(True)
    placed = cut_lineage(rows.select(F.col(bucket).alias("k"), F.col(member).alias("m"), asking.alias("q")))
    mixed = F.struct(F.xxhash64("m", "k"), "m")
    headed = with_stats(placed, "k", {"h0": F.min(mixed), "h1": F.max(mixed), "asked": F.max("q")}, floor=floor).where("asked and h0 != h1")
    shared = cut_lineage(headed.select("k", "m", F.array("h0.m", "h1.m").alias("heads")))
    stars = shared.select("m", F.explode("heads").alias("h")).where("m != h")
    first = cut_lineage(verify(stars.select(F.least("m", "h").alias("a"), F.greatest("m", "h").alias("b")).distinct()))
    groups = cut_lineage(connected_groups(first).select(F.col("id").alias("m"), F.col("group_id").alias("g")))
    labelled = cut_lineage(shared.select("k", "m").join(groups, "m", "left").select("k", "m", F.coalesce("g", "m").alias("g")))
    mixed_keys = labelled.groupBy("k").agg(F.min("g").alias("g0"), F.max("g").alias("g1")).where("g0 != g1").select("k")
    sizes = labelled.groupBy("k", "g").agg(F.count("*").alias("n")).join(mixed_keys, "k", "left_semi")
    split = sizes.groupBy("k").agg(F.max(F.struct("n", "g")).alias("top"), F.sum("n").alias("n"))
    split = cut_lineage(split.select("k", F.col("top.g").alias("top"), F.ceil((F.col("n") - F.col("top.n")) / block).cast("int").alias("rows"), F.ceil(F.col("n") / block).cast("int").alias("cols")))
    if split.isEmpty():
        return groups.select(F.col("m").alias("id"), F.col("g").alias("group_id"))
    apart = cut_lineage(hot_join(labelled, split, "k", floor=floor))
    x = apart.where("g != top").select("k", F.col("m").alias("x"), F.col("g").alias("gx"), "top", _block_of("m", F.col("rows")).alias("i"), F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("j"))
    y = apart.select("k", F.col("m").alias("y"), F.col("g").alias("gy"), F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"), _block_of("m", F.col("cols")).alias("j"))
    cross = x.join(y, ["k", "i", "j"]).where("gx != gy and (gy = top or x < y)")
    second = cut_lineage(verify(cross.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()))
    if second.isEmpty():
        return groups.select(F.col("m").alias("id"), F.col("g").alias("group_id"))
    return connected_groups(first.unionByName(second))


def member_pairs(links: DataFrame, members: DataFrame, carry: tuple[str, ...] = (), block: int = 4096, floor: int = FLOOR) -> DataFrame:
    """Pairs of members for pairs of classes: ``(a, b, key_a, key_b)`` with ``x_a`` and ``x_b`` of ``carry``.

    ``links(a, b)`` names classes (a = b for the pairs within one) and ``members(cid, key)`` their members. Classes are
    paired first; a large class is dealt out in blocks of ``block`` members, and a link visits each two blocks of its ends.
    """
    members = cut_lineage(with_stats(members, "cid", {"_n": F.count("*")}, floor=floor))
    blocks = F.ceil(F.col("_n") / block).cast("int")
    dealt = members.withColumn("_s", _block_of("key", blocks))
    sizes = members.groupBy("cid").agg(F.first(blocks).alias("_g"))

    def dealt_to(rows: DataFrame, side: str) -> DataFrame:
        cells = rows.join(sizes.select(F.col("cid").alias(side), "_g"), side).withColumn("_s", F.explode(F.sequence(F.lit(0), F.col("_g") - 1)))
        own = dealt.select(F.col("cid").alias(side), "_s", F.col("key").alias(f"key_{side}"), *[F.col(c).alias(f"{c}_{side}") for c in carry])
        return cells.drop("_g").join(own, [side, "_s"]).drop("_s")

    return dealt_to(dealt_to(links, "a"), "b")
