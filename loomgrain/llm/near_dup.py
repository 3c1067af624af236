"""Problem 7: groups of records that are mostly the same despite small edits.

Method: the generalised pigeonhole principle over long bit vectors, one bit for each member a set may hold. A mean
overlap of at least t over two sets means an overlap of at least t in one of them, and then two sets differ, for the
larger of n members, in at most 2 n (1 - t) / (1 + t) bits. Bits that are set in the same records are grouped: members
whose holders have the same least hash lie in one group, which is cut into partitions of three bits. If the thresholds
of a record's partitions (each a number of differing bits, or none at all for a partition that is not probed) add up,
with one more for each, to more than the bits that may differ, then one partition differs in no more than its threshold.
A dynamic programme gives every record the thresholds of least estimated candidate count: frequent bits get none, rare
ones 0 or 1. A partition is probed by hashes of its bits, and of its bits less one for a threshold of 1; records that
share a probe are verified exactly. Thresholds up to 1 always add up, so no pair is lost, and a record of n members
has at most 1.5 n probes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgrain.llm.buckets import bucket_groups, unique_items
from loomgrain.session import cut_lineage
from loomgrain.skew import FLOOR, hot_join, with_stats
from loomgrain.tables import clean_set, wide_hash

SLACK = 1e-9


def partition_bits(limit: float) -> int:
    """Bits a partition: with thresholds up to 1, three always add up at overlaps of 0.65 and more, two at any."""
    return 3 if limit >= 0.65 else 2


def may_differ(size: int, limit: float) -> int:
    """Bits in which a set of ``size`` members and one no larger differ at most at an overlap of ``limit``."""
    return int(2 * size * (1 - limit) / (1 + limit) + SLACK)


def allocate_thresholds(sizes: list[int], costs: list[tuple[float, float]], need: int) -> list[int]:
    """A threshold of -1, 0 or 1 for each partition, of least total cost, so that the sum of threshold + 1 is at least ``need``.

    ``sizes`` are the bits a record sets in each partition, ``costs`` the candidates estimated at thresholds 0 and 1. A
    partition of one bit has no threshold 1: a record that lacks the bit would share nothing.
    """
    left = np.arange(need + 1)  # what the partitions from here on still have to add up to
    best = np.where(left == 0, 0.0, np.inf)
    picks = np.zeros((len(sizes), need + 1), np.int8)
    for i in range(len(sizes) - 1, -1, -1):
        zero, one = costs[i]
        options = [best, best[np.maximum(left - 1, 0)] + zero]
        if sizes[i] > 1:
            options.append(best[np.maximum(left - 2, 0)] + one)
        table = np.stack(options)
        picks[i] = table.argmin(axis=0)
        best = table.min(axis=0)
    out, r = [], need
    for i in range(len(sizes)):
        pick = int(picks[i][r])
        out.append(pick - 1)
        r = max(0, r - pick)
    return out


def _mixed(bits: tuple[int, ...]) -> int:
    """One signed 64-bit hash of several members in order."""
    h = 0x9E3779B97F4A7C15
    for x in bits:
        h = ((h ^ (x & 0xFFFFFFFFFFFFFFFF)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
        h ^= h >> 31
    return h - (1 << 64) if h >> 63 else h


def probes(parts: list[int], items: list[int], freqs: list[int], size: int, limit: float) -> list[tuple[int, bool]]:
    """``(probe, asks)`` of one set of ``size`` members, of which those given occur in other records as well.

    The record answers to all its probes and asks with those within its thresholds; sets that differ from every other
    in too many bits have none.
    """
    need = may_differ(size, limit) - (size - len(items)) + 1
    if need <= 0:
        return []
    groups: dict[int, list[tuple[int, int]]] = {}
    for part, freq, item in sorted(zip(parts, freqs, items)):
        groups.setdefault(part, []).append((freq, item))
    held = list(groups.values())
    costs = []
    for g in held:
        least = float(g[0][0])
        costs.append((least, least * len(g) + (g[1][0] - least if len(g) > 1 else 0.0)))
    out = []
    for g, threshold in zip(held, allocate_thresholds([len(g) for g in held], costs, need)):
        bits = tuple(sorted(item for _, item in g))
        out.append((_mixed(bits), threshold >= 0))
        if len(bits) > 1:
            out.extend((_mixed(bits[:i] + bits[i + 1 :]), threshold > 0) for i in range(len(bits)))
    return out


def fingerprint_records(df: DataFrame, key: str, first: str, second: str, arrived: str, min_first: int) -> DataFrame:
    """``(key, arrived, x, y, h)``: the two cleaned, sorted sets and a 128-bit hash of both.

    Null keys and records of fewer than ``min_first`` members in the first set are left out; null arrays are empty.
    """
    rows = df.where(F.col(key).isNotNull() & (F.size(clean_set(first)) >= min_first))
    when = F.coalesce(F.col(arrived), F.timestamp_seconds(F.lit(0)))
    rows = rows.select(F.col(key).cast("long").alias("key"), when.alias("arrived"), F.sort_array(clean_set(first)).alias("x"), F.sort_array(clean_set(second)).alias("y"))
    return rows.withColumn("h", wide_hash("x", F.lit(-1), "y"))


def correlated_partitions(held: DataFrame, bits: int) -> DataFrame:
    """``(item, freq, part)`` of every member ``held(cid, tag, item)`` that two records or more hold.

    Members are grouped by the least hash among their holders, so members that occur together lie together. A group is
    a part of that one holder's members, and is cut into partitions of ``bits`` members of one set, alike postings first.
    """
    least = [F.min(F.xxhash64("cid", F.lit(seed))).alias(name) for seed, name in ((3, "group"), (5, "again"))]
    counted = held.groupBy("item").agg(F.count("*").alias("freq"), F.min("tag").alias("set"), *least).where("freq > 1")
    rank = F.row_number().over(Window.partitionBy("group", "set").orderBy("again", "freq", "item")) - 1
    return counted.select("item", "freq", F.xxhash64("group", "set", F.floor(rank / bits)).alias("part"))


def similar_classes(classes: DataFrame, limit: float = 0.7, floor: int = FLOOR) -> DataFrame:
    """``(id, group_id)`` of classes ``(cid, x, y)`` that a mean overlap of at least ``limit`` joins directly or indirectly.

    The overlap of two empty sets is 0.
    """
    budget = 2 * (1 - limit)
    # members that occur once are missed for sure: most records are out after the first set alone
    alive = classes.join(unique_items(classes, "cid", "x"), "cid", "left")
    alive = cut_lineage(alive.where(F.coalesce("uniques", F.lit(0)) / F.size("x") <= budget + SLACK).select("cid", "x", "y"))

    def held(column: str, tag: int) -> DataFrame:
        return alive.select("cid", F.lit(tag).alias("tag"), F.explode(F.transform(column, lambda h: F.xxhash64(F.lit(tag), h))).alias("item"))

    both = held("x", 1).unionByName(held("y", 2))
    parts = cut_lineage(correlated_partitions(both, partition_bits(limit)))
    known = hot_join(both, parts, "item", floor=floor).groupBy("cid").agg(F.collect_list(F.struct("tag", "part", "freq", "item")).alias("m"))
    known = known.join(alive.select("cid", F.size("x").alias("nx"), F.size("y").alias("ny")), "cid")
    names = ("tag", "part", "freq", "item")
    known = known.select("cid", "nx", "ny", *[F.col(f"m.{n}").alias(n) for n in names])

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cids: list[int] = []
            found: list[tuple[int, bool]] = []
            for cid, nx, ny, tag, part, freq, item in zip(batch.cid, batch.nx, batch.ny, batch.tag, batch.part, batch.freq, batch["item"]):
                for t, size in ((1, nx), (2, ny)):
                    own = tag == t
                    mine = probes(part[own].tolist(), item[own].tolist(), freq[own].tolist(), int(size), limit)
                    cids.extend([cid] * len(mine))
                    found.extend(mine)
            yield pd.DataFrame({"cid": np.array(cids, np.int64), "probe": np.array([p for p, _ in found], np.int64), "asks": np.array([q for _, q in found], bool)})

    a = alive.select(F.col("cid").alias("a"), F.col("x").alias("xa"), F.col("y").alias("ya"))
    b = alive.select(F.col("cid").alias("b"), F.col("x").alias("xb"), F.col("y").alias("yb"))

    def overlap(p: str, q: str):
        common = F.size(F.array_intersect(p, q))
        return common / F.greatest(F.size(p) + F.size(q) - common, F.lit(1))

    mean = (overlap("xa", "xb") + overlap("ya", "yb")) / 2
    asked = known.mapInPandas(probe, "cid long, probe long, asks boolean")
    return bucket_groups(asked, "probe", "cid", lambda pairs: pairs.join(a, "a").join(b, "b").where(mean >= limit).select("a", "b"), asks="asks", floor=floor)


def near_duplicate_groups(df: DataFrame, key: str = "fn_id", first: str = "ngram_hashes", second: str = "skeleton_hashes", arrived: str = "ingested_at", limit: float = 0.7, min_first: int = 8, floor: int = FLOOR) -> DataFrame:
    """``(key, group_id)`` for every record in a group of two or more; ``group_id`` is the least key.

    Equal records are one class and cost one probe, however many they are. Copies whose second set is empty
    have a mean overlap of one half and are not joined by being equal alone.
    """
    records = fingerprint_records(df, key, first, second, arrived, min_first)
    latest = records.groupBy("key").agg(F.max_by(F.struct("h", (F.size("y") > 0).alias("whole")), "arrived").alias("c")).select("key", "c.h", "c.whole")
    # a class is named by its least key: no two classes share one
    members = cut_lineage(with_stats(latest, "h", {"cid": F.min("key"), "n": F.count("*")}, floor=floor))
    sets = records.groupBy("h").agg(F.first("x").alias("x"), F.first("y").alias("y"))
    named = members.where("key = cid")
    labels = similar_classes(sets.join(named.select("h", "cid"), "h").select("cid", "x", "y"), limit, floor).select(F.col("id").alias("cid"), F.col("group_id").alias("label"))
    whole = F.col("whole") & (F.lit(1.0) >= limit) | (F.lit(0.5) >= limit)
    labelled = cut_lineage(named.select("cid", "n", "whole").join(labels, "cid", "left").where(F.col("label").isNotNull() | ((F.col("n") > 1) & whole)).withColumn("label", F.coalesce("label", "cid")))
    groups = labelled.groupBy("label").agg(F.min("cid").alias("group_id"), F.sum("n").alias("size")).where("size > 1")
    owners = hot_join(labelled, groups, "label", floor=floor).select("cid", "group_id")
    return hot_join(members.select("key", "cid"), owners, "cid", floor=floor).select(F.col("key").alias(key), "group_id")
