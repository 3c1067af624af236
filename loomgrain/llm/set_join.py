"""Problem 3: all pairs of records whose sets of values overlap above a limit.

Method: minwise hash signatures split into bands, records that share a band bucket become
candidates, candidates are made distinct and verified by their exact overlap.

Equal sets are one class, so a bucket never holds copies. A record of which more than 1 - limit of
the values occur nowhere else cannot have a partner and gets no signature; that loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrain.llm.buckets import bucket_pairs, member_pairs, unique_items
from loomgrain.session import cut_lineage
from loomgrain.skew import FLOOR, hot_join, with_stats
from loomgrain.tables import clean_set, wide_hash


@dataclass(frozen=True)
class Banding:
    """``bands`` bands of ``rows`` minwise hashes. A pair of overlap s is missed with (1 - s^rows)^bands.

    Where ``pool`` is given, only so many hashes are made and each band takes another choice of ``rows`` of them: much less
    work for long bands, at some more misses.
    """

    bands: int = 90
    rows: int = 5
    seed: int = 1
    pool: int = 0

    def choices(self) -> np.ndarray:
        """The hashes of each band."""
        if not self.pool:
            return np.arange(self.bands * self.rows).reshape(self.bands, self.rows)
        rng = np.random.default_rng(self.seed + 1)
        return np.stack([rng.choice(self.pool, self.rows, replace=False) for _ in range(self.bands)])

    def factors(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        n = self.pool or self.bands * self.rows
        return rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def band_keys(values: np.ndarray, starts: np.ndarray, banding: Banding, piece: int = 1 << 15) -> np.ndarray:
    """One row of band keys per set; ``values`` holds the sets one after the other, none of them empty.

    Sets are taken in pieces of about ``piece`` values, which stay in the processor's cache.
    """
    ends = np.append(starts[1:], len(values))
    keys = np.empty((len(starts), banding.bands), np.uint64)
    at = 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + piece, side="right")))
        keys[at:stop] = _piece_keys(values[starts[at] : ends[stop - 1]], starts[at:stop] - starts[at], banding)
        at = stop
    return keys.view(np.int64)


def _piece_keys(values: np.ndarray, starts: np.ndarray, banding: Banding) -> np.ndarray:
    x = values.view(np.uint64)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    a, b = banding.factors()
    h = np.empty_like(x)
    least = np.empty((len(a), len(starts)), np.uint64)
    for i in range(len(a)):
        np.multiply(x, a[i], out=h)
        h += b[i]
        np.right_shift(np.minimum.reduceat(h, starts), np.uint64(8), out=least[i])
    keys = np.empty((len(starts), banding.bands), np.uint64)
    for band, chosen in enumerate(banding.choices()):
        key = np.full(len(starts), band + 1, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for i in chosen:
            key = (key ^ least[i]) * np.uint64(0x94D049BB133111EB)
            key ^= key >> np.uint64(31)
        keys[:, band] = key
    return keys


def banded(classes: DataFrame, banding: Banding, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(cid, bucket)`` for each band of each class of ``classes(cid, items)``."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                lengths = batch["items"].map(len).to_numpy()
                values = np.concatenate(batch["items"].to_list()).astype(np.int64)
                starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
                yield pd.DataFrame({"cid": batch.cid, "buckets": list(band_keys(values, starts, banding)), **{c: batch[c] for c in carry}})

    kinds = dict(classes.dtypes)
    schema = ", ".join(["cid long", "buckets array<long>", *[f"{c} {kinds[c]}" for c in carry]])
    signed = classes.where(F.size("items") > 0).select("cid", "items", *carry).mapInPandas(sign, schema)
    return signed.select("cid", F.explode("buckets").alias("bucket"), *carry)


def tagged(column: str, tag: int) -> Column:
    """Members of a set column, kept apart from other columns' by a tag in the hash."""
    return F.transform(clean_set(column), lambda h: F.xxhash64(F.lit(tag), h))


def item_records(df: DataFrame, key: str, side: int, arrived: str | None, min_ngrams: int) -> DataFrame:
    """``(key, side, arrived, items, h)`` with the three arrays as one tagged, sorted set.

    Null keys and records of fewer than ``min_ngrams`` distinct n-grams are left out; null arrays are empty.
    ``h`` is a 128-bit hash of the sorted set.
    """
    items = F.sort_array(F.concat(clean_set("ngram_hashes"), tagged("structural_markers", 1), tagged("semantic_markers", 2)))
    rows = df.where(F.col(key).isNotNull() & (F.size(clean_set("ngram_hashes")) >= min_ngrams))
    when = F.coalesce(F.col(arrived), F.timestamp_seconds(F.lit(0))) if arrived else F.timestamp_seconds(F.lit(0))
    return rows.select(F.col(key).cast("long").alias("key"), F.lit(side).alias("side"), when.alias("arrived"), items.alias("items")).withColumn("h", wide_hash("items"))


def memberships(records: DataFrame, floor: int = FLOOR) -> DataFrame:
    """``(key, side, h, cid, copies)``: the class of each key by its latest row. A class is named by its least key and side, as
    2 key + side, so no two classes share a name; keys are below 2^62."""
    latest = records.groupBy("key", "side").agg(F.max_by("h", "arrived").alias("h"))
    return cut_lineage(with_stats(latest, "h", {"cid": F.min(F.shiftleft("key", 1) + F.col("side")), "copies": F.count("*")}, floor=floor))


def similar_classes(records: DataFrame, members: DataFrame, limit: float = 0.6, banding: Banding = Banding(), floor: int = FLOOR) -> DataFrame:
    """Pairs ``(a, b, overlap)`` of classes with |common| / |all| >= ``limit``, a < b.

    ``records(side, items, h)``; classes that only side 1 has (reference examples) are not paired with each other.
    """
    named = members.groupBy("h").agg(F.min("cid").alias("cid"), F.min("side").alias("side"))
    classes = records.groupBy("h").agg(F.first("items").alias("items")).join(named, "h").select("cid", "items", "side")
    lone = unique_items(classes, "cid", "items")
    size, uniques = F.size("items"), F.coalesce("uniques", F.lit(0))
    alive = cut_lineage(classes.join(lone, "cid", "left").where((size - uniques) >= F.lit(limit) * size).select("cid", "items", "side"))
    pairs = bucket_pairs(banded(alive, banding, ("side",)), "bucket", "cid", F.expr("side_a + side_b < 2"), ("side",), floor=floor)
    left = alive.select(F.col("cid").alias("a"), F.col("items").alias("items_a"))
    right = alive.select(F.col("cid").alias("b"), F.col("items").alias("items_b"))
    common = F.size(F.array_intersect("items_a", "items_b"))
    overlap = common / (F.size("items_a") + F.size("items_b") - common)
    return cut_lineage(pairs.join(left, "a").join(right, "b").select("a", "b", overlap.alias("overlap")).where(F.col("overlap") >= limit))


def similar_pairs(records: DataFrame, limit: float = 0.6, banding: Banding = Banding(), block: int = 4096, floor: int = FLOOR) -> DataFrame:
    """All pairs ``(key_a, key_b)`` of keys, smaller first, whose sets overlap by at least ``limit``; none of two examples.

    Classes are joined first and their members are put in last; members of a large class are dealt out in blocks.
    """
    members = memberships(records, floor)
    found = similar_classes(records, members, limit, banding, floor).select("a", "b")
    own = members.where("copies > 1 and shiftleft(key, 1) + side = cid").select(F.col("cid").alias("a"), F.col("cid").alias("b"))
    pairs = member_pairs(found.unionByName(own), members.select("cid", "key", "side"), ("side",), block, floor)
    pairs = pairs.where("side_a + side_b < 2 and key_a != key_b and (a != b or key_a < key_b)")
    return pairs.select(F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b"))


def record_links(records: DataFrame, limit: float = 0.6, banding: Banding = Banding(), floor: int = FLOOR) -> DataFrame:
    """One row per key: ``(key, side, class_id, copies, links)``, no pair being expanded.

    ``class_id`` is the least key of the equal sets, ``copies`` their number and ``links`` the number of other classes
    that overlap by at least ``limit``.
    """
    members = memberships(records, floor)
    degree = similar_classes(records, members, limit, banding, floor).select(F.explode(F.array("a", "b")).alias("cid")).groupBy("cid").agg(F.count("*").alias("links"))
    rows = hot_join(members, degree, "cid", "left", floor=floor)
    return rows.select("key", "side", F.shiftright("cid", 1).alias("class_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"))
