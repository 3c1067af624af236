"""Joins and bucket statistics that stay even when one key holds a third of all rows.

A key is hot if it has more than ``share`` of the rows (and more than ``floor``); there are at most ``1 / share``
of them whatever the data, which is what bounds every broadcast here. Rows of hot keys are never moved by their key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrain.session import cut_lineage

CELLS = 1 << 16
SHARE = 0.001
FLOOR = 20_000


def hot_keys(rows: DataFrame, key: str, share: float = SHARE, floor: int = FLOOR) -> list:
    """The keys with more than ``max(share * rows, floor)`` rows: at most ``1 / share`` values. Null keys never are.

    Rows are counted by a hash cell of the key first, which combines before it moves; only full cells are counted by key.
    """
    cell = F.pmod(F.xxhash64(key), F.lit(CELLS))
    counts = rows.where(F.col(key).isNotNull()).groupBy(cell.alias("_cell")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    limit = F.greatest(F.lit(float(floor)), total * F.lit(share))
    cells = [r["_cell"] for r in counts.where(F.col("n") > limit).collect()]  # at most 1 / share of them
    if not cells:
        return []
    exact = rows.where(cell.isin(cells)).groupBy(key).agg(F.count("*").alias("n"))
    all_rows = rows.where(F.col(key).isNotNull()).agg(F.count("*")).scalar()
    full = exact.where(F.col("n") > F.greatest(F.lit(float(floor)), all_rows * F.lit(share)))
    return [r[0] for r in full.select(key).collect()]


def hot_join(rows: DataFrame, dim: DataFrame, key: str, how: str = "inner", share: float = SHARE, floor: int = FLOOR, hot: list | None = None) -> DataFrame:
    """``rows`` joined with ``dim``, which holds each key once. Rows of hot keys meet a broadcast of at most ``1 / share`` rows.

    ``how`` is inner or left. ``rows`` is read several times and should be a stored table. ``hot`` may give the hot keys, where known.
    """
    hot = hot_keys(rows, key, share, floor) if hot is None else hot
    if not hot:
        return rows.join(dim, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    cold = rows.where(~is_hot).join(dim, key, how)
    return cold.unionByName(rows.where(is_hot).join(F.broadcast(dim.where(F.col(key).isin(hot))), key, how))


def with_stats(rows: DataFrame, key: str, stats: dict[str, Column], share: float = SHARE, floor: int = FLOOR) -> DataFrame:
    """``rows`` with aggregates of their key beside them. Aggregates combine before they move; hot keys are joined by broadcast.

    Rows of other keys move once and are aggregated where they are.
    """
    aggs = [c.alias(n) for n, c in stats.items()]
    hot = hot_keys(rows, key, share, floor)
    cold = rows.where(~F.coalesce(F.col(key).isin(hot), F.lit(False))) if hot else rows
    placed = cold.where(F.col(key).isNotNull()).repartition(key)
    out = placed.join(placed.groupBy(key).agg(*aggs), key)
    if hot:
        full = rows.where(F.col(key).isin(hot))
        out = out.unionByName(full.join(F.broadcast(full.groupBy(key).agg(*aggs)), key))
    return out


def cell_pairs(rows: DataFrame, bucket: str, member: str, allowed: Column | None = None, carry: tuple[str, ...] = (), block: int = 2048, floor: int = FLOOR) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of members that share a bucket, with ``x_a`` and ``x_b`` of ``carry``; a pair comes once for each bucket it shares.

    Buckets of one row are dropped first. A bucket of n rows becomes a triangle of cells, one for each two of its
    n / ``block`` blocks; a row visits the cells of its block, so a cell holds two blocks at most and no pair is lost.
    """
    sized = with_stats(rows, bucket, {"_n": F.count("*")}, floor=floor).where("_n > 1")
    shared = cut_lineage(sized.withColumn("_g", F.ceil(F.col("_n") / block).cast("int")).drop("_n"))
    own = shared.withColumn("_i", F.pmod(F.xxhash64(F.lit(7), member), F.col("_g")).cast("int"))
    cells = own.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_g") - 1)))
    cells = cells.select(F.col(bucket).alias("_k"), F.least("_i", "_j").alias("_lo"), F.greatest("_i", "_j").alias("_hi"), "_i", member, *carry)
    a = cells.select("_k", "_lo", "_hi", F.col("_i").alias("_ia"), F.col(member).alias("a"), *[F.col(c).alias(f"{c}_a") for c in carry])
    b = cells.select("_k", "_lo", "_hi", F.col("_i").alias("_ib"), F.col(member).alias("b"), *[F.col(c).alias(f"{c}_b") for c in carry])
    pairs = a.join(b, ["_k", "_lo", "_hi"]).where("a < b and (_lo = _hi or _ia != _ib)")
    if allowed is not None:
        pairs = pairs.where(allowed)
    return pairs.select("a", "b", *[f"{c}_{x}" for c in carry for x in "ab"])
