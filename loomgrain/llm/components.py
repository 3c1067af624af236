"""Problem 2: one group for all records that pairs link directly or indirectly.

Method: a two-dimensional grid. Vertices are hashed into blocks, an edge belongs to the cell of
its two blocks, and each cell runs a union-find over its own edges and hands on only a star per
local group. The representatives that a vertex has in the cells of its row and column then meet:
the least becomes its parent and the others are linked to it, which is the (much smaller) edge
list of the next round. It ends when no two representatives differ, and the parents are composed.

A vertex with very many links is spread over all cells of its row, and a task keeps one label per
vertex it has seen, never its edges. Representatives are compared by a mixed hash, so long chains
in key order shrink by a constant share each round. The grid follows the number of links left.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrain.session import cut_lineage
from loomgrain.skew import hot_join


def mix(ids: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: unequal keys have unequal hashes."""
    x = ids.astype(np.int64).view(np.uint64).copy()
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices of an edge list and the representative of each: the one of least mixed hash in its group."""
    vertices, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    order = np.argsort(mix(vertices))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    u, v = place[at[: len(a)]], place[at[len(a) :]]
    parent = np.arange(len(vertices))
    while len(u):
        low, high = np.minimum(u, v), np.maximum(u, v)
        np.minimum.at(parent, high, low)
        while True:  # compress
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
        u, v = parent[u], parent[v]
        u, v = u[u != v], v[u != v]
    return vertices, vertices[order][parent[place]]


def _cells(batches: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    """Union-find over the edges of one task, folded into a star forest every ``most`` edges."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        held.append((batch.a.to_numpy(), batch.b.to_numpy()))
        size += len(batch)
        if size >= most:
            held = [local_roots(*(np.concatenate(x) for x in zip(*held)))]
            size = len(held[0][0]) // 2
    if held:
        vertex, root = local_roots(*(np.concatenate(x) for x in zip(*held)))
        step = 1 << 17
        for i in range(0, len(vertex), step):
            r = root[i : i + step]
            yield pd.DataFrame({"vertex": vertex[i : i + step], "root": r, "weight": mix(r).view(np.int64)})


def connected_groups(links: DataFrame, a: str = "a", b: str = "b", cell_links: int = 250_000, least_blocks: int = 2) -> DataFrame:
    """``(id, group_id)`` for every record that a link names; ``group_id`` is the least id of the group.

    Links with a null end and self links name nothing. Repeated links and both directions count once.
    ``cell_links`` is the number of links one task should get; it sets the grid, not the result. The first round
    always has a grid of at least ``least_blocks`` blocks a side, later ones follow the links that are left.
    """
    u, v = F.col(a).cast("long"), F.col(b).cast("long")
    edges = links.select(F.least(u, v).alias("a"), F.greatest(u, v).alias("b"), (u.isNotNull() & v.isNotNull() & (u != v)).alias("ok")).where("ok").select("a", "b").distinct()
    edges = cut_lineage(edges)
    left, parents = edges.count(), []
    while left:
        blocks = max(1 if parents else least_blocks, ceil(sqrt(2 * left / cell_links)))
        row, col = (F.pmod(F.xxhash64(c), F.lit(blocks)) for c in ("a", "b"))
        gridded = edges.repartition(blocks * (blocks + 1) // 2, F.least(row, col), F.greatest(row, col))
        stars = gridded.mapInPandas(lambda batches: _cells(batches, 4 * cell_links), "vertex long, root long, weight long")
        stars = cut_lineage(stars)
        if blocks == 1:
            parents.append(stars.select("vertex", F.col("root").alias("parent")))
            break
        # unsigned comparison of the hash: flip the sign bit
        key = F.struct((F.col("weight").bitwiseXOR(F.lit(-(2**63)))).alias("w"), F.col("root").alias("r"))
        best = stars.groupBy("vertex").agg(F.min(key).alias("m"), F.collect_set("root").alias("roots"))
        best = cut_lineage(best.select("vertex", F.col("m.r").alias("parent"), "roots"))  # a vertex has one root a cell of its row
        parents.append(best.select("vertex", "parent"))
        edges = best.where(F.size("roots") > 1).select("parent", F.explode("roots").alias("root")).where("parent != root")
        edges = cut_lineage(edges.select(F.least("parent", "root").alias("a"), F.greatest("parent", "root").alias("b")).distinct())
        left = edges.count()
    if not parents:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("group_id"))
    labels = parents.pop()
    while parents:  # compose: a vertex takes the label of its parent, and many vertices may have one parent
        upper = labels.select(F.col("vertex").alias("parent"), F.col("parent").alias("top"))
        labels = cut_lineage(hot_join(parents.pop(), upper, "parent", "left").select("vertex", F.coalesce("top", "parent").alias("parent")))
    least = labels.groupBy("parent").agg(F.min("vertex").alias("group_id"))
    return hot_join(labels, least, "parent").select(F.col("vertex").alias("id"), "group_id")


def chain_links(df: DataFrame, members: str) -> DataFrame:
    """Links ``(a, b)`` between consecutive members of each list: as connected as all its pairs, one row per member."""
    m = F.array_compact(F.col(members))
    ends = F.arrays_zip(F.slice(m, 1, F.greatest(F.size(m) - 1, F.lit(0))).alias("a"), F.slice(m, 2, F.greatest(F.size(m) - 1, F.lit(0))).alias("b"))
    return df.where(F.size(m) > 1).select(F.explode(ends).alias("e")).select("e.a", "e.b")
