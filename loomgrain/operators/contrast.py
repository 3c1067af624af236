"""Contrastive scores of functions against a whole library, where a batch of functions stands.

The library lies in the shared folder as files of whole patterns. A task holds a batch of functions and one block of the library at a
time and counts common members in one table of functions by examples; nothing is joined, so pairs never move.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrain.functions import similarity as M
from loomgrain.session import shared_folder

SCRIPTS = ("typescript", "javascript")
BLOCK = 1000  # examples of a file of the library, about
CELLS = 400_000  # functions times examples in one table
KEPT = 64  # blocks that a task keeps


class Block:
    """Whole patterns of the library, positives first within each; which examples hold a member, by dimension."""

    def __init__(self, rows: pd.DataFrame, features: list[str]):
        rows = rows.sort_values(["pattern_id", "example_id"], kind="stable").reset_index(drop=True)
        self.rows, self.at = rows, {}
        self.languages = rows.language.fillna("unknown").to_numpy(object)
        for c in features:
            sizes = rows[c].map(len).to_numpy()
            values = np.concatenate([np.zeros(0, np.int64), *rows[c]]).astype(np.int64)
            order = np.argsort(values, kind="stable")
            known, starts = np.unique(values[order], return_index=True)
            self.at[c] = sizes, known, np.append(starts, len(values)), np.repeat(np.arange(len(rows)), sizes)[order]
        positive = rows.polarity == "positive"
        self.positive, self.negative = np.flatnonzero(positive), np.flatnonzero(rows.polarity.notna() & ~positive)
        patterns = rows.pattern_id.to_numpy(object)
        self.patterns, self.starts = _runs(patterns[self.positive])
        self.negative_patterns, self.negative_starts = _runs(patterns[self.negative])

    def common(self, items: pd.Series, column: str) -> np.ndarray:
        """Members that each function has in common with each example."""
        sizes, known, starts, examples = self.at[column]
        values = np.concatenate([np.zeros(0, np.int64), *items]).astype(np.int64)
        owners = np.repeat(np.arange(len(items)), items.map(len).to_numpy())
        if not len(values) or not len(known):
            return np.zeros((len(items), len(sizes)), np.int64)
        spot = np.minimum(np.searchsorted(known, values), len(known) - 1)
        met = known[spot] == values
        owners, spot = owners[met], spot[met]
        counts = starts[spot + 1] - starts[spot]
        ends = np.cumsum(counts)
        places = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts) + np.repeat(starts[spot], counts)
        cells = np.repeat(owners, counts) * len(sizes) + examples[places]
        return np.bincount(cells, minlength=len(items) * len(sizes)).reshape(len(items), len(sizes))


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array and where each begins."""
    starts = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, int)
    return values[starts], starts


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(a.shape), where=b > 0)


def _scored(fns: pd.DataFrame, block: Block, weights: dict[str, float], columns: dict[str, str], least: float, strong: float, moderate: float) -> pd.DataFrame:
    n, dims, meets, total = len(fns), {}, None, np.zeros((len(fns), len(block.rows)))
    for name, column in columns.items():
        common = block.common(fns[column], column)
        a, b = fns[column].map(len).to_numpy()[:, None], block.at[column][0][None, :]
        if name == "ast":
            sim = _ratio(common, np.minimum(a, b))
        else:
            sim = _ratio(common, a + b - common)
        if name != "semantic":
            sim[(a == 0) & (b == 0)] = 1.0 if name == "ast" else 0.5
        dims[name] = sim
        meets = common > 0 if meets is None else meets | (common > 0)
        total = total + sim * weights[name]
    pos, neg = block.positive, block.negative
    theirs, ours = block.languages[None, pos], fns.language.fillna("unknown").to_numpy(object)[:, None]
    same = (theirs == ours) | (theirs == "unknown") | (ours == "unknown") | (np.isin(theirs.astype(str), SCRIPTS) & np.isin(ours.astype(str), SCRIPTS))
    rank = total[:, pos] * np.where(same, 1.0, 0.2)
    sizes = np.diff(np.append(block.starts, len(pos)))
    top = np.repeat(np.maximum.reduceat(rank, block.starts, axis=1), sizes, axis=1)
    best = np.minimum.reduceat(np.where(rank == top, pos[None, :], len(block.rows)), block.starts, axis=1)  # of equals the least example
    candidate = np.logical_or.reduceat(meets[:, pos], block.starts, axis=1)
    i, p = np.nonzero(candidate & (dims["ast"][np.arange(n)[:, None], best] >= least))
    e = best[i, p]
    against = np.searchsorted(block.negative_patterns, block.patterns[p]) if len(neg) else np.zeros(len(p), int)
    have = np.zeros(len(p), bool)
    if len(neg):
        against = np.minimum(against, len(block.negative_patterns) - 1)
        have = block.negative_patterns[against] == block.patterns[p]
    signals = []
    for sim in dims.values():
        worst = np.where(have, np.maximum.reduceat(sim[:, neg], block.negative_starts, axis=1)[i, against], 0.0) if len(neg) else np.zeros(len(p))
        signals.append(np.maximum(sim[i, e] - worst, 0.0))
    signal = reduce(np.maximum, signals)
    gate = (signal > strong) | (sum((s > moderate).astype(int) for s in signals) >= 2)
    return pd.DataFrame({"fn_id": fns.fn_id.to_numpy()[i], "pattern_id": block.patterns[p], "example_id": block.rows.example_id.to_numpy()[e], "score": np.where(gate, total[i, e], 0.0), "signal": signal})


def whole_scores(functions: DataFrame, examples: DataFrame, weights: dict[str, float], columns: dict[str, str], least: float, strong: float, moderate: float) -> DataFrame:
    """``(fn_id, pattern_id, example_id, score, signal)`` of functions, each given once, and patterns of which a positive shares any member of any dimension."""
    spark, features = functions.sparkSession, list(columns.values())
    folder = shared_folder(spark, "library")
    known = examples.where("pattern_id is not null and example_id is not null").select(F.col("pattern_id"), F.col("example_id").cast("long"), "polarity", "language", *[M.members(c).alias(c) for c in features])
    known.repartition(max(1, known.count() // BLOCK), "pattern_id").write.parquet(folder)

    def blocks() -> Iterator[Block]:
        import pyarrow.fs
        import pyarrow.parquet

        if folder.startswith("file:") or "://" not in folder:
            system, path = pyarrow.fs.LocalFileSystem(), re.sub(r"^file:/*", "/", folder)
        else:
            system, path = pyarrow.fs.FileSystem.from_uri(folder)
        for info in sorted(system.get_file_info(pyarrow.fs.FileSelector(path)), key=lambda f: f.path):
            if info.path.endswith(".parquet"):
                with system.open_input_file(info.path) as f:
                    rows = pyarrow.parquet.ParquetFile(f).read().to_pandas()
                if (rows.polarity == "positive").any():
                    yield Block(rows, features)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, full = [], True
        for b in blocks():
            if len(kept) == KEPT:
                full = False
                break
            kept.append(b)
        for batch in batches:
            for block in kept if full else blocks():
                step = max(1, CELLS // len(block.rows))
                for at in range(0, len(batch), step):
                    yield _scored(batch.iloc[at : at + step].reset_index(drop=True), block, weights, columns, least, strong, moderate)

    rows = functions.select("fn_id", F.lower(F.trim("language")).alias("language"), *[M.members(c).alias(c) for c in features])
    kinds = dict(functions.dtypes)
    return rows.mapInPandas(scan, f"fn_id {kinds['fn_id']}, pattern_id string, example_id long, score double, signal double")
