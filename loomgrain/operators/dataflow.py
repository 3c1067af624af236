"""Definitions and uses of names over whole source tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from loomgrain.operators import cfg, frontend

CHAIN_SCHEMA = "file_id long, function string, first_line long, name string, use_at long, definitions array<long>"


def def_use_chains(files: DataFrame) -> DataFrame:
    """One row per use of a name that its function defines: ``(file_id, function, first_line, name, use_at, definitions)``.

    ``definitions`` are the positions of the writings that may reach the use, -1 for a parameter; positions count from the body's start.
    Functions in braces have control flow; in others every use sees the last writing before it.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for fid, path, text in zip(b.file_id, b.file_path, b.content):
                for f in frontend.functions_of(text or "", (path or "").rsplit(".", 1)[-1].lower(), path or ""):
                    chains = cfg.def_use(f.code, tuple(f.params))
                    for (name, at, _), reach in zip(chains.uses, chains.reaching):
                        if reach:
                            out.append((fid, f.name, f.first_line, name, at, sorted(chains.definitions[i][1] for i in reach)))
            yield pd.DataFrame(out, columns=["file_id", "function", "first_line", "name", "use_at", "definitions"])

    return files.select("file_id", "file_path", "content").where("file_id is not null").mapInPandas(walk, CHAIN_SCHEMA)
