"""Comparison of a query's rows with those of its SQL."""

import numpy as np
import pandas as pd


def rows_of(df: pd.DataFrame) -> list[tuple]:
    def one(v):
        if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and v != v:
            return "null"
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        if isinstance(v, (int, float, np.integer, np.floating)):
            return f"{v:.6f}"
        return str(v)

    df = df[sorted(df.columns)]
    return sorted(tuple(one(v) for v in r) for r in df.itertuples(index=False))


def assert_same(got: pd.DataFrame, want: pd.DataFrame) -> None:
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)
