"""Comparison of a Spark result with a DuckDB result, whatever the order of rows and columns."""

import numpy as np
import pandas as pd


def ordered(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object:
            df[c] = df[c].map(lambda v: repr(v.tolist()) if isinstance(v, np.ndarray) else repr(v) if isinstance(v, list | dict) else v)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def assert_same(got: pd.DataFrame, want: pd.DataFrame) -> None:
    a, b = ordered(got), ordered(want)
    assert list(a.columns) == list(b.columns)
    assert len(a) == len(b)
    for c in a.columns:
        x, y = a[c], b[c]
        if pd.api.types.is_numeric_dtype(x) and pd.api.types.is_numeric_dtype(y):
            np.testing.assert_allclose(x.astype(float), y.astype(float), rtol=1e-9, atol=1e-9, err_msg=c)
        else:
            same = (x.astype(str) == y.astype(str)) | (x.isna() & y.isna())
            assert same.all(), (c, x[~same].head(), y[~same].head())
