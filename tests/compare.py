"""Rows of both engines in one form: columns by name, doubles to nine digits, order ignored."""

import numpy as np
import pandas as pd


def plain(x):
    if isinstance(x, (list, tuple, np.ndarray)):
        return tuple(plain(y) for y in x)
    if x is None or x is pd.NaT or x is pd.NA or isinstance(x, (float, np.floating)) and x != x:
        return None
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    if isinstance(x, (int, np.integer)):
        return int(x)
    return round(float(x), 9) + 0.0 if isinstance(x, (float, np.floating)) else x


def rows(df: pd.DataFrame) -> list:
    names = sorted(df.columns)
    return [tuple(names), *sorted((tuple(plain(x) for x in r) for r in df[names].itertuples(index=False)), key=repr)]
