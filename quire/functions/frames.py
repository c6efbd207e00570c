"""Small helpers of frames: pandas ones on their way back to Arrow, and lists of values in filters."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def whole(frame: pd.DataFrame, columns: list[str] | None = None) -> pd.DataFrame:
    """The frame with each column in one piece: strings that came in several batches stay in several, which Arrow structs refuse."""
    return pd.DataFrame({c: frame[c].to_numpy(object) for c in columns or frame.columns})


def one_of(c: Column, values: list) -> Column:
    """c IN values, in parts of ten: so many a Parquet reader compares with a file's statistics one by one."""
    parts = [c.isin(values[i : i + 10]) for i in range(0, len(values), 10)]
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)
