"""Functions Spark has no built-in for; evaluated on Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType

from grainscope.functions.tail import chi_square_tail


@pandas_udf(DoubleType())
def chi2_sf(stat: pd.Series, df: pd.Series) -> pd.Series:
    """Chi-square survival function as a column expression; NULL in, NULL out."""
    known = stat.notna() & df.notna()
    tail = chi_square_tail(stat.fillna(0.0).to_numpy(), df.fillna(1).to_numpy())
    return pd.Series(tail, index=stat.index).where(known)


@pandas_udf(ArrayType(DoubleType()))
def chi2_sf_each(stats: pd.Series, dfs: pd.Series) -> pd.Series:
    """Survival function over arrays of equal length; NULL where df < 1."""
    if not len(stats):
        return pd.Series([], dtype=object)
    sizes = stats.map(len).to_numpy()
    df = np.concatenate(dfs.to_list())
    tail = np.where(df > 0, chi_square_tail(np.concatenate(stats.to_list()), np.maximum(df, 1)), np.nan)
    return pd.Series([[None if np.isnan(p) else p for p in part]
                      for part in np.split(tail, np.cumsum(sizes)[:-1])])
