"""SQL names for the scalar rules and the array kernels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import kernels as K

_SPECTRAL = StructType([StructField(c, DoubleType()) for c in K.SPECTRAL_COLUMNS])


def _rows(uv: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=float) for v in uv])


def register(spark: SparkSession, fs: float = 128.0) -> None:
    """Array kernels for signals sampled at ``fs``: spectral_features(uv), plv(uv, uv), bicoherence(uv).

    Scalar rules become SQL functions: site_of(name), bvc_band(score), depth_proxy(sef95, entropy, delta_rel).
    """
    @F.pandas_udf(_SPECTRAL)
    def spectral_features(uv: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(K.spectral_features(_rows(uv), fs))

    @F.pandas_udf(DoubleType())
    def plv(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(K.phase_locking(_rows(x), _rows(y), fs))

    @F.pandas_udf(DoubleType())
    def bicoherence(uv: pd.Series) -> pd.Series:
        return pd.Series([K.rolling_bicoherence(v, fs, [len(v)], len(v))[0] for v in _rows(uv)])

    for fn in (spectral_features, plv, bicoherence):
        spark.udf.register(fn.__name__, fn)
    spark.sql(r"""CREATE OR REPLACE TEMPORARY FUNCTION site_of(name STRING) RETURNS STRING
      RETURN lower(split(regexp_replace(trim(name), '(?i)^EEG[ _-]*', ''), '[-_ /.]')[0])""")
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION bvc_band(score INT) RETURNS STRING
      RETURN CASE WHEN score <= 0 THEN 'low' WHEN score <= 2 THEN 'moderate' WHEN score > 2 THEN 'very_high' END""")
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION depth_proxy(sef95 DOUBLE, entropy DOUBLE, delta_rel DOUBLE) RETURNS DOUBLE
      RETURN CASE WHEN sef95 IS NOT NULL AND entropy IS NOT NULL AND delta_rel IS NOT NULL THEN
        100 * (least(greatest(sef95 / 30, 0D), 1D) + least(greatest(entropy, 0D), 1D) + least(greatest(1 - delta_rel, 0D), 1D)) / 3 END""")
