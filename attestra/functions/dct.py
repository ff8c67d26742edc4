"""The one column function that needs Python: a perceptual hash from the discrete cosine transform of 32 x 32 pixels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashes import median_threshold_hash

SIZE, LOW = 32, 8


def low_basis() -> np.ndarray:
    """Rows 0 to 7 of the DCT-II basis of 32 points, the first scaled by 1/sqrt(2)."""
    k, x = np.arange(LOW)[:, None], np.arange(SIZE)[None, :]
    basis = np.cos((2 * x + 1) * k * np.pi / (2 * SIZE))
    basis[0] /= np.sqrt(2)
    return basis


def dct_coefficients(pixels: Column) -> Column:
    """The 64 lowest coefficients of an array of 1024 grey values, row by row; null where there are not 1024 (FN-10).

    A batch of images is two matrix products.
    """

    @F.pandas_udf("array<double>")
    def low(batch: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(batch), dtype=object)
        fine = [i for i, p in enumerate(batch) if p is not None and len(p) == SIZE * SIZE]
        if fine:
            images = np.stack([np.asarray(batch.iloc[i], dtype=np.float64) for i in fine]).reshape(-1, SIZE, SIZE)
            b = low_basis()
            found = np.round((b @ images @ b.T) / 4, 6).reshape(-1, LOW * LOW)
            for i, c in zip(fine, found, strict=True):
                out.iloc[i] = c
        return out

    return low(pixels)


def with_dct_hash(df: DataFrame, pixels: Column, into: str = "phash") -> DataFrame:
    """Adds the median-threshold hash of the coefficients (FN-10 and FN-8)."""
    out = df.withColumn(into, dct_coefficients(pixels))
    return out.withColumn(into, F.when(F.col(into).isNotNull(), median_threshold_hash(F.col(into))))
