"""What the two embedding operators share: which vectors take part, and their rows as matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """Neither null, zero nor with null, NaN or infinite components."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def is_single(df: DataFrame, vector: str) -> bool:
    return df.schema[vector].dataType.elementType.typeName() == "float"


def matrix(column, dim: int):
    """Rows of an Arrow list column, all of length dim, as an array."""
    import numpy as np

    values = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(values).reshape(-1, dim)
