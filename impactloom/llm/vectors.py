"""Packed vectors: reading, blocks and tiles for operators 7 and 10."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F


def usable(column: str) -> Column:
    """Whether a vector is not null and holds neither nulls nor non-finite components; empty ones are not."""
    bad = F.exists(F.col(column), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.col(column).isNotNull() & (F.size(column) > 0) & ~bad


def matrix(column: pd.Series, dtype="<f8") -> np.ndarray:
    """Rows of equal-length binary vectors."""
    return np.frombuffer(b"".join(column), dtype=dtype).reshape(len(column), -1)
