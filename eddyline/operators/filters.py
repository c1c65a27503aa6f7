"""Row filters on real columns (pushed into Parquet scans when possible)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eddyline.schema import PASSTHROUGH_TYPES


def keep_types(df: DataFrame, types: Iterable[str] = PASSTHROUGH_TYPES,
               col: str = "event_type") -> DataFrame:
    """Keep rows whose type is in ``types``; NULL and malformed rows drop out."""
    return df.filter(F.col(col).isin(list(types)))


def keep_equal(df: DataFrame, col: str, value) -> DataFrame:
    return df.filter(F.col(col) == F.lit(value))


def not_null(df: DataFrame, *cols: str) -> DataFrame:
    cond = None
    for c in cols:
        cond = F.col(c).isNotNull() if cond is None else cond & F.col(c).isNotNull()
    return df.filter(cond) if cond is not None else df
