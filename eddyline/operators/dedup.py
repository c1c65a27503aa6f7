"""Deduplication and final-row collapse.

Tables pick one row of each key by its rank: Spark keeps the best row of a key
in every task before the shuffle (window group limit), so a key repeated many
times is reduced where it stands and no task meets all its rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_rows(df: DataFrame, keys: Sequence[str], order) -> DataFrame:
    """The first row of each ``keys`` value in ``order`` (null keys are one)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(w)).filter(F.col("_place") == 1).drop("_place")


def dedup(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drop repeated ``keys`` (streams keep the first arrival, state grows
    with distinct keys unless a watermark bounds it)."""
    if df.isStreaming:
        return df.dropDuplicates(list(keys))
    return first_rows(df, list(keys), [F.lit(0)])


def dedup_within(df: DataFrame, keys: Sequence[str], time_col: str, delay: str) -> DataFrame:
    """Stream: drop repeats that arrive within ``delay`` of the watermark.
    Table: same as :func:`dedup`."""
    if df.isStreaming:
        return df.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(list(keys))
    return dedup(df, keys)


def latest_per_key(df: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """Keep, for each ``keys`` value, the row with the greatest ``version``
    (nulls are the smallest); the key columns come first."""
    keys = list(keys)
    others = [c for c in df.columns if c not in keys]
    return first_rows(df, keys, [F.col(v).desc_nulls_last() for v in version]).select(*keys, *others)
