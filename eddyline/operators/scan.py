"""A running maximum over a global arrival order, in two levels.

A window without partitions sends every row to one task.  Here the order is
cut into chunks (ranges of the arrival position): the maximum of each chunk is
aggregated, the few chunk maxima are scanned, and each row's own scan inside
its chunk starts from the maximum before it.  Rows shuffle once, on the chunk.
Scans per key are in :mod:`eddyline.operators.segments`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = "_chunk"
GK = "_gk"


def _with_group(df: DataFrame, keys: Sequence[str], chunk: Column) -> DataFrame:
    """Add one non-null struct group key (NULL key fields compare equal) and the chunk."""
    return df.withColumn(GK, F.struct(*[F.col(k) for k in keys]) if keys else F.lit(0)) \
             .withColumn(CHUNK, chunk)


def _order(cols: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def chunked_running_max(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
                        chunk: Column, value: Column, out: str,
                        inclusive: bool = False) -> DataFrame:
    """Running max of ``value`` in ``order`` (exclusive of the row by default).

    With ``keys=[]`` this is a global scan: the chunk totals (one row per
    chunk) are the only data that meet in one task.
    """
    d = _with_group(df, keys, chunk).withColumn("_v", value)
    part = [GK, CHUNK]
    totals = d.groupBy(*part).agg(F.max("_v").alias("_tot"))
    w_chunks = Window.partitionBy(GK).orderBy(CHUNK).rowsBetween(
        Window.unboundedPreceding, -1)
    carry = totals.select(*part, F.max("_tot").over(w_chunks).alias("_carry"))
    joined = d.join(carry, part, "left")
    w_rows = Window.partitionBy(*part).orderBy(*_order(order)).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1)
    res = F.greatest(F.col("_carry"), F.max("_v").over(w_rows))
    return joined.withColumn(out, res).drop(GK, CHUNK, "_v", "_carry")
