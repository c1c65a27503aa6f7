"""Lower nearest-rank percentile: element ``min(int(n*p), n-1)`` of the sorted sample.

This is the benchmark consumer's definition; it is neither
``percentile_disc`` (ceiling rank) nor an interpolating percentile.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nearest_rank_index(n: Column, p: float) -> Column:
    """0-based index of the ``p`` percentile in a sorted sample of size ``n``."""
    return F.least(F.floor(n.cast("double") * F.lit(float(p))), n - F.lit(1)).cast("long")


def percentile_name(p: float) -> str:
    return "p" + format(round(p * 100, 3), "g").replace(".", "_")
