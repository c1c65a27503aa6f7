"""Union of streams and predicate branches (side-output substitute)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_streams(*dfs: DataFrame) -> DataFrame:
    """``unionByName`` of tables or streams (missing columns become NULL)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def tag_branches(df: DataFrame, branches: dict[str, Column], default: str | None = None,
                 col: str = "branch") -> DataFrame:
    """Add ``col`` = name of the first matching predicate (in dict order)."""
    expr = None
    for name, pred in branches.items():
        expr = F.when(pred, F.lit(name)) if expr is None else expr.when(pred, F.lit(name))
    if expr is None:
        return df.withColumn(col, F.lit(default))
    if default is not None:
        expr = expr.otherwise(F.lit(default))
    return df.withColumn(col, expr)


def branch(df: DataFrame, branches: dict[str, Column],
           default: str | None = None) -> dict[str, DataFrame]:
    """One DataFrame per branch; a row goes to the first branch it matches.

    For streams, start one query per branch, or persist the micro-batch in
    ``foreachBatch`` and write every branch from it (one read of the source).
    """
    tagged = tag_branches(df, branches, default, col="_branch")
    names = list(branches) + ([default] if default is not None else [])
    return {n: tagged.filter(F.col("_branch") == n).drop("_branch") for n in names}
