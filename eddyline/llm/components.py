"""Connected components of a link table, as joins and aggregations.

Alternates two steps until the links no longer change: each node hangs its
larger neighbours below its smallest one, then each node hangs its smaller
neighbours below the smallest.  Every step is a grouped minimum (combined
before the shuffle) and an equi-join; the links end as stars round the
smallest node of each component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eddyline.llm.common import cut_lineage


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"),
                  F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (both.filter("v > u").join(low, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = (down.join(low, "u").filter("v <> m")
             .select(F.col("v").alias("u"), F.col("m").alias("v")))
    return moved.union(low.select("u", F.col("m").alias("v"))).filter("u <> v")


def connected_components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """``edges(u, v)`` → ``(node, root)`` with ``root`` the component's smallest
    node.  Nodes without a link to another node are not returned; repeated
    links, self-links and an empty table are allowed.  Each round ends in a
    reliable checkpoint; only a count and a checksum reach the driver."""
    cur = cut_lineage(edges.select("u", "v").filter("u <> v").distinct())
    state = _state(cur)
    for _ in range(max_rounds):
        if not state[0]:
            break
        cur = cut_lineage(_small_star(_large_star(cur).distinct()).distinct())
        new = _state(cur)
        if new == state:
            break
        state = new
    else:
        raise RuntimeError("components did not settle")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
