"""Mixing sources to target weights by subset-sum budget fitting.

Every source gets a target of words; full passes over the source cover whole
multiples of its size, and the remaining budget is filled exactly, or nearly,
by documents chosen by length:

1. documents are counted by exact length per source (Spark);
2. the budget is spread over the lengths in proportion to their counts, by
   cumulative rounding, which leaves at most twice the longest length open;
3. a bounded-knapsack dynamic programme over the spare counts fills what is
   open; its table is as long as that rest, not as the budget;
4. of each length the chosen number of documents with the smallest seeded
   hash is taken.  Hashes are counted in 4096 ranges, so no task sorts a whole
   length: a length that a third of all documents share is split.

The only tables handled whole are those with a row per source and, per
source, per distinct length: both bounded apart from the number of documents
(lengths by the longest document).

Defined cases: null text has size 0; null sources are one source, the last;
a source without words has target 0; documents of size 0 are taken once per
full pass and add no words; repeated rows are documents of their own; ties in
the hash are broken by id; an empty table gives an empty result; other
columns pass through.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from eddyline.llm.common import fresh, load_table, prepare, stored, word_count

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = 20240607


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """``(source, source_size)`` → also ``target``: the total shared by weight,
    no target above ``cap`` times its source's size, the excess reshared.

    With sources in order of cap / weight, the capped ones are a leading run;
    the level of the others follows from running sums."""
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("w", w).withColumn("cap", F.lit(float(cap)) * F.col("source_size"))
    order = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    upto = order.rowsBetween(W.unboundedPreceding, -1)
    onward = order.rowsBetween(0, W.unboundedFollowing)
    every = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    t = (t.withColumn("open", F.sum(F.col("source_size")).over(every).cast("double")
                      - F.coalesce(F.sum("cap").over(upto), F.lit(0.0)))
         .withColumn("level", F.col("open") / F.sum("w").over(onward))
         .withColumn("capped", F.col("cap") <= F.col("w") * F.col("level")))
    level = F.first(F.when(~F.col("capped"), F.col("level")), ignorenulls=True).over(every)
    return t.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(
        F.col("w") * level)).select("source", "source_size", "target")


def knapsack(lengths: np.ndarray, spare: np.ndarray, room: int) -> np.ndarray:
    """How many of each length to take so that their sum is as near to ``room``
    as possible, the lower of two (bounded knapsack; counts split into powers
    of two; sums above twice ``room`` are farther than none)."""
    take = np.zeros(len(lengths), dtype=np.int64)
    if room <= 0:
        return take
    top = 2 * room
    reached = np.zeros(top + 1, dtype=bool)
    reached[0] = True
    by = np.full(top + 1, -1, dtype=np.int32)      # the part that reached a sum first
    parts: list[tuple[int, int]] = []
    for i in np.argsort(-lengths, kind="stable"):
        left = min(int(spare[i]), top // int(lengths[i])) if lengths[i] > 0 else 0
        k = 1
        while left > 0 and not reached[room]:
            n = min(k, left)
            step = n * int(lengths[i])
            new = reached[:top + 1 - step] & ~reached[step:]
            by[step:][new] = len(parts)
            reached[step:] |= new
            parts.append((int(i), n))
            left, k = left - n, k * 2
    sums = np.flatnonzero(reached)
    s = int(sums[np.argmin(np.abs(sums - room))])
    while s:
        i, n = parts[by[s]]
        take[i] += n
        s -= n * int(lengths[i])
    return take


def fit_budget(lengths: np.ndarray, counts: np.ndarray, target: float) -> tuple[int, np.ndarray]:
    """Full passes over the source, and of each length how many documents are
    taken once more."""
    total = int((lengths * counts).sum())
    if total == 0:
        return 0, np.zeros(len(lengths), dtype=np.int64)
    budget = int(round(target))
    passes, room = divmod(budget, total)
    order = np.argsort(lengths, kind="stable")
    ls, cs = lengths[order], counts[order]
    share = max(0, room - int(ls[-1])) / total
    cum = np.floor(np.cumsum(np.where(ls > 0, cs, 0)) * share).astype(np.int64)
    x = np.minimum(np.diff(np.r_[0, cum]), cs)
    x[ls == 0] = 0
    x += knapsack(ls, np.where(ls > 0, cs - x, 0), room - int((x * ls).sum()))
    out = np.zeros(len(lengths), dtype=np.int64)
    out[order] = x
    return passes, out


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    passes, extra = fit_budget(pdf["size"].to_numpy(), pdf["n"].to_numpy(), float(pdf["target"].iloc[0]))
    return pd.DataFrame({"source": pdf["source"], "size": pdf["size"], "passes": passes, "extra": extra,
                         "source_size": pdf["source_size"], "target": pdf["target"]})


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                source_col: str = "source", weights=WEIGHTS, cap: float = CAP, seed: int = SEED,
                carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` (all by default) and, named apart where they
    clash: ``size``, ``source_size``, ``target`` (words of the source and its
    target) and ``copies``, how often the mix takes the document (0 to
    ``cap``).  Rows with 0 copies are returned too."""
    carry = docs.columns if carry is None else carry
    taken_names = list(dict.fromkeys([*carry, id_col, text_col, source_col]))
    own = {n: fresh(n, taken_names) for n in
           ("_s", "_n", "_h", "_b", "size", "source_size", "target", "copies")}
    keys = ("source", "size", "b")
    rows = docs.select(
        *[F.col(f"`{c}`") for c in carry],
        F.col(f"`{source_col}`").cast("string").alias(own["_s"]),
        word_count(F.col(f"`{text_col}`")).alias(own["_n"]),
        F.xxhash64(F.lit(seed), F.col(f"`{id_col}`")).alias(own["_h"]),
        F.col(f"`{id_col}`").alias(own["copies"]))
    rows = rows.withColumn(own["_b"], F.shiftrightunsigned(own["_h"], 52).cast("int"))
    hist = stored(rows.groupBy(*[F.col(own[a]).alias(b) for a, b in zip(("_s", "_n", "_b"), keys)])
                  .agg(F.count(F.lit(1)).alias("n")), "mix-lengths")
    lens = hist.groupBy("source", "size").agg(F.sum("n").alias("n"))
    sizes = lens.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = source_targets(sizes, weights, cap)
    schema = T.StructType([T.StructField("source", T.StringType()), *[
        T.StructField(n, T.LongType()) for n in ("size", "passes", "extra", "source_size")],
        T.StructField("target", T.DoubleType())])
    fit = stored(lens.alias("l").join(targets.alias("t"), F.expr("l.source <=> t.source"))
                 .select("l.source", "size", "n", "source_size", "target")
                 .groupBy("source").applyInPandas(_fit, schema), "mix-fit")

    upto = W.partitionBy("h.source", "h.size").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    ranges = (hist.alias("h").join(fit.alias("f"), F.expr("h.source <=> f.source AND h.size = f.size"))
              .withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
              .select(F.col("h.source").alias("r_source"), F.col("h.size").alias("r_size"),
                      F.col("b").alias("r_b"), "passes", F.col("source_size").alias("r_total"),
                      F.col("target").alias("r_target"),
                      F.greatest(F.lit(0), F.col("extra") - F.col("before")).alias("here")))
    joined = rows.join(ranges, (F.col(own["_s"]).eqNullSafe(F.col("r_source")))
                       & (F.col(own["_n"]) == F.col("r_size")) & (F.col(own["_b"]) == F.col("r_b")))
    rank = F.row_number().over(W.partitionBy(own["_s"], own["_n"], own["_b"])
                               .orderBy(own["_h"], own["copies"]))
    return joined.withColumn(own["_h"], rank).select(
        *[F.col(f"`{c}`") for c in carry],
        F.col(own["_n"]).alias(own["size"]), F.col("r_total").alias(own["source_size"]),
        F.col("r_target").alias(own["target"]),
        (F.col("passes") + (F.col(own["_h"]) <= F.col("here")).cast("long")).alias(own["copies"]))


def op1_mix_to_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = load_table(spark, sf_dir, "documents")
    return mix_sources(docs, carry=["doc_id", "source"]).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"),
        "source", "copies")
