"""Per-key state, batch forms: running counts and sums, last value, recent
list, per-type map, folds, inactivity alerts, a funnel state machine and
two-stream co-processing.

These are the table twins of the stateful processors in
:mod:`eddyline.streaming.processors`; a stream drained through a processor
gives the same final rows.  Ordered per-key scans are range-partitioned
segmented scans (:mod:`eddyline.operators.segments`), so one hot key spreads
over all tasks.  Order within a key is ``(event_time, event_id)``;
``partitions`` fixes the number of ranges (the session's shuffle width
otherwise), on which no result depends.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eddyline.functions.durations import duration_us, shift
from eddyline.operators.dedup import first_rows
from eddyline.operators.segments import (
    LastSeen, PreviousValue, RunningSums, segmented_fold, segmented_scan,
)

ORDER = ("event_time", "event_id")


def _ntz(c):
    return c.cast("timestamp_ntz")


def running_count(df: DataFrame, keys: Sequence[str] = ("key",), *, per_record: bool = False,
                  partitions: int | None = None) -> DataFrame:
    """Running count per key.

    Final form (one row per key, the last value a processor emits):
    ``key, running_count``.  Per-record form: ``key, event_id, event_time,
    running_count`` with counts 1..n in event order.
    """
    keys = list(keys)
    if not per_record:
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("running_count"))
    out = segmented_scan(df.select(*keys, *ORDER), keys, ORDER, RunningSums({"running_count": None}),
                         partitions=partitions)
    return out.select(*keys, "event_id", _ntz(F.col("event_time")).alias("event_time"), "running_count")


def running_last_type(df: DataFrame, keys: Sequence[str] = ("key",)) -> DataFrame:
    """Running count plus the type of the latest event (by time, then id): a
    count of fixed width beside the first row in falling order."""
    keys = list(keys)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("running_count"))
    last = first_rows(df.select(*keys, *ORDER, "event_type"), keys, [F.col(c).desc_nulls_last() for c in ORDER])
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    return counts.alias("a").join(last.alias("b"), same).select(
        *[F.col(f"a.{k}").alias(k) for k in keys], "running_count", F.col("event_type").alias("last_event_type"))


def running_sum(df: DataFrame, value: str = "value", keys: Sequence[str] = ("key",), *,
                partitions: int | None = None) -> DataFrame:
    """Generic accumulator: per-record running total of ``value``."""
    keys = list(keys)
    src = df.select(*keys, *ORDER, F.col(value).cast("long").alias("_add"))
    out = segmented_scan(src, keys, ORDER, RunningSums({"running_sum": "_add"}), partitions=partitions)
    return out.select(*keys, "event_id", _ntz(F.col("event_time")).alias("event_time"), "running_sum")


def collect_recent(df: DataFrame, n: int = 3, item: str = "event_id",
                   keys: Sequence[str] = ("key",)) -> DataFrame:
    """Last ``n`` items per key, oldest first, as ``a,b,c`` text.

    The rank filter keeps at most ``n`` rows of a key in each task before the
    shuffle (window group limit), so a hot key needs no chunks.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in ORDER])
    top = df.select(*keys, item, *ORDER).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n)
    items = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_r")).alias("o"),
                                                             F.col(item).alias("v")))), lambda x: x["v"])
    return top.groupBy(*keys).agg(F.array_join(items, ",").alias("recent"),
                                  F.count(F.lit(1)).alias("n_recent"))


def counts_by_type(df: DataFrame, keys: Sequence[str] = ("key",)) -> DataFrame:
    """Map state twin: count per (key, event type)."""
    return df.groupBy(*keys, "event_type").agg(F.count(F.lit(1)).alias("type_count"))


def fold_state(df: DataFrame, value: str = "value", keys: Sequence[str] = ("key",)) -> DataFrame:
    """Reducing (max) and aggregating (average) state per key."""
    return df.groupBy(*keys).agg(F.max(value).alias("max_value"),
                                 F.round(F.avg(value), 4).alias("avg_value"),
                                 F.count(F.lit(1)).alias("event_count"))


def inactivity_alerts(df: DataFrame, gap: str, delay: str | None = "10 seconds",
                      keys: Sequence[str] = ("key",), *, partitions: int | None = None) -> DataFrame:
    """Alert when a key has no event for more than ``gap`` of event time.

    An event alerts at ``t + gap`` if the key's next event comes later than
    that; the key's last event alerts only if the final watermark
    (``max(event_time) − delay``) has reached ``t + gap``.  The next event is
    the row before in falling order.
    """
    keys = list(keys)
    gap_us = duration_us(gap)
    delay_us = duration_us(delay) if delay else 0
    src = df.select(*keys, *ORDER, F.unix_micros("event_time").alias("_t_us"))
    nxt = segmented_scan(src, keys, [F.col(c).desc() for c in ORDER],
                         PreviousValue("_t_us", "next_us", T.LongType()), partitions=partitions)
    # final watermark as a scalar subquery: computed once, then a literal.
    final_wm = df.agg((F.max(F.unix_micros("event_time")) - F.lit(delay_us))).scalar()
    t_us = F.col("_t_us")
    fired = (F.when(F.col("next_us").isNotNull(), F.col("next_us") - t_us > F.lit(gap_us))
             .otherwise(t_us + F.lit(gap_us) <= final_wm))
    return nxt.filter(fired).select(
        *keys, _ntz(F.col("event_time")).alias("last_event_time"),
        _ntz(shift(F.col("event_time"), gap)).alias("alert_time"))


# ── funnel state machine ───────────────────────────────────────────────────
FUNNEL_STEPS = ("view", "click", "purchase")


def funnel_states(df: DataFrame, steps: Sequence[str] = FUNNEL_STEPS,
                  keys: Sequence[str] = ("key",), *, partitions: int | None = None) -> DataFrame:
    """Per-key funnel: only the expected next step advances the stage; the
    last step completes a funnel and resets the stage to 0.

    Each sorted partition reduces its part of a key to a transition table (end
    stage and completions for every start stage); only tables of keys that
    cross a partition's end are composed.  Output: ``key, stage, completed``.
    """
    return segmented_fold(df.select(*keys, *ORDER, "event_type"), keys, ORDER, "event_type", steps,
                          partitions=partitions)


# ── two-stream co-processing ───────────────────────────────────────────────
def co_process(left: DataFrame, right: DataFrame, bound: str,
               keys: Sequence[str] = ("key",), *, partitions: int | None = None) -> DataFrame:
    """Match every right row (e.g. click) with the latest left row (view) of
    its key at or before it, if no older than ``bound``; else no match.

    Batch twin of a processor over ``union(left, right)`` that keeps the last
    left row in state.  Output: ``key, click_id, click_time, view_id,
    view_time`` (one row per right row).
    """
    keys = list(keys)
    cols = [*keys, *ORDER]
    view = F.struct(F.col("event_id").alias("id"), F.unix_micros("event_time").alias("t"))
    kind = T.StructType([T.StructField("id", left.schema["event_id"].dataType), T.StructField("t", T.LongType())])
    u = (left.select(*cols, view.cast(kind).alias("_own"))
         .unionByName(right.select(*cols, F.lit(None).cast(kind).alias("_own"))))
    scanned = segmented_scan(u, keys, ORDER, LastSeen("_own", "view", kind), partitions=partitions)
    fresh = F.unix_micros("event_time") - F.col("view.t") <= F.lit(duration_us(bound))
    return scanned.filter(F.col("_own").isNull()).select(
        *keys, F.col("event_id").alias("click_id"),
        _ntz(F.col("event_time")).alias("click_time"),
        F.when(fresh, F.col("view.id")).alias("view_id"),
        F.when(fresh, _ntz(F.timestamp_micros("view.t"))).alias("view_time"))


def key_profile(df: DataFrame, keys: Sequence[str] = ("key",)) -> DataFrame:
    """Batch twin of the multi-state processor: count, max value, distinct types."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("event_count"),
                                 F.max("value").alias("max_value"),
                                 F.count_distinct("event_type").alias("n_types"))
