"""Stream forms of the per-key state operators (``transformWithStateInPandas``).

Each function takes a (streaming) DataFrame of event records with
``event_time`` and returns the processor's output stream.  The batch twins
live in :mod:`eddyline.operators.keyed`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eddyline.functions.durations import duration_us
from eddyline.session import ensure_stateful_conf
from eddyline.streaming import bucketed as B
from eddyline.streaming import processors as P


def apply_processor(df: DataFrame, processor, output, *, keys: Sequence[str] = ("key",),
                    time_mode: str = "None", output_mode: str = "Update", initial=None) -> DataFrame:
    """``initial``: rows (with the key columns) that the first batch hands to
    the processor's ``handleInitialState``, key by key."""
    ensure_stateful_conf(df.sparkSession)
    return df.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=output, outputMode=output_mode, timeMode=time_mode,
        initialState=initial.groupBy(*keys) if initial is not None else None)


def apply_buckets(df: DataFrame, processor, *, initial: DataFrame | None = None, **kw) -> DataFrame:
    """A processor of :mod:`eddyline.streaming.bucketed`: grouped by a hash
    bucket of ``key``, so that one call serves many keys."""
    return apply_processor(df.withColumn(B.BUCKET, B.bucket_of_key()), processor, processor.OUTPUT, keys=[B.BUCKET],
                           initial=initial.withColumn(B.BUCKET, B.bucket_of_key()) if initial is not None else None, **kw)


def running_count_stream(df: DataFrame, *, per_record: bool = False,
                         ttl: str | None = None, engine: str = "aggregate") -> DataFrame:
    """ST1 (one row per key and batch, Update) or ST2 (one row per record, Append).

    ST1 with ``engine="aggregate"`` is Spark's own stateful aggregation
    (``groupBy(key).count()`` in Update mode: JVM-side, partial aggregation
    before the shuffle, same rows as the processor); ``engine="processor"``
    runs :class:`eddyline.streaming.bucketed.BucketCount` (value state in
    ``transformWithState``).
    ``ttl`` expires the count of a key idle for that long (processor only,
    processing time).
    """
    if engine not in ("aggregate", "processor"):
        raise ValueError("engine must be 'aggregate' or 'processor'")
    if not per_record and not ttl and engine == "aggregate":
        return df.groupBy("key").agg(F.count(F.lit(1)).alias("running_count"))
    if per_record:
        return apply_processor(df.select("key", "event_id", "event_time"),
                               P.PerRecordCountProcessor(), P.PerRecordCountProcessor.OUTPUT,
                               output_mode="Append")
    ttl_ms = duration_us(ttl) // 1000 if ttl else None
    return apply_buckets(df.select("key"), B.BucketCount(ttl_ms), time_mode="ProcessingTime" if ttl else "None")


def seeded_count_stream(df: DataFrame, seeds: DataFrame, ttl: str) -> DataFrame:
    """Running count from ``seeds(key, seed)``, which expire ``ttl`` of
    processing time after the first batch (``key, running_count, seen``)."""
    return apply_buckets(df.select("key"), B.BucketSeededCount(duration_us(ttl) // 1000),
                         time_mode="ProcessingTime", initial=seeds.select("key", "seed"))


def running_sum_stream(df: DataFrame) -> DataFrame:
    """Per-record running sum (Append)."""
    return apply_processor(df.select("key", "event_id", "event_time", "value"),
                           P.RunningSumProcessor(), P.RunningSumProcessor.OUTPUT, output_mode="Append")


def running_last_type_stream(df: DataFrame) -> DataFrame:
    return apply_buckets(df.select("key", "event_id", "event_time", "event_type"), B.BucketLastType())


def fold_stream(df: DataFrame) -> DataFrame:
    return apply_buckets(df.select("key", "value"), B.BucketTotals())


def recent_list_stream(df: DataFrame, n: int = 3) -> DataFrame:
    return apply_buckets(df.select("key", "event_id", "event_time"), B.BucketRecent(n))


def type_counts_stream(df: DataFrame) -> DataFrame:
    return apply_processor(df.select("key", "event_type"), P.TypeCountsProcessor(),
                           P.TypeCountsProcessor.OUTPUT)


def funnel_stream(df: DataFrame, steps: Sequence[str] = ("view", "click", "purchase")):
    return apply_processor(df.select("key", "event_id", "event_time", "event_type"),
                           P.FunnelProcessor(steps), P.FunnelProcessor.OUTPUT)


def inactivity_stream(df: DataFrame, gap: str, *, processing_time: bool = False) -> DataFrame:
    """Event-time (needs a watermark on ``event_time``) or processing-time alerts."""
    return apply_buckets(df.select("key", "event_time"), B.BucketInactivity(duration_us(gap) // 1000, processing_time),
                         output_mode="Append", time_mode="ProcessingTime" if processing_time else "EventTime")


def manual_sessions_stream(df: DataFrame, gap: str) -> DataFrame:
    return apply_buckets(df.select("key", "event_time"), B.BucketSessions(duration_us(gap) // 1000),
                         output_mode="Append", time_mode="EventTime")


def co_process_stream(left: DataFrame, right: DataFrame, bound: str) -> DataFrame:
    """Union both sides with a discriminator, then one processor per key (needs
    a watermark on ``event_time`` of both sides)."""
    cols = ["key", "event_id", "event_time"]
    u = (left.select(*cols, F.lit(True).alias("is_left"))
         .unionByName(right.select(*cols, F.lit(False).alias("is_left"))))
    return apply_processor(u, P.CoProcessor(duration_us(bound) // 1000), P.CoProcessor.OUTPUT,
                           output_mode="Append", time_mode="EventTime")


def key_profile_stream(df: DataFrame) -> DataFrame:
    return apply_buckets(df.select("key", "value", "event_type"), B.BucketProfile())
