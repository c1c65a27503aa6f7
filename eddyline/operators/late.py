"""Late rows: the batch definition of what a watermark drops.

A row is late when, at its arrival, the watermark — the largest event time
seen in *earlier* arrivals minus ``delay`` — has already reached the end of
its window (or its own time, without a window).  The running maximum over
arrival order is a global ordered scan; it runs as a two-level chunked scan
(max per arrival chunk, prefix max over chunks, then within the chunk), so
only the per-chunk maxima meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eddyline.functions.durations import duration_us
from eddyline.operators.scan import chunked_running_max

DEFAULT_CHUNK_ROWS = 1_000_000


def mark_late(df: DataFrame, *, time_col: str = "event_time", arrival_col: str = "arrival_seq",
              tiebreak: str | Column | None = None, delay: str = "10 seconds",
              window: str | None = None, chunk_rows: int = DEFAULT_CHUNK_ROWS,
              out: str = "is_late") -> DataFrame:
    """Add boolean ``out``; ``arrival_col`` is a numeric arrival position."""
    order = [F.col(arrival_col)] + ([F.col(tiebreak) if isinstance(tiebreak, str) else tiebreak]
                                    if tiebreak is not None else [])
    chunk = F.floor(F.col(arrival_col) / F.lit(chunk_rows)).cast("long")
    t_us = F.unix_micros(F.col(time_col))
    scanned = chunked_running_max(df, [], order, chunk, t_us, "_max_before")
    wm = F.col("_max_before") - F.lit(duration_us(delay))
    if window:
        w = duration_us(window)
        bound = F.floor(t_us / F.lit(w)) * F.lit(w) + F.lit(w)
        late = bound <= wm
    else:
        late = t_us < wm
    return scanned.withColumn(out, F.coalesce(late, F.lit(False))).drop("_max_before")


def split_late(df: DataFrame, **kw) -> tuple[DataFrame, DataFrame]:
    """(on-time rows, late rows) — the side output the JVM engine offers.

    The tagged rows are checkpointed once to the shared checkpoint folder
    (reliable, survives lost executors), and both outputs read them."""
    from eddyline.session import cut_lineage
    tagged = cut_lineage(mark_late(df, **kw))
    return (tagged.filter(~F.col("is_late")).drop("is_late"),
            tagged.filter(F.col("is_late")).drop("is_late"))


def drop_late(df: DataFrame, **kw) -> DataFrame:
    return mark_late(df, **kw).filter(~F.col("is_late")).drop("is_late")


def mark_late_stream(stream: DataFrame, *, id_col: str = "event_id", time_col: str = "event_time",
                     delay: str = "10 seconds", window: str | None = None, shares: int = 64) -> DataFrame:
    """A stream's rows with ``is_late``, by the watermark that Spark itself
    holds: it is asked for in a stateful processor, batch by batch, and is the
    largest event time of the batches before less ``delay``.  Rows are dealt
    over ``shares`` groups by a hash of their id, whatever their key.  The event
    time travels as a plain column, so late rows reach the processor instead of
    being dropped in front of it; the columns are those of ``stream`` and
    ``is_late``."""
    from eddyline.session import ensure_stateful_conf
    from eddyline.streaming.processors import LateMarkProcessor

    ensure_stateful_conf(stream.sparkSession)
    others = [c for c in stream.columns if c != time_col]
    rows = stream.withWatermark(time_col, delay).select(
        F.pmod(F.xxhash64(id_col), F.lit(shares)).cast("int").alias("late_share"), *others,
        F.unix_micros(time_col).alias("late_time_us"))
    output = T.StructType([*[stream.schema[c] for c in others], T.StructField("late_time_us", T.LongType()),
                           T.StructField("is_late", T.BooleanType())])
    marked = rows.groupBy("late_share").transformWithStateInPandas(
        statefulProcessor=LateMarkProcessor(duration_us(window) if window else None), outputStructType=output,
        outputMode="Append", timeMode="EventTime")
    back = F.timestamp_micros("late_time_us").cast(stream.schema[time_col].dataType).alias(time_col)
    return marked.select(*[back if c == time_col else F.col(c) for c in stream.columns], "is_late")
