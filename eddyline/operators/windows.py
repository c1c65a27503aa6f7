"""Event-time windows: tumbling, sliding, session, and pane pre-aggregation.

All are ``groupBy(keys, window(...)).agg(...)``: Spark plans a partial
aggregate before the shuffle on ``(key, window)`` and, in a stream, a
state-store save/restore around the final aggregate.  Window bounds are
projected to ``window_start`` / ``window_end`` as TIMESTAMP_NTZ in UTC.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eddyline.functions.durations import duration_us, shift
from eddyline.operators.segments import SessionStart, segmented_scan
from eddyline.schema import SLIDING_SLIDE, SLIDING_WINDOW, TUMBLING_WINDOW, WATERMARK_DELAY

EVENT_TIME = "event_time"


def with_event_time(df: DataFrame, time_col: str = EVENT_TIME,
                    delay: str | None = WATERMARK_DELAY,
                    allowed_lateness: str | None = None) -> DataFrame:
    """Bounded out-of-orderness watermark (ignored by batch plans).

    ``allowed_lateness`` (the JVM engine's extra lateness for windows) is
    folded into the delay: Spark keeps window state until
    ``max(time) − delay − lateness`` passes the window end.  Unlike the JVM
    option this delays the first Append emission instead of re-firing.
    """
    if not delay:
        return df
    if allowed_lateness:
        total = duration_us(delay) + duration_us(allowed_lateness)
        delay = f"{total // 1000} milliseconds"
    return df.withWatermark(time_col, delay)


def _ntz(c: Column) -> Column:
    return c.cast("timestamp_ntz")


def project_window(df: DataFrame, keys: Sequence[str], aggs: Sequence[str],
                   win: str = "window", ntz: bool = True) -> DataFrame:
    """Window struct → ``window_start``, ``window_end`` next to keys and aggregates."""
    start, end = F.col(f"{win}.start"), F.col(f"{win}.end")
    if ntz:
        start, end = _ntz(start), _ntz(end)
    return df.select(*keys, start.alias("window_start"), end.alias("window_end"), *aggs)


def windowed_agg(df: DataFrame, duration: str, aggs: Sequence[Column], *,
                 slide: str | None = None, keys: Sequence[str] = ("key",),
                 time_col: str = EVENT_TIME, ntz: bool = True) -> DataFrame:
    """Generic tumbling (``slide=None``) or sliding window aggregate."""
    w = F.window(time_col, duration, slide) if slide else F.window(time_col, duration)
    agg = df.groupBy(*keys, w.alias("window")).agg(*aggs)
    names = [a for a in agg.columns if a not in (*keys, "window")]
    return project_window(agg, keys, names, ntz=ntz)


def count_agg() -> list[Column]:
    return [F.count(F.lit(1)).alias("event_count")]


def avg_half_up(value: str, digits: int, value_scale: int) -> Column:
    """Mean of a column holding decimals with ``value_scale`` places, rounded
    half-up to ``digits`` places exactly (integer arithmetic on the scaled
    sum), so the result does not depend on floating-point summation order."""
    m, k = 10 ** value_scale, 10 ** digits
    units = F.round(F.col(value) * F.lit(m)).cast("long")
    num, n = F.sum(units), F.count(units)
    q = F.floor((F.lit(2 * k) * F.abs(num) + n * F.lit(m)) / (F.lit(2 * m) * n)).cast("long")
    return (F.signum(num) * q / F.lit(float(k))).cast("double")


def avg_count_agg(value: str = "value", digits: int | None = 2,
                  exact_scale: int | None = None) -> list[Column]:
    """``avg_value`` (rounded to ``digits``) and ``event_count``.

    ``exact_scale``: the values are decimals with that many places (e.g.
    money with 2) — the mean is then rounded exactly, see :func:`avg_half_up`.
    """
    if exact_scale is not None and digits is not None:
        a = avg_half_up(value, digits, exact_scale)
    else:
        a = F.avg(value)
        if digits is not None:
            a = F.round(a, digits)
    return [a.alias("avg_value"), F.count(F.lit(1)).alias("event_count")]


def stats_agg(value: str = "value") -> list[Column]:
    return [F.count(F.lit(1)).alias("event_count"), F.sum(value).alias("sum_value"),
            F.min(value).alias("min_value"), F.max(value).alias("max_value"),
            F.round(F.avg(value), 4).alias("avg_value")]


def tumbling(df: DataFrame, duration: str = TUMBLING_WINDOW,
             aggs: Sequence[Column] | None = None, **kw) -> DataFrame:
    """Pattern 02: count per (key, tumbling window)."""
    return windowed_agg(df, duration, aggs or count_agg(), **kw)


PANES_MIN_RATIO = 4


def sliding(df: DataFrame, duration: str = SLIDING_WINDOW, slide: str = SLIDING_SLIDE,
            aggs: Sequence[Column] | None = None, *, panes: str | bool = "auto",
            **kw) -> DataFrame:
    """Pattern 03: average and count per (key, sliding window).

    With the default aggregates on a table, and a window of at least
    ``PANES_MIN_RATIO`` slides, rows are aggregated once into panes instead
    of being copied into every window (``panes=False`` forces the copy).
    """
    ratio = duration_us(duration) / duration_us(slide)
    use_panes = (panes is True or (panes == "auto" and ratio >= PANES_MIN_RATIO)) \
        and aggs is None and not df.isStreaming and ratio == int(ratio)
    if use_panes:
        keys = kw.get("keys", ("key",))
        return sliding_panes(df, duration, slide, keys=keys, time_col=kw.get("time_col", EVENT_TIME),
                             ntz=kw.get("ntz", True))
    return windowed_agg(df, duration, aggs or avg_count_agg(), slide=slide, **kw)


def sliding_panes(df: DataFrame, duration: str = SLIDING_WINDOW, slide: str = SLIDING_SLIDE,
                  value: str = "value", keys: Sequence[str] = ("key",),
                  time_col: str = EVENT_TIME, digits: int | None = 2, ntz: bool = True) -> DataFrame:
    """Sliding avg/count by pane pre-aggregation (batch).

    Rows aggregate once into tumbling panes of width ``slide``; each pane
    total then fans out to the ``duration/slide`` windows containing it.
    The fan-out multiplies pane totals, not rows — a large win when the
    size/slide ratio is large.  Equal to :func:`sliding` for count/sum/avg.
    """
    size_us, slide_us = duration_us(duration), duration_us(slide)
    if size_us % slide_us:
        return sliding(df, duration, slide, avg_count_agg(value, digits),
                       keys=keys, time_col=time_col, ntz=ntz)
    k = size_us // slide_us
    panes = (df.groupBy(*keys, F.window(time_col, slide).start.alias("_pane"))
             .agg(F.sum(value).alias("_s"), F.count(value).alias("_c"),
                  F.count(F.lit(1)).alias("_n")))
    fan = panes.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    start = F.timestamp_micros(F.unix_micros("_pane") - F.col("_i").cast("long") * F.lit(slide_us))
    win = (fan.groupBy(*keys, start.alias("_ws"))
           .agg(F.sum("_s").alias("_s"), F.sum("_c").alias("_c"), F.sum("_n").alias("_n")))
    avg = F.col("_s") / F.col("_c")
    if digits is not None:
        avg = F.round(avg, digits)
    start, end = F.col("_ws"), shift(F.col("_ws"), duration)
    if ntz:
        start, end = _ntz(start), _ntz(end)
    return win.select(*keys, start.alias("window_start"), end.alias("window_end"), avg.alias("avg_value"), F.col("_n").alias("event_count"))


SessionAggs = dict  # out name -> (kind, column); kind in count|sum|min|max|avg

_KINDS = ("count", "sum", "min", "max", "avg")


def _session_columns(aggs: SessionAggs) -> list[Column]:
    out = []
    for name, (kind, col) in aggs.items():
        if kind not in _KINDS:
            raise ValueError(f"session aggregate kind must be one of {_KINDS}")
        c = F.lit(1) if col is None else F.col(col)
        fn = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg}[kind]
        out.append(fn(c).alias(name))
    return out


def sessions(df: DataFrame, gap: str, aggs: SessionAggs | None = None, *,
             keys: Sequence[str] = ("key",), time_col: str = EVENT_TIME,
             ntz: bool = True) -> DataFrame:
    """Session windows: a session closes after ``gap`` without events.

    ``aggs`` maps output names to ``(kind, column)`` with kind count, sum,
    min, max or avg (decomposable, so tables can merge partial sessions).
    Events exactly ``gap`` apart share a session; rows without a time have none.
    Streams use ``session_window`` (Append mode); tables use
    :func:`sessionize_batch`.  Both give sessions ``[first, last + gap)``.
    """
    aggs = aggs or {"event_count": ("count", None)}
    if df.isStreaming:
        agg = df.groupBy(*keys, F.session_window(time_col, gap).alias("window")).agg(
            *_session_columns(aggs))
        out = project_window(agg, keys, list(aggs), ntz=ntz)
        return out.withColumnRenamed("window_start", "session_start") \
                  .withColumnRenamed("window_end", "session_end")
    return sessionize_batch(df, gap, aggs, keys=keys, time_col=time_col, ntz=ntz)


def sessionize_batch(df: DataFrame, gap: str, aggs: SessionAggs, *,
                     keys: Sequence[str] = ("key",), time_col: str = EVENT_TIME,
                     ntz: bool = True, partitions: int | None = None) -> DataFrame:
    """Sessions of a table: a segmented scan over ``(key, time)`` ranges gives
    every row the start of its session, then one aggregation by (key, start)
    with a partial step, so neither a hot key nor a long session is one task."""
    keys = list(keys)
    cols = [c for c in dict.fromkeys(c for _, c in aggs.values() if c is not None) if c not in keys]
    timed = df.filter(F.col(time_col).isNotNull())        # as session_window does
    d = timed.select(*keys, F.unix_micros(F.col(time_col)).alias("_t"), *cols)
    scanned = segmented_scan(d, keys, ["_t"], SessionStart("_t", duration_us(gap), "session_from"), partitions=partitions)
    out = scanned.groupBy(*keys, "session_from").agg(F.max("_t").alias("_e"), *_session_columns(aggs))
    start, end = F.timestamp_micros("session_from"), shift(F.timestamp_micros("_e"), gap)
    if ntz:
        start, end = _ntz(start), _ntz(end)
    return out.select(*keys, start.alias("session_start"), end.alias("session_end"), *list(aggs))
