"""Joins: stream–table enrichment, interval joins, same-window co-aggregation,
table-materialised joins.

Interval joins add a time-bucket equi-key (bucket width ≥ the join bound): a
left row stands in the bucket of its own time; a right row stands in its own
and, if the bound reaches back over its bucket's start, in the one before.
The join is an equi-join on ``(key, bucket)`` plus the exact range filter, a
hot key is spread over its time buckets, and as every left row stands in one
bucket only, each pair is met once and an outer join knows the left rows
without a partner by itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eddyline.functions.durations import duration_us

DEFAULT_MAX_BROADCAST_BYTES = 64 * 1024 * 1024
HEAVY_PARTS = 4              # a key with over 1 / (4 x shuffle width) of the rows is split

_WIDTHS = {T.ByteType: 1, T.BooleanType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4, T.DateType: 4}


def _bytes_of(field: T.StructField) -> Column:
    """Bytes that a value of the column takes in a row: 8, and the contents of
    what has no fixed width."""
    c, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.lit(8) + F.coalesce(F.octet_length(c), F.lit(0))
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.lit(8) + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
    return F.lit(16 if isinstance(kind, T.DecimalType) and kind.precision > 18 else _WIDTHS.get(type(kind), 8))


def table_bytes(table: DataFrame) -> int:
    """Measured size of a table's rows (one aggregation over it)."""
    each = F.lit(8)
    for field in table.schema.fields:
        each = each + _bytes_of(field)
    return int(table.agg(F.sum(each.cast("long"))).first()[0] or 0)


def heavy_keys(df: DataFrame, on: Sequence[str], parts: int) -> DataFrame:
    """``on, _salts``: the keys that hold more than a ``parts``-th of the rows
    (so at most ``parts`` of them), and into how many shares to split each."""
    counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    share = F.lit(df.agg((F.count(F.lit(1)) / F.lit(parts)).alias("s")).first()["s"] or 1.0)
    return counts.filter(F.col("_n") > share).select(*on, F.ceil(F.col("_n") / share).cast("int").alias("_salts"))


def split_join(df: DataFrame, table: DataFrame, on: str | Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join in which a heavy key of ``df`` is dealt over several tasks:
    its rows get one of the key's salts, and the table's rows of that key are
    copied to each of them.  Other keys are joined as they are."""
    on = [on] if isinstance(on, str) else list(on)
    parts = HEAVY_PARTS * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heavy = F.broadcast(heavy_keys(df, on, parts).select(*[F.col(c).alias(f"_h{i}") for i, c in enumerate(on)], "_salts"))
    same = [F.col(c).eqNullSafe(F.col(f"_h{i}")) for i, c in enumerate(on)]
    names = [f"_h{i}" for i in range(len(on))]
    salts = F.coalesce("_salts", F.lit(1))
    salted = df.join(heavy, same, "left").withColumn(
        "_salt", F.pmod(F.monotonically_increasing_id(), salts).cast("int")).drop(*names, "_salts")
    copied = table.join(heavy, same, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop(*names, "_salts")
    return salted.join(copied, [*on, "_salt"], how).drop("_salt")


def enrich(df: DataFrame, table: DataFrame, on: str | Sequence[str], how: str = "left", *,
           broadcast: str | bool = "auto",
           max_broadcast_bytes: int = DEFAULT_MAX_BROADCAST_BYTES) -> DataFrame:
    """Stream–table (or table–table) equi-join (``how`` inner or left).

    ``broadcast=True`` measures the table first and broadcasts it within
    ``max_broadcast_bytes``; deciding before planning keeps the large side from
    being shuffled at all.  Beyond that it is a shuffle join, in which a table
    on the left has its heavy keys split (:func:`split_join`).
    ``broadcast="auto"`` leaves the choice to Catalyst (estimated size under
    ``spark.sql.autoBroadcastJoinThreshold``) and AQE (measured size after
    the shuffle stages ran).
    """
    if broadcast is True:
        if table_bytes(table) <= max_broadcast_bytes:
            return df.join(F.broadcast(table), on, how)
        if not df.isStreaming:
            return split_join(df, table, on, how)
    return df.join(table, on, how)


def time_bucket(ts: str | Column, width_us: int) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_micros(c) / F.lit(width_us)).cast("long")


def _bucketed(left: DataFrame, right: DataFrame, bound: str, left_time: str, right_time: str, factor: int):
    """Both sides with their bucket, and the bound in microseconds."""
    w = duration_us(bound)
    width = max(1, w) * factor
    b = time_bucket(right_time, width)
    # the range [t - bound, t] of left times reaches the bucket before
    crosses = F.unix_micros(F.col(right_time)) - F.lit(w) < b * F.lit(width)
    lb = left.withColumn("_b", time_bucket(left_time, width))
    rb = right.withColumn("_b", F.explode(F.when(crosses, F.array(b, b - F.lit(1))).otherwise(F.array(b))))
    return lb, rb, w


def interval_join(left: DataFrame, right: DataFrame, bound: str, *,
                  key: str = "key", left_time: str = "left_time",
                  right_time: str = "right_time", how: str = "inner",
                  left_id: str | None = None, bucket_factor: int = 2) -> DataFrame:
    """Pairs with equal ``key`` and ``left_time <= right_time <= left_time + bound``.

    Buckets are ``bucket_factor × bound`` wide; only right rows whose range
    crosses their bucket's start are copied (a ``1 / bucket_factor`` share).
    ``how="left"`` also returns every left row without a partner (right
    columns null), rows with a null key or time and repeated rows included, in
    the same single join (``left_id`` is not needed for it any more).  Streams: both sides need watermarks on their time
    columns.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be 'inner' or 'left'")
    lb, rb, w = _bucketed(left, right, bound, left_time, right_time, bucket_factor)
    rb = rb.withColumnRenamed(key, "_rkey").withColumnRenamed("_b", "_rb")
    cond = F.expr(f"`{key}` = _rkey AND _b = _rb AND `{right_time}` >= `{left_time}` AND "
                  f"`{right_time}` <= `{left_time}` + INTERVAL {w} MICROSECONDS")
    return lb.join(rb, cond, "inner" if how == "inner" else "leftOuter").drop("_rkey", "_b", "_rb")


def interval_join_stream(left: DataFrame, right: DataFrame, bound: str, *, key: str = "key",
                         left_time: str = "left_time", right_time: str = "right_time",
                         how: str = "inner") -> DataFrame:
    """Stream–stream form of :func:`interval_join` (Append): the same bucket
    equi-key, for outer joins too, so a hot key's state is spread over its
    buckets.  Both inputs must carry watermarks; an unmatched left row is
    emitted once the watermark has passed its range."""
    if not (left.isStreaming and right.isStreaming):
        raise ValueError("interval_join_stream expects two streams")
    return interval_join(left, right, bound, key=key, left_time=left_time, right_time=right_time, how=how)


def window_cogroup(left: DataFrame, right: DataFrame, duration: str, *, key: str = "key",
                   left_time: str = "left_time", right_time: str = "right_time") -> DataFrame:
    """Same-window join as co-aggregation: per ``(key, window)`` the count of
    rows on each side and whether both sides met.

    Each side is aggregated (map-side combined) before the join, so the join
    meets one row per side and group — never all pairs of a group.
    """
    lw = (left.groupBy(key, F.window(left_time, duration).alias("w"))
          .agg(F.count(F.lit(1)).alias("left_count")))
    rw = (right.groupBy(key, F.window(right_time, duration).alias("w"))
          .agg(F.count(F.lit(1)).alias("right_count")))
    j = lw.join(rw, [key, "w"], "full_outer")
    return j.select(key, F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                    F.col("w.end").cast("timestamp_ntz").alias("window_end"),
                    F.coalesce("left_count", F.lit(0)).alias("left_count"),
                    F.coalesce("right_count", F.lit(0)).alias("right_count"),
                    (F.col("left_count").isNotNull() & F.col("right_count").isNotNull())
                    .alias("joined"))
