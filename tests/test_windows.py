"""Window edges, sliding membership, sessions, panes (FIXTURES §5)."""

import datetime as dt

import pytest

from pyspark.sql import functions as F

from eddyline.operators.windows import (
    avg_count_agg, sessions, sliding, sliding_panes, tumbling,
)


def _events(spark, rows):
    """rows: (key, 'HH:MM:SS.fff', value)"""
    data = [(k, f"2024-01-01 {t}", v) for k, t, v in rows]
    return (spark.createDataFrame(data, "key string, ts string, value int")
            .withColumn("event_time", F.to_timestamp("ts")).drop("ts"))


def test_window_edges(spark):
    df = _events(spark, [("a", "00:00:00.000", 1), ("a", "00:00:59.999", 1),
                         ("a", "00:01:00.000", 1)])
    got = sorted((r.window_start.time(), r.event_count) for r in tumbling(df).collect())
    assert got == [(dt.time(0, 0), 2), (dt.time(0, 1), 1)]


def test_sliding_membership(spark):
    df = _events(spark, [("a", "00:07:30.000", 4)])
    five = sorted(r.window_start.time() for r in sliding(df).collect())
    assert five == [dt.time(0, m) for m in range(3, 8)]
    four = sorted(r.window_start.time() for r in sliding(df, "2 minutes", "30 seconds").collect())
    assert four == [dt.time(0, 6), dt.time(0, 6, 30), dt.time(0, 7), dt.time(0, 7, 30)]


def test_sliding_panes_equals_sliding(spark, sf_small):
    from eddyline.plans import inputs
    ev = inputs.decoded_events(spark, sf_small)
    a = sliding(ev, aggs=avg_count_agg()).collect()
    b = sliding_panes(ev).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_session_gap(spark):
    # gaps of 4 and 6 minutes with a 5 minute session gap: two sessions
    df = _events(spark, [("a", "00:00:00", 1), ("a", "00:04:00", 1), ("a", "00:10:00", 1),
                         (None, "00:00:00", 1)])
    got = sorted(((r.key or ""), r.session_start.time(), r.session_end.time(), r.event_count)
                 for r in sessions(df, "5 minutes").collect())
    assert got == [("", dt.time(0, 0), dt.time(0, 5), 1),
                   ("a", dt.time(0, 0), dt.time(0, 9), 2),
                   ("a", dt.time(0, 10), dt.time(0, 15), 1)]


def test_sessions_across_chunks_and_exact_gap(spark):
    # a session spanning midnight (chunk boundary) and a gap exactly equal to the gap
    data = [("a", "2024-01-01 23:58:00"), ("a", "2024-01-02 00:02:00"),
            ("a", "2024-01-02 00:07:00"), ("a", "2024-01-02 23:59:00")]
    df = (spark.createDataFrame(data, "key string, ts string")
          .withColumn("event_time", F.to_timestamp("ts")).withColumn("value", F.lit(1)))
    got = sorted((str(r.session_start), r.event_count)
                 for r in sessions(df, "5 minutes", {"event_count": ("count", None),
                                                     "total": ("sum", "value")}).collect())
    # exactly one gap apart: one session, as session_window has it
    assert got == [("2024-01-01 23:58:00", 3), ("2024-01-02 23:59:00", 1)]
    no_time = df.select("key", F.lit(None).cast("timestamp").alias("event_time"), "value")
    assert sessions(df.select("key", "event_time", "value").union(no_time), "5 minutes").count() == 2
    hourly = df.select("key", F.date_trunc("hour", "event_time").alias("event_time"))
    own = sorted(tuple(r) for r in sessions(hourly, "1 hour").collect())
    ref = hourly.groupBy("key", F.session_window("event_time", "1 hour").alias("w")).count()
    assert sorted((r[0], r[3]) for r in own) == sorted((r.key, r["count"]) for r in ref.collect())


def test_session_aggregate_kinds_merge_across_chunks(spark):
    # one session spanning three day-chunks; partials must merge exactly
    data = [("a", "2024-01-01 23:59:00", 1), ("a", "2024-01-02 00:01:00", 4),
            ("a", "2024-01-02 23:59:30", 7), ("a", "2024-01-03 00:00:10", 2)]
    df = (spark.createDataFrame(data, "key string, ts string, value int")
          .withColumn("event_time", F.to_timestamp("ts")))
    aggs = {"n": ("count", None), "s": ("sum", "value"), "lo": ("min", "value"),
            "hi": ("max", "value"), "mean": ("avg", "value")}
    got = sorted((r.n, r.s, r.lo, r.hi, r.mean) for r in sessions(df, "1 day", aggs).collect())
    assert got == [(4, 14, 1, 7, 3.5)]


@pytest.mark.parametrize("block_rows", [3, 10_000])
def test_window_averages_by_blocks_equal_windows(spark, block_rows):
    from eddyline.functions import udfs
    df = spark.sql("SELECT if(id % 5 = 0, null, concat('u', id % 3)) AS key, if(id % 4 = 0, null, cast(id % 11 AS int)) AS value, "
                   "if(id % 17 = 0, null, timestamp_seconds(1704067200 - 7200 + id * 97)) AS event_time FROM range(200)")
    got = udfs.sliding_average_blocks(df, ["key"], "value", "5 minutes", "1 minute", block_rows=block_rows)
    exp = df.groupBy("key", F.window("event_time", "5 minutes", "1 minute").alias("w")).agg(
        F.coalesce(F.avg("value"), F.lit(0.0)).alias("a"), F.count("*").alias("n"))
    exp = exp.select("key", F.col("w.start").cast("timestamp_ntz"), F.col("w.end").cast("timestamp_ntz"), "a", "n")
    assert got.columns == ["key", "window_start", "window_end", "avg_value", "event_count"]
    order = lambda rows: sorted((str(r[0]), *r[1:3], round(r[3], 9), r[4]) for r in rows)
    assert order(got.collect()) == order(exp.collect())
