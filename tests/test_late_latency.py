"""Late rows (FIXTURES late / not_late) and percentile ranks (percentile_rank,
percentile_one, latency_gap)."""

from pyspark.sql import functions as F

from eddyline.operators import late, latency


def _arrivals(spark, times):
    data = [(i, f"2024-01-01 {t}") for i, t in enumerate(times)]
    return (spark.createDataFrame(data, "arrival_seq long, ts string")
            .withColumn("event_time", F.to_timestamp("ts")))


def test_late_fixture(spark):
    df = _arrivals(spark, ["00:00:30", "00:02:00", "00:00:40"])
    got = [r.is_late for r in late.mark_late(df, window="1 minute", chunk_rows=2)
           .orderBy("arrival_seq").collect()]
    assert got == [False, False, True]


def test_not_late_fixture(spark):
    df = _arrivals(spark, ["00:00:30", "00:01:05", "00:00:40"])
    got = [r.is_late for r in late.mark_late(df, window="1 minute").orderBy("arrival_seq")
           .collect()]
    assert got == [False, False, False]


def _lat(spark, values, received=None):
    received = received or [0] * len(values)
    return spark.createDataFrame(list(zip(received, values)), "received_at long, latency_ms long")


def test_percentile_rank_lower_nearest(spark):
    r = latency.latency_report(_lat(spark, list(range(1, 101))), "1 hour").first()
    assert (r.n, r.p50, r.p95, r.p99, r.min, r.max) == (100, 51, 96, 100, 1, 100)
    assert r.mean == 50.5


def test_percentile_one_sample(spark):
    r = latency.latency_report(_lat(spark, [7]), "1 hour").first()
    assert (r.p50, r.p95, r.p99) == (7, 7, 7)


def test_latency_gap_bucket_marked_empty(spark):
    df = _lat(spark, [10, 20, 30], received=[1000, 1500, 11_000])
    out = latency.latency_buckets(df, "5 seconds").orderBy("bucket_start").collect()
    assert [(r.n, r.is_empty) for r in out] == [(2, False), (0, True), (1, False)]
    rep = latency.latency_report(df, "5 seconds")
    s = latency.latency_summary(rep).first()
    assert s.buckets == 2 and s.median_p99 == 25.0 and s.events == 3
    assert [r.p99 for r in latency.p99_rows(rep).collect()] == [20, 30]


def test_split_late_outputs_partition_rows(spark):
    df = _arrivals(spark, ["00:00:30", "00:02:00", "00:00:40", "00:03:00", "00:01:10"])
    on_time, late_rows = late.split_late(df, window="1 minute")
    assert on_time.count() + late_rows.count() == 5
    assert sorted(r.arrival_seq for r in late_rows.collect()) == [2, 4]


def test_summary_query_lists_every_bucket_p99(spark, tmp_path):
    import duckdb

    from eddyline.plans.catalog import QUERIES
    from eddyline.plans.oracle import ORACLE
    hours = [5, 0, 0, 2, 2, 11]                  # out of order, with empty hours
    duckdb.sql("COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + INTERVAL (h) HOUR AS ts, i AS user_id, 'view' AS event_type, "
               f"1.0 AS value FROM (SELECT unnest({list(range(6))}) AS i, unnest({hours}) AS h)) "
               f"TO '{tmp_path}/events.parquet' (FORMAT PARQUET)")
    duckdb.sql(f"CREATE OR REPLACE TEMP VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = duckdb.sql(ORACLE["latency_summary"])
    got = QUERIES["latency_summary"](spark, str(tmp_path))
    assert got.columns == want.columns == ["events", "buckets", "median_p99", "p99_list"]
    row = tuple(got.first())
    assert row == want.fetchall()[0] and len(row[3].split(",")) == row[1] == 4
