"""Decode, encode and event-time functions (FIXTURES §5: json_bad, type_filter,
defaults, epoch_ms_fraction)."""

import datetime as dt

from pyspark.sql import functions as F

from eddyline.functions.decode import decode_events, event_time_col, flexible_event_time
from eddyline.functions.encode import render_count_line, to_kafka_rows
from eddyline.operators.filters import keep_types
from eddyline.schema import CORRUPT_COL


def _json(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "json_str string")


def test_json_bad_is_permissive(spark):
    df = _json(spark, ["garbage", None, '{"event_type":"click"}',
                       '{"event_type":"click","value":"7","key":5}', '{"value":42.0}',
                       '{"produced_at":"2024-01-01T00:00:00Z"}'])
    got = decode_events(df).collect()
    assert len(got) == 6
    assert all(v is None for v in got[0]) and all(v is None for v in got[1])
    assert got[2]["event_type"] == "click" and got[2]["key"] is None
    assert got[3]["key"] == "5" and got[3]["value"] is None
    assert got[4]["value"] is None
    assert got[5]["produced_at"] is None


def test_strict_drops_and_dead_letter_keeps(spark):
    df = _json(spark, ["garbage", None, '{"event_id":"1","event_type":"click"}',
                       '{"event_id":"2","event_type":"view"'])
    strict = decode_events(df, strict=True).collect()
    assert [r["event_id"] for r in strict] == ["1"]
    dead = decode_events(df, keep_corrupt=True).filter(F.col(CORRUPT_COL).isNotNull())
    assert sorted(r[CORRUPT_COL] for r in dead.collect()) == [
        "garbage", '{"event_id":"2","event_type":"view"']


def test_type_filter_keeps_click_and_purchase(spark):
    df = _json(spark, ['{"event_type":"click"}', '{"event_type":"purchase"}',
                       '{"event_type":"view"}', '{"event_id":"x"}', '{"event_type":""}'])
    kept = keep_types(decode_events(df)).collect()
    assert sorted(r["event_type"] for r in kept) == ["click", "purchase"]


def test_defaults_fill_key_value_type(spark):
    df = _json(spark, ['{"event_type":"click","value":5}', '{"key":"k"}'])
    got = decode_events(df, defaults=True).collect()
    assert got[0]["key"] == "unknown" and got[0]["value"] == 5.0
    assert got[1]["value"] == 0.0 and got[1]["event_type"] == ""


def test_epoch_ms_fraction(spark):
    df = spark.createDataFrame([(1700000000999,)], "produced_at long")
    r = df.select(event_time_col("produced_at").alias("a"),
                  event_time_col("produced_at", truncate_seconds=True).alias("b")).first()
    assert r["a"].replace(tzinfo=None) == dt.datetime(2023, 11, 14, 22, 13, 20, 999000)
    assert r["b"].replace(tzinfo=None) == dt.datetime(2023, 11, 14, 22, 13, 20)


def test_flexible_event_time_iso_epoch_ingest(spark):
    df = spark.createDataFrame(
        [("2024-01-01T00:00:01.5Z",), ("1704067202000",), ("not a time",), (None,)], "raw string")
    ingest = F.lit(dt.datetime(2030, 1, 1)).cast("timestamp")
    got = [r[0].replace(tzinfo=None) for r in
           df.select(flexible_event_time("raw", ingest)).collect()]
    assert got == [dt.datetime(2024, 1, 1, 0, 0, 1, 500000), dt.datetime(2024, 1, 1, 0, 0, 2),
                   dt.datetime(2030, 1, 1), dt.datetime(2030, 1, 1)]


def test_to_json_omits_nulls_and_kafka_rows(spark):
    df = spark.createDataFrame([("1", "click", None, 3, 10)],
                               "event_id string, event_type string, key string, value int, "
                               "produced_at long")
    r = to_kafka_rows(df).first()
    assert r["key"] == "1"
    assert r["value"] == '{"event_id":"1","event_type":"click","value":3,"produced_at":10}'


def test_render_count_line(spark):
    df = spark.createDataFrame([("a", 3)], "key string, running_count long")
    assert render_count_line(df).first()["line"] == "key=a  count=3"
