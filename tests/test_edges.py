"""Empty inputs and nulls: operators return empty results, never fail."""

from pyspark.sql import functions as F

from eddyline.operators import keyed, late, latency
from eddyline.operators.windows import sessions, tumbling, with_event_time
from eddyline.plans import inputs
from eddyline.schema import KAFKA_SOURCE_SCHEMA
from eddyline.session import scratch_dir
from eddyline.sources.files import file_stream
from eddyline.streaming import stateful
from eddyline.streaming.run import drain


def _empty_events(spark):
    return spark.createDataFrame(
        [], "event_id string, event_type string, key string, value int, produced_at long"
    ).withColumn("event_time", F.timestamp_millis("produced_at"))


def test_empty_tables(spark):
    ev = _empty_events(spark)
    assert tumbling(ev).count() == 0
    assert sessions(ev, "5 minutes").count() == 0
    assert keyed.running_count(ev, per_record=True).count() == 0
    assert keyed.inactivity_alerts(ev, "1 hour").count() == 0
    assert keyed.funnel_states(ev).count() == 0
    lat = spark.createDataFrame([], "received_at long, latency_ms long")
    assert latency.latency_report(lat, "1 hour").count() == 0
    assert latency.latency_buckets(lat, "1 hour").count() == 0
    arr = ev.withColumn("arrival_seq", F.lit(0).cast("long"))
    assert late.mark_late(arr, window="1 minute").count() == 0


def test_empty_stream_drains(spark, sf_small):
    path = scratch_dir(spark, "empty-src")
    inputs.messages(spark, sf_small).limit(0).write.parquet(path)
    s = inputs.decode_front(file_stream(spark, path, KAFKA_SOURCE_SCHEMA))
    assert drain(tumbling(with_event_time(s)), output_mode="update",
                 keys=["key", "window_start", "window_end"], name="empty-upd").count() == 0
    s2 = inputs.decode_front(file_stream(spark, path, KAFKA_SOURCE_SCHEMA))
    assert drain(s2.select("event_id"), output_mode="append", name="empty-app").count() == 0
    s3 = inputs.decode_front(file_stream(spark, path, KAFKA_SOURCE_SCHEMA))
    out = drain(stateful.running_count_stream(s3, engine="processor"), output_mode="update",
                keys=["key"], name="empty-proc")
    assert out.count() == 0
