"""Stream forms equal batch forms; results do not depend on how the input is
split into micro-batches; a query resumes from its checkpoint without loss
or duplicates (FIXTURES restart, open_window, running_count)."""

import pytest
from pyspark.sql import functions as F

from eddyline.operators import keyed
from eddyline.operators.windows import tumbling, with_event_time
from eddyline.plans import inputs
from eddyline.schema import KAFKA_SOURCE_SCHEMA
from eddyline.session import scratch_dir
from eddyline.sources.files import file_stream
from eddyline.streaming import stateful
from eddyline.streaming.run import drain


def _sorted(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("n_files,engine", [(1, "processor"), (3, "processor"),
                                            (5, "processor"), (3, "aggregate")])
def test_running_count_split_invariant(spark, sf_small, n_files, engine):
    batch = keyed.running_count(inputs.decoded_events(spark, sf_small))
    s = inputs.decode_front(inputs.message_stream(spark, sf_small, n_files))
    got = drain(stateful.running_count_stream(s, engine=engine), output_mode="update",
                keys=["key"], name="split")
    assert _sorted(got.select("key", "running_count")) == _sorted(batch)


def test_tumbling_update_equals_batch_and_append_drops_open(spark, sf_small):
    batch = tumbling(with_event_time(inputs.decoded_events(spark, sf_small)))
    upd = drain(tumbling(with_event_time(inputs.event_stream(spark, sf_small))),
                output_mode="update", keys=["key", "window_start", "window_end"], name="upd")
    assert _sorted(upd) == _sorted(batch)
    app = drain(tumbling(with_event_time(inputs.event_stream(spark, sf_small))),
                output_mode="append", name="app")
    last_end = batch.agg(F.max("window_end")).first()[0]
    # the window holding the newest event is still open at the final watermark
    assert app.count() == batch.count() - batch.filter(F.col("window_end") == last_end).count()


def test_restart_from_checkpoint(spark, sf_small):
    msgs = inputs.messages(spark, sf_small)
    bounds = msgs.agg(F.min("offset"), F.max("offset")).first()
    lo, hi = bounds[0], bounds[1]
    step = (hi - lo) / 4
    src = scratch_dir(spark, "restart-src")

    def add(i):
        cond = (F.col("offset") >= lo + i * step) & (
            (F.col("offset") < lo + (i + 1) * step) if i < 3 else F.lit(True))
        msgs.filter(cond).repartition(1).write.mode("append").parquet(src)

    base = scratch_dir(spark, "restart")
    kw = dict(output_mode="update", keys=["key"], name="restart", path=f"{base}/out",
              checkpoint=f"{base}/ckpt")

    def run():
        s = inputs.decode_front(file_stream(spark, src, KAFKA_SOURCE_SCHEMA))
        return drain(stateful.running_count_stream(s, engine="processor"), **kw)

    add(0)
    add(1)
    run()
    add(2)
    add(3)
    got = run()
    batch = keyed.running_count(inputs.decoded_events(spark, sf_small))
    assert _sorted(got.select("key", "running_count")) == _sorted(batch)


def test_per_record_stream_equals_batch(spark, sf_small):
    batch = keyed.running_count(inputs.decoded_events(spark, sf_small), per_record=True)
    s = inputs.decode_front(inputs.message_stream(spark, sf_small, 5))
    got = drain(stateful.running_count_stream(s, per_record=True), output_mode="append",
                name="per-record")
    got = got.withColumn("event_time", F.col("event_time").cast("timestamp_ntz"))
    assert _sorted(got.select(*batch.columns)) == _sorted(batch)


def test_text_file_stream_of_json_lines(spark, sf_small):
    """JSON lines landed as text files: the message front works on them too."""
    from eddyline.functions.decode import decode_events
    from eddyline.sources.events import read_events
    path = scratch_dir(spark, "json-lines")
    inputs.messages(spark, sf_small).select(F.col("value").cast("string").alias("value")) \
        .write.text(path)
    s = read_events(spark, "text", path, stream=True, options={"maxFilesPerTrigger": "1"})
    got = drain(decode_events(s.withColumnRenamed("value", "json_str")).select("event_id"),
                output_mode="append", name="json-lines")
    assert got.count() == inputs.events(spark, sf_small).count()


def test_allowed_lateness_folds_into_watermark(spark, sf_small):
    s = inputs.event_stream(spark, sf_small)
    plan = with_event_time(s, delay="10 seconds", allowed_lateness="1 minute") \
        ._jdf.queryExecution().logical().toString()
    assert "EventTimeWatermark" in plan and "1 minutes 10 seconds" in plan


class _BusyQuery:
    """A query whose triggers take longer than their interval."""
    recentProgress = [{"batchId": 0, "numInputRows": 7}]

    def __init__(self):
        self.polls, self.stopped = 0, False

    def exception(self):
        return None

    @property
    def status(self):
        self.polls += 1
        assert self.polls < 5, "waits for a pause that never comes"
        return {"isTriggerActive": True}

    def stop(self):
        self.stopped = True


def test_a_consumed_query_stops_though_a_trigger_is_active():
    from eddyline.streaming.run import _wait_done
    q = _BusyQuery()
    _wait_done(q, 7, lambda: True, "busy", 5)
    assert q.stopped and not q.polls


def test_two_parts_hold_the_rows_without_a_time(spark, tmp_path):
    from eddyline.plans import catalog
    spark.sql("SELECT id AS event_id, if(id = 1, null, timestamp_ntz'2024-01-01 00:00:00') AS ts, id AS user_id, 'view' AS event_type, "
              "1D AS value FROM range(3)").write.parquet(f"{tmp_path}/events.parquet")
    staged = drain(inputs.two_part_stream(spark, str(tmp_path), 0.5), name="staged")
    assert staged.count() == catalog._input_rows(spark, str(tmp_path)) == 3
