"""The four jobs as runnable streaming queries: files in, Parquet out,
drained with availableNow, equal to the batch forms."""

import pytest
from pyspark.sql import functions as F

from eddyline.config import PipelineConfig
from eddyline.operators import keyed
from eddyline.operators.dedup import latest_per_key
from eddyline.plans import catalog, inputs
from eddyline.session import scratch_dir
from eddyline.sources.files import stage_stream_files
from eddyline.streaming import patterns
from eddyline.streaming.run import read_result


@pytest.mark.parametrize("pattern", ["01", "02", "03", "04"])
def test_pattern_job_equals_batch(spark, sf_small, pattern):
    src, _ = stage_stream_files(inputs.messages(spark, sf_small), 2, "offset", name="job-src")
    base = scratch_dir(spark, f"job-{pattern}")
    cfg = PipelineConfig(mode="available_now")
    q = patterns.start(spark, pattern, cfg, source_kind="files", path=src, sink="parquet",
                       out=f"{base}/out", checkpoint=f"{base}/ckpt")
    assert q.awaitTermination(300)
    assert q.exception() is None
    ev = inputs.decoded_events(spark, sf_small)
    expected = {"01": catalog.passthrough(ev),
                "02": catalog.tumbling_count_plan(ev),
                "03": catalog.sliding_avg_plan(ev),
                "04": keyed.running_count(ev)}[pattern]
    mode = patterns.PATTERNS[pattern][1]
    schema = patterns.build(pattern, inputs.decode_front(
        spark.read.parquet(src))).schema
    got = read_result(spark, schema, f"{base}/out", mode)
    if mode == "update":
        keys = ["key"] if pattern == "04" else ["key", "window_start", "window_end"]
        got = latest_per_key(got, keys, ["batch_id"]).drop("batch_id")
    cols = expected.columns
    got = got.select(*[F.col(c).cast(expected.schema[c].dataType) for c in cols])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))


@pytest.mark.parametrize("mode", ["microbatch", "realtime", "available_now"])
@pytest.mark.parametrize("pattern", ["01", "02", "03", "04"])
def test_output_mode_of_every_pattern(pattern, mode):
    got = patterns.output_mode(pattern, PipelineConfig(mode=mode))
    assert got == ("append" if pattern == "01" and mode != "realtime" else "update")


def test_pattern_04_rate_limit_is_a_default():
    assert patterns.with_rate_limit("04", PipelineConfig()).max_offsets_per_trigger == 10_000
    assert patterns.with_rate_limit("04", PipelineConfig(max_offsets_per_trigger=7)).max_offsets_per_trigger == 7
    assert patterns.with_rate_limit("02", PipelineConfig()).max_offsets_per_trigger is None
