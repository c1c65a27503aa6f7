"""Row-wise foreach with commit marks, a lookup table that changes under a
running stream, expiring state, SQL views, sketches, the accumulator's plan."""

import os

import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from eddyline.functions import udfs
from eddyline.operators import latency
from eddyline.plans import catalog, inputs, views
from eddyline.session import local_path, scratch_dir
from eddyline.streaming.sinks import RowWriter, enrich_refreshing, run_foreach


def lines_of(df):
    return sorted(r.line for r in df.collect())


def test_row_writer_commits_skips_and_fails_cleanly(tmp_path):
    w = RowWriter(str(tmp_path), str)
    assert w.open(0, 7)
    w.process("a")
    w.process("b")
    w.close(None)
    assert not w.open(0, 7)                             # committed: a replay skips the part
    w.close(None)
    assert w.open(1, 7)
    w.process("half")
    w.close(ValueError("lost"))
    assert w.open(1, 7)                                 # not committed: written anew
    w.process("c")
    w.close(None)
    names = sorted(f.base_name for f in pafs.LocalFileSystem().get_file_info(pafs.FileSelector(str(tmp_path / "epoch=7"))))
    assert [n for n in names if not n.startswith("_")] == ["part=0.txt", "part=1.txt"]
    assert (tmp_path / "epoch=7/part=0.txt").read_text() == "a\nb\n"


def test_foreach_replays_an_epoch_without_repeats(spark, sf_small):
    base = scratch_dir(spark, "foreach-test")
    rows = lambda: catalog.passthrough(inputs.file_stream(spark, src, msgs.schema, max_files_per_trigger=n).transform(inputs.decode_front))
    msgs = inputs.messages(spark, sf_small)
    src, n = inputs.stage_stream_files(msgs, 3, "offset", name="foreach-src")
    first = lines_of(run_foreach(rows(), lambda r: r["value"], base=base))
    assert len(first) == catalog.passthrough_filter(spark, sf_small).count()
    root = local_path(base)
    last = max(int(f) for f in os.listdir(f"{root}/checkpoint/commits") if f.isdigit())
    for f in (f"{last}", f".{last}.crc"):
        os.remove(f"{root}/checkpoint/commits/{f}")     # as if the driver died before the commit
    assert lines_of(run_foreach(rows(), lambda r: r["value"], base=base)) == first


def test_lookup_table_that_changes_between_batches(spark):
    path = scratch_dir(spark, "lookup-src")
    for i in range(3):
        spark.createDataFrame([("a", i), ("b", i)], "key string, x int").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("key string, x int").option("maxFilesPerTrigger", 1).parquet(path)
    calls = []

    def loader():
        calls.append(len(calls))
        return spark.createDataFrame([("a", f"v{calls[-1]}")], "key string, name string")

    got = sorted((r.key, r.x, r.name) for r in enrich_refreshing(stream, loader, "key").collect())
    versions = [n for k, _, n in got if k == "a"]
    assert len(calls) == 3 and sorted(versions) == ["v0", "v1", "v2"] and all(n is None for k, _, n in got if k == "b")


def test_seeds_expire(spark, sf_small):
    got = {r.key: (r.running_count, r.seen) for r in catalog.ttl_seed_stream(spark, sf_small).collect()}
    ev = inputs.events(spark, sf_small)
    lo, hi = ev.agg(F.min("produced_at"), F.max("produced_at")).first()
    cut = lo + int((hi - lo) * catalog.SEED_SHARE)
    plain = {r.key: (r.n, r.first) for r in ev.groupBy("key").agg(F.count("*").alias("n"), F.min("produced_at").alias("first")).collect()}
    assert got == {k: (n + (catalog.SEED if first <= cut else 0), n) for k, (n, first) in plain.items()}
    assert len({c - n for c, n in got.values()}) == 2   # some seeds lived, some expired


def test_views_of_batch_queries(spark, sf_small):
    names = views.register_twins(spark, sf_small, ["tumbling_count", "sessions", "running_count"])
    assert names == ["tumbling_count", "sessions", "running_count"]
    n = spark.sql("SELECT sum(event_count) AS n FROM tumbling_count").first().n
    assert n == spark.sql("SELECT sum(event_count) AS n FROM sessions").first().n == spark.table("event_records").count() \
        if "event_records" in views.register_inputs(spark, sf_small) else False
    with pytest.raises(ValueError, match="tumbling_count_stream"):
        views.register_twins(spark, sf_small, ["tumbling_count_stream"])
    assert "sessions" in views.batch_twins() and not any(n.endswith("_stream") for n in views.batch_twins())


def test_sketches_merge_and_stay_within_the_error(spark):
    df = spark.range(50_000).select((F.col("id") % 5).alias("run"), F.pmod(F.col("id") * 7919, F.lit(3001)).alias("latency_ms"))
    runs = latency.latency_sketches(df, ["run"])
    whole = latency.merge_sketches(runs.withColumn("all", F.lit(1)), ["all"])
    got = latency.checked_quantiles(whole, df.select(F.lit(1).alias("all"), F.col("latency_ms").alias("_lat")), ["all"]).first()
    assert got.n == 50_000 and got.p50_ok and got.p95_ok and got.p99_ok
    shifted = df.select(F.lit(1).alias("all"), (F.col("latency_ms") + 500).alias("_lat"))
    assert not latency.checked_quantiles(whole, shifted, ["all"]).first().p50_ok


def test_summary_without_collected_list(spark, sf_small):
    summary = catalog.latency_summary(spark, sf_small)
    assert "collect_list" not in summary._jdf.queryExecution().executedPlan().toString()
    assert summary.columns == ["events", "buckets", "median_p99"]


def test_accumulator_sends_partials(spark):
    """The exchange of one huge group carries a row a task, not the rows."""
    df = spark.range(0, 20_000, 1, 4).select(F.lit("hot").alias("key"), (F.col("id") % 7).cast("double").alias("value"))
    partial = udfs.partial_groups(df, ["key"], "value", udfs.AverageAccumulator())
    assert partial.count() == 4 and partial.columns == ["key", "_sum", "_cnt", "_rows"]
    out = udfs.accumulate_by_group(df, ["key"], "value", "key string, result double, rows long")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 3 and plan.index("Exchange") > plan.index("MapInPandas")
    r = out.first()
    assert (r.key, r.rows) == ("hot", 20_000) and abs(r.result - sum(i % 7 for i in range(20_000)) / 20_000) < 1e-9


def test_sliding_accumulator_equals_windows(spark, sf_small):
    ev = inputs.typed_events(spark, sf_small).withColumn("value", F.when(F.col("event_type") != "error", F.col("value")))
    got = udfs.accumulate_sliding(ev, ["key", "event_type"], "value", "2 hours", "30 minutes")
    exp = ev.groupBy("key", "event_type", F.window("event_time", "2 hours", "30 minutes").alias("w")).agg(
        F.coalesce(F.avg("value"), F.lit(0.0)).alias("a"), F.count("*").alias("n"))
    key = lambda r, s, a, n: (r.key, r.event_type, s, round(a, 6), n)
    assert sorted(key(r, r.window_start, r.result, r.rows) for r in got.collect()) == sorted(
        key(r, r.s, r.a, r.n) for r in exp.select("*", F.col("w.start").cast("timestamp_ntz").alias("s")).collect())


def test_sliding_keeps_its_time_type(spark, sf_small):
    from eddyline.operators.windows import sliding
    ev = inputs.typed_events(spark, sf_small)
    for duration, slide in (("5 minutes", "1 minute"), ("2 minutes", "1 minute")):
        assert dict(sliding(ev, duration, slide, ntz=False).dtypes)["window_start"] == "timestamp"
        assert dict(sliding(ev, duration, slide).dtypes)["window_start"] == "timestamp_ntz"
