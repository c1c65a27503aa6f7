"""Per-key state operators, batch forms (FIXTURES §5: running_count, null_key,
inactivity) and brute-force checks of the funnel and co-processing."""

import datetime as dt

import numpy as np
import pytest
import pandas as pd
from pyspark.sql import functions as F

from eddyline.operators import keyed


def _ev(spark, rows):
    """rows: (key, seconds, event_type[, event_id])"""
    data = [(r[0], r[1], r[2], r[3] if len(r) > 3 else str(i)) for i, r in enumerate(rows)]
    return (spark.createDataFrame(data, "key string, s long, event_type string, event_id string")
            .withColumn("event_time", F.timestamp_seconds(F.col("s") + F.lit(1704067200)))
            .withColumn("value", F.col("s").cast("int")).drop("s"))


def test_running_count_fixture(spark):
    df = _ev(spark, [("a", 1, "x"), ("b", 2, "x"), ("a", 3, "x"), ("a", 4, "x"), ("b", 5, "x")])
    per = keyed.running_count(df, per_record=True, partitions=3).orderBy("event_time")
    assert [(r.key, r.running_count) for r in per.collect()] == [
        ("a", 1), ("b", 1), ("a", 2), ("a", 3), ("b", 2)]
    final = dict((r.key, r.running_count) for r in keyed.running_count(df).collect())
    assert final == {"a": 3, "b": 2}


def test_null_key_is_its_own_group(spark):
    df = _ev(spark, [(None, 1, "x"), (None, 2, "x"), ("a", 3, "x")])
    per = keyed.running_count(df, per_record=True, partitions=3).collect()
    assert sorted(((r.key or ""), r.running_count) for r in per) == [("", 1), ("", 2), ("a", 1)]


def test_inactivity_fixture(spark):
    # events at 00:00, 00:04, 00:20 with a 5 minute gap: one alert at 00:09; the last
    # event alerts only once the final watermark passes 00:25
    df = _ev(spark, [("k", 0, "x"), ("k", 240, "x"), ("k", 1200, "x")])
    got = keyed.inactivity_alerts(df, "5 minutes", delay="10 seconds").collect()
    assert [r.alert_time.time() for r in got] == [dt.time(0, 9)]
    later = df.unionByName(_ev(spark, [("other", 1600, "x", "z")]))
    got2 = sorted(r.alert_time.time() for r in keyed.inactivity_alerts(
        later.filter("key = 'k' OR key = 'other'"), "5 minutes").filter("key = 'k'").collect())
    assert got2 == [dt.time(0, 9), dt.time(0, 25)]


def _brute_funnel(types, steps=("view", "click", "purchase")):
    stage, done = 0, 0
    for t in types:
        if t == steps[stage]:
            stage += 1
            if stage == len(steps):
                stage, done = 0, done + 1
    return stage, done


@pytest.mark.parametrize("partitions", [None, 1, 7])
def test_funnel_matches_brute_force(spark, partitions):
    rng = np.random.default_rng(3)
    n = 2000
    pdf = pd.DataFrame({
        "key": np.where(rng.random(n) < 0.4, "hot", rng.choice(["a", "b", "c"], n)),
        "s": rng.integers(0, 20_000, n),
        "event_type": rng.choice(["view", "click", "purchase", "error"], n),
    })
    pdf["event_id"] = [f"{i:05d}" for i in range(n)]
    df = (spark.createDataFrame(pdf).withColumn(
        "event_time", F.timestamp_seconds(F.col("s") + F.lit(1704067200))))
    got = {r.key: (r.stage, r.completed) for r in keyed.funnel_states(
        df, partitions=partitions).collect()}
    exp = {k: _brute_funnel(g.sort_values(["s", "event_id"]).event_type)
           for k, g in pdf.groupby("key")}
    assert got == exp


@pytest.mark.parametrize("partitions", [None, 5])
def test_co_process_matches_brute_force(spark, partitions):
    rng = np.random.default_rng(5)
    n = 1500
    pdf = pd.DataFrame({"key": rng.choice(["a", "b"], n), "s": rng.integers(0, 40_000, n),
                        "event_type": rng.choice(["view", "click"], n)})
    pdf["event_id"] = [f"{i:05d}" for i in range(n)]
    df = spark.createDataFrame(pdf).withColumn(
        "event_time", F.timestamp_seconds(F.col("s") + F.lit(1704067200)))
    got = {r.click_id: r.view_id for r in keyed.co_process(
        df.filter("event_type = 'view'"), df.filter("event_type = 'click'"), "1 hour",
        partitions=partitions).collect()}
    exp = {}
    for _, g in pdf.sort_values(["s", "event_id"]).groupby("key"):
        last = None
        for r in g.itertuples():
            if r.event_type == "view":
                last = (r.event_id, r.s)
            else:
                exp[r.event_id] = last[0] if last and r.s - last[1] <= 3600 else None
    assert got == exp


def test_collect_recent_and_type_map(spark):
    df = _ev(spark, [("a", i, "view" if i % 2 else "click") for i in range(10)])
    r = keyed.collect_recent(df, 3).first()
    assert keyed.collect_recent(df, 3).first().recent == "7,8,9"
    assert r.recent == "7,8,9" and r.n_recent == 3
    m = {x.event_type: x.type_count for x in keyed.counts_by_type(df).collect()}
    assert m == {"view": 5, "click": 5}


def test_dup_fixture(spark):
    from eddyline.operators.dedup import dedup, latest_per_key
    df = _ev(spark, [("a", 1, "x", "e1"), ("a", 1, "x", "e1"), ("a", 1, "x", "e1"),
                     ("b", 2, "y", "e2")])
    assert sorted(r.event_id for r in dedup(df, ["event_id"]).collect()) == ["e1", "e2"]
    last = latest_per_key(df.withColumn("v", F.lit(0)), ["key"], ["event_time", "event_id"])
    assert sorted((r.key, r.event_id) for r in last.collect()) == [("a", "e1"), ("b", "e2")]


def test_accumulator_groups_across_arrow_batches(spark):
    from eddyline.functions import udfs
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [("a" if i < 50 else ("b" if i < 53 else None), float(i) if i % 5 else None)
                for i in range(60)]
        df = spark.createDataFrame(rows, "key string, value double")
        got = {r.key: (round(r.result, 6), r.rows) for r in udfs.accumulate_by_group(
            df, ["key"], "value", "key string, result double, rows long").collect()}
        pdf = df.toPandas()
        exp = {}
        for k, g in pdf.groupby(pdf.key.fillna("<n>")):
            v = g.value.dropna()
            exp[None if k == "<n>" else k] = (round(v.mean(), 6) if len(v) else 0.0, len(g))
        assert got == exp
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("partitions", [None, 9])
def test_running_count_hot_key_adaptive(spark, partitions):
    rng = np.random.default_rng(9)
    n = 1200
    pdf = pd.DataFrame({"key": np.where(rng.random(n) < 0.5, "hot", rng.choice(["a", "b"], n)),
                        "s": rng.integers(0, 100_000, n)})
    pdf["event_id"] = [f"{i:05d}" for i in range(n)]
    df = spark.createDataFrame(pdf).withColumn(
        "event_time", F.timestamp_seconds(F.col("s") + F.lit(1704067200)))
    got = {r.event_id: r.running_count for r in keyed.running_count(
        df, per_record=True, partitions=partitions).collect()}
    exp = {}
    for _, g in pdf.sort_values(["s", "event_id"]).groupby("key"):
        for i, eid in enumerate(g.event_id, 1):
            exp[eid] = i
    assert got == exp


@pytest.mark.parametrize("partitions", [None, 1, 7, 40])
def test_null_times_and_keys_count_alike_at_every_number_of_ranges(spark, partitions):
    rng = np.random.default_rng(4)
    rows = [(None if rng.random() < 0.4 else str(rng.choice(["a", "b"])),
             None if rng.random() < 0.2 else int(rng.integers(0, 3600)), f"{i:04d}") for i in range(300)]
    df = spark.createDataFrame(rows, "key string, s long, event_id string").withColumn(
        "event_time", F.timestamp_seconds("s")).withColumn("value", F.lit(2))
    exp, seen = {}, {}
    for k, t, e in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        seen[k] = seen.get(k, 0) + 1
        exp[e] = seen[k]
    got = keyed.running_count(df, per_record=True, partitions=partitions)
    assert {r.event_id: r.running_count for r in got.collect()} == exp
    total = keyed.running_sum(df, partitions=partitions)
    assert {r.event_id: r.running_sum for r in total.collect()} == {e: 2 * n for e, n in exp.items()}
