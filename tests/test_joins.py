"""Interval joins with time-bucket keys equal the plain range join (FIXTURES
interval_join), including pairs across bucket edges."""

import numpy as np
import pytest
import pandas as pd
from pyspark.sql import functions as F

from eddyline.operators import joins


def _side(spark, rows, id_col, t_col):
    return (spark.createDataFrame(rows, f"key string, {id_col} string, s long")
            .withColumn(t_col, F.timestamp_seconds(F.col("s") + F.lit(1704067200))).drop("s"))


def test_interval_join_fixture(spark):
    views = _side(spark, [("k", "v1", 0), ("k", "v2", 10_000)], "view_id", "view_time")
    clicks = _side(spark, [("k", "c1", 60), ("k", "c2", 5400)], "click_id", "click_time")
    inner = joins.interval_join(views, clicks, "1 hour", left_time="view_time",
                                right_time="click_time").collect()
    assert [(r.view_id, r.click_id) for r in inner] == [("v1", "c1")]
    left = joins.interval_join(views, clicks, "1 hour", left_time="view_time",
                               right_time="click_time", how="left", left_id="view_id")
    assert sorted((r.view_id, r.click_id or "") for r in left.collect()) == [
        ("v1", "c1"), ("v2", "")]


@pytest.mark.parametrize("factor", [1, 2, 3])
def test_interval_join_matches_brute_force(spark, factor):
    rng = np.random.default_rng(11)
    v = pd.DataFrame({"key": rng.choice(["a", "hot", "hot", "b"], 400),
                      "view_id": [f"v{i}" for i in range(400)], "s": rng.integers(0, 30_000, 400)})
    c = pd.DataFrame({"key": rng.choice(["a", "hot", "hot", "b"], 400),
                      "click_id": [f"c{i}" for i in range(400)], "s": rng.integers(0, 30_000, 400)})
    views = _side(spark, list(v.itertuples(index=False)), "view_id", "view_time")
    clicks = _side(spark, list(c.itertuples(index=False)), "click_id", "click_time")
    got = sorted((r.view_id, r.click_id) for r in joins.interval_join(
        views, clicks, "20 minutes", left_time="view_time", right_time="click_time",
        bucket_factor=factor).collect())
    m = v.merge(c, on="key", suffixes=("_v", "_c"))
    m = m[(m.s_c >= m.s_v) & (m.s_c <= m.s_v + 1200)]
    assert got == sorted(zip(m.view_id, m.click_id))


def test_window_cogroup_counts(spark):
    views = _side(spark, [("k", "v1", 0), ("k", "v2", 100), ("j", "v3", 0)], "view_id", "view_time")
    clicks = _side(spark, [("k", "c1", 200), ("k", "c2", 4000)], "click_id", "click_time")
    got = sorted((r.key, r.window_start.hour, r.left_count, r.right_count, r.joined)
                 for r in joins.window_cogroup(views, clicks, "1 hour", left_time="view_time",
                                               right_time="click_time").collect())
    assert got == [("j", 0, 1, 0, False), ("k", 0, 2, 1, True), ("k", 1, 0, 1, False)]


def test_enrich_checked_broadcast(spark):
    facts = spark.createDataFrame([("a", 1), ("b", 2)], "key string, x int")
    dim = spark.createDataFrame([("a", "A")], "key string, name string")
    out = joins.enrich(facts, dim, "key", broadcast=True)
    assert sorted((r.key, r.name) for r in out.collect()) == [("a", "A"), ("b", None)]
    assert "broadcast" in out._jdf.queryExecution().optimizedPlan().toString().lower() or \
        "Broadcast" in out._jdf.queryExecution().executedPlan().toString()


def test_left_interval_join_nulls_and_repeats(spark):
    """One join: repeated rows, repeated ids, null keys and null times."""
    rng = np.random.default_rng(3)
    v = [(str(rng.choice(["a", "hot"])), f"v{i % 90}", int(rng.integers(0, 20_000))) for i in range(300)]
    v += [(None, "n1", 5), ("a", None, 700), ("a", "t", None), v[0], v[0]]
    c = [(str(rng.choice(["a", "hot"])), f"c{i}", int(rng.integers(0, 20_000))) for i in range(60)]
    c += [(None, "cn", 5), ("a", "ct", None), c[0]]
    views, clicks = _side(spark, v, "view_id", "view_time"), _side(spark, c, "click_id", "click_time")
    got = joins.interval_join(views, clicks, "5 minutes", left_time="view_time", right_time="click_time", how="left")
    exp = []
    for k, i, s in v:
        hits = [c2 for k2, c2, s2 in c if k is not None and k == k2 and s is not None and s2 is not None and s <= s2 <= s + 300]
        exp += [(str(k), str(i), str(h)) for h in hits or [None]]
    assert sorted((str(r.key), str(r.view_id), str(r.click_id)) for r in got.collect()) == sorted(exp)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "Aggregate" not in plan and "LeftAnti" not in plan


def test_wide_rows_are_not_broadcast(spark):
    facts = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "key string, x int")
    wide = spark.createDataFrame([("a", "y" * 200_000), ("c", "z")], "key string, name string")
    assert 200_000 < joins.table_bytes(wide) < 201_000
    out = joins.enrich(facts, wide, "key", broadcast=True, max_broadcast_bytes=100_000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted((str(r.key), r.x, r.name and len(r.name)) for r in out.collect()) == [
        ("None", 3, None), ("a", 1, 200_000), ("b", 2, None)]


@pytest.mark.parametrize("how", ["left", "inner"])
def test_split_join_spreads_a_heavy_key(spark, how):
    rows = [("hot" if i % 3 == 0 else None if i % 3 == 1 else f"k{i % 40}", i) for i in range(3000)]
    facts = spark.createDataFrame(rows, "key string, x int").repartition(3)
    dim = spark.createDataFrame([("hot", "H1"), ("hot", "H2"), ("k2", "K"), (None, "N"), ("zz", "Z")], "key string, name string")
    heavy = {r.key: r._salts for r in joins.heavy_keys(facts, ["key"], 16).collect()}
    assert heavy == {"hot": 6, None: 6}
    got = sorted((str(r.key), r.x, str(r.name)) for r in joins.split_join(facts, dim, "key", how).collect())
    exp = sorted((str(r.key), r.x, str(r.name)) for r in facts.join(dim, "key", how).collect())
    assert got == exp and joins.split_join(facts, dim, "key", how).columns == ["key", "x", "name"]
    assert joins.split_join(facts.limit(0), dim, "key", how).count() == 0
