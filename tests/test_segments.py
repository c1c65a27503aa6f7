"""Segmented scans equal a plain loop over each key's ordered rows: any number
of ranges and any Arrow batch size, a hot key, equal times, nulls anywhere."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eddyline.operators import segments as S

ROWS_SCHEMA = "k1 string, k2 long, t long, id string, v long, x string"


def make_rows(seed, n=900):
    r = random.Random(seed)
    out = []
    for i in range(n):
        hot = r.random() < 0.4
        k1 = "hot" if hot else r.choice(["a", "b", None])
        k2 = 1 if hot else r.choice([1, 2, None])
        t = 77 if hot and r.random() < 0.7 else r.choice([None, *range(40)])
        out.append((k1, k2, t, None if r.random() < 0.1 else f"{i:04d}", None if r.random() < 0.2 else r.randint(-5, 9),
                    None if r.random() < 0.5 else r.choice(["s0", "s1", "s2", "other"])))
    return out


def ordered(rows):
    """Rows by key, in order (nulls first); ties of null ids are dropped, as
    their order is not defined."""
    seen, by = set(), {}
    for x in rows:
        if x[3] is None and (x[0], x[1], x[2]) in seen:
            continue
        seen.add((x[0], x[1], x[2]) if x[3] is None else None)
        by.setdefault((x[0], x[1]), []).append(x)
    for k in by:
        by[k].sort(key=lambda x: (x[2] is not None, x[2] or 0, x[3] is not None, x[3] or ""))
    return by


@pytest.fixture(params=[(1, 10_000), (5, 7), (23, 50)], ids=["one", "small batches", "many ranges"])
def shape(request, spark):
    parts, batch = request.param
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    yield parts
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def frame(spark, by):
    return spark.createDataFrame([x for rows in by.values() for x in rows], ROWS_SCHEMA).repartition(3)


def values(df, *cols):
    return {(r["k1"], r["k2"], r["t"], r["id"]): tuple(r[c] for c in cols) for r in df.collect()}


def test_sums_counts_previous_and_last_seen(spark, shape):
    by = ordered(make_rows(shape))
    df = frame(spark, by)
    keys, order = ["k1", "k2"], ["t", "id"]
    sums = values(S.segmented_scan(df, keys, order, S.RunningSums({"n": None, "s": "v"}), partitions=shape), "n", "s")
    prev = values(S.segmented_scan(df, keys, order, S.PreviousValue("v", "p", T.LongType()), partitions=shape), "p")
    back = values(S.segmented_scan(df, keys, [F.col(c).desc() for c in order],
                                   S.PreviousValue("v", "p", T.LongType()), partitions=shape), "p")
    seen = values(S.segmented_scan(df, keys, order, S.LastSeen("x", "l", T.StringType()), partitions=shape), "l")
    for rows in by.values():
        total, last = 0, None
        for i, x in enumerate(rows):
            total, last, at = total + (x[4] or 0), x[5] or last, x[:4]
            assert sums[at] == (i + 1, total)
            assert prev[at] == (rows[i - 1][4] if i else None,)
            assert back[at] == (rows[i + 1][4] if i + 1 < len(rows) else None,)
            assert seen[at] == (last,)


def test_session_starts(spark, shape):
    by = ordered([x for x in make_rows(shape + 100) if x[2] is not None])
    got = values(S.segmented_scan(frame(spark, by), ["k1", "k2"], ["t", "id"], S.SessionStart("t", 1, "start"),
                                  partitions=shape), "start")
    for rows in by.values():
        start = last = None
        for x in rows:
            start = x[2] if last is None or x[2] - last > 1 else start
            last = x[2]
            assert got[x[:4]] == (start,)


def machine(types, stage=0, done=0, n=3):
    for x in types:
        if x == f"s{stage}":
            stage += 1
            if stage == n:
                stage, done = 0, done + 1
    return stage, done


def test_funnel_by_key(spark, shape):
    by = ordered(make_rows(shape + 200))
    got = S.segmented_fold(frame(spark, by), ["k1", "k2"], ["t", "id"], "x", ["s0", "s1", "s2"], partitions=shape)
    assert got.columns == ["k1", "k2", "stage", "completed"]
    assert {(r[0], r[1]): (r[2], r[3]) for r in got.collect()} == {k: machine([x[5] for x in v]) for k, v in by.items()}


def test_transition_tables_from_every_stage():
    r = random.Random(3)
    for size in (1, 2, 50, 400):
        codes = np.array([r.choice([-1, 0, 1, 2]) for _ in range(size)])
        new = np.array([i == 0 or r.random() < 0.1 for i in range(size)])
        stages, counts = S.transition_tables(new, codes, 3)
        for k, part in enumerate(np.split(codes, np.flatnonzero(new)[1:])):
            for s in range(3):
                assert (stages[k, s], counts[k, s]) == machine([f"s{c}" for c in part], s)


def test_step_codes_of_nulls():
    assert S.step_codes(pa.array(["b", None, "z", "a"]), ["a", "b"]).tolist() == [1, -1, -1, 0]


def test_one_key_at_one_instant_spreads(spark):
    df = spark.range(4000).select(F.lit("k").alias("k"), F.lit(5).alias("t"), F.lit(None).cast("string").alias("id"))
    sizes = [r["count"] for r in S._ranged(df, ["k"], ["t", "id"], 8).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1200
    out = S.segmented_scan(df, ["k"], ["t", "id"], S.RunningSums({"n": None}), partitions=8)
    assert sorted(r["n"] for r in out.collect()) == list(range(1, 4001))


def test_empty_table_and_no_keys(spark):
    df = spark.createDataFrame([], ROWS_SCHEMA)
    assert S.segmented_scan(df, ["k1"], ["t"], S.RunningSums({"n": None})).count() == 0
    assert S.segmented_fold(df, ["k1"], ["t"], "x", ["s0"]).count() == 0
    some = spark.createDataFrame([(None, None, i, None, 1, None) for i in range(50)], ROWS_SCHEMA)
    out = S.segmented_scan(some, [], ["t"], S.RunningSums({"n": None}), partitions=4)
    assert {r["t"]: r["n"] for r in out.collect()} == {i: i + 1 for i in range(50)}
