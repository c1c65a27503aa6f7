import math

import numpy as np
from pyspark.sql import functions as F

from eddyline.llm import topk as K


def brute(rows, k):
    vs = [(r, i, [math.floor(256 * float(np.float32(x))) for x in v]) for r, (i, v) in enumerate(rows)
          if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for r, i, v in vs:
        if i is not None and i % 5 == 0:
            s = sorted((-sum(a * b for a, b in zip(v, w)), (j is None, j or 0), j) for q, j, w in vs if q != r)
            out += [(i, n + 1, j, -x) for n, (x, _, j) in enumerate(s[:k])]
    return sorted(out, key=str)


def check(spark, rows, k=5):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    got = K.exact_topk(df, F.col("vec_id") % 5 == 0, k=k)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, k)


def test_random_copies_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(0, .2, 6)]) for i in range(60)]
    rows += [(100 + i, rows[7][1]) for i in range(20)] + [(200, None), (205, [1.0, None]), (210, [math.nan, 1.0]),
             (215, [math.inf]), (None, rows[0][1]), (220, rows[0][1]), (220, rows[0][1]), (225, [0.0] * 6), (230, [])]
    check(spark, rows)


def test_fewer_candidates_than_k_and_empty(spark):
    check(spark, [(0, [1.0, 2.0]), (1, [-1.0, 0.5])])
    check(spark, [(0, [1.0])])
    check(spark, [])


def test_several_chunks_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(K, "CHUNK", 7)
    monkeypatch.setattr(K, "BLOCK", 2)
    monkeypatch.setattr(K, "TOGETHER", 3)
    rng = np.random.default_rng(2)
    check(spark, [(i, [float(x) for x in rng.normal(0, .3, 5)]) for i in range(80)])


def test_matrices_are_cogrouped_not_joined(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    v = K.whole_vectors(e, "vec_id", "embedding").select(F.col("id").alias("cid"), "v")
    chunks = K._packed(v, 100, 200, 64, 2)
    got = K._entries(chunks, 2, K._packed(v.filter("cid % 50 = 0"), 4, 8, 64, 2), 2, lambda row, s: np.nonzero(s > 10 ** 9))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("FlatMapCoGroupsInPandas") == 1 and got.count() == 0
