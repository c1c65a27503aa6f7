import numpy as np
from pyspark.sql import functions as F

from eddyline.llm import mixing as M


def test_knapsack_is_as_near_as_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n = int(rng.integers(1, 5))
        ls, cs = rng.choice(np.arange(1, 30), n, replace=False), rng.integers(0, 4, n)
        room = int(rng.integers(0, 60))
        sums = {0}
        for a, c in zip(ls, cs):
            sums = {s + a * k for s in sums for k in range(c + 1)}
        take = M.knapsack(ls.astype(np.int64), cs.astype(np.int64), room)
        assert (take <= cs).all()
        assert abs(int((take * ls).sum()) - room) == min(abs(int(s) - room) for s in sums)


def test_targets_are_reshared_until_no_source_is_above_its_cap(spark):
    sizes = {"a": 10, "b": 500, "c": 90, "d": 3, None: 40}
    got = {r.source: r.target for r in M.source_targets(
        spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    names = ["a", "b", "c", "d", None]
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    capped = set()
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        t = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if t[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    exp = {s: 3.0 * sizes[s] if s in capped else t[s] for s in names}
    assert all(abs(got[s] - exp[s]) < 1e-9 for s in names) and abs(sum(got.values()) - 643) < 1e-9


def test_mix_comes_near_every_target_and_reruns_agree(docs):
    a = M.mix_sources(docs, carry=["doc_id", "source"])
    rows = a.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"),
                                   F.first("target").alias("target"), F.max("copies").alias("most")).collect()
    assert max(r.most for r in rows) <= 3
    assert all(abs(r.taken - r.target) <= 0.01 * r.target + 100 for r in rows)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, M.mix_sources(
        docs.repartition(7), carry=["doc_id", "source"]).collect()))


def test_odd_rows_and_empty_table(odd, none):
    out = M.mix_sources(odd)
    assert out.columns[:7] == odd.columns and out.columns[7:] == ["size_", "source_size", "target", "copies_"]
    rows = {(r.doc_id, r.source): r for r in out.collect()}
    assert out.count() == odd.count() and rows[2, "s"].size_ == 0 and rows[7, "t"].size_ == 0
    assert all(0 <= r.copies_ <= 3 for r in rows.values())
    assert M.mix_sources(none).count() == 0


def test_a_length_shared_by_all_documents_is_split_exactly(spark):
    df = spark.range(4000).selectExpr("id doc_id", "'one two three' text", "if(id < 3000, 'x', 'y') source")
    got = {r.source: r for r in M.mix_sources(df).groupBy("source").agg(
        F.sum(F.col("copies") * 3).alias("taken"), F.first("target").alias("target")).collect()}
    assert all(abs(r.taken - r.target) <= 3 for r in got.values())


def test_query_against_brute_force(spark, docs):
    import re
    sizes = {r.doc_id: (r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in docs.collect()}
    total = {}
    for s, n in sizes.values():
        total[s] = total.get(s, 0) + n
    names = sorted((s for s in total if s is not None), key=lambda s: s.encode("utf-32-be")) + [None] * (None in total)
    w, capped = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, set()
    while True:
        free = [s for s in names if s not in capped]
        rest = sum(total.values()) - sum(3 * total[s] for s in capped)
        target = {s: 3.0 * total[s] if s in capped else rest * w[s] / sum(w[x] for x in free) for s in names}
        over = {s for s in free if target[s] > 3 * total[s]}
        if not over:
            break
        capped |= over
    got = M.op1_mix_to_targets(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(sizes)
    taken = {}
    for r in got:
        source, n = sizes[r.doc_id]
        assert (r.size, r.source_size) == (n, total[source]) and abs(r.target - target[source]) < 1e-6
        assert 0 <= r.taken <= 3 * n and (r.taken % n == 0 if n else r.taken == 0)
        taken[source] = taken.get(source, 0) + r.taken
    assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] + 100 for s in names)
    again = M.op1_mix_to_targets(spark, "/root/testdata/sf0.001").collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
