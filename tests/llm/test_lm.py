import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from eddyline.llm import lm as L


def words(x):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or "")) + [None]


def test_base_scores_match_brute_force_and_the_model_beats_them(docs):
    got = {r.doc_id: r for r in L.score_texts(docs).collect()}
    rows = [(r.doc_id, words(r.text)) for r in docs.collect()]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    c = Counter(w for i, ws in rows if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in rows:
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert abs(r.base_score - sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) < 1e-6 * len(ws)
    both = [(sum(r.score for r in got.values() if r.held_out == h), sum(r.base_score for r in got.values() if r.held_out == h))
            for h in (False, True)]
    assert both[0][0] > both[0][1]


def test_class_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    m = L.LogBilinear(rng.dirichlet(np.ones(90)))
    m.out += rng.normal(0, 1, m.out.shape).astype(np.float32)
    ctx = np.repeat(rng.integers(0, 91, (2, 1)), 90, axis=1)
    assert abs(np.exp(m.log_probs(ctx, np.arange(90))).sum() - 1) < 1e-4


def test_kept_normalisers_change_nothing(monkeypatch):
    rng = np.random.default_rng(1)
    m = L.LogBilinear(rng.dirichlet(np.ones(70)))
    ctx, cls = rng.integers(0, 71, (2, 500)), rng.integers(0, 70, 500)
    kept = [m.log_probs(ctx[:, :250], cls[:250]), m.log_probs(ctx, cls)]
    monkeypatch.setattr(L, "TABLE", 10)
    fresh = m.log_probs(ctx, cls)
    assert np.allclose(kept[1], fresh, atol=1e-5) and np.allclose(kept[0], fresh[:250], atol=1e-5)


def test_contrastive_training_learns_a_pattern():
    n = 30_000
    cls = np.tile([0, 1, 2], n // 3)
    uni = np.full(90, 1e-3)
    uni[:3] = 1
    m = L.LogBilinear(uni / uni.sum())
    learn, ctx = m.trainer(), L.contexts(cls, np.array([n]), 90)
    for lo in range(0, n, 512):
        learn(ctx[:, lo:lo + 512], cls[lo:lo + 512])
    p = np.exp(m.log_probs(ctx, cls))
    assert p[-100:].mean() > 0.9


def test_classes_grow_with_the_vocabulary_and_cover_it():
    assert [L.class_number(v) for v in (0, 100, 1_000_000, 8_000_000, 10 ** 9)] == [64, 64, 600, 1200, 6000]
    c = L.Classes([b"the", b"of"], 5)
    got = c.of([b"the", b"nation", b"ration", b"", b"of"])
    assert got[0] == 0 and got[4] == 1 and got[1] == got[2] and 2 <= got[1] < 7 and got[3] == c.end == 7


def test_held_out_score_beats_the_base_score(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = L.score_texts(docs).filter("held_out").agg(
        (F.sum("score") / F.sum("n_tokens")).alias("s"), (F.sum("base_score") / F.sum("n_tokens")).alias("b")).first()
    print(f"held out, log10 a token: {r.s:.3f}, base {r.b:.3f}")
    assert r.s > r.b + 0.06


def test_shares_within_classes_sum_to_one(spark):
    """A class's known words and its unknown words together; and every score is
    a log probability."""
    docs = spark.createDataFrame([(i, f"a{i % 3} b{i % 5}tail c{i % 7}tail d common common") for i in range(300)], "doc_id long, text string")
    vocabulary = sorted({w for r in docs.collect() for w in r.text.split()})
    probes = [(10_000 + i, f"common {w}") for i, w in enumerate(vocabulary)] + [(20_000, "common"), (20_001, "common \u00fcnseen")]
    held = F.col("doc_id") >= 10_000
    got = {r.doc_id: r for r in L.score_texts(docs.union(spark.createDataFrame(probes, "doc_id long, text string")), held=held).collect()}
    known = spark.createDataFrame([(w.encode(), i + 1) for i, w in enumerate(vocabulary)], "word binary, c long")
    classes = L.Classes([b"common"], 7)
    n, v = L.class_counts(known, classes)
    assert n.sum() == sum(range(1, len(vocabulary) + 1)) and v.sum() == len(vocabulary)
    for k in range(1, 8):
        own = [r.c for r in known.collect() if classes.of([bytes(r.word)])[0] == k]
        assert abs(sum((c + 1) / (n[k] + v[k] + 1) for c in own) + 1 / (n[k] + v[k] + 1) - 1) < 1e-12
    assert all(r.score < 0 and math.isfinite(r.score) for r in got.values())
    assert got[20_001].n_known == got[20_001].n_tokens - 1


def test_odd_rows_and_empty_table(odd, none):
    got = L.score_texts(odd).collect()
    assert len(got) == odd.count()
    assert all(r.n_tokens == 1 for r in got if r.doc_id in (2, 3, 7))
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    assert L.score_texts(none).count() == 0
    all_held = L.score_texts(odd, held=F.lit(True)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 for r in all_held)
