import re

import numpy as np
import xxhash

from eddyline.llm import simhash as S


def fingerprint(x):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
    hs = [xxhash.xxh64_intdigest(" ".join(w[j:j + 4]).encode(), 42) for j in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(fps, distance):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fs = sorted(root)
    for i, a in enumerate(fs):
        for b in fs[:i]:
            if (a ^ b).bit_count() <= distance:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {f: find(f) for f in fs}


def test_query_matches_brute_force(spark, sf_small, docs):
    rows = docs.collect()
    fps = {r.doc_id: fingerprint(r.text) for r in rows}
    root = components(set(fps.values()), 4)
    first = {}
    for i, f in sorted(fps.items()):
        first.setdefault(root[f], i)
    got = S.op10_simhash_pigeonring(spark, sf_small).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {
        i: (f"{f:016x}", first[root[f]]) for i, f in fps.items()}


def test_links_of_dense_and_sparse_fingerprints(spark):
    rng = np.random.default_rng(2)
    fps = set()
    for _ in range(40):
        seed = int(rng.integers(0, 2 ** 63))
        for _ in range(6):
            f = seed
            for b in rng.choice(64, int(rng.integers(0, 7)), replace=False):
                f ^= 1 << int(b)
            fps.add(f)
    dense = int(rng.integers(0, 2 ** 63))
    fps |= {dense ^ (1 << a) ^ (1 << b) for a in range(0, 24) for b in range(24, 40)}
    signed = [(f - 2 ** 64 if f >= 2 ** 63 else f,) for f in fps]
    df = spark.createDataFrame(signed, "fp long")
    for distance, hot in ((4, 20_000), (4, 40), (0, 20_000), (2, 20_000), (7, 20_000)):
        from eddyline.llm.components import connected_components
        roots = {r.node % 2 ** 64: r.root % 2 ** 64 for r in connected_components(
            S.fingerprint_links(df, distance, hot)).collect()}
        exp = components(fps, distance)
        same = {}
        for f in fps:
            same.setdefault(exp[f], set()).add(roots.get(f, f))
        assert all(len(s) == 1 for s in same.values()), distance
        assert len({next(iter(s)) for s in same.values()}) == len(same)


def test_odd_rows_and_empty_table(odd, none):
    got = S.simhash_groups(odd).collect()
    assert len(got) == odd.count()
    assert {r.component_id for r in got if r.doc_id in (2, 3, 7)} == {2} and all(
        r.fp == 0 for r in got if r.doc_id in (2, 3, 7))
    assert {r.component_id for r in got if r.doc_id in (1, 8)} == {1}
    assert S.simhash_groups(none).count() == 0
