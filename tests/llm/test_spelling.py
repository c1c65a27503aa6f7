import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from eddyline.llm import spelling as S

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def brute_words(docs, min_length=5, min_count=3):
    total = Counter()
    for doc, text in docs:
        for m in RUN.finditer(text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m.group())
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % 97 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            total[w] += 1
    return {w: n for w, n in total.items() if len(w) >= min_length and n >= min_count}


def edits(w, letters):
    for i in range(len(w) + 1):
        for c in letters:
            yield w[:i] + c + w[i:]
            yield w[:i] + c + w[i + 1:]
        yield w[:i] + w[i + 1:]


def brute_groups(n):
    letters = sorted(set("".join(n)))
    near = {w: {x for x in edits(w, letters) if x in n and x != w} for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def got(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(tuple(r) for r in df.collect())


def vocabulary(seed, letters="abcdeé", size=400, longest=8):
    r = random.Random(seed)
    out = {}
    while len(out) < size:
        w = "".join(r.choices(letters, weights=[8, 4, 3, 2, 1, 1][:len(letters)], k=r.randint(5, longest)))
        out[w] = r.choice([3, 4, 6, 8, 20, 50, 50])
    return out


@pytest.mark.parametrize("hot,bucket", [(100_000, 24), (40, 3), (7, 1)])
def test_groups_against_brute_force(spark, monkeypatch, hot, bucket):
    """Also with the trie split by Spark, and nodes dealt over blocks."""
    monkeypatch.setattr(S, "BUCKET", bucket)
    n = vocabulary(hot)
    n["x" * 70], n["x" * 71], n["y" + "x" * 70], n["xxxxx"] = 3, 9, 40, 5
    df = spark.createDataFrame([(w, c, 1) for w, c in n.items()], "word string, n long, node int")
    assert got(S.variant_groups(df, hot=hot)) == brute_groups(n)


def test_one_node_against_brute_force():
    r = random.Random(1)
    groups = list("abcde") + ["é"] + [c for c in "fghijklmnopqrstuvwxyz"]
    words = [w.encode("latin-1") for w in vocabulary(3, size=700)]
    r.shuffle(words)
    i, j = S._Search(words, words, np.zeros(len(words), np.int64), groups, 0).run()
    pairs = sorted((min(words[a], words[b]), max(words[a], words[b])) for a, b in zip(i, j))
    want = sorted((a, b) for a in words for b in words if a < b and S.one_edit(a, b))
    assert pairs == want and len(want) > 300


def test_chain_of_forms(spark):
    n = {"aaaaa": 4, "aaaab": 8, "aaabb": 16, "aabbb": 32, "abbbb": 64, "bbbbb": 128, "bbbbbb": 256, "ccccc": 5}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    rows = got(S.variant_groups(df))
    assert rows == brute_groups(n)
    assert {r[2] for r in rows} == {"bbbbbb", "ccccc"}


DOCS = [(1, "Colour colour COLOR color color, colour; cölour Ünder×x"), (2, None), (3, ""), (None, "colour null id " * 4),
        (4, "Ábcde ábcde Ábcde Ábcde Ābcdef bcdef bcdef\x00bcdef \U0001F600bcdef"), (4, "colour color" * 3), (4, "colour color" * 3),
        (5, "lengthy " * 30_000 + "q" * 50_000)]


def test_words_against_brute_force(spark, docs):
    df = spark.createDataFrame([(d, t, 1, "w") for d, t in DOCS], "doc_id long, text string, n int, word string")
    want = brute_words(DOCS)
    assert {r["word"]: r["n"] for r in S.count_words(df, flush=3).collect()} == want and len(want) > 3
    many = [(i, "alpha beta gamma delta epsilon zetas etaeta thetas") for i in range(2000)]     # enough to meet the checksum
    df = spark.createDataFrame(many, "doc_id long, text string")
    want = brute_words(many)
    assert {r["word"]: r["n"] for r in S.count_words(df).collect()} == want
    assert want["alpha"] < 2000 and len(want) > 8


def test_query_against_brute_force(spark, docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert got(S.op12_spelling_variants(spark, "/root/testdata/sf0.001")) == brute_groups(brute_words(rows))


def test_empty_and_odd(spark, none, odd):
    assert got(S.variant_groups(S.count_words(none))) == []
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    assert got(S.variant_groups(S.count_words(odd))) == brute_groups(brute_words(rows))
