import hashlib
import re

import pytest
from pyspark.sql import functions as F

from eddyline.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return [m.group() for m in WORD.finditer(low)]


def brute(docs, bench, n=10):
    wins = {}
    for item, text in bench:
        w = words(text)
        for i in range(max(len(w) - n, 0) + 1 if w else 0):
            wins.setdefault(tuple(w[i:i + n]), set()).add("" if item is None else str(item))
    sizes = {len(k) for k in wins}
    out = []
    for doc, text in docs:
        w, hit, items = words(text), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                got = wins.get(tuple(w[i:i + size]))
                if got:
                    hit.update(range(i, i + size))
                    items |= got
        ids = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(items), ids, bool(hit)))
    return sorted(out, key=str)


def digest(df):
    n = len(df.columns) - 4
    a = df.columns[n:]
    rows = df.select("doc_id", a[0], a[1], F.size(a[2]), F.sha2(F.array_join(F.array_sort(a[2]), ","), 256), F.col(a[1]) > 0)
    return sorted((tuple(r) for r in rows.collect()), key=str)


PASSAGE = "One two THREE four, five; six seven eight nine ten — eleven twelvé thirteen"
BENCH = [(1, PASSAGE), (2, "Short é item!"), (10, "short É ITEM"), (3, ""), (4, None), (5, "... !!"), (6, PASSAGE),
         (None, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"), (7, "alpha beta gamma"), (7, "nu xi")]
DOCS = [(1, "x " + PASSAGE + " y"), (2, "two three four five six seven eight nine ten — eleven"), (3, "a short-é, Item b"),
        (4, None), (5, ""), (None, "short é"), (6, "alpha beta\ngamma delta epsilon zeta eta theta iota kappa alpha beta gamma"),
        (7, " ".join(["pad"] * 50_000) + " alpha beta gamma " + "z" * 200_000 + " nu.xi"), (8, PASSAGE), (8, PASSAGE),
        (9, "one two three four five six seven eight nine"), (10, "short \U0001F600 é item short é item")]


@pytest.mark.parametrize("max_bytes", [D.MAX_BYTES, 150])
def test_query_against_brute_force(spark, max_bytes):
    docs = spark.createDataFrame([(d, t, i, "r") for i, (d, t) in enumerate(DOCS)], "doc_id long, text string, items int, Runs string")
    bench = spark.createDataFrame([(*r, 0) for r in BENCH], "item_id long, text string, win int")
    got = D.find_contamination(docs, bench, max_bytes=max_bytes)
    assert got.columns[:4] == docs.columns
    assert digest(got) == brute(DOCS, BENCH)


def test_whole_small_table(spark, docs):
    sf = "/root/testdata/sf0.001"
    bench = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in D.op11_decontaminate(spark, sf).collect()), key=str)
    assert got == brute(rows, bench)
    assert any(r[5] for r in got) and not all(r[5] for r in got)


def test_removal_and_empty_tables(spark, none, odd):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    spans = {r[0]: r[1] for r in D.decontaminate(docs, bench).collect() if r[0] is not None}
    assert spans[1] == "x  y" and spans[3] == "a  b" and spans[4] is None and spans[9] == DOCS[10][1]
    assert spans[10] == "short \U0001F600 é item "
    left = {r[0] for r in D.decontaminate(docs, bench, remove="documents").collect()}
    assert left == {4, 5, None, 9}
    empty = bench.limit(0)
    assert D.find_contamination(odd, empty).filter("n_hit <> 0").count() == 0
    assert D.find_contamination(none, bench).count() == 0


def test_blocks_do_not_change_hashes(monkeypatch):
    low = ("word " * 40 + "x" * 90 + " tail of words").encode()
    whole = D.words_of(low)
    monkeypatch.setattr(D, "BLOCK", 16)
    for a, b in zip(whole, D.words_of(low)):
        assert (a == b).all()
