import re

from eddyline.llm import token_rollup as R
from eddyline.session import scratch_dir


def test_batches_add_up_and_replays_change_nothing(spark, docs):
    counts = R.count_tokens(docs).cache()
    roll = R.TokenRollup(spark, scratch_dir(spark, "t"))
    exp = {}
    for r in counts.collect():
        a = exp.setdefault((r.source, r.lang, r.tokenizer), [0, 0])
        a[0] += 1
        a[1] += r.n_tokens
    got = lambda: {(r.source, r.lang, r.tokenizer): [r.n_docs, r.n_tokens] for r in roll.totals().collect()}
    roll.commit("1", R.inserted(counts))
    roll.commit("1", R.inserted(counts))
    assert got() == exp
    gone, old = counts.filter("id % 2 = 0"), counts.filter("id % 10 = 1")
    roll.commit("2", R.deleted(gone))
    new = old.selectExpr("id", "source", "lang", "tokenizer", "n_tokens + 5 n_tokens")
    roll.commit("3", R.revised(old, new))
    for r in counts.collect():
        a = exp[r.source, r.lang, r.tokenizer]
        if r.id % 2 == 0:
            a[0] -= 1
            a[1] -= r.n_tokens
        if r.id % 10 == 1:
            a[1] += 5
    assert got() == {k: v for k, v in exp.items() if any(v)}
    roll.commit("4", R.deleted(counts.limit(0)))
    assert got() == {k: v for k, v in exp.items() if any(v)}


def test_counts_match_the_tokenizer(docs):
    import public_tokenizers as P
    import tiktoken
    enc = tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=R.read_ranks(P.path("byte_bpe_50k.tiktoken")),
                            special_tokens={})
    text = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.n_tokens == len(enc.encode_ordinary(text[r.id])) for r in R.count_tokens(docs).collect())


def test_query_matches_brute_force(spark, sf_small, docs):
    counts = {r.id: r for r in R.count_tokens(docs).collect()}
    from pyspark.sql import functions as F
    again = {r.id: r.n_tokens for r in R.count_tokens(docs.withColumn(
        "text", F.regexp_replace("text", r"\s+", " "))).collect()}
    assert re.sub(r"\s+", " ", "a \n b") == "a b"
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf_small}/labels.parquet").collect()}
    exp = {}
    for i, r in counts.items():
        mark = labels.get(i)
        if mark and mark.toxic == 1:
            continue
        a = exp.setdefault((r.source, r.lang), [0, 0])
        a[0] += 1
        a[1] += again[i] if mark and mark.quality == 0 else r.n_tokens
    got = R.op8_token_rollups(spark, sf_small).collect()
    assert {(r.source, r.lang): [r.n_docs, r.n_tokens] for r in got} == exp


def test_odd_rows_and_empty_table(spark, odd, none):
    roll = R.TokenRollup(spark, scratch_dir(spark, "t"))
    roll.commit("1", R.inserted(R.count_tokens(odd)))
    assert sum(r.n_docs for r in roll.totals().collect()) == odd.count()
    empty = R.TokenRollup(spark, scratch_dir(spark, "t"))
    empty.commit("1", R.inserted(R.count_tokens(none)))
    assert empty.totals().count() == 0


def test_broken_commit_changes_nothing_and_batches_merge(spark):
    from pyspark.sql import functions as F
    roll = R.TokenRollup(spark, scratch_dir(spark, "t"), fan=3)
    rows = spark.createDataFrame([(i, "s", "en", "v", 10) for i in range(4)], "id long, source string, lang string, tokenizer string, n_tokens long")
    roll.commit("0", R.inserted(rows))
    broken = R.inserted(rows.withColumn("n_tokens", F.expr("IF(id = 2, raise_error('lost'), n_tokens)").cast("long")))
    for batch in ("0", "1"):
        try:
            roll.commit(batch, broken)
            raise AssertionError("the commit should have failed")
        except Exception as e:
            assert "lost" in str(e)
    assert [(r.n_docs, r.n_tokens) for r in roll.totals().collect()] == [(4, 40)]
    for i in range(1, 12):
        roll.commit(str(i), R.inserted(rows.filter("id < 1")))
        roll.commit(str(i), R.inserted(rows.filter("id < 1")))
    assert [(r.n_docs, r.n_tokens) for r in roll.totals().collect()] == [(15, 150)]
    assert len(roll.folders.live()) <= 4
    roll.commit("5", R.inserted(rows))                     # merged long ago
    assert [(r.n_docs, r.n_tokens) for r in roll.totals().collect()] == [(15, 150)]


def test_marks_find_every_id(spark, monkeypatch):
    import numpy as np
    monkeypatch.setattr(R, "MARK_BITS", 1 << 10)            # many ids meet by chance
    df = spark.range(5000)
    marks = R.IdMarks(df.filter("id % 17 = 0"), "id")
    got = df.select("id", R.IdMarks.place(df["id"]).alias("p")).toPandas()
    found = R.IdMarks.found(marks.bits, got["p"].to_numpy(np.int64))
    assert found[got["id"] % 17 == 0].all() and not found.all()
    none = R.IdMarks(df.limit(0), "id")
    assert not R.IdMarks.found(none.bits, np.array([-1, 0, 5])).any()


def test_long_unbroken_text_and_null_ids(spark):
    import random
    text = "".join(random.Random(1).choices("etaoinshr", k=200_000))
    df = spark.createDataFrame([(None, text, "s", "en"), (1, text + " \n " + text, "s", "en"), (1, None, "s", "en")],
                               "doc_id long, text string, source string, lang string")
    marks = R.IdMarks(df, "doc_id")
    got = {(r.id, r.n_tokens > 0): r for r in R.count_tokens(df, marks=marks).collect()}
    assert got[None, True].n_revised is None
    assert got[1, True].n_revised < got[1, True].n_tokens and got[1, False].n_revised == 0
