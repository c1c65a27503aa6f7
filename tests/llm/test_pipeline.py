import numpy as np

import corpus_pipeline as C
from eddyline.llm import line_dedup, mixing, pieces, simhash
from eddyline.llm.common import stored


def test_stages_in_order_and_their_effect(spark, sf_small, docs):
    assert [n for n, _ in C.STAGES] == ["quality rules", "line dedup", "SimHash near-dedup",
                                        "mixing to target weights", "SentencePiece encoding"]
    seen, cur = [], docs
    for _, stage in C.STAGES[:-1]:
        cur = stored(stage(spark, cur, sf_small), "t")
        assert cur.columns == docs.columns
        seen.append(cur)
    good, lines, single, mixed = seen
    kept = {r.doc_id for r in good.collect()}
    judged = C.judge_documents(docs, ["doc_id"]).filter("kept").collect()
    assert kept == {r.doc_id for r in judged}
    exp = line_dedup.drop_site_boilerplate(good, good["source"], "text").collect()
    assert {(r.doc_id, r.text) for r in lines.collect()} == {(r.doc_id, r.text) for r in exp}
    assert all(r.n_chars == len(r.text) for r in lines.collect())
    groups = simhash.simhash_groups(lines).collect()
    assert sorted(r.doc_id for r in single.collect()) == sorted({r.component_id for r in groups})
    copies = {r.doc_id: r.copies for r in mixing.mix_sources(single, carry=["doc_id"]).collect()}
    got = mixed.groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in got} == {i: n for i, n in copies.items() if n}
    out = C.run(spark, sf_small)
    assert out.count() == 2 * mixed.count()
    text = {r.doc_id: r.text for r in mixed.collect()}
    back = pieces.decode_pieces(out.select("doc_id", "ids")).collect()
    assert all(r.decoded == text[r.doc_id] for r in back)


def test_stages_take_odd_rows_and_empty_tables(spark, sf_small, odd, none):
    rng = np.random.default_rng(0)
    more = spark.createDataFrame([(100 + i, " ".join(rng.choice(["the", "cat", "sat", "on", "a", "mat", "dog"], 40)),
                                   "en", None if i % 2 else "s", None) for i in range(12)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    base = odd.select(*none.columns)
    for start in (base, none, base.unionByName(more).unionByName(more)):
        cur = start
        for _, stage in C.STAGES:
            cur = stored(stage(spark, cur, sf_small), "t")
            cur.count()
    for _, stage in C.STAGES[:-1]:
        assert stored(stage(spark, base, sf_small), "t").columns == base.columns


def test_near_dedup_picks_rows_not_ids(spark, sf_small):
    rng = np.random.default_rng(3)
    a, b, c = (" ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(60)) for _ in range(3))
    rows = [(1, a, "en", "s", 1), (1, b, "en", "s", 1), (2, a, "en", "s", 1), (2, b, "en", None, 1),
            (None, a, "en", "s", 1), (None, c, "en", "s", 1), (None, c, "en", "s", 1), (None, c, None, "en", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = C.simhash_dedup(spark, docs, sf_small).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted([(1, a), (1, b), (0, c)])
