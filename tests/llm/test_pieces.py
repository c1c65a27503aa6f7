import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from eddyline.llm import pieces as P
from eddyline.llm.common import mix64


@pytest.fixture(scope="module")
def vocab():
    return P.Vocabulary(P.default_model())


def segmentations(vocab, raw):
    index = {t: i for i, t in enumerate(vocab.text) if t and i > 258}

    def parts(b):
        if not b:
            return [[]]
        return [[index[b[:n]], *rest] for n in range(1, len(b) + 1) if b[:n] in index for rest in parts(b[n:])]

    paths = parts(raw)
    w = np.array([sum(vocab.logw[i] for i in p) for p in paths])
    return {tuple(p): x for p, x in zip(paths, w - np.logaddexp.reduce(w))}


def test_probabilities_and_marginals_are_exact(vocab):
    text, n = "the on", 20_000
    exact = segmentations(vocab, (P.MARK + text.replace(" ", P.MARK)).encode())
    part = P._Slice(vocab, [text] * n, mix64(np.arange(n, dtype=np.uint64)).view(np.int64), 3)
    first, second, weight = {}, {}, {}
    for found in part.search():
        ids = [tuple(part.ids(e).tolist()) for e, *_ in found]
        assert len(set(ids)) == 3 and found[0][2] >= found[1][2] >= found[2][2] >= found[0][3]
        for i, (_, logp, _, cut) in zip(ids, found):
            assert abs(exact[i] - logp) < 1e-9
            weight[i] = weight.get(i, 0) + 1 / math.exp(P.log_inclusion(logp, cut))
        first[ids[0]] = first.get(ids[0], 0) + 1
        second[ids[1]] = second.get(ids[1], 0) + 1
    p = {s: math.exp(x) for s, x in exact.items()}
    for s in sorted(p, key=p.get)[-2:]:
        assert abs(first[s] / n - p[s]) < 0.02
        assert abs(second[s] / n - sum(p[a] * p[s] / (1 - p[a]) for a in p if a != s)) < 0.02
        assert abs(weight[s] / n - 1) < 0.05          # Horvitz-Thompson: each path counts once


def test_round_trip_and_distinct_samples(docs, vocab):
    d = docs.withColumn("h", F.col("text"))
    got = P.decode_pieces(P.sample_pieces(d, k=3, carry=["doc_id", "h"]))
    assert got.filter("decoded <> h").count() == 0
    few = got.groupBy("doc_id").agg(F.count_distinct("ids").alias("n"), F.count("*").alias("m"))
    assert few.filter("n <> m OR m <> 3").count() == 0
    assert got.filter(F.col("log_inclusion") > 1e-9).count() == 0


def test_samples_follow_the_row_key_alone(docs):
    a = P.sample_pieces(docs.repartition(1)).select("doc_id", "rank", "ids", "perturbed")
    b = P.sample_pieces(docs.repartition(5)).select("doc_id", "rank", "ids", "perturbed")
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_batches_are_bounded_by_bytes(spark, vocab):
    """Spark hands texts over in batches of about a megabyte, so neither side's
    memory follows 10 000 rows a batch; results don't depend on it."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 26))
    rows = [(i, "the cat sat on the mat " * 400) for i in range(600)] + [(600, None), (601, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = P.decode_pieces(P.sample_pieces(df, k=1, carry=["doc_id", "text"]))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes] * b.num_rows, pa.int64())], names=["n"])

    assert got.filter("decoded <> coalesce(text, '')").count() == 0
    most = df.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0]
    assert most < 1.2e6


def test_many_paths_and_lists_as_one_by_one(vocab):
    texts = ["", "the cat", " a  b\nc d \n\n e", "\n", "x ", "\U0001F600 \u4e00\u1234 tail", "a\nb", f"u{P.MARK}v"]
    for t in texts:
        assert vocab.chunks(t) == (vocab.chunk.findall(P.MARK + t.replace(" ", P.MARK)) if t else [])
    part = P._Slice(vocab, texts, mix64(np.arange(len(texts), dtype=np.uint64)).view(np.int64), 2)
    paths = [e for found in part.search() for e, *_ in found]
    ids, count = part.ids_of(paths)
    lists = [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])]
    assert lists == [part.ids(p).tolist() for p in paths]
    lists.insert(3, None)
    got = P.decode_lists(pa.array(vocab.text, pa.binary()), pa.array(lists * 300, pa.list_(pa.int32())).slice(2))
    assert got.to_pylist() == ([None if x is None else P.decode_ids(vocab.text, x) for x in lists] * 300)[2:]


def test_odd_rows_and_empty_table(odd, none):
    got = P.decode_pieces(P.sample_pieces(odd, k=2, carry=["doc_id", "text", "size"])).collect()
    empty = [r for r in got if not r.text]
    assert len(empty) == 2 and all(r.ids == [] and r.log_prob == 0 and r.log_inclusion == 0 for r in empty)
    assert all(r.decoded == (r.text or "").replace(P.MARK, " ") for r in got)
    assert P.sample_pieces(none).count() == 0


def test_query_against_the_operator_and_the_weights(spark, docs, vocab):
    """Two rows a document; what the digest says of ids and round trips holds
    for the ids themselves, and differences of log probabilities are those of
    the pieces' weights."""
    got = {(r.doc_id, r["rank"]): r for r in P.op3_sentencepiece_gumbel(spark, "/root/testdata/sf0.001").collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    keyed = docs.withColumn("h", F.xxhash64(F.coalesce(F.translate("text", P.MARK, " "), F.lit(""))))
    ids = {(r.doc_id, r["rank"]): r for r in P.sample_pieces(keyed, k=2, carry=["doc_id", "h"]).select(
        "doc_id", "rank", "ids", F.xxhash64("ids").alias("hash")).collect()}
    assert set(got) == set(ids) and {d for d, _ in got} == set(text)
    for key, r in got.items():
        assert r.round_trip and r.ids_hash == ids[key]["hash"] and r.n_pieces == len(ids[key].ids) and r.log_inclusion < 1e-9
        assert P.decode_ids(vocab.text, ids[key].ids) == (text[key[0]] or "").replace(P.MARK, " ")
    for d in text:
        if (d, 2) in got:
            a, b = (sum(vocab.logw[i] for i in ids[d, k].ids) for k in (1, 2))
            assert abs((got[d, 1].log_prob - got[d, 2].log_prob) - (a - b)) < 1e-6 * max(1, abs(a))
            assert got[d, 1].perturbed >= got[d, 2].perturbed and got[d, 1].ids_hash != got[d, 2].ids_hash


def _found(vocab, texts, k, lat=None, slices=1):
    """Ids and numbers of all samples, the texts dealt over ``slices``."""
    keys, out = mix64(np.arange(len(texts), dtype=np.uint64)).view(np.int64), []
    for at in np.array_split(np.arange(len(texts)), slices):
        part = P._Slice(vocab, pa.array([texts[i] for i in at], pa.string()), keys[at], k, lat)
        out += [[(part.ids(e).tolist(), *x) for e, *x in found] for found in part.search()]
    return out


def _texts(n, words):
    rng = np.random.default_rng(7)
    kinds = ["".join(rng.choice(list("aeinrst\u00e9\u4e00"), rng.integers(1, 9))) for _ in range(words)]
    return [" ".join(rng.choice(kinds, rng.integers(0, 400))) + "\n" * (i % 3) for i in range(n)]


def test_words_of_earlier_slices_are_not_built_again(vocab, monkeypatch):
    """Samples don't depend on what is kept, also where the kept words overflow."""
    texts, built = _texts(60, 150), []
    plain = _found(vocab, texts, 3)
    build = P.Lattice._build

    def counted(self, words, *more):
        built.append(len(words))
        return build(self, words, *more)

    monkeypatch.setattr(P.Lattice, "_build", counted)
    assert _found(vocab, texts, 3, P.Lattice(vocab), 6) == plain
    assert sum(built[1:]) < built[0]                         # each slice has nearly all words
    monkeypatch.setattr(P, "KEEP", 500)
    assert _found(vocab, texts, 3, P.Lattice(vocab), 20) == plain


def test_kept_lattices_shrink_after_a_long_text(vocab):
    lat = P.Lattice(vocab)
    _found(vocab, [" ".join(map(str, range(60_000)))], 1, lat)
    _found(vocab, ["a short text"] * 2, 1, lat)
    assert len(lat.buf) < 1000 and len(lat.cum) < 10_000


def test_far_subsets_are_left_out_only_if_they_cannot_win(vocab, monkeypatch):
    texts = [*_texts(40, 500), "z " * 300, "\u4e00" * 300, "", "\u4e00" * 200 + " the on" * 90]
    short = _found(vocab, texts, 4)
    drawn = []
    mix = P.mix64
    monkeypatch.setattr(P, "mix64", lambda x: drawn.append(len(x)) or mix(x))
    assert _found(vocab, texts, 4) == short
    few, drawn[:] = sum(drawn), []
    monkeypatch.setattr(P, "SPREAD", np.inf)
    assert _found(vocab, texts, 4) == short
    assert few < sum(drawn)


def test_words_by_bytes_are_those_of_the_expression(vocab):
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list(f"a\u00e9 \n{P.MARK}\u2580\x00"), rng.integers(0, 12))) for _ in range(3000)]
    for cut in (True, False):
        v = P.Vocabulary(P.default_model())
        v.cut, v.chunk = cut, P.re.compile(v.chunk.pattern if cut else rf"{P.MARK}*[^{P.MARK}]+|{P.MARK}+")
        words, first = v.split(pa.array(["x", *texts], pa.string()).slice(1))
        words = [w.decode() for w in words.to_pylist()]
        assert [words[a:b] for a, b in zip(first, first[1:])] == [
            v.chunk.findall(P.MARK + t.replace(" ", P.MARK)) if t else [] for t in texts]
    words, first = vocab.split(pa.array(["", ""]))
    assert len(words) == 0 and first.tolist() == [0, 0, 0]
