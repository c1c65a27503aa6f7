"""Language-model scoring with a log-bilinear model.

The model predicts a word's class from the two words before: the context
words' vectors add up to a predicted vector, whose products with all output
vectors, plus biases, are normalised over all classes.  The number of classes
is ``GROWTH`` times the cube root of the number of distinct training words, so
the model grows with the corpus while its parameters still fit the driver and
a token's normaliser stays affordable.  Half of the
classes are the most frequent words, each its own class; in the other half,
words share a class by their last ``TAIL`` bytes (hashed), and a word has its
add-one share of its class's training count (a class's unknown words together
have a share of one).  The end of a text is a class too.  So the probabilities
of all words, known or not, sum to one.

Training is noise-contrastive estimation in numpy, on all training tokens:
every task trains on its own partition from the same start (Adagrad on the
rows a batch touches, noise classes shared by the batch), and the results are
averaged in two levels with the tokens as weights; ``ROUNDS`` such rounds.

Word counts cover all training tokens and grow with the corpus, so they are
never broadcast: texts are dealt into blocks of about ``BLOCK`` bytes by a
hash, each block lists its distinct words, the counts of all blocks are summed
by word and joined back to the blocks' lists, and each block meets its own
list again for scoring.  A word crosses the shuffle once for each block, not
once for each occurrence, so frequent words are no hot keys.

Defined cases: null text is empty (one end token); a null id is treated as an
empty text by the fold's hash, and trains; rows that repeat are rows of their
own; without training tokens every count is 0 and the base score is 0; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eddyline.llm.common import Scratch, as_bytes, load_table, prepare, text_slices

LEAST_CLASSES, GROWTH = 64, 6
TAIL = 3                        # bytes by which less frequent words share a class
CONTEXT = 2
DIM = 24
NOISE = 32                      # noise classes of a batch
BATCH = 4096
ROUNDS = 1
BLOCK = 16_000_000
SLICE = 2_000_000
NORMS = 2048                    # contexts normalised at a time
TABLE = 1 << 22                 # pairs of context classes whose normalisers are kept
PART = 4096                     # parameters in a row of the averaging
END_WORD = b""                  # no word is empty


def fold(id_col: Column) -> Column:
    """Remainder by 7 of the CRC-32 of the id as text."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 7, F.lit(0))


def tokens(text) -> list[bytes]:
    return [*as_bytes(text).lower().split(), END_WORD]


def _flat(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all tokens, the distinct tokens, and the texts' lengths."""
    lists = [tokens(t) for t in texts]
    n = np.array([len(x) for x in lists], dtype=np.int64)
    flat = np.empty(int(n.sum()), dtype=object)
    flat[:] = [w for x in lists for w in x]
    codes, kinds = pd.factorize(flat)
    return codes, kinds, n


class Classes:
    """Words to classes: ``top`` words, ``buckets`` of tails, the end, and (in
    contexts only) the start of a text."""

    def __init__(self, top: list[bytes], buckets: int):
        self.top, self.buckets = top, buckets
        self.index = {w: i for i, w in enumerate(top)}
        self.end = len(top) + buckets
        self.start = self.end + 1
        self.index[END_WORD] = self.end

    def of(self, words) -> np.ndarray:
        first, known, m = len(self.top), self.index, self.buckets
        return np.array([known[w] if w in known else first + zlib.crc32(w[-TAIL:]) % m for w in words], dtype=np.int64)


def class_number(distinct: int) -> int:
    """Classes of a vocabulary of ``distinct`` words."""
    return max(LEAST_CLASSES, math.ceil(GROWTH * max(0, distinct) ** (1 / 3)))


def contexts(cls: np.ndarray, n: np.ndarray, start: int) -> np.ndarray:
    """The two classes before each token, nearest first; before a text, ``start``."""
    pos = np.arange(len(cls)) - np.repeat(np.cumsum(n) - n, n)
    out = np.full((CONTEXT, len(cls)), start, dtype=np.int64)
    for back in range(1, CONTEXT + 1):
        out[back - 1, back:] = cls[:-back] if len(cls) > back else out[back - 1, back:]
        out[back - 1, pos < back] = start
    return out


def _summed_rows(rows: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct places in ``at`` and the sums of their rows."""
    # short integers sort by radix
    order = np.argsort(at.astype(np.uint16) if at.max(initial=0) < 65536 else at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return at[first], np.add.reduceat(rows[order], first, axis=0)


class LogBilinear:
    """``inp (2, classes + 1, DIM)``, ``out (classes, DIM)``, ``bias (classes)``."""

    def __init__(self, unigram: np.ndarray, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.unigram, n = unigram, len(unigram)
        self.known = None                       # normalisers by pair of context classes
        self.inp = rng.normal(0, 0.1, (CONTEXT, n + 1, DIM)).astype(np.float32)
        self.out = rng.normal(0, 0.1, (n, DIM)).astype(np.float32)
        self.bias = np.log(unigram).astype(np.float32)

    def pack(self) -> np.ndarray:
        return np.concatenate([self.inp.ravel(), self.out.ravel(), self.bias]).astype(np.float32)

    def unpack(self, flat: np.ndarray) -> None:
        a, b = self.inp.size, self.inp.size + self.out.size
        self.inp = flat[:a].reshape(self.inp.shape).astype(np.float32)
        self.out = flat[a:b].reshape(self.out.shape).astype(np.float32)
        self.bias = flat[b:].astype(np.float32)

    def trainer(self, rate: float = 0.1, seed: int = 5):
        """A function that takes one more batch (contexts, classes)."""
        rng = np.random.default_rng(seed)
        seen_inp, seen_out = np.full_like(self.inp, 1e-2), np.full_like(self.out, 1e-2)
        seen_bias = np.full_like(self.bias, 1e-2)
        cum = np.cumsum(self.unigram)
        # log-odds of data against NOISE draws from the unigram distribution
        odds = np.log(NOISE * self.unigram).astype(np.float32)

        def step(w, seen, at, g):
            s = seen[at] + g * g
            seen[at] = s
            w[at] -= rate * g / np.sqrt(s)

        def learn(ctx: np.ndarray, cls: np.ndarray) -> None:
            noise = np.minimum(np.searchsorted(cum, rng.random(NOISE) * cum[-1]), len(cum) - 1)
            r = sum(self.inp[i][ctx[i]] for i in range(CONTEXT))
            o = self.out[cls]
            real = np.einsum("nd,nd->n", r, o) + self.bias[cls] - odds[cls]
            fake = r @ self.out[noise].T + self.bias[noise] - odds[noise]
            # sigmoid(real) - 1 and sigmoid(fake); odds beyond e^60 are certain
            g_real = -1 / (1 + np.exp(np.clip(real, -60, 60)))
            g_fake = 1 / (1 + np.exp(np.clip(-fake, -60, 60)))
            gr = g_real[:, None] * o + g_fake @ self.out[noise]
            # a class may be met as data and as noise: one sum for each class
            at, g = _summed_rows(np.column_stack([np.concatenate([g_real[:, None] * r, g_fake.T @ r]),
                                                  np.concatenate([g_real, g_fake.sum(0)])]),
                                 np.concatenate([cls, noise]))
            step(self.out, seen_out, at, g[:, :-1])
            step(self.bias, seen_bias, at, g[:, -1])
            for i in range(CONTEXT):
                at, g = _summed_rows(gr, ctx[i])
                step(self.inp[i], seen_inp[i], at, g)

        return learn

    def log_norms(self, pairs: np.ndarray) -> np.ndarray:
        """log of the normaliser for each column of context classes, from
        matrix products with all output vectors."""
        out = np.empty(pairs.shape[1])
        for lo in range(0, len(out), NORMS):
            p = pairs[:, lo:lo + NORMS]
            s = sum(self.inp[i][p[i]] for i in range(CONTEXT)) @ self.out.T
            s += self.bias
            top = s.max(axis=1, keepdims=True) if s.max() > 60 else np.zeros((1, 1), s.dtype)
            s -= top
            np.exp(s, out=s)
            out[lo:lo + NORMS] = top[:, 0] + np.log(s.sum(axis=1, dtype=np.float64))
        return out

    def _norms_of(self, ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Normalisers, and the place of each token's among them.  A context
        that comes again is normalised once: in the model's lifetime while a
        table of all pairs has ``TABLE`` places at most, else in the batch."""
        width = len(self.unigram) + 1
        pair = ctx[0] * width + ctx[1]
        if width * width > TABLE:
            key, back = np.unique(pair, return_inverse=True)
            return self.log_norms(np.array([key // width, key % width])), back
        if self.known is None:
            self.known = np.full(width * width, np.nan)
        new = np.unique(pair[np.isnan(self.known[pair])])
        self.known[new] = self.log_norms(np.array([new // width, new % width]))
        return self.known, pair

    def log_probs(self, ctx: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """Natural log of each token's class probability."""
        norms, back = self._norms_of(ctx)
        out = np.empty(len(cls))
        for lo in range(0, len(cls), 65536):
            s = slice(lo, lo + 65536)
            r = sum(self.inp[i][ctx[i, s]] for i in range(CONTEXT))
            out[s] = np.einsum("nd,nd->n", r, self.out[cls[s]]) + self.bias[cls[s]] - norms[back[s]]
        return out


def block_words(blocked: DataFrame) -> DataFrame:
    """``(block, word, n)``: a block's distinct words, with their count in the
    block's training texts."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        codes, kinds, n = _flat(pdf["text"].tolist())
        trains = np.repeat(~pdf["held"].to_numpy(), n)
        count = np.bincount(codes[trains], minlength=len(kinds))
        return pd.DataFrame({"block": pdf["block"].iloc[0], "word": kinds, "n": count})

    return (blocked.select("block", "held", "text").groupBy("block")
            .applyInPandas(run, "block int, word binary, n long"))


def class_counts(known: DataFrame, classes: Classes) -> tuple[np.ndarray, np.ndarray]:
    """Training tokens and distinct words of each class (``known(word, c)``)."""
    shared = known.sparkSession.sparkContext.broadcast(classes)
    size = classes.end + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens_, words = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for b in batches:
            at = shared.value.of(b.column(0).to_pylist())
            np.add.at(tokens_, at, b.column(1).to_numpy())
            np.add.at(words, at, 1)
        some = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(tokens_[some]), pa.array(words[some])], names=["k", "n", "v"])

    n, v = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for r in (known.select("word", "c").mapInArrow(run, "k long, n long, v long").groupBy("k")
              .agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()):
        n[r["k"]], v[r["k"]] = r["n"], r["v"]
    return n, v


def _added(rows: DataFrame, *keys: str) -> DataFrame:
    """Weighted parameter rows added up by ``keys``."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.sum([np.frombuffer(b) for b in pdf["x"]], axis=0)
        return pd.DataFrame({**{k: pdf[k].iloc[:1] for k in keys}, "n": [pdf["n"].sum()], "x": [x.tobytes()]})

    return rows.groupBy(*keys).applyInPandas(run, ", ".join(f"{k} int" for k in keys) + ", n long, x binary")


def train_round(docs: DataFrame, model: LogBilinear, classes: Classes) -> LogBilinear:
    """Every partition trains on its own texts; the average of the results,
    added up by part of the parameters, first in groups of tasks."""
    shared = docs.sparkSession.sparkContext.broadcast((model.pack(), model.unigram, classes))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flat, unigram, cl = shared.value
        own = LogBilinear(unigram)
        own.unpack(flat)
        learn, n_seen = own.trainer(), 0
        for pdf in batches:
            texts = pdf["text"].tolist()
            for lo, hi in text_slices(texts, SLICE):
                codes, kinds, n = _flat(texts[lo:hi])
                cls = cl.of(kinds)[codes]
                ctx = contexts(cls, n, cl.start)
                order = np.random.default_rng(len(cls)).permutation(len(cls))
                for at in range(0, len(cls), BATCH):
                    p = order[at:at + BATCH]
                    learn(ctx[:, p], cls[p])
                n_seen += len(cls)
        if n_seen:
            x = own.pack().astype(np.float64) * n_seen
            parts = [x[i:i + PART].tobytes() for i in range(0, len(x), PART)]
            yield pd.DataFrame({"part": np.arange(len(parts), dtype=np.int32),
                                "several": np.int32(TaskContext.get().partitionId() % 256), "n": n_seen, "x": parts})

    rows = docs.filter(~F.col("held")).select("text").mapInPandas(run, "part int, several int, n long, x binary")
    got = _added(_added(rows, "part", "several").drop("several"), "part").collect()
    out = LogBilinear(model.unigram)
    out.unpack(model.pack())
    if got:
        out.unpack(np.concatenate([np.frombuffer(r["x"]) / r["n"] for r in sorted(got, key=lambda r: r["part"])]))
    return out


def frequent_words(known: DataFrame, distinct: int, n: int) -> list[tuple[bytes, int]]:
    """The ``n`` most frequent words, ties to the smaller; a quantile of the
    counts keeps what tasks send near ``n`` rows in all."""
    words = known.filter(F.length("word") > 0)
    if distinct > 4 * n:
        least = words.agg(F.percentile_approx("c", 1 - 2 * n / distinct, 10_000)).first()[0] or 0
        words = words.filter(F.col("c") >= least // 2)
    return [(bytes(r["word"]), r["c"]) for r in words.orderBy(F.col("c").desc(), "word").limit(n).collect()]


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                held: Column | None = None, rounds: int = ROUNDS) -> DataFrame:
    """``(id_col, held_out, n_tokens, n_known, train_tokens, base_score,
    score)``, one row per input row; rows where ``held`` is true don't train."""
    scratch = Scratch(docs.sparkSession, "lm")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"),
                       (held if held is not None else fold(F.col(id_col)) == 2).alias("held"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-size // BLOCK))
    # the text is part of the hash, so that rows that share an id spread too
    blocked = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(n_blocks)).cast("int"))
    words = scratch.write(block_words(blocked), "words")
    scratch.release()
    counts = scratch.write(words.groupBy("word").agg(F.sum("n").alias("c")), "counts")
    known = counts.filter("c > 0")
    total, distinct = known.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    n_classes = class_number(distinct)
    classes = Classes([w for w, _ in frequent_words(known, distinct, n_classes // 2)], n_classes - n_classes // 2)
    class_n, class_v = class_counts(known, classes)
    unigram = 1.0 + class_n
    model = LogBilinear(unigram / unigram.sum())
    for _ in range(rounds if total else 0):
        model = train_round(rows, model, classes)
    scratch.release()

    listed = words.select("block", "word").join(counts, "word").select("block", "word", "c")
    shared = docs.sparkSession.sparkContext.broadcast((model.pack(), model.unigram, classes, class_n + class_v + 1.0))
    cell: dict = {}
    schema = T.StructType([T.StructField(id_col, rows.schema["id"].dataType), T.StructField("held_out", T.BooleanType()),
                           *[T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")],
                           T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])

    def run(texts: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if "m" not in cell:
            flat, uni, cl, shares = shared.value
            cell["m"] = LogBilinear(uni), cl, np.log(shares)
            cell["m"][0].unpack(flat)
        m, cl, log_share = cell["m"]
        alone = np.r_[np.ones(len(cl.top), bool), np.zeros(cl.buckets, bool), True]
        count = dict(zip(map(bytes, own["word"]), own["c"]))
        parts = []
        for lo, hi in text_slices(texts["text"].tolist(), SLICE):
            pdf = texts.iloc[lo:hi]
            codes, kinds, n = _flat(pdf["text"].tolist())
            c = np.array([count.get(w, 0) for w in kinds], dtype=np.int64)
            base = np.log10((c + 1.0) / (total + 1.0 * (distinct + 1)))
            cls = cl.of(kinds)
            within = np.where(alone[cls], 0.0, np.log(c + 1.0) - log_share[cls])
            flat_cls = cls[codes]
            score = (m.log_probs(contexts(flat_cls, n, cl.start), flat_cls) + within[codes]) / np.log(10.0)
            at = np.cumsum(n) - n
            parts.append(pd.DataFrame({
                id_col: pdf["id"], "held_out": pdf["held"], "n_tokens": n,
                "n_known": np.add.reduceat((c > 0)[codes].astype(np.int64), at), "train_tokens": total,
                "base_score": np.add.reduceat(base[codes], at), "score": np.add.reduceat(score, at)}))
        return pd.concat(parts) if parts else pd.DataFrame({f.name: [] for f in schema})

    return blocked.groupBy("block").cogroup(listed.groupBy("block")).applyInPandas(run, schema)


def op7_lm_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return score_texts(load_table(spark, sf_dir, "documents"))
