"""Spelling variants: words one edit apart, found in a trie of letter counts.

Words are counted over whole texts (each task adds up its own counts first).
Letters fall into groups; a word becomes the vector of its counts by group,
and the words form a trie whose level ``t`` branches on the count of group
``t``.  One inserted, deleted or replaced letter changes the vector by a
surplus of one at most in one group and a deficit of one at most in another.
So a search goes down the trie depth first with one unit of surplus and one
of deficit to spend; the words of the leaves that it reaches are verified.

Of two words one has more letters in the first group where they differ, and
only that one goes looking (of words with equal vectors, the larger), so each
pair is met once.

The top of the trie is built by Spark: a node with more than ``hot`` words is
split by the next group, level by level, and searches go down those levels as
rows.  What is left are nodes of bounded size, each searched by one task with
the searches that have come to it; a node where more than ``hot`` searches
meet (or, with all groups used up, more than ``hot`` words) is dealt over
several tasks in blocks, so no task holds more than ``hot`` words and ``hot``
searches.

Defined cases: null texts have no words; a null id reads as the empty string
where a word is altered by its id; repeated rows count as often as they
stand; words of any length are compared whole; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eddyline.llm.common import load_table, prepare, stored

HOT = 20_000                 # words, or searches, in one task's node
BUCKET = 24                  # words in a trie leaf
PAIRS = 1 << 21              # pairs compared at a time
WIDE = 64                    # longer words are compared one by one
# Latin-1: letters A-Z lowered, a-z and C0-FF kept, all else a blank
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def altered(word: bytes, doc_id: str) -> bytes:
    """The word (Latin-1), without one letter if its checksum says so."""
    text = word if word.isascii() else word.decode("latin-1").encode()
    h = zlib.crc32(doc_id.encode() + b":" + text)
    if h % 97:
        return word
    cut = h % len(word)
    return word[:cut] + word[cut + 1:]


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 5,
                min_count: int = 3, flush: int = 200_000) -> DataFrame:
    """``(word string, n long)`` over all documents."""
    src = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
                      F.col(text_col).cast("string").alias("text")).filter("text IS NOT NULL")

    def counted(total: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in total], pa.string()),
                                           pa.array(total.values(), pa.int64())], names=["word", "n"])

    def run(batches):
        total: Counter = Counter()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = Counter(text.as_py().encode("latin-1", "replace").translate(LETTERS).split())
                for word, n in found.items():
                    if len(word) >= min_length:          # a deletion only shortens
                        word = altered(word, doc)
                        if len(word) >= min_length:
                            total[word] += n
                if len(total) > flush:
                    yield counted(total)
                    total = Counter()
        yield counted(total)

    return (src.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .filter(F.col("n") >= min_count))


# ── letter groups ──────────────────────────────────────────────────────────
def _codes(word: str) -> np.ndarray:
    return np.frombuffer(word.encode("latin-1"), np.uint8)


def letter_groups(words: DataFrame) -> list[str]:
    """The groups of letters, level by level: a-z alone and the accented ones
    dealt over six groups, those whose counts vary most first."""
    groups = [chr(c) for c in range(97, 123)] + ["".join(chr(c) for c in range(0xC0 + i, 0x100, 6)) for i in range(6)]

    def run(batches):
        n, total, squares = 0, np.zeros(len(groups)), np.zeros(len(groups))
        for batch in batches:
            counts = _group_matrix([w.encode("latin-1") for w in batch.column(0).to_pylist()], groups).astype(float)
            n, total, squares = n + len(counts), total + counts.sum(axis=0), squares + (counts ** 2).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(groups), dtype=np.int32)),
                                          pa.array(np.full(len(groups), n, np.int64)), pa.array(total), pa.array(squares)],
                                         names=["i", "n", "total", "squares"])

    sums = (words.select("word").mapInArrow(run, "i int, n long, total double, squares double").groupBy("i")
            .agg(F.sum("n").alias("n"), F.sum("total").alias("t"), F.sum("squares").alias("s")).collect())
    spread = {r["i"]: r["s"] / r["n"] - (r["t"] / r["n"]) ** 2 for r in sums if r["n"]}
    order = sorted(range(len(groups)), key=lambda i: (-spread.get(i, 0.0), i))
    return [groups[i] for i in order]


def _level(group: str) -> Column:
    """The word's letters of a group, counted as what translating them away takes off."""
    return F.length("word") - F.length(F.translate("word", group, ""))


def _group_matrix(words: list[bytes], groups: list[str]) -> np.ndarray:
    """Counts by word and group."""
    of = np.full(256, len(groups), np.int64)
    for i, g in enumerate(groups):
        of[_codes(g)] = i
    width = len(groups) + 1
    sizes = np.array([len(w) for w in words], np.int64)
    flat = of[np.frombuffer(b"".join(words), np.uint8)] + np.repeat(np.arange(len(words)) * width, sizes)
    counts = np.bincount(flat, minlength=len(words) * width).reshape(len(words), width)[:, :-1]
    return counts.astype(np.int32)


# ── verification ───────────────────────────────────────────────────────────
def one_edit(a: bytes, b: bytes) -> bool:
    """Whether two different words are one insertion, deletion or replacement apart."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    short, long_ = sorted((a, b), key=len)
    p = 0
    while p < len(short) and a[p] == b[p]:
        p += 1
    return a[p + 1:] == b[p + 1:] if len(a) == len(b) else short[p:] == long_[p + 1:]


class _Words:
    """Words of one side of a node, laid out for comparing many at a time."""

    def __init__(self, words: list[bytes], groups: list[str]):
        self.words = words
        self.size = np.array([len(w) for w in words], np.int64)
        self.counts = _group_matrix(words, groups)
        bits = np.left_shift(np.uint64(1), np.arange(len(groups), dtype=np.uint64))
        self.odd = ((self.counts & 1).astype(np.uint64) * bits).sum(axis=1, dtype=np.uint64)
        self.left = np.zeros((len(words), WIDE), np.uint8)
        self.right = np.zeros((len(words), WIDE), np.uint8)
        for i, w in enumerate(words):
            if len(w) <= WIDE:
                a = np.frombuffer(w, np.uint8)
                self.left[i, :len(a)] = a
                self.right[i, WIDE - len(a):] = a


def _verify(q: _Words, m: _Words, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs are exactly one edit apart: common start and common end
    together reach all but one letter of the longer word."""
    same = q.left[i] == m.left[j]
    start = np.where(same.all(axis=1), WIDE, same.argmin(axis=1))
    same = (q.right[i] == m.right[j])[:, ::-1]
    end = np.where(same.all(axis=1), WIDE, same.argmin(axis=1))
    longer, shorter = np.maximum(q.size[i], m.size[j]), np.minimum(q.size[i], m.size[j])
    ok = (longer - shorter <= 1) & (start < WIDE) & (np.minimum(start, shorter) + np.minimum(end, shorter) >= longer - 1)
    for x in np.flatnonzero(longer > WIDE):
        ok[x] = one_edit(q.words[i[x]], m.words[j[x]])
    return ok


class _Search:
    """One node: its words as a trie, and the searches that have come to it."""

    def __init__(self, words: list[bytes], searches: list[bytes], state: np.ndarray, groups: list[str], depth: int):
        self.m, self.q, self.state = _Words(words, groups), _Words(searches, groups), state
        # levels above the node are equal, or spent, for all that is here
        self.depth, self.levels = depth, len(groups)
        keys = self.m.counts[:, depth:].T[::-1]
        self.order = np.lexsort(keys) if len(keys) else np.arange(len(words))
        self.sorted = self.m.counts[self.order]
        self.rank = {w: r for r, w in enumerate(sorted(set(words) | set(searches)))}
        self.m_rank = np.array([self.rank[w] for w in words])
        self.q_rank = np.array([self.rank[w] for w in searches])
        self.pending, self.waiting, self.found = [], 0, []

    def run(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.m.words) and len(self.q.words):
            self._down(0, len(self.order), self.depth, np.arange(len(self.q.words)), self.state)
            self._flush()
        if not self.found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*self.found))

    def _down(self, lo: int, hi: int, level: int, q: np.ndarray, state: np.ndarray) -> None:
        """Words ``lo:hi`` share their counts from the node down to ``level``;
        ``state`` is what each search has spent: 0 nothing, 1 the deficit (the
        word has one letter fewer), 2 both."""
        if not len(q):
            return
        if hi - lo <= BUCKET or level == self.levels:
            return self._leaf(lo, hi, level, q, state)
        column = self.sorted[lo:hi, level]
        cuts = np.flatnonzero(np.diff(column)) + 1
        own = self.q.counts[q, level]
        for a, b in zip(np.concatenate(([0], cuts)), np.concatenate((cuts, [hi - lo]))):
            c = column[a]
            stay, fewer, more = own == c, (own == c + 1) & (state == 0), (own == c - 1) & (state == 1)
            take = stay | fewer | more
            spent = np.where(stay, state, np.where(fewer, 1, 2))
            self._down(lo + a, lo + b, level + 1, q[take], spent[take])

    def _leaf(self, lo: int, hi: int, level: int, q: np.ndarray, state: np.ndarray) -> None:
        j, step = self.order[lo:hi], max(1, PAIRS // (hi - lo))
        for at in range(0, len(q), step):
            part = q[at:at + step]
            # an edit changes the parity of two groups at most
            near = np.bitwise_count(self.q.odd[part][:, None] ^ self.m.odd[j][None, :]) <= 2
            a, b = np.nonzero(near)
            self.pending.append((part[a], j[b], state[at:at + step][a], np.full(len(a), level)))
            self.waiting += len(a)
            if self.waiting > PAIRS // 8:
                self._flush()

    def _flush(self) -> None:
        if not self.pending:
            return
        i, j, state, level = (np.concatenate(x) for x in zip(*self.pending))
        self.pending, self.waiting = [], 0
        diff = self.q.counts[i] - self.m.counts[j]
        diff[np.arange(self.levels) < level[:, None]] = 0                # spent on the way
        more, fewer = np.maximum(diff, 0).sum(axis=1), np.maximum(-diff, 0).sum(axis=1)
        nz = diff != 0
        first = np.take_along_axis(diff, nz.argmax(axis=1)[:, None], axis=1)[:, 0]
        fresh = state == 0
        ok = (more <= fresh) & (fewer <= (state < 2)) & ~(fresh & (first < 0))
        # nothing spent at all: equal vectors, the larger word is the search
        ok &= ~(fresh & (first == 0)) | (self.q_rank[i] > self.m_rank[j])
        i, j = i[ok], j[ok]
        good = _verify(self.q, self.m, i, j)
        self.found.append((i[good], j[good]))


# ── nodes and searches as rows ─────────────────────────────────────────────
def _nodes(words: DataFrame, groups: list[str], hot: int) -> DataFrame:
    """``(node, depth, word, n, state, own)``: each word in the node that
    holds it, and once more in each other node its search comes to."""
    at = words.select(F.lit("").alias("node"), "word", "n", F.lit(0).alias("state"), F.lit(True).alias("own"))
    done = []
    for depth in range(len(groups) + 1):
        if depth:                                        # searches end where no word is
            at = at.join(at.filter("own").groupBy("node").agg(F.count(F.lit(1)).alias("words")), "node")
        else:
            at = at.withColumn("words", F.lit(words.count()))
        at = stored(at, "spelling-level")
        last = depth == len(groups)
        done.append(at.filter(F.lit(last) | (F.col("words") <= hot)).withColumn("depth", F.lit(depth)))
        at = at.filter(F.col("words") > hot)
        if last or at.isEmpty():
            break
        c, child = _level(groups[depth]), lambda count, state, own: F.struct(
            F.concat_ws(",", "node", count.cast("string")).alias("node"), state.cast("int").alias("state"), own.alias("own"))
        no = F.lit(False)
        ways = F.array(child(c, F.col("state"), F.col("own")),
                       F.when((F.col("state") == 0) & (c > 0), child(c - 1, F.lit(1), no)),
                       F.when(F.col("state") == 1, child(c + 1, F.lit(2), no)))
        at = (at.select("word", "n", F.explode(F.filter(ways, lambda w: w.isNotNull())).alias("w"))
              .select("w.node", "word", "n", "w.state", "w.own"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def near_pairs(words: DataFrame, hot: int = HOT) -> DataFrame:
    """``(a, n_a, b, n_b)``: each pair of words one edit apart, once."""
    groups = letter_groups(words)
    rows = _nodes(words, groups, hot)
    met = rows.groupBy("node", "depth").agg(F.count(F.lit(1)).alias("met"), F.count_if("own").alias("held"))
    blocks = met.select("node", "depth", F.ceil(F.col("met") / hot).cast("int").alias("q_blocks"),
                        F.ceil(F.col("held") / hot).cast("int").alias("m_blocks"))
    rows = rows.join(blocks, ["node", "depth"])
    # a search goes to one block of searches, beside every block of words
    pick = F.xxhash64("word")
    as_search = rows.select("node", "depth", F.pmod(pick, "q_blocks").cast("int").alias("qb"),
                            F.explode(F.sequence(F.lit(0), F.col("m_blocks") - 1)).alias("mb"),
                            "word", "n", "state", F.lit(False).alias("held"))
    as_word = rows.filter("own").select("node", "depth",
                                        F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)).alias("qb"),
                                        F.pmod(pick, "m_blocks").cast("int").alias("mb"), "word", "n", "state", F.lit(True).alias("held"))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        held = pdf[pdf["held"]]
        asks = pdf[~pdf["held"]]
        words = [w.encode("latin-1") for w in held["word"]]
        asked = [w.encode("latin-1") for w in asks["word"]]
        i, j = _Search(words, asked, asks["state"].to_numpy(np.int64), groups, int(pdf["depth"].iloc[0])).run()
        return pd.DataFrame({"a": asks["word"].to_numpy()[i], "n_a": asks["n"].to_numpy()[i],
                             "b": held["word"].to_numpy()[j], "n_b": held["n"].to_numpy()[j]})

    return (as_search.unionByName(as_word).groupBy("node", "depth", "qb", "mb")
            .applyInPandas(search, "a string, n_a long, b string, n_b long"))


def variant_groups(words: DataFrame, ratio: int = 2, hot: int = HOT) -> DataFrame:
    """``words(word, n)`` distinct → ``(word, form, root, n, n_near, form_n)``.

    A word's form is its near word of largest count, ties to the smaller,
    where that count is ``ratio`` times its own at least.  Counts grow along
    forms, so they end; roots are found by doubling the way gone each round."""
    words = stored(words.select("word", "n"), "spelling-words")
    pairs = near_pairs(words, hot)
    both = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")),
                             F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n"))))
    best = pairs.select(both.alias("p")).select("p.*").groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("o"), "near")).alias("best"))
    formed = (-F.col("best.o")) >= ratio * F.col("n")
    out = stored(words.join(best, "word", "left").select(
        "word", F.when(formed, F.col("best.near")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(formed, -F.col("best.o")).cast("long").alias("form_n")), "spelling-forms")
    way = out.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        step = way.select(F.col("word").alias("root"), F.col("root").alias("next"))
        way = stored(way.join(step, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if way.filter("moved").isEmpty():
            break
        way = way.drop("moved")
    return out.join(way.select("word", "root"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return variant_groups(count_words(load_table(spark, sf_dir, "documents")))
