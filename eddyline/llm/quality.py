"""Quality rules: word counts and repetition, then n-gram perplexity bands.

The language model is a character 4-gram model with modified Kneser-Ney
smoothing over UTF-16 units as they are: case, digits, marks and all scripts
stay apart, and four units make one 64-bit code, so no two grams share one.
What is counted grows with the corpus and never reaches the driver.

* Texts fall into two halves by a hash of the text, and each is scored by the
  model of the other half: otherwise a document's own rare grams, which the
  model has seen once, would pass for good language.
* The model trains on trusted documents, by one rule for every language and
  any number of labels: not labelled bad, and either labelled good or made of
  letters and blanks to at least ``LETTERS`` of its characters.  So symbol and
  table junk is foreign to the model even where nothing is labelled.
* Texts are dealt into blocks of one language and half, of about ``BLOCK``
  bytes, by a hash.  Each block lists its distinct grams, sorted by hash and
  cut into hash ranges (``RANGE`` bytes of a language's text for each), with
  their counts in trusted texts; the lists of a range are summed by gram.
* The levels of the model (grams of 4, 3, 2 and 1 units) are tables; discounts
  come from counts of counts, contexts' sums and the next shorter level are
  joined by hash.  The result is stored as one pair of sorted hash arrays for
  each language and range, in which the blocks' lists are looked up by binary
  search; each block meets its own list again for scoring.
* A document's score is its mean -log10 probability a UTF-16 unit.  The band of
  a language leaves out ``TARGET`` of its trusted documents' scores, half on
  each side, and reaches ``WIDTH`` interquartile ranges beyond the quartiles at
  most; documents outside the band are rejected.

Defined cases: null text is empty (no words, fails the base rules); null and
empty languages are one language; a half is scored by its own model if the
other half has no trusted text; a language without any trusted document has no
band, and nothing of it is kept; an id labelled both 0 and 1 counts as 0, and
a null id as unlabelled; U+FFFF, which is no character, counts as U+FFFE;
repeated rows are rows of their own and are counted each; an empty table gives
an empty result; other columns are ignored, or pass through.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eddyline.llm.common import Scratch, as_bytes, fresh, load_table, mix64, prepare, text_slices

ORDER = 4
SYMBOLS = "#*$%&|<>"
LETTERS = 0.92             # of the characters of an unlabelled document that trains
TARGET = 0.01              # of a language's trusted documents, outside its band
WIDTH, LEAST_SPREAD = 12.0, 0.04
MIN_WORDS = 20
WINDOW = 8
SLICE = 2_000_000          # characters held at once by a worker
BLOCK = 4_000_000          # bytes of the texts that share a list of grams
RANGE = 32_000_000         # bytes of a language's text for each hash range of its model
EDGE = 0xFFFF              # unit before a text
FLOOR = 1.0 / 0xFFFF       # of each unit but EDGE, below the shortest level
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


# ---- text to numbers -------------------------------------------------------

_TABLES: dict = {}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Per code point (the last entry stands for all above the first plane):
    whether it is a letter, its mark or white space; and a mark of 1 for word
    characters, 3 for symbols among them."""
    if not _TABLES:
        letter = np.array([unicodedata.category(chr(cp))[0] in "LM" or chr(cp).isspace() for cp in range(0x10000)] + [True])
        mark = np.ones(0x10001, dtype=np.uint8)
        mark[[0x20, *range(0x09, 0x0E)]] = 0
        mark[[ord(c) for c in SYMBOLS]] = 3
        _TABLES["t"] = letter, mark
    return _TABLES["t"]


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and where each text starts (and the end)."""
    cps = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.minimum(cps, 0x10000), np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)


def _units(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """UTF-16 units of all texts, and where each text starts (and the end)."""
    units = np.frombuffer("".join(texts).encode("utf-16-le", "surrogatepass"), dtype=np.uint16)
    size = np.array([len(t) for t in texts], dtype=np.int64)
    if len(units) > size.sum():
        size = np.array([len(t.encode("utf-16-le", "surrogatepass")) // 2 for t in texts], dtype=np.int64)
    return np.where(units == EDGE, EDGE - 1, units).astype(np.uint16), np.r_[0, np.cumsum(size)].astype(np.int64)


def _unit_codes(units: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The four units that end at each unit as one 64-bit code."""
    code = units.astype(np.uint64)
    pos = np.arange(len(units)) - np.repeat(starts[:-1], np.diff(starts))
    for back in range(1, ORDER):
        prev = np.full(len(units), EDGE, dtype=np.uint64)
        prev[back:] = units[:-back] if len(units) > back else prev[back:]
        prev[pos < back] = EDGE
        code |= prev << np.uint64(16 * back)
    return code.view(np.int64)


def letter_shares(texts: list[str]) -> np.ndarray:
    """Share of letters and white space in each text; 0 without characters."""
    cps, starts = _points(texts)
    return _sums(_tables()[0][cps].astype(np.int64), starts) / np.maximum(np.diff(starts), 1)


# ---- model -----------------------------------------------------------------

def _discounts_from(counts_of_counts) -> np.ndarray:
    n = [max(1.0, float(x)) for x in counts_of_counts]
    y = n[0] / (n[0] + 2 * n[1])
    d = [0.0, 1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
    return np.clip(np.array(d), [0.0, 0.05, 0.05, 0.05], [0.0, 0.95, 1.9, 2.9])


def block_grams(blocked: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """``rows(lang, half, block, _bits, _text, _id)`` → ``(lang, half, block,
    range, g, n)``: the block's distinct grams, sorted by hash and cut into
    ``2 ** _bits`` hash ranges (arrays as bytes), with their count in trusted
    texts.  ``labelled(lang, half, block, id, q)`` are the block's labels."""
    def run(pdf: pd.DataFrame, marks: pd.DataFrame | None = None) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({c: [] for c in ("lang", "half", "block", "range", "g", "n")})
        quality = dict(zip(marks["id"], marks["q"])) if marks is not None else {}
        texts = [t if isinstance(t, str) else "" for t in pdf["_text"]]
        label = [quality.get(i) for i in pdf["_id"]]
        got = []
        for lo, hi in text_slices(texts, SLICE):
            part = texts[lo:hi]
            units, at = _units(part)
            codes, kinds = pd.factorize(_unit_codes(units, at))
            trusted = np.array([x == 1 if x is not None else y >= LETTERS for x, y in zip(label[lo:hi], letter_shares(part))])
            own = np.repeat(trusted, np.diff(at))
            got.append(pd.Series(np.bincount(codes[own], minlength=len(kinds)), index=kinds))
        one = got[0] if len(got) == 1 else pd.concat(got).groupby(level=0).sum()
        g, n, bits = one.index.to_numpy(np.int64), one.to_numpy(np.int64), int(pdf["_bits"].iloc[0])
        h = mix64(g.view(np.uint64))
        order = np.argsort(h)
        g, n, h = g[order], n[order], h[order]
        place = (h >> np.uint64(63)) * 0 if not bits else h >> np.uint64(64 - bits)
        cuts = np.r_[0, np.flatnonzero(np.diff(place)) + 1, len(g)] if len(g) else np.zeros(1, np.int64)
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "half": pdf["half"].iloc[0], "block": pdf["block"].iloc[0],
                             "range": place[cuts[:-1]].astype(np.int64),
                             "g": [g[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])],
                             "n": [n[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]})

    key = ["lang", "half", "block"]
    rows = blocked.select(*key, "_bits", "_text", "_id").groupBy(*key)
    schema = "lang string, half int, block int, range long, g binary, n binary"
    if labelled is None:
        return rows.applyInPandas(lambda pdf: run(pdf), schema)
    return rows.cogroup(labelled.groupBy(*key)).applyInPandas(lambda pdf, marks: run(pdf, marks), schema)


def _arrays(column: pd.Series, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, kind) for x in column]) if len(column) else np.zeros(0, kind)


def summed_grams(listed: DataFrame) -> DataFrame:
    """The lists of each language and range summed by gram: ``(lang, range, g,
    n0, n1)``, a row a gram.  As ranges grow in number with the text, what
    meets in one task does not."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g, n = _arrays(pdf["g"], np.int64), _arrays(pdf["n"], np.int64)
        half = np.repeat(pdf["half"].to_numpy(), [len(x) // 8 for x in pdf["g"]])
        codes, kinds = pd.factorize(g)
        out = {f"n{m}": np.bincount(codes, weights=np.where(half == m, n, 0), minlength=len(kinds)).astype(np.int64) for m in (0, 1)}
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "range": pdf["range"].iloc[0], "g": kinds, **out})

    return listed.groupBy("lang", "range").applyInPandas(run, "lang string, range long, g long, n0 long, n1 long")


def _discount(order_counts: str, m: int) -> list[F.Column]:
    """Discounts of counts 1, 2 and 3 or more (as :func:`_discounts_from`),
    from the counts of counts of half ``m``."""
    n = [F.greatest(F.lit(1.0), F.col(f"{order_counts}{m}_{k}").cast("double")) for k in range(1, 5)]
    y = n[0] / (n[0] + 2 * n[1])
    raw = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
    return [F.greatest(F.lit(0.05), F.least(F.lit(top), x)) for x, top in zip(raw, (0.95, 1.9, 2.9))]


def gram_probabilities(counts: DataFrame, floor: float = FLOOR, keep=lambda df, name: df) -> DataFrame:
    """``(lang, g, n0, n1, ...)``, counts of 4-grams in the two halves → ``(lang,
    g, p0, p1, ...)``: the probability of the last unit after the three before, by
    each half's model, for the grams of both.  Lower orders count distinct left
    neighbours; probabilities interpolate with the next shorter order, the
    shortest with ``floor``, the uniform distribution.  ``keep`` stores a level."""
    levels = [counts]
    for order in range(ORDER - 1, 0, -1):
        short = F.col("g").bitwiseAND(F.lit((1 << 16 * order) - 1).cast("long"))
        levels.insert(0, keep(levels[0].groupBy("lang", short.alias("g")).agg(
            *[F.sum((F.col(f"n{m}") > 0).cast("long")).alias(f"n{m}") for m in (0, 1)]), "level"))
    lower = None
    for order, level in enumerate(levels, 1):
        more = [c for c in level.columns if c not in ("lang", "g", "n0", "n1")]
        of = level.groupBy("lang").agg(*[F.sum((F.col(f"n{m}") == k).cast("long")).alias(f"c{m}_{k}")
                                         for m in (0, 1) for k in range(1, 5)])
        off = keep(of.select("lang", *[d.alias(f"o{m}_{k}") for m in (0, 1) for k, d in enumerate(_discount("c", m), 1)]),
                   "discounts")                          # a row a language

        def taken(m: int) -> F.Column:
            c = F.col(f"n{m}")
            return F.when(c == 0, 0.0).when(c == 1, F.col(f"o{m}_1")).when(c == 2, F.col(f"o{m}_2")).otherwise(F.col(f"o{m}_3"))

        rows = level.join(off, "lang").select(
            "lang", "g", "n0", "n1", *more, taken(0).alias("d0"), taken(1).alias("d1"),
            F.shiftrightunsigned("g", 16).alias("ctx"),
            F.col("g").bitwiseAND(F.lit((1 << 16 * (order - 1)) - 1).cast("long")).alias("short"))
        sums = rows.groupBy("lang", "ctx").agg(*[F.sum(f"{c}{m}").alias(f"{t}{m}")
                                                 for m in (0, 1) for c, t in (("n", "t"), ("d", "free"))])
        rows = rows.join(sums, ["lang", "ctx"])
        if lower is None:
            rows = rows.withColumns({"q0": F.lit(floor), "q1": F.lit(floor)})
        else:
            rows = rows.join(lower.select("lang", F.col("g").alias("short"), F.col("p0").alias("q0"),
                                          F.col("p1").alias("q1")), ["lang", "short"])
        lower = rows.select("lang", "g", *more, *[
            F.when(F.col(f"t{m}") > 0, (F.col(f"n{m}") - F.col(f"d{m}") + F.col(f"free{m}") * F.col(f"q{m}"))
                   / F.col(f"t{m}")).otherwise(F.col(f"q{m}")).alias(f"p{m}") for m in (0, 1)])
    return lower


def hash_arrays(priced: DataFrame) -> DataFrame:
    """The model as stored: for each language and range the grams sorted by
    hash, and both halves' -log10 probabilities beside them, as bytes."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g = pdf["g"].to_numpy(np.int64)
        order = np.argsort(mix64(g.view(np.uint64)))
        cost = [-np.log10(pdf[f"p{m}"].to_numpy(np.float64)[order]) for m in (0, 1)]
        return pd.DataFrame({"lang": pdf["lang"].iloc[:1], "range": pdf["range"].iloc[:1], "g": [g[order].tobytes()],
                             "cost0": [cost[0].tobytes()], "cost1": [cost[1].tobytes()]})

    return priced.groupBy("lang", "range").applyInPandas(run, "lang string, range long, g binary, cost0 binary, cost1 binary")


def looked_up(listed: DataFrame, model: DataFrame, halves: DataFrame) -> DataFrame:
    """Each block's grams with their cost by the model of the other half:
    ``(lang, half, block, g, cost)``.  ``halves(lang, t0, t1)``: how much
    trusted text each half has; a half without any is not asked."""
    def run(lists: pd.DataFrame, arrays: pd.DataFrame) -> pd.DataFrame:
        if not len(lists) or not len(arrays):
            return pd.DataFrame({c: [] for c in ("lang", "half", "block", "g", "cost")})
        h = mix64(np.frombuffer(arrays["g"].iloc[0], np.uint64))
        cost = [np.frombuffer(arrays[f"cost{m}"].iloc[0]) for m in (0, 1)]
        trained = [arrays["t0"].iloc[0] > 0, arrays["t1"].iloc[0] > 0]
        out = []
        for half, g in zip(lists["half"], lists["g"]):
            other = 1 - half if trained[1 - half] else half
            out.append(cost[other][np.searchsorted(h, mix64(np.frombuffer(g, np.uint64)))].tobytes())
        return pd.DataFrame({"lang": lists["lang"], "half": lists["half"], "block": lists["block"], "g": lists["g"], "cost": out})

    asked = model.join(halves, "lang")
    return (listed.select("lang", "range", "half", "block", "g").groupBy("lang", "range")
            .cogroup(asked.groupBy("lang", "range"))
            .applyInPandas(run, "lang string, half int, block int, g binary, cost binary"))


# ---- base rules ------------------------------------------------------------

def _repeat_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text, and those in windows of 8 found twice or more in it.
    Windows are named exactly by naming pairs of words, then pairs of pairs,
    then pairs of those."""
    words = [as_bytes(t).split() for t in texts]
    n = np.array([len(w) for w in words], dtype=np.int64)
    repeat = np.zeros(len(texts), dtype=np.int64)
    flat = np.empty(int(n.sum()), dtype=object)
    flat[:] = [w for ws in words for w in ws]
    if len(flat) < WINDOW:
        return n, repeat
    ids = pd.factorize(flat)[0].astype(np.int64)
    for step in (1, 2, 4):
        a, b = ids[:-step], ids[step:]
        ids = pd.factorize(a * (int(ids.max()) + 1) + b)[0].astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), n)
    inside = np.flatnonzero(doc[:len(ids)] == doc[WINDOW - 1:])
    name = pd.factorize(ids[inside] * len(texts) + doc[inside])[0]
    twice = inside[np.bincount(name, minlength=1)[name] >= 2] if len(name) else inside
    edge = np.zeros(len(flat) + 1, dtype=np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + WINDOW, -1)
    covered = np.cumsum(edge)[:-1] > 0
    repeat += np.bincount(doc[covered], minlength=len(texts))
    return n, repeat


def _dup_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.diff(np.r_[0, np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)][starts])


def measure(blocked: DataFrame, costs: DataFrame, carry: list[str]) -> DataFrame:
    """``blocked(lang, half, block, carry..., _text)`` and ``costs(lang, half,
    block, g, cost)`` → carry columns, ``lang``, base counts, ``score`` (mean
    -log10 probability a unit, null without text) and ``letters``."""
    schema = T.StructType([blocked.schema[c] for c in carry] + [
        T.StructField("lang", T.StringType()), *[T.StructField(c, T.LongType()) for c in COUNTS],
        T.StructField("score", T.DoubleType()), T.StructField("letters", T.DoubleType())])

    def run(own: pd.DataFrame, grams: pd.DataFrame) -> pd.DataFrame:
        g, cost = _arrays(grams["g"], np.int64), _arrays(grams["cost"], np.float64)
        order = np.argsort(g)
        g, cost = g[order], cost[order]
        parts = []
        every = [t if isinstance(t, str) else "" for t in own["_text"]]
        for lo, hi in text_slices(every, SLICE):
            part, texts = own.iloc[lo:hi], every[lo:hi]
            cps, starts = _points(texts)
            mark = _tables()[1][cps]
            units, at = _units(texts)
            codes, kinds = pd.factorize(_unit_codes(units, at))
            size = np.diff(at)
            score = np.full(len(texts), np.nan)
            if len(kinds):
                each = cost[np.searchsorted(g, kinds)][codes]
                score[size > 0] = (_sums(each, at) / np.maximum(size, 1))[size > 0]
            n, repeat = _repeat_words(texts)
            parts.append(pd.DataFrame({
                **{c: part[c] for c in carry}, "lang": part["lang"], "n_words": n,
                "word_chars": _sums((mark > 0).astype(np.int64), starts),
                "n_symbols": _sums((mark == 3).astype(np.int64), starts),
                "n_dup_lines": [_dup_lines(t) for t in texts], "n_repeat_words": repeat, "score": score,
                "letters": letter_shares(texts)}))
        return pd.concat(parts) if parts else pd.DataFrame({f.name: [] for f in schema})

    key = ["lang", "half", "block"]
    return blocked.groupBy(*key).cogroup(costs.groupBy(*key)).applyInPandas(run, schema)


def perplexity_bands(scored: DataFrame) -> DataFrame:
    """``(lang, low, high)`` from the trusted documents (``_trusted``) that pass
    the base rules: the quantiles that leave out ``TARGET`` of them, but no
    further out than ``WIDTH`` interquartile ranges (each counted as
    ``LEAST_SPREAD`` at least) from the quartiles."""
    usable = scored.filter("_trusted AND score IS NOT NULL AND NOT isnan(score) AND n_words >= " + str(MIN_WORDS)
                           + " AND 100 * n_repeat_words <= 30 * n_words")
    q = F.percentile_approx("score", [TARGET / 2, 0.25, 0.75, 1 - TARGET / 2], 10_000)
    far = WIDTH * F.greatest(F.col("q")[2] - F.col("q")[1], F.lit(LEAST_SPREAD))
    return usable.groupBy("lang").agg(q.alias("q")).select(
        "lang", F.greatest(F.col("q")[0], F.col("q")[1] - far).alias("low"),
        F.least(F.col("q")[3], F.col("q")[2] + far).alias("high"))


def judge_documents(docs: DataFrame, carry: list[str], text_col: str = "text", lang_col: str = "lang",
                    labels: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
    """``carry`` columns, the base counts, ``base_failed``, ``kept``,
    ``perplexity``; one row per input row.  ``labels(id_col, quality)`` says
    which documents are good (1) or bad (0).  Added names that clash with a
    carried column get underscores."""
    scratch = Scratch(docs.sparkSession, "quality")
    keep = {c: f"_c{i}" for i, c in enumerate(carry)}
    rows = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in keep.items()],
                       F.col(f"`{text_col}`").cast("string").alias("_text"),
                       F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("")).alias("lang"),
                       (F.col(f"`{id_col}`") if labels is not None else F.lit(None)).cast("string").alias("_id")).withColumn(
                           "half", F.pmod(F.xxhash64("_text"), F.lit(2)).cast("int"))
    # a row a language and half: how many blocks it has, and its language's hash ranges
    size = rows.groupBy("lang", "half").agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0)).alias("b"))
    whole = size.groupBy("lang").agg(F.greatest(F.lit(1), F.ceil(F.sum("b") / RANGE)).alias("r"))
    sizes = scratch.write(size.join(whole, "lang").select(
        "lang", "half", F.greatest(F.lit(1), F.ceil(F.col("b") / BLOCK)).cast("int").alias("_blocks"),
        F.ceil(F.log2(F.col("r").cast("double"))).cast("int").alias("_bits")), "sizes")
    # carried columns are part of the hash, so that rows that share a text spread too
    spread = [c for c in keep.values() if "map<" not in rows.schema[c].dataType.simpleString()]
    blocked = rows.join(sizes, ["lang", "half"]).withColumn(
        "block", F.pmod(F.xxhash64("_text", *spread), F.col("_blocks")).cast("int")).drop("_blocks")
    marks = labelled = None
    if labels is not None:
        # the labels are dealt into the blocks by narrow rows, so that no text moves for them
        marks = (labels.select(F.col(f"`{id_col}`").cast("string").alias("_id"), "quality").filter("_id IS NOT NULL")
                 .groupBy("_id").agg(F.min("quality").alias("q")).filter("q IS NOT NULL"))
        labelled = scratch.write(blocked.select("lang", "half", "block", "_id").distinct().join(marks, "_id")
                                 .withColumnRenamed("_id", "id"), "labels")
    listed = scratch.write(block_grams(blocked, labelled), "lists")
    scratch.drop("labels")
    counts = scratch.write(summed_grams(listed), "counts")
    halves = scratch.write(counts.groupBy("lang").agg(F.sum("n0").alias("t0"), F.sum("n1").alias("t1")), "halves")
    model = scratch.write(hash_arrays(gram_probabilities(counts, keep=scratch.write)), "model")
    scratch.drop("counts", "level", "discounts")
    costs = scratch.write(looked_up(listed, model, halves), "costs")
    scratch.drop("lists", "model")
    got = scratch.write(measure(blocked, costs, [*keep.values(), "_id"]), "scores")
    scratch.drop("costs")
    q = F.lit(None).cast("int")
    if marks is not None:
        got, q = got.join(marks, "_id", "left"), F.col("q")
    judged = got.withColumn("_trusted", F.when(q.isNotNull(), q == 1).otherwise(F.col("letters") >= LETTERS))
    bands = scratch.write(perplexity_bands(judged), "bands")                   # a row a language
    inside = F.coalesce(F.col("score").between(F.col("low"), F.col("high")), F.lit(False))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    own = {n: fresh(n, carry) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines",
                                        "n_repeat_words", "base_failed", "kept", "perplexity")}
    return (judged.join(bands, "lang", "left").withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & inside)
            .withColumn("perplexity", F.pow(F.lit(10.0), F.when(~F.isnan("score"), F.col("score"))))
            .select(*[F.col(k).alias(c) for c, k in keep.items()],
                    *[F.col(n).alias(a) for n, a in own.items()]))


def op6_quality_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return judge_documents(load_table(spark, sf_dir, "documents"), ["doc_id"],
                           labels=load_table(spark, sf_dir, "labels"))
