"""Personal data: fixed patterns, and a character BiLSTM-CRF that adds spans.

Base spans (email, ip, card, phone) come from linear scans.  The tagger is
trained on the driver from the base spans of a bounded sample of documents
(``sample`` documents, ``windows`` windows), with spans altered so that it
learns shapes the patterns miss (digits parted by other marks, "at" signs in
brackets); it then reads every character of every text:

* a text is cut into windows of ``WINDOW`` characters that overlap by
  ``OVERLAP``; windows of many texts form one batch;
* each window is decoded by itself (Viterbi over the CRF);
* windows are reconciled over the whole text: a place covered twice takes the
  tag of the window in which it lies further from an edge, and spans are the
  runs of the reconciled tags, so they may cross windows;
* spans that overlap a base span give way to it; those left are added if they
  meet the kind's least length and number of digits.

Defined cases: null text is empty; repeated rows are rows of their own; if
the sample holds no span, no tagger is trained and only base spans are given;
an empty table gives an empty result; other columns are carried on request.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eddyline.llm.common import Scratch, fresh, load_table, prepare, text_slices
from eddyline.llm.tagger import Tagger

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)                 # outside; begin and inside of each kind
WINDOW, OVERLAP = 256, 32
LEARN = 64                                # characters in a training window
SLICE = 400_000                           # characters held at once by a worker

# The patterns of the base spans.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str):
    """Each @ is met once, with the run of name characters before it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind index, end)`` in order of start, then kind."""
    out = [(a, 0, b) for a, b in _emails(text)]
    if DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text)
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text)
                    if 9 <= len(DIGIT.findall(m[0])) <= 15]
    return sorted(out)


# Character classes: digit, small, capital, space, line end, other letter,
# other character, and one for each of these marks.
MARKS = "@.-_%+(),:;/[]"
N_CLASSES = 7 + len(MARKS) + 1
PAD = N_CLASSES - 1
_CLASS: dict = {}


def _classes() -> np.ndarray:
    if "t" not in _CLASS:
        t = np.full(0x3000, 6, dtype=np.uint8)
        for cp in range(0x3000):
            c = chr(cp)
            t[cp] = (0 if c in "0123456789" else 1 if "a" <= c <= "z" else 2 if "A" <= c <= "Z"
                     else 4 if c in "\n\r" else 3 if c.isspace()
                     else 7 + MARKS.index(c) if c in MARKS else 5 if c.isalpha() else 6)
        _CLASS["t"] = t
    return _CLASS["t"]


def char_classes(text: str) -> np.ndarray:
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return _classes()[np.minimum(cps, 0x2FFF)]


def window_starts(n: int) -> np.ndarray:
    """Starts of the windows that cover ``n`` characters."""
    step = WINDOW - OVERLAP
    return np.arange(0, max(1, n - OVERLAP), step) if n else np.zeros(0, dtype=np.int64)


def _windows(cls: np.ndarray, starts: np.ndarray) -> np.ndarray:
    padded = np.r_[cls, np.full(WINDOW, PAD, dtype=cls.dtype)]
    return padded[starts[:, None] + np.arange(WINDOW)]


def reconcile(paths: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Tags of the whole text: where two windows overlap, the first half is
    further inside the earlier window, the second half inside the later."""
    tags = np.zeros(n, dtype=np.int8)
    half = OVERLAP // 2
    for i, s in enumerate(starts):
        lo = 0 if i == 0 else half
        hi = min(WINDOW, n - s)
        tags[s + lo:s + hi] = paths[i, lo:hi]
    return tags


def tag_spans(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs of one kind; a begin tag starts a new span."""
    on = np.flatnonzero(tags)
    out: list[list[int]] = []
    for p in on:
        kind, begin = (int(tags[p]) - 1) // 2, int(tags[p]) % 2 == 1
        if out and out[-1][2] == p and out[-1][1] == kind and not begin:
            out[-1][2] = int(p) + 1
        else:
            out.append([int(p), kind, int(p) + 1])
    return [tuple(x) for x in out]


def _whole_runs(text: str, span: tuple[int, int, int]) -> tuple[int, int, int]:
    """The span grown to the ends of the digit runs it cuts."""
    a, kind, b = span
    while a > 0 and text[a] in "0123456789" and text[a - 1] in "0123456789":
        a -= 1
    while b < len(text) and text[b - 1] in "0123456789" and text[b] in "0123456789":
        b += 1
    return a, kind, b


# Shapes of the added spans: the kinds written another way.
_PART = r"(?:[01]?[0-9]?[0-9]|2[0-4][0-9]|25[0-5])"
SHAPES = (
    re.compile(r"[A-Za-z0-9._%+-]+ ?(?:[\[(] ?(?:@|at) ?[\])]|@| at ) ?[A-Za-z0-9-]+(?: ?(?:\.|[\[(](?:\.|dot)[\])]) ?[A-Za-z0-9-]+)+"),
    re.compile(rf"{_PART}(?: ?(?:-|_|,|\[\.\]|\(\.\)|\.) ?{_PART}){{3}}"),
    re.compile(r"[0-9](?:[ ./_-]?[0-9])+"),
    re.compile(r"\+[0-9][ ()./0-9-]+[0-9]"),
)


def _accept(text: str, span: tuple[int, int, int]) -> bool:
    """Whether an added span holds what its kind must hold: the kind's shape,
    its number of digits and check digit, and no letter or digit beside it."""
    a, kind, b = span
    part = text[a:b]
    if not SHAPES[kind].fullmatch(part) or a and text[a - 1].isalnum() or b < len(text) and text[b].isalnum():
        return False
    digits = DIGIT.findall(part)
    if kind == 2:
        return 12 <= len(digits) <= 19 and luhn("".join(digits))
    return kind != 3 or 9 <= len(digits) <= 15


def _trimmed(text: str, span: tuple[int, int, int]) -> tuple[int, int, int]:
    """The span without blanks and punctuation at its ends."""
    a, kind, b = span
    while a < b and not (text[a].isalnum() or text[a] == "+"):
        a += 1
    while b > a and not text[b - 1].isalnum():
        b -= 1
    return a, kind, b


def added_spans(text: str, tags: np.ndarray, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    out = []
    for s in tag_spans(tags):
        s = _trimmed(text, s)
        if s[0] == s[2]:
            continue
        s = _whole_runs(text, s)
        if _accept(text, s) and not any(s[0] < b[2] and b[0] < s[2] for b in base):
            out.append(s)
    return out


# ---- training --------------------------------------------------------------

def _altered(rng, text: str, a: int, kind: int, b: int) -> tuple[str, int]:
    """The text with the span written another way, and its new end."""
    part = text[a:b]
    turn = rng.integers(3)
    if kind == 0 and turn == 0:
        part = part.replace("@", "[@]" if rng.integers(2) else "(@)")
    elif kind == 1 and turn == 0:
        part = part.replace(".", "-" if rng.integers(2) else "[.]")
    elif kind == 2 and turn < 2:
        sep = "./"[int(turn)]
        digits = re.sub(r"[^0-9]", "", part)
        part = sep.join(digits[i:i + 4] for i in range(0, len(digits), 4))
    elif kind == 3 and turn == 0:
        part = re.sub(r"[\x20().-]+", "/", part)
    return text[:a] + part + text[b:], a + len(part)


HARD = re.compile(r"[0-9A-Za-z]*[0-9][0-9A-Za-z .:/-]{9,40}")


def _learn_window(text: str, start: int, spans: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    y = np.zeros(len(text) + LEARN, dtype=np.int64)
    for a, kind, b in spans:
        y[a:b] = 2 + 2 * kind
        y[a] = 1 + 2 * kind
    return _windows(char_classes(text), np.array([start]))[0][:LEARN], y[start:start + LEARN]


def training_windows(texts: list[str], most: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Windows round the base spans of the texts (some altered), round runs
    with digits that are no span (ids, refused numbers), and from elsewhere,
    with their tags; at most ``most``."""
    rng = np.random.default_rng(seed)
    out: list = []
    for text in texts:
        spans = base_spans(text)
        for a, kind, b in spans:
            if len(out) >= most or any(s != (a, kind, b) and s[0] < b + 2 * LEARN and a < s[2] + 2 * LEARN
                                       for s in spans) or b - a > LEARN // 2:
                continue
            changed, end = _altered(rng, text, a, kind, b)
            out.append(_learn_window(changed, max(0, a - int(rng.integers(0, LEARN - (end - a)))), [(a, kind, end)]))
        for m in list(HARD.finditer(text))[:3]:
            start = max(0, m.start() - int(rng.integers(0, LEARN // 2)))
            if len(out) < most and not any(s[0] < start + LEARN and start < s[2] for s in spans):
                out.append(_learn_window(text, start, []))
        if not spans and len(text) > LEARN and len(out) < most:
            out.append(_learn_window(text, int(rng.integers(0, len(text) - LEARN)), []))
    if not out:
        return np.zeros((0, LEARN), np.uint8), np.zeros((0, LEARN), np.int64)
    return tuple(np.array(x) for x in zip(*out))


def sample_texts(docs: DataFrame, id_col: str, text_col: str, n: int, others: int, max_chars: int) -> list[str]:
    """The ``n`` texts with the smallest seeded hash among those with an @ or a
    run of digits, and ``others`` of the rest.  A share of the documents by
    hash, of ``8 (n + others)`` at first, is written aside; only if it does not
    hold enough of both, a share twice as large is.  From it, first the hashes
    and then the texts are fetched, so ``n + others`` texts reach the driver
    whatever the number of tasks."""
    c = F.col(text_col).cast("string")
    place = F.shiftrightunsigned(F.xxhash64(F.lit(11), F.col(id_col), c), 1)          # 63 bits
    rows = docs.select(c.alias("t"), place.alias("h"))
    total = docs.count()
    share = min(1.0, 8 * (n + others) / max(total, 1))
    hint = F.coalesce(F.col("t").rlike(r"@|[0-9][0-9.]{6}"), F.lit(False)).alias("hint")
    scratch = Scratch(docs.sparkSession, "personal")
    while True:
        # equal texts share a hash and are one example
        part = scratch.write(rows.filter(F.col("h") <= min(2 ** 63 - 1, int(share * 2 ** 63))).filter(F.length("t") <= max_chars)
                             .select("h", hint, "t").dropDuplicates(["h"]), "sample")
        ends = {}
        for flag, want in ((True, n), (False, others)):
            w = [r["h"] for r in part.filter(F.col("hint") == flag).select("h").orderBy("h").limit(want).collect()]
            ends[flag] = (w[-1] if w else -1, len(w) >= want)
        if share >= 1 or ends[True][1] and ends[False][1]:
            break
        share = min(1.0, 2 * share)
        scratch.drop("sample")
    texts = []
    for flag in (True, False):
        got = part.filter((F.col("hint") == flag) & (F.col("h") <= ends[flag][0])).select("h", "t")
        texts += [t for _, t in sorted((r["h"], r["t"]) for r in got.collect())]
    scratch.drop("sample")
    return texts


def train_tagger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 1500,
                 windows: int = 3000, max_chars: int = 8000, steps: int = 400) -> Tagger | None:
    """Tagger from a bounded sample: of documents up to ``max_chars``
    characters, ``sample`` with an @ or a run of digits, and a fifth as many
    others (:func:`sample_texts`)."""
    x, y = training_windows(sample_texts(docs, id_col, text_col, sample, sample // 5, max_chars), windows)
    if not (y > 0).any():
        return None
    tagger = Tagger(N_CLASSES, TAGS)
    tagger.fit(x, y, steps=steps)
    return tagger


# ---- finding ---------------------------------------------------------------

def tag_texts(tagger: Tagger, texts: list[str], batch: int = 2048) -> list[np.ndarray]:
    """Reconciled tags of every character of every text."""
    cls = [char_classes(t) for t in texts]
    starts = [window_starts(len(c)) for c in cls]
    wins = [_windows(c, s) for c, s in zip(cls, starts) if len(s)]
    if not wins:
        return [np.zeros(0, np.int8) for _ in texts]
    x = np.concatenate(wins)
    paths = np.concatenate([tagger.decode(tagger.emissions(x[i:i + batch])) for i in range(0, len(x), batch)])
    cut = np.r_[0, np.cumsum([len(s) for s in starts])]
    some = paths.any(axis=1)
    return [reconcile(paths[a:b], s, len(c)) if some[a:b].any() else np.zeros(len(c), np.int8)
            for a, b, s, c in zip(cut[:-1], cut[1:], starts, cls)]


def find_personal(docs: DataFrame, tagger: Tagger | None, carry: list[str], text_col: str = "text") -> DataFrame:
    """``carry`` columns, ``base`` and ``added``: arrays of structs (start,
    kind, end) in code points, ends exclusive.  Added names that clash with a
    carried column get underscores."""
    model = docs.sparkSession.sparkContext.broadcast(tagger)
    src = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)],
                      F.col(f"`{text_col}`").cast("string").alias("_text"))
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("kind", T.StringType()),
                                     T.StructField("end", T.LongType())]))
    schema = T.StructType([src.schema[i] for i in range(len(carry))]
                          + [T.StructField("base", span), T.StructField("added", span)])

    def shown(spans):
        return [{"start": a, "kind": KINDS[k], "end": b} for a, k, b in spans]

    def run(batches):
        for pdf in batches:
            for lo, hi in text_slices([t or "" for t in pdf["_text"]], SLICE):
                part = pdf.iloc[lo:hi]
                texts = [t if isinstance(t, str) else "" for t in part["_text"]]
                base = [base_spans(t) for t in texts]
                tags = tag_texts(model.value, texts) if model.value is not None else [np.zeros(0, np.int8)] * len(texts)
                more = [added_spans(t, g, b) if g.any() else [] for t, g, b in zip(texts, tags, base)]
                yield pd.DataFrame({**{c: part[c] for c in part.columns[:-1]},
                                    "base": [shown(b) for b in base], "added": [shown(a) for a in more]})

    return src.mapInPandas(run, schema).toDF(*carry, fresh("base", carry), fresh("added", carry))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = load_table(spark, sf_dir, "documents")
    found = find_personal(docs, train_tagger(docs), ["doc_id"])
    order = F.array(*[F.lit(k) for k in KINDS])

    def joined(spans):
        keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("a"), F.array_position(order, s["kind"]).alias("b"),
                                                      s["kind"].alias("c"), s["end"].alias("d")))
        return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(
            ":", s["c"], s["a"].cast("string"), s["d"].cast("string"))), ",")

    def n_of(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[n_of(k) for k in KINDS], F.sha2(joined("base"), 256).alias("base_sha256"),
                        joined(F.concat("base", "added")).alias("spans"))
