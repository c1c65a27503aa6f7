"""Benchmark decontamination with a broadcast set of normalised word windows.

Words are runs of ASCII letters and digits and of all characters beyond ASCII,
with A-Z lowered.  A benchmark item gives its windows of ``n`` consecutive
words (an item of fewer words is one window of its own).  The distinct windows
are broadcast as a hash set; a scan over the texts hashes every window of
theirs, looks it up, verifies a hit by comparing the words themselves, and
marks the words it covers.  Documents or the covered spans can then be removed.

The set is measured before it is broadcast.  Beyond ``max_bytes`` of window
text it is dealt by hash into as many parts as needed, and the scan runs once
for each part, adding to what the passes before it have marked; a document's
result is the same for any number of parts.  Nothing is shuffled but the
benchmark's own windows.

Hashes are computed for a block of texts at once with numpy: the hash of a
word is the sum of a mixed value for each of its bytes and places, that of a
window a polynomial over its words.

Defined cases: null or empty texts have no words and are not contaminated; an
item without words has no window; items that share an id are one item; a null
item id reads as the empty string; repeated documents are rows of their own,
null document ids stay; an empty benchmark marks nothing; other columns are
kept, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eddyline.llm.common import as_bytes, fresh, load_table, mix64, prepare, stored, text_slices

WINDOW = 10
MAX_BYTES = 8 << 20          # window text in one broadcast part
BLOCK = 1 << 20              # bytes hashed at a time
KEEP = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32
             for c in range(256))
_PLACES = mix64(np.arange(64 * 256, dtype=np.uint64))
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BITS = 20

RUN = T.ArrayType(T.StructType([T.StructField(f, T.LongType()) for f in ("first", "last", "start", "end")]))
_RUN_ARROW = pa.list_(pa.struct([(f, pa.int64()) for f in ("first", "last", "start", "end")]))


def words_of(low: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of a translated text, block by
    block; a block ends at a blank."""
    parts, at = [], 0
    while at < len(low):
        to = low.find(b" ", at + BLOCK) if at + BLOCK < len(low) else -1
        to = len(low) if to < 0 else to
        a = np.frombuffer(low, np.uint8, to - at, at)
        pos = np.flatnonzero(a != 32)
        if len(pos):
            new = np.flatnonzero(np.diff(pos, prepend=-2) > 1)           # in pos, where words begin
            sizes = np.diff(new, append=len(pos))
            place = np.arange(len(pos)) - np.repeat(new, sizes)
            with np.errstate(over="ignore"):
                mixed = _PLACES[((place & 63) << 8) + a[pos]] * (2 * (place >> 6) + 1).astype(np.uint64)
                hashes = np.add.reduceat(mixed, new)
            starts = pos[new] + at
            parts.append((starts, starts + sizes, hashes))
        at = to
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(p) for p in zip(*parts))


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every window of ``n`` consecutive words."""
    m = max(0, len(words) - n + 1)
    out = np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * _STEP + words[k:k + m]
    return mix64(out)


class WindowSet:
    """A part of the benchmark's windows: by length, the sorted hashes behind
    a bit filter; by text, the items that hold the window."""

    def __init__(self, rows: list[tuple[bytes, str]]):
        self.items: dict[bytes, list[str]] = {}
        for window, item in rows:
            self.items.setdefault(window, []).append(item)
        by_size: dict[int, list[np.uint64]] = {}
        for window in self.items:
            h = words_of(window)[2]
            by_size.setdefault(len(h), []).append(window_hashes(h, len(h))[0])
        self.sizes = {}
        for n, hs in by_size.items():
            hs = np.unique(np.array(hs, np.uint64))
            seen = np.zeros(1 << _BITS, bool)
            seen[hs >> np.uint64(64 - _BITS)] = True
            self.sizes[n] = (hs, seen)

    def mark(self, low: bytes, bounds: np.ndarray, spans: tuple) -> tuple[np.ndarray, dict[int, set]]:
        """Words covered by windows, and the items by document.  ``bounds``:
        where the documents begin in ``low``, and its end."""
        starts, ends, hashes = spans
        doc = np.searchsorted(bounds, starts, side="right") - 1
        hit, found = np.zeros(len(starts) + 1, np.int64), {}
        for n, (hs, seen) in self.sizes.items():
            w = window_hashes(hashes, n)
            near = np.flatnonzero(seen[w >> np.uint64(64 - _BITS)])
            near = near[doc[near] == doc[near + n - 1]]
            at = np.minimum(np.searchsorted(hs, w[near]), len(hs) - 1)
            for i in near[hs[at] == w[near]]:
                text = b" ".join(low[starts[j]:ends[j]] for j in range(i, i + n))
                if text in self.items:
                    hit[i] += 1
                    hit[i + n] -= 1
                    found.setdefault(int(doc[i]), set()).update(self.items[text])
        return np.cumsum(hit[:-1]) > 0, found


def _runs(raw: bytes, starts: np.ndarray, ends: np.ndarray, hit: np.ndarray) -> list[dict]:
    """Maximal runs of hit words, with their code points."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    points = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    return [{"first": int(a), "last": int(b) - 1, "start": int(points[starts[a]]), "end": int(points[ends[b - 1]])}
            for a, b in edges.reshape(-1, 2)]


def _scan_slice(part: WindowSet, texts: list, old_runs: list, old_items: list) -> tuple[list, list, list, list]:
    raw = [as_bytes(t) for t in texts]
    low = b" ".join(raw).translate(KEEP)
    bounds = np.cumsum([0] + [len(r) + 1 for r in raw])
    spans = words_of(low)
    hit, found = part.mark(low, bounds, spans)
    first = np.searchsorted(spans[0], bounds)
    n_words, n_hit, items, runs = [], [], [], []
    for i, r in enumerate(raw):
        a, b = first[i], first[i + 1]
        own = hit[a:b]
        for x in old_runs[i] or ():
            own[x["first"]:x["last"] + 1] = True
        n_words.append(int(b - a))
        n_hit.append(int(own.sum()))
        items.append(sorted(set(old_items[i] or ()) | found.get(i, set())))
        runs.append(_runs(r, spans[0][a:b] - bounds[i], spans[1][a:b] - bounds[i], own) if n_hit[-1] else [])
    return n_words, n_hit, items, runs


def benchmark_windows(bench: DataFrame, id_col: str = "item_id", text_col: str = "text", n: int = WINDOW) -> DataFrame:
    """``(win binary, item string)``: the distinct windows of each item."""
    src = bench.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"),
                       F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for pdf in batches:
            rows = []
            for item, text in zip(pdf["item"], pdf["text"]):
                words = as_bytes(text).translate(KEEP).split(b" ")
                words = [w for w in words if w]
                for i in range(max(len(words) - n, 0) + 1 if words else 0):
                    rows.append((b" ".join(words[i:i + n]), item))
            yield pd.DataFrame(rows, columns=["win", "item"])

    return src.mapInPandas(run, "win binary, item string").distinct()


def find_contamination(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id",
                       item_text_col: str = "text", n: int = WINDOW, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``docs`` with four columns more: ``n_words``, ``n_hit``, ``items`` (ids
    as strings, sorted) and ``runs`` (maximal runs of hit words: first and
    last word, start and end in code points)."""
    sc = docs.sparkSession.sparkContext
    windows = stored(benchmark_windows(bench, item_col, item_text_col, n), "decontaminate-windows")
    total = windows.agg(F.sum(F.length("win"))).first()[0] or 0
    n_parts = max(1, -(-total // max_bytes))
    given = docs.columns
    names = [fresh(c, given) for c in ("n_words", "n_hit", "items", "runs")]
    types = [T.LongType(), T.LongType(), T.ArrayType(T.StringType()), RUN]
    schema = T.StructType([*docs.schema.fields, *[T.StructField(c, t) for c, t in zip(names, types)]])
    arrow = [pa.int64(), pa.int64(), pa.list_(pa.string()), _RUN_ARROW]
    place, width = given.index(text_col), len(given)
    out = docs
    for p in range(n_parts):
        rows = windows.filter(F.pmod(F.xxhash64("win", "item"), F.lit(n_parts)) == p).collect()
        part = sc.broadcast(WindowSet([(bytes(r["win"]), r["item"]) for r in rows]))
        later = p > 0

        def run(batches, part=part, later=later):
            for batch in batches:
                texts = batch.column(place).to_pylist()
                old_items = batch.column(width + 2).to_pylist() if later else [None] * len(texts)
                old_runs = batch.column(width + 3).to_pylist() if later else [None] * len(texts)
                cols = [[], [], [], []]
                for a, b in text_slices(texts, BLOCK):
                    for c, new in zip(cols, _scan_slice(part.value, texts[a:b], old_runs[a:b], old_items[a:b])):
                        c.extend(new)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:width], *[pa.array(c, t) for c, t in zip(cols, arrow)]],
                    names=[f"c{i}" for i in range(width + 4)])

        # names may clash in case or repeat inside Arrow: columns go by place
        plain = out.toDF(*[f"c{i}" for i in range(len(out.columns))])
        out = plain.mapInArrow(run, T.StructType([T.StructField(f"c{i}", f.dataType)
                                                  for i, f in enumerate(schema.fields)])).toDF(*schema.names)
        if p + 1 < n_parts:
            out = stored(out, "decontaminate-pass")
    return out


def without_spans(text: str, runs: str) -> Column:
    """``text`` without the code points of its runs."""
    piece = F.transform(
        F.sequence(F.lit(0), F.size(runs)),
        lambda i: F.substring(F.col(text),
                              F.when(i > 0, F.get(F.col(runs), i - 1)["end"]).otherwise(0).cast("int") + 1,
                              F.when(i < F.size(runs), F.get(F.col(runs), i)["start"]).otherwise(F.length(text)).cast("int")
                              - F.when(i > 0, F.get(F.col(runs), i - 1)["end"]).otherwise(0).cast("int")))
    return F.when(F.size(runs) > 0, F.concat_ws("", piece)).otherwise(F.col(text))


def decontaminate(docs: DataFrame, bench: DataFrame, remove: str = "spans", text_col: str = "text", **how) -> DataFrame:
    """The columns of ``docs``: without the contaminated documents
    (``remove="documents"``), or all of them, texts without the hit runs."""
    if remove not in ("spans", "documents"):
        raise ValueError("remove is 'spans' or 'documents'")
    given = docs.columns
    found = find_contamination(docs, bench, text_col, **how)
    n_hit, runs = found.columns[len(given) + 1], found.columns[len(given) + 3]
    if remove == "documents":
        return found.filter(F.col(n_hit) == 0).select(*[F.col(f"`{c}`") for c in given])
    return found.select(*[without_spans(text_col, runs).alias(c) if c == text_col else F.col(f"`{c}`") for c in given])


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    found = find_contamination(load_table(spark, sf_dir, "documents").select("doc_id", "text"),
                               load_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


ORACLE_SQL = r"""
WITH b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
                  regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
           FROM benchmark WHERE text IS NOT NULL),
bi AS (SELECT item, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(w[i:i + 9], ' ') AS win FROM bi),
d AS (SELECT row_number() OVER () AS rid, doc_id,
             coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
      FROM documents),
dw AS (SELECT rid, size, w, unnest(range(1, len(w) - size + 2)) AS i
       FROM d, (SELECT DISTINCT size FROM bw) AS s WHERE len(w) >= size),
hit AS (SELECT rid, i, bw.size, item FROM (SELECT rid, size, i, array_to_string(w[i:i + size - 1], ' ') AS win FROM dw) AS x
        JOIN bw ON bw.size = x.size AND bw.win = x.win),
places AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + size)) AS p FROM hit) GROUP BY rid),
found AS (SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(places.n, 0) AS n_hit, coalesce(found.n, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(places.n, 0) > 0 AS contaminated
FROM d LEFT JOIN places ON places.rid = d.rid LEFT JOIN found ON found.rid = d.rid
"""
