"""SimHash near-duplicates, linked through pigeonring filtering.

The 64 bits of a fingerprint are a ring of 8 segments.  If two fingerprints
differ in at most ``distance`` bits, then from some segment on *every* chain
of 1, 2, ... 8 consecutive segments holds at most ``chain length * distance /
8`` differing bits.  Candidates are generated by the first links of the chain
(three segments: the first equal, the next two with one differing bit at
most for distance 4), pruned by the remaining links, and only then compared
in full.

Links are never written as all pairs of a bucket: a bucket gives a spanning
forest of its links, at most one row per member.  Buckets above ``hot``
members are cut into blocks, and each pair of blocks is a bucket of its own,
so no task holds a whole hot bucket and no link is lost.

Defined cases: null text is empty; a text without words has fingerprint 0 and
links like any other; repeated rows stay repeated; null ids are kept, and a
component made only of null ids has a null id; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eddyline.llm.common import as_bytes, cut_lineage, load_table, prepare
from eddyline.llm.components import connected_components

SEGMENTS = 8
WIDTH = 8            # bits in a segment
INDEXED = 3          # segments in the indexed part of a chain


def text_fingerprint(text, words: int = 4, seed: int = 42) -> int:
    """Unsigned 64-bit fingerprint of the word shingles of one text."""
    import xxhash
    tokens = as_bytes(text).lower().split()
    if not tokens:
        return 0
    digest = xxhash.xxh64_intdigest
    n = max(1, len(tokens) - words + 1)
    votes = np.zeros(64, dtype=np.int64)
    for lo in range(0, n, 65536):
        hs = np.array([digest(b" ".join(tokens[i:i + words]), seed)
                       for i in range(lo, min(n, lo + 65536))], dtype="<u8")
        bits = np.unpackbits(hs.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 words: int = 4, seed: int = 42) -> DataFrame:
    """``(id_col, fp BIGINT)``, one row per input row."""
    src = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    schema = T.StructType([T.StructField(id_col, src.schema[0].dataType), T.StructField("fp", T.LongType())])

    def run(batches):
        for pdf in batches:
            fps = np.array([text_fingerprint(t, words, seed) for t in pdf["_text"]], dtype=np.uint64)
            yield pd.DataFrame({id_col: pdf.iloc[:, 0], "fp": fps.view(np.int64)})

    return src.mapInPandas(run, schema)


def chain_budget(distance: int) -> list[int]:
    """Most differing bits in the first 1..8 segments of a viable chain."""
    return [length * distance // SEGMENTS for length in range(1, SEGMENTS + 1)]


def _patterns(distance: int) -> list[int]:
    """Differences a viable chain may show in its indexed segments."""
    budget, out = chain_budget(distance), []
    for n in range(budget[INDEXED - 1] + 1):
        for bits in itertools.combinations(range(INDEXED * WIDTH), n):
            if all(sum(b < (k + 1) * WIDTH for b in bits) <= budget[k] for k in range(INDEXED)):
                out.append(sum(1 << b for b in bits))
    return out


def _members(fps: DataFrame, distance: int) -> DataFrame:
    """``(k, fp)``: the buckets each fingerprint stands in.

    One of two differing fingerprints has the highest differing bit set; it
    alone visits the other's bucket, so only patterns whose highest bit is
    set in the fingerprint are generated."""
    rows = []
    for i in range(SEGMENTS):
        s = i * WIDTH
        ring = F.col("fp") if i == 0 else F.shiftrightunsigned("fp", s).bitwiseOR(
            F.shiftleft("fp", 64 - s))
        rows.append(F.struct(F.lit(i).cast("long").alias("i"),
                             ring.bitwiseAND(F.lit((1 << INDEXED * WIDTH) - 1)).alias("c")))
    chains = fps.select("fp", F.explode(F.array(*rows)).alias("r")).select("fp", "r.i", "r.c")
    pats = _patterns(distance)
    bits = F.array(*[F.lit(p).cast("long") for p in pats])
    tops = {p: (1 << p.bit_length() >> 1) for p in pats}
    top = F.array(*[F.lit(tops[p]).cast("long") for p in pats])
    keep = F.filter(F.arrays_zip(bits.alias("p"), top.alias("t")),
                    lambda x: F.col("c").bitwiseAND(x["t"]) == x["t"])
    return (chains.select("fp", "i", "c", F.explode(keep).alias("x"))
            .select((F.shiftleft("i", 56) + F.col("c").bitwiseXOR(F.col("x.p"))).alias("k"), "fp"))


_POP = np.array([bin(i).count("1") for i in range(65536)], dtype=np.uint8)


def _popcount(x: np.ndarray) -> np.ndarray:
    return sum(_POP[(x >> np.uint64(16 * j)) & np.uint64(0xFFFF)].astype(np.int16) for j in range(4))


def _linked(a: np.ndarray, b: np.ndarray, i: np.ndarray, budget: list[int]) -> np.ndarray:
    """Which pairs are linked and viable from segment ``i`` on: chain by
    chain, then the full Hamming distance (the last chain's sum)."""
    diff = a ^ b
    s = (i * WIDTH).astype(np.uint64)
    diff = (diff >> s) | (diff << ((np.uint64(64) - s) & np.uint64(63)))
    ok = np.arange(len(diff))
    total = np.zeros(len(diff), dtype=np.int16)
    for k in range(SEGMENTS):
        total = total + _POP[(diff >> np.uint64(k * WIDTH)) & np.uint64(0xFF)]
        keep = total <= budget[k]
        ok, diff, total = ok[keep], diff[keep], total[keep]
    return ok


def _forest(fp: np.ndarray, i: int, budget: list[int]) -> tuple[list, list]:
    """Spanning forest of one bucket's links: each member is compared with
    those not reached yet, and leaves the rest as soon as it is reached."""
    us, vs = [], []
    rest = np.unique(fp)
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            c = queue.pop()
            hit = _linked(np.full(len(rest), c), rest, np.full(len(rest), i), budget)
            if len(hit):
                found = rest[hit]
                us.append(np.full(len(found), c))
                vs.append(found)
                queue.extend(found)
                rest = np.delete(rest, hit)
    return us, vs


def _bucket_links(batches, distance: int):
    """Rows sorted by bucket → links; a bucket may span several batches."""
    budget, small = chain_budget(distance), 8
    held: list[pd.DataFrame] = []

    def links(k, sub, fp):
        seg = (k >> np.int64(56)) & np.int64(15)
        first = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (sub[1:] != sub[:-1])]) if len(k) else np.array([], int)
        size = np.diff(np.r_[first, len(k)])
        group = np.repeat(np.arange(len(first)), size)
        us, vs = [], []
        many = size > small
        few = ~many[group] if len(first) else np.array([], bool)
        for step in range(1, small):
            if len(k) <= step:
                break
            j = np.flatnonzero((group[step:] == group[:-step]) & few[step:])
            ok = j[_linked(fp[j], fp[j + step], seg[j], budget)]
            ok = ok[fp[ok] != fp[ok + step]]
            us.append(fp[ok])
            vs.append(fp[ok + step])
        for g in np.flatnonzero(many):
            a, b = _forest(fp[first[g]:first[g] + size[g]], int(seg[first[g]]), budget)
            us += a
            vs += b
        if not us:
            return None
        return pd.DataFrame({"u": np.concatenate(us).view(np.int64),
                             "v": np.concatenate(vs).view(np.int64)}).drop_duplicates()

    for pdf in itertools.chain(batches, [None]):
        if pdf is not None:
            if not len(pdf):
                continue
            held.append(pdf)
            if (pdf["k"].iloc[0] == pdf["k"].iloc[-1] and pdf["sub"].iloc[0] == pdf["sub"].iloc[-1]):
                continue                       # the open bucket may go on
        if not held:
            continue
        cur = pd.concat(held) if len(held) > 1 else held[0]
        k, sub = cur["k"].to_numpy(), cur["sub"].to_numpy()
        fp = cur["fp"].to_numpy().view(np.uint64)
        cut = len(k) if pdf is None else int(np.flatnonzero((k != k[-1]) | (sub != sub[-1]))[-1]) + 1
        out = links(k[:cut], sub[:cut], fp[:cut])
        held = [cur.iloc[cut:]] if cut < len(k) else []
        if out is not None and len(out):
            yield out


def fingerprint_links(fps: DataFrame, distance: int = 4, hot: int = 20_000) -> DataFrame:
    """``fps(fp)`` distinct → links ``(u, v)`` whose components are those of
    all pairs at most ``distance`` bits apart (0 to 7)."""
    if not 0 <= distance < SEGMENTS:
        raise ValueError("distance must be 0 to 7")
    members = _members(fps, distance)
    sizes = members.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot)
    sizes = cut_lineage(sizes.select("k", F.ceil(F.col("n") / hot).cast("int").alias("blocks")))
    # block pair (lo, hi): a member of block b stands in every pair that has b
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    pairs = F.when(F.col("blocks").isNull(), F.array(F.lit("")))\
        .otherwise(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.concat_ws(
            "-", F.least(o, block).cast("string"), F.greatest(o, block).cast("string"))))
    split = (members.join(sizes, "k", "left")
             .select("k", "fp", F.explode(pairs).alias("sub")))
    parts = split.repartition("k", "sub").sortWithinPartitions("k", "sub")
    return parts.mapInPandas(lambda it: _bucket_links(it, distance), "u long, v long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   words: int = 4, distance: int = 4, seed: int = 42,
                   hot: int = 20_000) -> DataFrame:
    """``(id_col, fp, component_id)`` per input row: ``component_id`` is the
    smallest id reachable over links of ``distance`` bits or fewer."""
    fps = cut_lineage(fingerprints(docs, id_col, text_col, words, seed))
    nodes = cut_lineage(fps.groupBy("fp").agg(F.min(id_col).alias("first_id")))
    roots = connected_components(fingerprint_links(nodes.select("fp"), distance, hot))
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        nodes["fp"], "first_id", F.coalesce("root", nodes["fp"]).alias("root"))
    ids = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_fp = placed.join(ids, "root").select("fp", "component_id")
    return fps.join(by_fp, "fp").select(id_col, "fp", "component_id")


def op10_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = load_table(spark, sf_dir, "documents")
    return simhash_groups(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
