"""Token counts as delta-maintained rollups.

Totals by source, language and tokenizer version are sums of signed deltas: an
insert adds a document's count, a delete subtracts it, a revised count
subtracts the old one and adds the new.  A batch of deltas is summed by key
(partly before the shuffle, so a hot source costs no more than others) and
committed as one folder behind a manifest: a commit that fails half-way
changes nothing, committing a batch again replaces it, and old batches are
merged level by level, so the totals read a bounded number of small folders.

Texts are read once and never shuffled.  Documents whose count may be revised
are marked by a bit set of their ids, of a fixed ``MARK_BITS`` bits whatever
the number of documents: a marked text is counted both ways in the same pass,
and the join by id that picks the exact ones moves counts only.

Defined cases: null text counts 0 tokens; null sources and languages are keys
of their own; null ids are counted, and as they match no label they are never
deleted or revised; keys whose documents and tokens sum to 0 are left out of
the totals; repeated rows count as often as they stand; an empty batch is
committed and adds nothing; texts of any length, unbroken ones too, are
counted whole; other columns are ignored.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from eddyline.llm.common import load_table, prepare, scratch_dir, stored
from eddyline.sources.batches import BatchFolders

KEYS = ["source", "lang", "tokenizer"]
SUMS = ["n_docs", "n_tokens"]
VERSION = "byte_bpe_50k"


def read_ranks(path: str) -> dict[bytes, int]:
    """Vocabulary file (base64 piece and rank on each line), read on the driver."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


MARK_BITS = 1 << 23
SPACES = re.compile("[ \t\n\x0b\f\r]+")


class IdMarks:
    """A set of ids as ``MARK_BITS`` bits by hash: every id of the set is
    found, and another one by chance; the driver gets 1 MB at most."""

    def __init__(self, ids: DataFrame, col: str):
        place = self.place(F.col(col))
        words = (ids.filter(F.col(col).isNotNull()).select((place / 64).cast("int").alias("w"), (place % 64).cast("int").alias("b"))
                 .groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("bits")))
        self.bits = np.zeros(MARK_BITS // 64, np.int64)
        for w, bits in words.collect():
            self.bits[w] = bits

    @staticmethod
    def place(col: Column) -> Column:
        """Place of an id in the set; -1 for null."""
        return F.when(col.isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64(col), F.lit(MARK_BITS))).cast("long")

    @staticmethod
    def found(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
        return (places >= 0) & ((bits[places >> 6].view(np.uint64) >> (places & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


def squeezed(text: str) -> str:
    """The text with each run of white space as one blank."""
    return SPACES.sub(" ", text)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                 lang_col: str = "lang", version: str = VERSION, ranks_file: str | None = None,
                 pattern: str | None = None, marks: IdMarks | None = None, revise=squeezed) -> DataFrame:
    """``(id, source, lang, tokenizer, n_tokens)``, one row per document; with
    ``marks``, also ``n_revised``: the count of ``revise(text)`` for marked
    documents, null for the others."""
    if ranks_file is None:
        import public_tokenizers
        ranks_file, pattern = public_tokenizers.path(f"{version}.tiktoken"), public_tokenizers.PATTERN
    sc = docs.sparkSession.sparkContext
    vocab = sc.broadcast((read_ranks(ranks_file), pattern))
    bits = sc.broadcast(marks.bits if marks else None)
    cell: dict = {}

    @F.pandas_udf("n_tokens long, n_revised long")
    def counts(texts: pd.Series, places: pd.Series) -> pd.DataFrame:
        import tiktoken
        if "enc" not in cell:
            ranks, pat = vocab.value
            cell["enc"] = tiktoken.Encoding(version, pat_str=pat, mergeable_ranks=ranks, special_tokens={})
        enc = cell["enc"]
        marked = IdMarks.found(bits.value, places.to_numpy(np.int64)) if bits.value is not None else np.zeros(len(texts), bool)
        size = lambda t: len(enc.encode_ordinary(t)) if isinstance(t, str) else 0
        plain = [size(t) for t in texts]
        again = [(size(revise(t)) if isinstance(t, str) else 0) if m else None for t, m in zip(texts, marked)]
        return pd.DataFrame({"n_tokens": plain, "n_revised": pd.array(again, dtype="Int64")})

    got = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
                      F.col(lang_col).cast("string").alias("lang"), F.lit(version).alias("tokenizer"),
                      counts(F.col(text_col).cast("string"), IdMarks.place(F.col(id_col))).alias("c"))
    return got.select("id", *KEYS, "c.n_tokens", *(["c.n_revised"] if marks else []))


def _signed(counts: DataFrame, sign: int) -> DataFrame:
    return counts.select("id", *KEYS, F.lit(sign).cast("long").alias("n_docs"),
                         (F.lit(sign) * F.col("n_tokens")).cast("long").alias("n_tokens"))


def inserted(counts: DataFrame) -> DataFrame:
    return _signed(counts, 1)


def deleted(counts: DataFrame) -> DataFrame:
    return _signed(counts, -1)


def revised(old: DataFrame, new: DataFrame) -> DataFrame:
    """The old counts of the revised documents out, the new ones in."""
    return deleted(old).union(inserted(new))


class TokenRollup:
    """Totals kept under a folder, a sub-folder for each batch; ``fan`` batch
    folders are merged into one."""

    SCHEMA = StructType([*[StructField(k, StringType()) for k in KEYS], *[StructField(c, LongType()) for c in SUMS]])

    def __init__(self, spark: SparkSession, path: str, fan: int = 10):
        self.folders = BatchFolders(spark, path, fan)

    @staticmethod
    def _sums(rows: DataFrame) -> DataFrame:
        # one small row a key: a single file keeps the folder readable
        return rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS]).repartition(1)

    def commit(self, batch: str, deltas: DataFrame) -> None:
        """Add a batch of signed deltas, or replace it by the same batch."""
        self.folders.commit(batch, self._sums(deltas))
        self.folders.compact(self._sums, self.SCHEMA)

    def totals(self) -> DataFrame:
        rows = self.folders.rows(self.SCHEMA)
        return (rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])
                .filter(F.greatest(*[F.abs(c) for c in SUMS]) > 0))


def op8_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents inserted; those labelled toxic deleted; those labelled of
    low quality counted anew with their white space squeezed.  The last batch
    is committed twice, as after a failed run."""
    prepare(spark)
    docs = load_table(spark, sf_dir, "documents")
    labels = load_table(spark, sf_dir, "labels").filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    low = "quality = 0 AND coalesce(toxic, 0) <> 1"
    counts = stored(count_tokens(docs, marks=IdMarks(labels.filter(low), "doc_id")), "token-counts")
    marked = stored(counts.join(labels.withColumnRenamed("doc_id", "id"), "id"), "token-marked")
    new = marked.filter(low).select("id", *KEYS, F.col("n_revised").alias("n_tokens"))
    rollup = TokenRollup(spark, scratch_dir(spark, "token-rollup"))
    rollup.commit("1-load", inserted(counts))
    rollup.commit("2-toxic", deleted(marked.filter("toxic = 1")))
    for _ in range(2):
        rollup.commit("3-squeeze", revised(marked.filter(low), new))
    return rollup.totals()
