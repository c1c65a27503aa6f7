"""Small helpers shared by the operators of this subpackage.

Words everywhere are the maximal runs of characters outside
``\\x20 \\x09-\\x0D``; on UTF-8 bytes that is exactly ``bytes.split()``, and
``bytes.lower()`` lowers A-Z alone.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eddyline.session import cut_lineage, scratch_dir, ship_package
from eddyline.sources.tables import load_table

WORD = r"[^\x20\x09-\x0D]+"

__all__ = ["WORD", "prepare", "load_table", "cut_lineage", "scratch_dir", "as_bytes",
           "text_slices", "text_ranges", "bound_batches", "mix64", "fresh", "word_count", "stored", "Scratch"]


def prepare(spark: SparkSession) -> None:
    """Make this package importable in the Python workers."""
    ship_package(spark)


def as_bytes(text) -> bytes:
    """UTF-8 bytes of a text value; null is empty."""
    if text is None or text is pd.NA or (isinstance(text, float) and text != text):
        return b""
    return text.encode("utf-8", "surrogatepass")


def text_slices(texts: list, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` with about ``limit`` characters each (one text at
    least), so that a worker's memory does not follow the Arrow batch size."""
    yield from text_ranges([len(t) if isinstance(t, (str, bytes)) else 0 for t in texts], limit)


def text_ranges(sizes: Sequence[int], limit: int) -> Iterator[tuple[int, int]]:
    """:func:`text_slices` by the texts' sizes alone."""
    start = total = 0
    for i, n in enumerate(sizes):
        total += n
        if total >= limit:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of the splitmix64 generator: a bijection on uint64."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def bound_batches(spark: SparkSession, limit: int = 1 << 20) -> None:
    """Batches of ``limit`` bytes at most between Spark and Python (plus a row):
    10 000 long rows a batch fill the executors' memory on both sides."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(limit))


def fresh(name: str, taken: list[str]) -> str:
    """``name``, with underscores added until no column in ``taken`` clashes
    (column names compare without case, as Spark does)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def word_count(text: str | Column) -> Column:
    """Number of words as BIGINT; null is 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends there,
    so a lost executor costs one re-read, and later scans prune columns."""
    path = scratch_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables an operator writes on its way, in the shared folder; it drops
    those that later tables no longer need, so that they don't pile up."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.paths = spark, name, {}

    def write(self, df: DataFrame, table: str) -> DataFrame:
        """``df`` written as ``table`` and read again (see :func:`stored`)."""
        path = scratch_dir(self.spark, f"{self.name}-{table}")
        df.write.option("compression", "zstd").parquet(path)
        self.paths.setdefault(table, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: str) -> None:
        """Delete tables whose every reader has been written."""
        path_of = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for table in tables:
            for path in self.paths.pop(table, []):
                p = path_of(path)
                p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        self.release()

    def release(self) -> None:
        """Let Spark remove the shuffle files of finished jobs: its cleaner
        follows the driver's garbage collection, which may be long in coming.
        Spark's listeners keep their last event, with the plan of the last
        table written, until another comes: hence a job of one row."""
        self.spark.range(1).collect()
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
