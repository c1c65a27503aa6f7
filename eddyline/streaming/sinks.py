"""Sinks: Kafka, upsert by batch folder, row-wise foreach, branch writers.

``upsert_sink`` is the Update-mode sink when no table format with MERGE is
available: each micro-batch is a folder of its own behind a manifest
(:class:`eddyline.sources.batches.BatchFolders`).  A replayed batch replaces
its folder, or changes nothing once it was merged, so the result is
exactly-once; folders are merged level by level, so their number stays a
multiple of the logarithm of the number of batches.  Readers take the last
version of each key (``latest_per_key`` on ``batch_id``).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

import pyarrow.fs as pafs
from pyspark.sql import functions as F
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from eddyline.config import PipelineConfig
from eddyline.operators.dedup import latest_per_key
from eddyline.sources.batches import FAN, BatchFolders

BATCH_COL = "batch_id"


def upsert_sink(path: str, *, keys: Sequence[str] | None = None, complete: bool = False,
                fan: int = FAN) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer.  With ``keys``, folders of one level are merged
    to the last row of each key once ``fan`` of them are there; ``complete``
    keeps the last batch only."""
    def write_batch(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn(BATCH_COL, F.lit(batch_id).cast("long"))
        folders = BatchFolders(batch.sparkSession, path, fan)
        folders.commit(batch_id, rows, alone=complete)
        if keys and not complete:
            folders.compact(lambda df: latest_per_key(df, keys, [BATCH_COL]).select(*rows.columns), rows.schema)
    return write_batch


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(hpath)


def read_upserts(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All live rows written by :func:`upsert_sink`, with ``batch_id``."""
    return BatchFolders(spark, path).rows(schema)


def write_events_kafka(df: DataFrame, cfg: PipelineConfig, checkpoint: str, *,
                       topic: str | None = None, output_mode: str = "update"):
    """Kafka sink writer (``key``/``value`` columns).  Not started here."""
    return (df.writeStream.format("kafka")
            .option("kafka.bootstrap.servers", cfg.bootstrap_servers)
            .option("topic", topic or cfg.output_topic)
            .option("checkpointLocation", checkpoint)
            .outputMode(output_mode))


def console_writer(df: DataFrame, output_mode: str = "update", checkpoint: str | None = None):
    """Debug sink (``truncate=false``); does not flush in real-time mode."""
    w = df.writeStream.format("console").option("truncate", "false").outputMode(output_mode)
    return w.option("checkpointLocation", checkpoint) if checkpoint else w


class RowWriter:
    """``foreach`` sink on a file system that all executors share: ``open`` /
    ``process`` / ``close`` for each partition and epoch.

    Lines go to an attempt file; ``close`` without an error renames it to
    ``epoch=E/part=P.txt``, which is at once the result and the mark that this
    part of the epoch is committed.  A replayed epoch finds the mark and skips
    the part; a failed attempt leaves a hidden file that no reader opens.
    """

    def __init__(self, folder: str, fmt: Callable = str):
        self.folder, self.fmt = folder, fmt

    def open(self, partition_id: int, epoch_id: int) -> bool:
        self._fs, root = pafs.FileSystem.from_uri(self.folder)
        own = f"{root}/epoch={epoch_id}"
        self._done = f"{own}/part={partition_id}.txt"
        if self._fs.get_file_info(self._done).type != pafs.FileType.NotFound:
            return False
        self._fs.create_dir(own, recursive=True)
        self._attempt = f"{own}/_attempt-{uuid.uuid4().hex}"
        self._out = self._fs.open_output_stream(self._attempt)
        return True

    def process(self, row) -> None:
        self._out.write((self.fmt(row) + "\n").encode())

    def close(self, error) -> None:
        if getattr(self, "_out", None) is None:          # a part that was skipped
            return
        self._out.close()
        self._out = None
        if error is None:
            self._fs.move(self._attempt, self._done)


def enrich_refreshing(stream: DataFrame, loader: Callable[[], DataFrame], on, *,
                      name: str = "refreshing", how: str = "left",
                      timeout_s: float | None = None) -> DataFrame:
    """Stream–table join whose table is re-read for every micro-batch.

    ``loader()`` is called inside ``foreachBatch``, so a slowly changing
    table is picked up at the next batch.  Each batch's join result goes to
    its own folder (idempotent on replay); returns all batches' rows.
    """
    from eddyline.session import scratch_dir
    from eddyline.streaming.run import await_query
    spark = stream.sparkSession
    base = scratch_dir(spark, name)
    out = f"{base}/out"

    def join_batch(batch: DataFrame, batch_id: int) -> None:
        batch.join(loader(), on, how).write.mode("overwrite").parquet(
            f"{out}/{BATCH_COL}={batch_id}")

    q = (stream.writeStream.foreachBatch(join_batch)
         .option("checkpointLocation", f"{base}/checkpoint")
         .trigger(availableNow=True).start())
    await_query(q, timeout_s)
    if not _exists(spark, out):
        return spark.createDataFrame([], stream.schema)
    return spark.read.option("basePath", out).parquet(out)


def run_foreach(df: DataFrame, fmt: Callable, *, name: str = "foreach", base: str | None = None,
                timeout_s: float | None = None) -> DataFrame:
    """Drain ``df`` through :class:`RowWriter`, one line per row as ``fmt``
    renders it, and read the committed lines back.  ``base`` (lines and
    checkpoint) may be given again to resume."""
    from eddyline.session import scratch_dir
    from eddyline.streaming.run import await_query
    spark = df.sparkSession
    base = base or scratch_dir(spark, name)
    lines = f"{base}/lines"
    q = (df.writeStream.foreach(RowWriter(lines, fmt))
         .option("checkpointLocation", f"{base}/checkpoint")
         .trigger(availableNow=True).start())
    await_query(q, timeout_s)
    if not _exists(spark, lines):
        return spark.createDataFrame([], "line string")
    return spark.read.text(f"{lines}/epoch=*/part=*.txt").select(F.col("value").alias("line"))


def write_branches(stream: DataFrame, branches: dict, path: str, *, default: str | None = None,
                   name: str = "branches", timeout_s: float | None = None) -> DataFrame:
    """Multi-sink side outputs from one read of the source.

    ``foreachBatch`` persists each micro-batch once, writes every branch to
    ``path/branch=<name>/batch_id=<id>`` (overwrite: idempotent on replay)
    and releases it.  Returns all written rows with ``branch``.
    """
    from pyspark import StorageLevel

    from eddyline.operators.sets import branch
    from eddyline.session import scratch_dir
    from eddyline.streaming.run import await_query
    spark = stream.sparkSession
    base = scratch_dir(spark, name)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            for bname, part in branch(batch, branches, default).items():
                part.write.mode("overwrite").parquet(
                    f"{path}/branch={bname}/{BATCH_COL}={batch_id}")
        finally:
            batch.unpersist()

    q = (stream.writeStream.foreachBatch(write_batch)
         .option("checkpointLocation", f"{base}/checkpoint")
         .trigger(availableNow=True).start())
    await_query(q, timeout_s)
    if not _exists(spark, path):
        return spark.createDataFrame([], stream.schema).withColumn("branch", None)
    return spark.read.option("basePath", path).parquet(path)
