"""Run a streaming DataFrame to completion and read its result back.

``drain`` starts the query with ``availableNow`` (process what is there,
then stop), waits with a time limit, re-raises the query's failure and
returns the sink contents as a batch DataFrame.  Results go to Parquet in
the shared checkpoint folder — never to the memory sink, which collects to
the driver.

* ``append``: Parquet file sink (exactly-once via its commit log).
* ``update`` / ``complete``: :func:`eddyline.streaming.sinks.upsert_sink`
  (a folder per batch, merged in levels); update results are collapsed to the
  last version of each key, complete results are the last batch.
"""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from eddyline.session import scratch_dir
from eddyline.streaming.sinks import BATCH_COL, read_upserts, upsert_sink


class StreamFailed(RuntimeError):
    pass


def start_available_now(sdf: DataFrame, *, output_mode: str, path: str, checkpoint: str,
                        name: str, batch_sink: bool, keys: Sequence[str] | None = None):
    if batch_sink:
        writer = sdf.writeStream.foreachBatch(upsert_sink(path, keys=keys, complete=output_mode == "complete"))
    else:
        writer = sdf.writeStream.format("parquet").option("path", path)
    return (writer.outputMode(output_mode).option("checkpointLocation", checkpoint)
            .queryName(f"{name}_{checkpoint.rsplit('-', 1)[-1]}")
            .trigger(availableNow=True).start())


def await_query(q, timeout_s: float | None = None) -> None:
    """Wait for the end of ``q``; without a limit unless one is given."""
    done = q.awaitTermination(timeout_s) if timeout_s else (q.awaitTermination() or True)
    if not done:
        q.stop()
        raise TimeoutError(f"stream {q.name} did not finish within {timeout_s}s")
    exc = q.exception()
    if exc is not None:
        raise StreamFailed(str(exc))


def default_state_partitions(spark) -> int:
    """State partitions for a new checkpoint: the session's shuffle width.  The
    checkpoint keeps it for good, so it follows the configured width, not the
    number of executors that happen to be up."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


@contextmanager
def shuffle_width(spark, n: int | None):
    """Temporarily set ``spark.sql.shuffle.partitions`` (fixed into a stream's
    checkpoint when the query first starts)."""
    if n is None:
        yield
        return
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def drain(sdf: DataFrame, *, output_mode: str = "append", name: str = "drain",
          keys: Sequence[str] | None = None, timeout_s: float | None = None,
          path: str | None = None, checkpoint: str | None = None,
          state_partitions: int | None = None) -> DataFrame:
    """Drain ``sdf`` and return its output as a batch DataFrame.

    For ``update`` pass ``keys`` to collapse to the final row of each key.
    ``path``/``checkpoint`` may be reused to resume a stopped query (the
    state width recorded in the checkpoint then wins).
    """
    if not sdf.isStreaming:
        raise ValueError("drain expects a streaming DataFrame")
    spark = sdf.sparkSession
    base = scratch_dir(spark, name) if path is None or checkpoint is None else None
    path = path or f"{base}/out"
    checkpoint = checkpoint or f"{base}/checkpoint"
    batch_sink = output_mode in ("update", "complete")
    width = state_partitions or default_state_partitions(spark)
    with shuffle_width(spark, width):
        q = start_available_now(sdf, output_mode=output_mode, path=path,
                                checkpoint=checkpoint, name=name, batch_sink=batch_sink, keys=keys)
        await_query(q, timeout_s)
    return read_result(spark, sdf.schema, path, output_mode, keys)


def read_result(spark, schema: StructType, path: str, output_mode: str,
                keys: Sequence[str] | None = None) -> DataFrame:
    if output_mode == "append":
        return spark.read.schema(schema).parquet(path)
    with_batch = StructType(schema.fields + [StructField(BATCH_COL, LongType())])
    rows = read_upserts(spark, path, with_batch)
    if output_mode == "complete":                       # the last batch is the only live one
        return rows.drop(BATCH_COL)
    if keys is None:
        return rows
    from eddyline.operators.dedup import latest_per_key
    return latest_per_key(rows, keys, [BATCH_COL]).drop(BATCH_COL)


def drain_until_consumed(sdf: DataFrame, rows: int, settled=None, *, output_mode: str = "update",
                         name: str = "drain-pt", keys: Sequence[str] | None = None,
                         interval: str = "1 second", timeout_s: float | None = None) -> DataFrame:
    """Drain a processing-time query (timers and TTL keep it alive, so
    ``availableNow`` never ends): run on a processing-time trigger until the
    batches have read ``rows`` source rows and ``settled(result so far)``, if
    given, is true, then stop at once: where a trigger takes longer than
    ``interval``, the next one starts right after it, and a pause between two
    never comes.  No limit on time unless one is given."""
    spark = sdf.sparkSession
    base = scratch_dir(spark, name)
    path, checkpoint = f"{base}/out", f"{base}/checkpoint"
    batch_sink = output_mode in ("update", "complete")
    writer = (sdf.writeStream.foreachBatch(upsert_sink(path, keys=keys, complete=output_mode == "complete"))
              if batch_sink else sdf.writeStream.format("parquet").option("path", path))
    with shuffle_width(spark, default_state_partitions(spark)):
        q = (writer.outputMode(output_mode).option("checkpointLocation", checkpoint)
             .queryName(f"{name}_{base.rsplit('-', 1)[-1]}")
             .trigger(processingTime=interval).start())
        _wait_done(q, rows, (lambda: settled(read_result(spark, sdf.schema, path, output_mode, keys)))
                   if settled else (lambda: True), name, timeout_s)
    return read_result(spark, sdf.schema, path, output_mode, keys)


def _wait_done(q, rows: int, settled, name: str, timeout_s: float | None) -> None:
    import time
    deadline = time.time() + timeout_s if timeout_s else None
    read: dict = {}                                      # source rows by batch
    checked = -1
    try:
        while True:
            if q.exception() is not None:
                raise StreamFailed(str(q.exception()))
            for p in q.recentProgress:
                read[p["batchId"]] = max(read.get(p["batchId"], 0), p["numInputRows"])
            newest = max(read, default=-1)
            if newest != checked and sum(read.values()) >= rows:
                checked = newest
                if settled():
                    return          # a batch still under way has no rows and is not committed
            if deadline and time.time() > deadline:
                raise TimeoutError(f"{name}: not done after {timeout_s}s")
            time.sleep(0.2)
    finally:
        q.stop()
