"""``read_events``: one entry point for Kafka, files, rate and tables.

Batch (``stream=False``) and stream reads return the same columns, so every
operator runs unchanged on both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eddyline.config import PipelineConfig


def read_kafka(spark: SparkSession, cfg: PipelineConfig, *, stream: bool = True,
               topic: str | None = None, options: dict | None = None) -> DataFrame:
    """Kafka source (needs the spark-sql-kafka package on the class path)."""
    reader = spark.readStream if stream else spark.read
    r = (reader.format("kafka")
         .option("kafka.bootstrap.servers", cfg.bootstrap_servers)
         .option("subscribe", topic or cfg.input_topic))
    if stream:
        r = r.option("startingOffsets", cfg.starting_offsets)
        if cfg.max_offsets_per_trigger:
            r = r.option("maxOffsetsPerTrigger", str(cfg.max_offsets_per_trigger))
    if cfg.group_id:
        r = r.option("kafka.group.id", cfg.group_id)
    for k, v in (options or {}).items():
        r = r.option(k, v)
    return r.load()


def read_events(spark: SparkSession, source: str, path: str | None = None, *,
                stream: bool = False, schema=None, cfg: PipelineConfig | None = None,
                options: dict | None = None) -> DataFrame:
    """Open an event source.

    ``source`` is ``kafka`` | ``parquet`` | ``json`` | ``text`` | ``rate`` |
    ``table``.  File sources need a ``schema`` when streaming (never inferred);
    ``maxFilesPerTrigger`` etc. pass through ``options``.
    """
    options = dict(options or {})
    if source == "kafka":
        return read_kafka(spark, cfg or PipelineConfig.from_env(), stream=stream, options=options)
    if source == "rate":
        if not stream:
            raise ValueError("the rate source is streaming only")
        r = spark.readStream.format("rate")
        for k, v in options.items():
            r = r.option(k, v)
        return r.load()
    if source == "table":
        return spark.readStream.table(path) if stream else spark.read.table(path)
    if source not in ("parquet", "json", "text"):
        raise ValueError(f"unknown source {source!r}")
    reader = spark.readStream if stream else spark.read
    if schema is not None:
        reader = reader.schema(schema)
    elif stream and source != "text":
        raise ValueError("streaming file sources need an explicit schema")
    for k, v in options.items():
        reader = reader.option(k, v)
    return getattr(reader, source)(path)
