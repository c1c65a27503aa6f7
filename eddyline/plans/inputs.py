"""Inputs of the registered queries, all derived from the driver's tables.

``decoded_events`` is the reference's pipeline front, used by the four
pattern queries: event records are serialised to JSON messages (what a
producer sends), then cast and parsed with the fixed schema, exactly as from
Kafka.  ``typed_events`` reads the same records from the typed columns, so
the other batch queries get Parquet filter pushdown and column pruning.  ``event_stream`` replays the
same messages as a file stream of ``n_files`` time-ordered micro-batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from eddyline.functions.decode import (  # noqa: F401 - re-exported for the catalog
    cast_message, decode_events, decode_with_key, flexible_event_time, with_event_time_col,
)
from eddyline.schema import KAFKA_SOURCE_SCHEMA
from eddyline.sources.files import file_stream, stage_stream_files
from eddyline.sources.tables import (  # noqa: F401
    driver_events, epoch_millis, load_table, orders_as_events, to_messages,
)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return driver_events(load_table(spark, sf_dir, "events"))


def typed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event records read straight from the table's typed columns, with
    ``event_time``: filters and column pruning reach the Parquet scan.  Same
    values as :func:`decoded_events`, without the JSON round trip."""
    return with_event_time_col(events(spark, sf_dir))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_messages(events(spark, sf_dir))


def decode_front(msgs: DataFrame, *, defaults: bool = False) -> DataFrame:
    """Kafka-shaped rows → typed records with ``event_time``."""
    return with_event_time_col(decode_events(cast_message(msgs), defaults=defaults))


def decoded_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode_front(messages(spark, sf_dir))


def message_stream(spark: SparkSession, sf_dir: str, n_files: int = 3,
                   msgs: DataFrame | None = None, name: str = "messages") -> DataFrame:
    """Messages staged as ``n_files`` ascending-time ranges, read as a stream
    of about that many micro-batches."""
    msgs = msgs if msgs is not None else messages(spark, sf_dir)
    path, per_batch = stage_stream_files(msgs, n_files, "offset", name=name)
    return file_stream(spark, path, KAFKA_SOURCE_SCHEMA, max_files_per_trigger=per_batch)


def event_stream(spark: SparkSession, sf_dir: str, n_files: int = 3) -> DataFrame:
    return decode_front(message_stream(spark, sf_dir, n_files))


def two_part_stream(spark: SparkSession, sf_dir: str, share: float) -> DataFrame:
    """Messages of the first ``share`` of the time span as the first batch,
    and the rest (rows without a time too) after it."""
    from eddyline.session import scratch_dir
    msgs = messages(spark, sf_dir)
    lo, hi = msgs.agg(F.min("offset"), F.max("offset")).first()
    path = scratch_dir(spark, "two-part")
    cut = lo + int((hi - lo) * share) if lo is not None else 0
    first = msgs.filter(F.col("offset") <= cut)
    first.write.parquet(path)
    n_first = max(1, len(spark.read.schema(msgs.schema).parquet(path).inputFiles()))
    msgs.filter((F.col("offset") > cut) | F.col("offset").isNull()).write.mode("append").parquet(path)
    return file_stream(spark, path, KAFKA_SOURCE_SCHEMA, max_files_per_trigger=n_first)


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_event_time_col(orders_as_events(load_table(spark, sf_dir, "orders")))


def arrival_order(df: DataFrame) -> DataFrame:
    """Deterministic out-of-order arrival: each event is delayed by 0–12
    positions (``seq = id + (id * 7919) % 13``), ties broken by id."""
    eid = F.col("event_id").cast("long")
    return df.withColumn("arrival_seq", eid + F.pmod(eid * F.lit(7919), F.lit(13)))


def noisy_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages where every ``error`` event's JSON lost its closing brace
    (malformed input for decode and dead-letter tests)."""
    m = messages(spark, sf_dir)
    text = F.col("value").cast("string")
    broken = F.when(F.get_json_object(text, "$.event_type") == "error",
                    F.expr("substr(CAST(value AS STRING), 1, length(CAST(value AS STRING)) - 1)"))
    return m.withColumn("value", F.coalesce(broken, text).cast("binary"))


JVM_SCHEMA = StructType([
    StructField("event_id", StringType()), StructField("event_type", StringType()),
    StructField("key", StringType()), StructField("value", DoubleType()),
    StructField("produced_at", StringType()),
])


def jvm_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JVM-form messages: ``value`` a double, ``produced_at`` ISO-8601 text;
    ``signup`` events carry no key and ``error`` events no value."""
    ev = load_table(spark, sf_dir, "events")
    key = F.when(F.col("event_type") != "signup",
                 F.concat(F.lit("user_"), F.col("user_id").cast("string")))
    value = F.when(F.col("event_type") != "error", F.col("value"))
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    payload = F.to_json(F.struct(F.col("event_id").cast("string").alias("event_id"),
                                 "event_type", key.alias("key"), value.alias("value"),
                                 iso.alias("produced_at")))
    ms = epoch_millis(ev, "ts")
    return ev.select(F.lit(None).cast("binary").alias("key"), payload.cast("binary").alias("value"),
                     F.timestamp_millis(ms).alias("timestamp"))


def jvm_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decode JVM-form messages with the JVM defaults and the ISO/epoch/ingest
    event-time rule."""
    m = jvm_messages(spark, sf_dir)
    ev = decode_events(m.select(F.col("value").cast("string").alias("json_str"), "timestamp"),
                       defaults=True, keep=["timestamp"], schema=JVM_SCHEMA)
    return ev.withColumn("event_time", flexible_event_time("produced_at", "timestamp"))
