"""Schemas and fixed values of the event model."""

from __future__ import annotations

from pyspark.sql.types import (
    BinaryType, IntegerType, LongType, StringType, StructField, StructType,
    TimestampType,
)

# Fixed values (must equal the reference for equal results):
# event record fields and types; event types kept by the stateless pattern;
# watermark delay; tumbling window; sliding window (code and docs variants);
# JVM-side defaults for a missing key / value / type.
EVENT_SCHEMA = StructType([
    StructField("event_id", StringType()),
    StructField("event_type", StringType()),
    StructField("key", StringType()),
    StructField("value", IntegerType()),
    StructField("produced_at", LongType()),
])
PASSTHROUGH_TYPES = ("click", "purchase")
WATERMARK_DELAY = "10 seconds"
TUMBLING_WINDOW = "1 minute"
SLIDING_WINDOW, SLIDING_SLIDE = "5 minutes", "1 minute"
SLIDING_WINDOW_DOCS, SLIDING_SLIDE_DOCS = "2 minutes", "30 seconds"
DEFAULT_KEY, DEFAULT_VALUE, DEFAULT_TYPE = "unknown", 0.0, ""
PERCENTILES = (0.50, 0.95, 0.99)

CORRUPT_COL = "_corrupt_record"

# Kafka source row (public Spark Kafka source schema).
KAFKA_SOURCE_SCHEMA = StructType([
    StructField("key", BinaryType()),
    StructField("value", BinaryType()),
    StructField("topic", StringType()),
    StructField("partition", IntegerType()),
    StructField("offset", LongType()),
    StructField("timestamp", TimestampType()),
    StructField("timestampType", IntegerType()),
])

EVENT_COLUMNS = [f.name for f in EVENT_SCHEMA.fields]


def event_schema_with_corrupt() -> StructType:
    return StructType(EVENT_SCHEMA.fields + [StructField(CORRUPT_COL, StringType())])
