"""The driver's parquet tables, and their mapping onto the event record.

The event record has five fields (``event_id, event_type, key, value,
produced_at``).  The driver's ``events`` table maps onto it column by column;
every operator downstream sees only the record, whatever the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from eddyline.schema import EVENT_COLUMNS


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def epoch_millis(df: DataFrame, ts_col: str) -> Column:
    """Floor epoch milliseconds of a timestamp column, independent of session zone."""
    if isinstance(df.schema[ts_col].dataType, TimestampNTZType):
        us = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{ts_col}`)")
    else:
        us = F.unix_micros(F.col(ts_col))
    return F.floor(us / F.lit(1000)).cast("long")


def driver_events(df: DataFrame) -> DataFrame:
    """``events`` table → event record (``value`` truncated to INT)."""
    return df.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.col("event_type"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("key"),
        F.col("value").cast("int").alias("value"),
        epoch_millis(df, "ts").alias("produced_at"),
    )


def orders_as_events(df: DataFrame) -> DataFrame:
    """``orders`` table → event record: a second, independent event source."""
    return df.select(
        F.concat(F.lit("order_"), F.col("o_orderkey").cast("string")).alias("event_id"),
        F.lit("order").alias("event_type"),
        F.concat(F.lit("user_"), F.col("o_custkey").cast("string")).alias("key"),
        F.col("o_totalprice").cast("int").alias("value"),
        epoch_millis(df, "o_orderdate").alias("produced_at"),
    )


def to_messages(events: DataFrame, topic: str = "benchmark-input",
                partitions: int = 16, offset: Column | None = None) -> DataFrame:
    """Event records → rows shaped like the Kafka source (key/value bytes).

    ``value`` is the JSON text of the record, exactly what a producer sends;
    ``offset`` is the arrival order (``produced_at`` unless given).
    """
    payload = F.to_json(F.struct(*[F.col(c) for c in EVENT_COLUMNS]))
    return events.select(
        F.col("key").cast("binary").alias("key"),
        payload.cast("binary").alias("value"),
        F.lit(topic).alias("topic"),
        F.pmod(F.xxhash64("key"), F.lit(partitions)).cast("int").alias("partition"),
        (offset if offset is not None else F.col("produced_at")).cast("long").alias("offset"),
        F.timestamp_millis("produced_at").alias("timestamp"),
        F.lit(0).alias("timestampType"),
    )
