"""Record → output payloads: JSON, Kafka rows, rendered text lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eddyline.schema import EVENT_COLUMNS


def to_json_payload(cols: list[str] | None = None) -> Column:
    """JSON text of a struct of ``cols``; null fields are omitted."""
    return F.to_json(F.struct(*[F.col(c) for c in (cols or EVENT_COLUMNS)]))


def to_kafka_rows(df: DataFrame, key_col: str | None = "event_id",
                  value_cols: list[str] | None = None) -> DataFrame:
    """Project to the Kafka sink shape: ``key`` (string, or none), ``value`` JSON.

    By default the value carries the record fields present in ``df`` plus
    ``processed_at`` when it exists.
    """
    if value_cols is None:
        value_cols = [c for c in EVENT_COLUMNS + ["processed_at"] if c in df.columns]
    cols = [to_json_payload(value_cols).alias("value")]
    if key_col:
        cols.insert(0, F.col(key_col).cast("string").alias("key"))
    return df.select(*cols)


def with_processed_at(df: DataFrame, col: str = "processed_at") -> DataFrame:
    """Processing timestamp: one value per micro-batch (non-deterministic)."""
    return df.withColumn(col, F.current_timestamp())


def _ts_text(c: str) -> Column:
    """ISO instant in UTC; milliseconds only if there are any."""
    t = F.col(c)
    return F.when(F.date_format(t, "SSS") == "000", F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(
        F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))


def render_window_line(df: DataFrame, value_col: str = "avg_value", digits: int = 4,
                       out: str = "line") -> DataFrame:
    """``key=K  window=[start .. end)  avg_value=X.XXXX`` (bounds as UTC instants)."""
    fmt = f"key=%s  window=[%s .. %s)  {value_col}=%.{digits}f"
    return df.select(F.format_string(fmt, F.col("key"), _ts_text("window_start"),
                                     _ts_text("window_end"),
                                     F.col(value_col).cast("double")).alias(out))


def render_count_line(df: DataFrame, count_col: str = "running_count",
                      out: str = "line") -> DataFrame:
    return df.select(F.format_string("key=%s  count=%d", F.col("key"),
                                     F.col(count_col)).alias(out))
