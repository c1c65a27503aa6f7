"""Message decoding: bytes → JSON text → typed event record.

All parsing is ``from_json`` against a fixed schema (never inferred), so it
stays inside whole-stage codegen.  Permissive by default: unparseable text
gives an all-null record; ``strict=True`` drops such rows and
``keep_corrupt=True`` keeps the raw text for a dead-letter branch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eddyline.schema import (
    CORRUPT_COL, DEFAULT_KEY, DEFAULT_TYPE, DEFAULT_VALUE, EVENT_SCHEMA,
    event_schema_with_corrupt,
)


def cast_message(df: DataFrame, keep_key: bool = False) -> DataFrame:
    """Kafka row → ``json_str`` (and ``kafka_key`` when ``keep_key``)."""
    cols = [F.col("value").cast("string").alias("json_str")]
    if keep_key:
        cols.insert(0, F.col("key").cast("string").alias("kafka_key"))
    return df.select(*cols)


def decode_events(df: DataFrame, col: str = "json_str", *, defaults: bool = False,
                  strict: bool = False, keep_corrupt: bool = False,
                  keep: list[str] | None = None, schema=None) -> DataFrame:
    """Parse ``col`` into the event record and flatten it.

    ``defaults=True`` fills a missing key with ``unknown``, value with ``0.0``
    (as DOUBLE) and type with ``""``, as the JVM jobs do.  ``strict=True``
    drops records that are not JSON objects matching the schema.
    """
    want_corrupt = strict or keep_corrupt
    sch = schema or (event_schema_with_corrupt() if want_corrupt else EVENT_SCHEMA)
    opts = {"mode": "PERMISSIVE"}
    if want_corrupt:
        opts["columnNameOfCorruptRecord"] = CORRUPT_COL
    # ``inline(array(from_json(...)))`` parses each message exactly once: with
    # a plain projection, filters on parsed fields (``isnotnull(event_time)``
    # added by ``window``, type filters) are pushed below it and re-evaluate
    # ``from_json``; a generator output is not inlined into pushed filters.
    parsed = df.select(*(keep or []), F.col(col).alias("_raw"),
                       F.inline(F.array(F.from_json(F.col(col), sch, opts))))
    out = parsed
    if strict:
        out = out.filter(F.col("_raw").isNotNull() & F.col(CORRUPT_COL).isNull())
    if defaults:
        out = (out.withColumn("key", F.coalesce(F.col("key"), F.lit(DEFAULT_KEY)))
               .withColumn("value", F.coalesce(F.col("value").cast("double"),
                                               F.lit(DEFAULT_VALUE)))
               .withColumn("event_type", F.coalesce(F.col("event_type"), F.lit(DEFAULT_TYPE))))
    drop = ["_raw"] if not keep_corrupt else []
    if want_corrupt and not keep_corrupt:
        drop.append(CORRUPT_COL)
    return out.drop(*drop)


def decode_with_key(df: DataFrame) -> DataFrame:
    """Kafka row → ``kafka_key`` + the five record fields."""
    return decode_events(cast_message(df, keep_key=True), keep=["kafka_key"])


def event_time_col(produced_at: str | Column = "produced_at",
                   truncate_seconds: bool = False) -> Column:
    """Epoch-ms → TIMESTAMP.  ``truncate_seconds`` reproduces the reference's
    ``from_unixtime(ms/1000)`` precision without its zone dependence."""
    c = F.col(produced_at) if isinstance(produced_at, str) else produced_at
    if truncate_seconds:
        return F.timestamp_seconds(F.floor(c / F.lit(1000)))
    return F.timestamp_millis(c)


def flexible_event_time(raw: str | Column, ingest: str | Column) -> Column:
    """ISO-8601 instant, else epoch-ms number, else the ingestion timestamp."""
    r = F.col(raw) if isinstance(raw, str) else raw
    g = F.col(ingest) if isinstance(ingest, str) else ingest
    as_iso = F.try_to_timestamp(r)
    as_ms = F.when(r.rlike(r"^-?[0-9]+$"), F.timestamp_millis(r.try_cast("bigint")))
    return F.coalesce(as_iso, as_ms, g)


def with_event_time_col(df: DataFrame, produced_at: str = "produced_at",
                        out: str = "event_time", truncate_seconds: bool = False) -> DataFrame:
    return df.withColumn(out, event_time_col(produced_at, truncate_seconds))
