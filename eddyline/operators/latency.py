"""Latency analytics: the benchmark consumer's computation as Spark aggregates.

``latency_ms = received − produced``; per bucket of arrival time the report
has n, lower nearest-rank p50/p95/p99 (element ``min(int(n·p), n−1)`` of the
sorted sample), mean, min and max.  Percentiles are exact and computed from
a histogram: latencies are integer milliseconds, so ``(bucket, latency) →
count`` is pre-aggregated map-side and its size is bounded by the range of
latency values, however many samples (or however skewed) a bucket has.  A
running count over the histogram then locates each rank.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eddyline.functions.durations import duration_us
from eddyline.functions.percentile import nearest_rank_index, percentile_name
from eddyline.schema import PERCENTILES


def with_latency(df: DataFrame, received: str = "received_at", produced: str = "produced_at",
                 out: str = "latency_ms") -> DataFrame:
    """Epoch-ms columns → latency; rows without ``produced`` are skipped."""
    return (df.filter(F.col(produced).isNotNull())
              .withColumn(out, (F.col(received) - F.col(produced)).cast("long")))


def bucket_of(ms_col: str, width: str) -> F.Column:
    w_ms = duration_us(width) // 1000
    return F.floor(F.col(ms_col) / F.lit(w_ms)).cast("long")


def latency_histogram(df: DataFrame, bucket: str = "5 seconds", *,
                      received: str = "received_at", latency: str = "latency_ms",
                      group: Sequence[str] = ()) -> DataFrame:
    """``(group, bucket, latency) → count``, combined map-side before the shuffle."""
    b = df.select(*group, bucket_of(received, bucket).alias("bucket"),
                  F.col(latency).alias("_lat"))
    return b.groupBy(*group, "bucket", "_lat").agg(F.count(F.lit(1)).alias("_c"))


def report_from_histogram(hist: DataFrame, bucket: str, *, group: Sequence[str] = (),
                          percentiles: Sequence[float] = PERCENTILES) -> DataFrame:
    """Histogram (``bucket, _lat, _c``) → report rows; see :func:`latency_report`."""
    group = list(group)
    w_ms = duration_us(bucket) // 1000
    part = Window.partitionBy(*group, "bucket")
    ranked = hist.select("*",
                         F.sum("_c").over(part.orderBy("_lat").rowsBetween(
                             Window.unboundedPreceding, 0)).alias("_cum"),
                         F.sum("_c").over(part).alias("_n"))
    picks = [F.min(F.when(F.col("_cum") > nearest_rank_index(F.col("_n"), p), F.col("_lat")))
             .alias(percentile_name(p)) for p in percentiles]
    rep = ranked.groupBy(*group, "bucket").agg(
        F.sum("_c").alias("n"), *picks,
        (F.sum(F.col("_lat") * F.col("_c")) / F.sum("_c")).alias("mean"),
        F.min("_lat").alias("min"), F.max("_lat").alias("max"))
    if group:
        last = F.max("bucket").over(Window.partitionBy(*group))
    else:  # one run: the last bucket as a scalar subquery, not a one-task window
        last = hist.agg(F.max("bucket")).scalar()
    rep = rep.withColumn("is_partial", F.col("bucket") == last)
    return rep.select(*group, F.timestamp_millis(F.col("bucket") * F.lit(w_ms))
                      .cast("timestamp_ntz").alias("bucket_start"),
                      *[c for c in rep.columns if c not in (*group, "bucket")])


def latency_report(df: DataFrame, bucket: str = "5 seconds", *, received: str = "received_at",
                   latency: str = "latency_ms", group: Sequence[str] = (),
                   percentiles: Sequence[float] = PERCENTILES) -> DataFrame:
    """One row per (group, bucket): ``bucket_start, n, p50, p95, p99, mean,
    min, max, is_partial`` (the last bucket of a group is the trailing partial one)."""
    hist = latency_histogram(df, bucket, received=received, latency=latency, group=group)
    return report_from_histogram(hist, bucket, group=group, percentiles=percentiles)


def latency_buckets(df: DataFrame, bucket: str = "5 seconds", *,
                    received: str = "received_at", latency: str = "latency_ms") -> DataFrame:
    """Report over *every* bucket from the first to the last; empty ones are
    marked (``n = 0``, ``is_empty``) like the consumer's "No data" line."""
    spark = df.sparkSession
    w_ms = duration_us(bucket) // 1000
    rep = latency_report(df, bucket, received=received, latency=latency)
    lo_hi = df.agg(F.min(bucket_of(received, bucket)).alias("lo"),
                   F.max(bucket_of(received, bucket)).alias("hi")).first()
    if lo_hi["lo"] is None:
        return rep.withColumn("is_empty", F.lit(False))
    # the bucket range is generated distributed, not exploded in one task
    all_b = spark.range(lo_hi["lo"], lo_hi["hi"] + 1).select(
        F.timestamp_millis(F.col("id") * F.lit(w_ms)).cast("timestamp_ntz").alias("bucket_start"))
    out = all_b.join(rep, "bucket_start", "left")
    return out.select("bucket_start", F.coalesce("n", F.lit(0)).cast("long").alias("n"),
                      *[c for c in rep.columns if c not in ("bucket_start", "n")],
                      F.col("n").isNull().alias("is_empty"))


def latency_summary(report: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Run summary per group: events, buckets with data, median of the bucket
    p99s.  The median is an order statistic of the counts by p99 value, whose
    number is bounded by the latency range; the p99s themselves are rows
    (:func:`p99_rows`)."""
    group = list(group)
    by_value = report.groupBy(*group, "p99").agg(F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_c"))
    part = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    ranked = by_value.select("*", F.sum("_c").over(part.orderBy("p99").rowsBetween(
        Window.unboundedPreceding, 0)).alias("_cum"), F.sum("_c").over(part).alias("_all"))
    low = F.min(F.when(2 * F.col("_cum") >= F.col("_all"), F.col("p99")))
    high = F.min(F.when(2 * F.col("_cum") >= F.col("_all") + 1, F.col("p99")))
    return ranked.groupBy(*group).agg(F.sum("_n").alias("events"), F.sum("_c").alias("buckets"),
                                      ((low + high) / 2).alias("median_p99"))


def p99_rows(report: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """``group, bucket_start, p99`` of every bucket with data, in bucket order."""
    return report.select(*group, "bucket_start", "p99").orderBy(*group, "bucket_start")


def p99_list(report: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """``group, p99_list``: the p99s of every bucket with data, in bucket
    order, comma-joined.  A number a bucket, so a run's text grows with its
    time span, not with its events."""
    return report.groupBy(*group).agg(F.expr(
        "listagg(CAST(p99 AS STRING), ',') WITHIN GROUP (ORDER BY bucket_start)").alias("p99_list"))


# ── mergeable quantile sketches ────────────────────────────────────────────
SKETCH_K = 400               # rank error about 0.7 % of n, in 99 of 100 sketches
RANK_ERROR = 0.02            # what the checks allow
SKETCH_QUANTILES = ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))


def latency_sketches(df: DataFrame, group: Sequence[str], latency: str = "latency_ms", k: int = SKETCH_K) -> DataFrame:
    """``group, n, sketch``: a KLL sketch of the latencies of each group, built
    with a partial step.  A stored sketch of a few kilobytes stands for its
    run, and sketches of several runs merge (:func:`merge_sketches`)."""
    return df.groupBy(*group).agg(F.count(latency).alias("n"), F.kll_sketch_agg_bigint(latency, k).alias("sketch"))


def merge_sketches(sketches: DataFrame, group: Sequence[str], k: int = SKETCH_K) -> DataFrame:
    """Sketches of finer groups → one of each ``group``."""
    return sketches.groupBy(*group).agg(F.sum("n").alias("n"), F.kll_merge_agg_bigint("sketch", k).alias("sketch"))


def window_sketches(df: DataFrame, bucket: str, *, received_ts: str = "received_ts",
                    latency: str = "latency_ms", k: int = SKETCH_K) -> DataFrame:
    """Sketches by arrival bucket (``bucket_start, n, sketch``); on a stream
    they are the state of an Update-mode aggregation."""
    got = latency_sketches(df.withColumn("w", F.window(received_ts, bucket)), ["w"], latency, k)
    return got.select(F.col("w.start").cast("timestamp_ntz").alias("bucket_start"), "n", "sketch")


def sketch_quantiles(sketches: DataFrame) -> DataFrame:
    """``p50``, ``p95`` and ``p99`` of each sketch, beside its other columns."""
    return sketches.withColumns({name: F.kll_sketch_get_quantile_bigint("sketch", F.lit(q))
                                 for q, name in SKETCH_QUANTILES}).drop("sketch")


def checked_quantiles(sketches: DataFrame, exact: DataFrame, group: Sequence[str],
                      error: float = RANK_ERROR) -> DataFrame:
    """Quantiles of each sketch and, as ``p50_ok`` …, whether the asked rank
    lies within ``error`` of the value's exact ranks among ``exact(group,
    _lat)`` (one sample of slack in small groups)."""
    group = list(group)
    got = sketch_quantiles(sketches)
    hist = exact.groupBy(*group, "_lat").agg(F.count(F.lit(1)).alias("_c"))
    below = [F.sum(F.when(F.col("_lat") < F.col(name), F.col("_c")).otherwise(0)).alias(f"_b{name}")
             for _, name in SKETCH_QUANTILES]
    upto = [F.sum(F.when(F.col("_lat") <= F.col(name), F.col("_c")).otherwise(0)).alias(f"_u{name}")
            for _, name in SKETCH_QUANTILES]
    names = [name for _, name in SKETCH_QUANTILES]
    ranks = hist.join(got.select(*group, *names), group).groupBy(*group).agg(
        F.sum("_c").alias("_n"), *below, *upto)
    out = got.join(ranks, group)
    for q, name in SKETCH_QUANTILES:
        slack = F.greatest(F.lit(error) * F.col("_n"), F.lit(1.0))
        out = out.withColumn(f"{name}_ok", (F.col(f"_b{name}") - slack <= F.lit(q) * F.col("_n"))
                             & (F.col(f"_u{name}") + slack >= F.lit(q) * F.col("_n")) & (F.col("n") == F.col("_n")))
    return out.select(*group, "n", *names, *[f"{name}_ok" for name in names])


def approx_latency(df: DataFrame, bucket: str, *, received_ts: str = "received_ts",
                   latency: str = "latency_ms", accuracy: int = 10000) -> DataFrame:
    """Streaming-friendly approximate percentiles (works in Update mode)."""
    return df.groupBy(F.window(received_ts, bucket).alias("w")).agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile_approx(latency, [0.5, 0.95, 0.99], accuracy).alias("pcts")).select(
        F.col("w.start").cast("timestamp_ntz").alias("bucket_start"), "n",
        F.col("pcts")[0].alias("p50"), F.col("pcts")[1].alias("p95"),
        F.col("pcts")[2].alias("p99"))
