"""User-defined function surfaces (the slow path, used where asked for).

* :class:`Accumulator` — a custom aggregate with a partial step (``add`` before
  the shuffle, ``merge`` after it), by group or by sliding window.
* :func:`avg_accumulator` — a custom aggregate as a grouped-aggregate pandas
  UDF: create/add/merge/result of an average whose empty result is 0.0;
  :func:`sliding_average_blocks` aggregates many windows in one such call.
* :func:`value_band` — a vectorised scalar pandas UDF usable in streams.
* :func:`render_window_groups` — a window "process function": all rows of
  one ``(key, window)`` group handed to pandas at once.

Built-in expressions cover the same results faster; these exist for users
porting per-record or per-window code.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructType

from eddyline.functions.durations import duration_us


@F.pandas_udf(DoubleType())
def avg_accumulator(values: pd.Series) -> float:
    """Average of the group; 0.0 for an empty group (accumulator result)."""
    v = values.dropna()
    return float(v.sum() / len(v)) if len(v) else 0.0


@F.pandas_udf(LongType())
def value_band(values: pd.Series) -> pd.Series:
    """Lower bound of the 100-wide band a value falls in."""
    return (values // 100 * 100).astype("Int64")


@F.pandas_udf(LongType())
def count_rows(values: pd.Series) -> int:
    """Row count of the group (companion of :func:`avg_accumulator`: pandas
    aggregates cannot be mixed with built-in ones in one ``agg``)."""
    return len(values)


BLOCK_ROWS = 20_000          # rows that one call of a block aggregate gets, about
BLOCK_SPAN_US = 3_600_000_000


def sliding_average_blocks(df: DataFrame, keys: Sequence[str], value: str, duration: str, slide: str,
                           time_col: str = "event_time", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """:func:`avg_accumulator` and :func:`count_rows` over sliding windows as
    one grouped-aggregate pandas UDF whose group is a block of whole
    ``(keys, window)`` groups: a call aggregates thousands of windows instead
    of one.  A block holds the windows of some keys that start in the same
    hours; a row goes once to each block with a window of its, which is hardly
    ever more than one.  ``keys, window_start, window_end, avg_value,
    event_count``; ``duration`` must be a multiple of ``slide``."""
    keys = list(keys)
    size_us, slide_us = duration_us(duration), duration_us(slide)
    if size_us % slide_us:
        raise ValueError("the window must be a multiple of the slide")
    k, span = size_us // slide_us, max(BLOCK_SPAN_US, size_us) // slide_us      # in panes
    rows = df.filter(F.col(time_col).isNotNull()).select(
        *keys, F.col(value).cast("double").alias("_v"),
        F.floor(F.unix_micros(time_col) / F.lit(slide_us)).cast("long").alias("_pane"))
    spans = F.array_distinct(F.array(*[F.floor((F.col("_pane") - F.lit(b)) / F.lit(span)).cast("long") for b in (0, k - 1)]))
    n_blocks = max(1, rows.count() // block_rows)
    blocks = rows.withColumn("_span", F.explode(spans)).withColumn("_block", F.pmod(F.xxhash64(*keys, "_span"), F.lit(n_blocks)))
    kinds = ", ".join(f"{c}: {df.schema[c].dataType.simpleString()}" for c in keys)

    @F.pandas_udf(f"array<struct<{kinds}, pane: bigint, avg_value: double, event_count: bigint>>")
    def averages(pane: pd.Series, of: pd.Series, values: pd.Series, *key: pd.Series) -> list:
        codes = pd.MultiIndex.from_arrays([pd.factorize(c, use_na_sentinel=False)[0] for c in key])
        who = pd.factorize(codes)[0]
        first = pd.Series(range(len(who))).groupby(who).first()
        one = pd.DataFrame({"who": who, "span": of.to_numpy(), "pane": pane.to_numpy(), "v": values.to_numpy()})
        panes = one.groupby(["who", "span", "pane"], sort=False)["v"].agg(["sum", "count", "size"]).reset_index()
        copies = pd.concat([panes.assign(pane=panes["pane"] - b) for b in range(k)], ignore_index=True)
        copies = copies[copies["pane"] // span == copies["span"]]
        g = copies.groupby(["who", "pane"], sort=False)[["sum", "count", "size"]].sum().reset_index()
        avg = (g["sum"] / g["count"].where(g["count"] > 0)).fillna(0.0)        # 0.0 for a group without values
        at = first.loc[g["who"]].to_numpy()
        held = [c.astype(object).where(c.notna(), None).to_numpy()[at] for c in key]
        names = [*keys, "pane", "avg_value", "event_count"]
        return [dict(zip(names, r)) for r in zip(*held, g["pane"].tolist(), avg.tolist(), g["size"].astype("int64").tolist())]

    out = blocks.groupBy("_block").agg(averages("_pane", "_span", "_v", *keys).alias("_w")).select(F.explode("_w").alias("_w"))
    start = F.timestamp_micros(F.col("_w.pane") * F.lit(slide_us))
    ntz = [start.cast("timestamp_ntz").alias("window_start"),
           (start.cast("timestamp_ntz") + F.expr(f"INTERVAL {size_us} MICROSECONDS")).alias("window_end")]
    return out.select(*[F.col(f"_w.{c}").alias(c) for c in keys], *ntz, F.col("_w.avg_value").alias("avg_value"),
                      F.col("_w.event_count").alias("event_count"))


def _render_frame(pdf: pd.DataFrame) -> pd.DataFrame:
    """Vectorised: one line per (key, window) group of a sorted frame."""
    g = pdf.groupby(["key", "ws", "we"], sort=False, dropna=False)["value"].mean().fillna(0.0)
    g = g.reset_index()
    fmt = "%Y-%m-%dT%H:%M:%SZ"
    key = g["key"].astype(object).where(g["key"].notna(), "null").astype(str)  # as %s of null
    lines = ("key=" + key + "  window=[" + g["ws"].dt.strftime(fmt) + " .. "
             + g["we"].dt.strftime(fmt) + ")  avg_value=" + g["value"].map("{:.4f}".format))
    return pd.DataFrame({"line": lines})


def render_window_groups(df: DataFrame, duration: str, slide: str | None = None,
                         time_col: str = "event_time") -> DataFrame:
    """Window process function: rows clustered by ``(key, window)``, each
    partition sorted, then rendered group by group in pandas.

    ``mapInPandas`` sees Arrow batches of a sorted partition; a group cut by
    a batch boundary is carried into the next batch, so every group is
    rendered once and whole, while groups are processed vectorised.
    """
    w = F.window(time_col, duration, slide) if slide else F.window(time_col, duration)
    g = df.select("key", "value", w.alias("w")).select(
        "key", "value", F.col("w.start").cast("timestamp_ntz").alias("ws"),
        F.col("w.end").cast("timestamp_ntz").alias("we"))
    clustered = g.repartition("key", "ws").sortWithinPartitions("key", "ws")

    def render(batches):
        carry = None
        for pdf in batches:
            if carry is not None:
                pdf = pd.concat([carry, pdf], ignore_index=True)
            if pdf.empty:
                continue
            k, ws = pdf["key"].iloc[-1], pdf["ws"].iloc[-1]
            tail = ((pdf["key"] == k) | (pdf["key"].isna() & pd.isna(k))) & (pdf["ws"] == ws)
            carry, done = pdf[tail], pdf[~tail]
            if len(done):
                yield _render_frame(done)
        if carry is not None and len(carry):
            yield _render_frame(carry)

    return clustered.mapInPandas(render, "line string")


class Accumulator:
    """A user aggregate over pandas frames, with a partial step.

    ``state`` names the partial's columns and their types.  ``add`` folds rows
    into one partial a group, ``merge`` folds partials of equal groups into
    one (both frames have the group columns and the state columns), ``result``
    gives the final value of each partial.
    """

    state: dict[str, str] = {}

    def add(self, rows: pd.DataFrame, keys: list[str], value: str) -> pd.DataFrame:
        raise NotImplementedError

    def merge(self, partials: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
        raise NotImplementedError

    def result(self, partials: pd.DataFrame) -> pd.Series:
        raise NotImplementedError


class AverageAccumulator(Accumulator):
    """Average; nulls are skipped, as the built-in ``avg`` does, and a group
    without values gives 0.0."""

    state = {"_sum": "double", "_cnt": "long", "_rows": "long"}

    def add(self, rows, keys, value):
        g = rows.groupby(keys, sort=False, dropna=False)[value]
        return pd.DataFrame({"_sum": g.sum(), "_cnt": g.count(), "_rows": g.size()}).reset_index()

    def merge(self, partials, keys):
        return partials.groupby(keys, sort=False, dropna=False)[list(self.state)].sum().reset_index()

    def result(self, partials):
        avg = partials["_sum"] / partials["_cnt"].where(partials["_cnt"] > 0)
        return avg.fillna(0.0).astype("float64")


FLUSH_GROUPS = 100_000       # partials that a task holds before it sends them


def _arrow_ready(part: pd.DataFrame, keys: list[str], columns: list[str]) -> pd.DataFrame:
    out = part[columns].copy()
    for k in keys:
        out[k] = part[k].astype(object).where(part[k].notna(), None)
    return out


def partial_groups(df: DataFrame, keys: Sequence[str], value: str, acc: Accumulator) -> DataFrame:
    """``keys`` and the state columns: partials of each task's rows, before
    any shuffle.  A task merges its batches' partials and sends them when
    ``FLUSH_GROUPS`` groups have gathered, so a group that holds a third of
    the rows leaves each task as a few rows."""
    keys = list(keys)
    src = df.select(*keys, value)
    columns = [*keys, *acc.state]
    schema = StructType([*[src.schema[k] for k in keys],
                         *StructType.fromDDL(", ".join(f"{c} {t}" for c, t in acc.state.items())).fields])

    def run(batches):
        held = None
        for pdf in batches:
            if pdf.empty:
                continue
            part = acc.add(pdf, keys, value)
            held = part if held is None else acc.merge(pd.concat([held, part], ignore_index=True), keys)
            if len(held) >= FLUSH_GROUPS:
                yield _arrow_ready(held, keys, columns)
                held = None
        if held is not None:
            yield _arrow_ready(held, keys, columns)

    return src.mapInPandas(run, schema)


def merge_groups(partials: DataFrame, keys: Sequence[str], acc: Accumulator) -> DataFrame:
    """Partials (:func:`partial_groups`) → one row a group: ``keys`` and the
    state columns.  Partials are clustered on the keys and sorted; a group that
    goes on in the next Arrow batch is carried over."""
    keys = list(keys)
    columns = [*keys, *acc.state]
    clustered = partials.select(*columns).repartition(*keys).sortWithinPartitions(*keys)

    def run(batches):
        carry = None
        for pdf in batches:
            if pdf.empty:
                continue
            merged = acc.merge(pdf if carry is None else pd.concat([carry, pdf], ignore_index=True), keys)
            carry, done = merged.iloc[[-1]], merged.iloc[:-1]
            if len(done):
                yield _arrow_ready(done, keys, columns)
        if carry is not None:
            yield _arrow_ready(carry, keys, columns)

    return clustered.mapInPandas(run, clustered.schema)


def _results(merged: DataFrame, keys: list[str], out_schema: str, acc: Accumulator) -> DataFrame:
    def run(batches):
        for pdf in batches:
            out = _arrow_ready(pdf, keys, keys)
            out["result"] = acc.result(pdf).values
            out["rows"] = pdf["_rows"].astype("int64").values
            yield out

    return merged.mapInPandas(run, out_schema)


def accumulate_by_group(df: DataFrame, keys, value: str, out_schema: str,
                        acc: Accumulator | None = None) -> DataFrame:
    """Run an accumulator by group: ``add`` before the shuffle, ``merge`` after
    it.  Output columns: the keys, ``result``, ``rows`` (the accumulator keeps
    the row count as ``_rows``)."""
    keys, acc = list(keys), acc or AverageAccumulator()
    return _results(merge_groups(partial_groups(df, keys, value, acc), keys, acc), keys, out_schema, acc)


def accumulate_sliding(df: DataFrame, keys, value: str, duration: str, slide: str,
                       acc: Accumulator | None = None, time_col: str = "event_time") -> DataFrame:
    """Run an accumulator over sliding windows: rows are added once, into
    panes as wide as the slide; each pane's partial is copied into the windows
    that hold it and merged there.  ``keys, window_start, window_end, result,
    rows``; ``duration`` must be a multiple of ``slide``."""
    keys, acc = list(keys), acc or AverageAccumulator()
    size_us, slide_us = duration_us(duration), duration_us(slide)
    if size_us % slide_us:
        raise ValueError("the window must be a multiple of the slide")
    panes = df.select(*keys, value, F.window(time_col, slide).start.alias("_pane"))
    merged = merge_groups(partial_groups(panes, [*keys, "_pane"], value, acc), [*keys, "_pane"], acc)
    back = F.explode(F.sequence(F.lit(0), F.lit(size_us // slide_us - 1))).alias("_back")
    copied = merged.select("*", back).withColumn(
        "window_start", F.timestamp_micros(F.unix_micros("_pane") - F.col("_back").cast("long") * F.lit(slide_us)).cast("timestamp_ntz"))
    out_keys = [*keys, "window_start"]
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    out = _results(merge_groups(copied, out_keys, acc), out_keys,
                   f"{kinds}, window_start timestamp_ntz, result double, rows long", acc)
    return out.select(*out_keys, (F.col("window_start") + F.expr(f"INTERVAL {size_us} MICROSECONDS")).alias("window_end"),
                      "result", "rows")
