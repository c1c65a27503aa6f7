"""Stateful processors for ``transformWithStateInPandas``.

Each handler receives the rows of one key in one micro-batch as an
iterator of pandas frames (Arrow batches) and keeps its state in the
RocksDB state store.  Counts and folds do not depend on the order of rows.
Processors that do (last type, recent items, sessions, inactivity) keep event
times in their state, so rows may arrive in any order within the watermark:
last values compare times, sessions merge, and sessions and alerts leave only
once the watermark has passed them.  The per-record count and the funnel
number rows as they arrive (ordered within a batch), as a record-at-a-time
job does.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import (
    IntegerType, LongType, StringType, StructField, StructType, TimestampType,
)

from eddyline.operators.segments import transition_tables


def _key(key) -> object:
    return key[0] if isinstance(key, tuple) else key


def _sorted(rows: Iterator[pd.DataFrame], cols: Sequence[str]) -> pd.DataFrame:
    frames = [f[list(cols)] for f in rows]
    if not frames:
        return pd.DataFrame(columns=list(cols))
    pdf = pd.concat(frames, ignore_index=True)
    return pdf.sort_values(["event_time", "event_id"], kind="stable", ignore_index=True, na_position="first")


def _null_first(pair: tuple) -> tuple:
    """Sort key of ``(time, id)``: a null id comes before all others, as in SQL."""
    return pair[0], pair[1] is not None, pair[1] or ""


def _us(ts: pd.Series) -> pd.Series:
    return pd.to_datetime(ts, utc=True).astype("datetime64[us, UTC]").astype("int64")


def _ms(ts: pd.Series) -> pd.Series:
    return _us(ts) // 1000


def _instants(ms) -> pd.Series:
    return pd.to_datetime(pd.Series(ms, dtype="int64"), unit="ms", utc=True)


# ── ST1 / ST3 / ST5: one folded value per key ─────────────────────────────
class KeyFold(StatefulProcessor):
    """A value per key: ``merge(state or None, frame) -> state`` over a
    batch's frames; the state's fields named in ``show`` are emitted.  TTL
    counts from the key's last update."""

    def __init__(self, name: str, state: StructType, merge, show: Sequence[str],
                 ttl_ms: int | None = None):
        self.name, self.state_type, self.merge = name, state, merge
        self.show, self.ttl_ms = tuple(show), ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState(self.name, self.state_type, self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        folded = None
        if self.value.exists():
            folded = tuple(self.value.get())
        for frame in rows:
            folded = self.merge(folded, frame)
        if folded is None:
            return
        self.value.update(folded)
        names = self.state_type.fieldNames()
        yield pd.DataFrame({"key": [_key(key)],
                            **{c: [folded[names.index(c)]] for c in self.show}})

    def close(self) -> None:
        pass


def _add_rows(state, frame: pd.DataFrame):
    return ((state[0] if state else 0) + len(frame),)


class CountProcessor(KeyFold):
    OUTPUT = StructType([StructField("key", StringType()),
                         StructField("running_count", LongType())])

    def __init__(self, ttl_ms: int | None = None):
        super().__init__("count", StructType([StructField("running_count", LongType())]),
                         _add_rows, ["running_count"], ttl_ms)


class SeededCountProcessor(StatefulProcessor):
    """Running count that starts from a seed, as long as the seed lives.

    Seeds come as the query's initial state and expire ``ttl_ms`` of
    processing time after it was loaded; a key whose first rows come later
    starts from 0.  ``seen`` counts the key's rows alone."""
    OUTPUT = StructType([StructField("key", StringType()), StructField("running_count", LongType()),
                         StructField("seen", LongType())])

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seed = handle.getValueState("seed", StructType([StructField("seed", LongType())]), self.ttl_ms)
        self.counts = handle.getValueState("counts", StructType([
            StructField("start", LongType()), StructField("seen", LongType())]))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.seed.update((int(initialState["seed"].sum()),))

    def handleInputRows(self, key, rows, timerValues):
        n = sum(len(f) for f in rows)
        if self.counts.exists():
            start, seen = self.counts.get()
        else:
            start, seen = (self.seed.get()[0] if self.seed.exists() else 0), 0
        self.counts.update((start, seen + n))
        yield pd.DataFrame({"key": [_key(key)], "running_count": [start + seen + n], "seen": [seen + n]})

    def close(self) -> None:
        pass


class RunningSumProcessor(StatefulProcessor):
    """Running sum of ``value`` per record, rows of a batch in event order."""
    OUTPUT = StructType([StructField("key", StringType()), StructField("event_id", StringType()),
                         StructField("event_time", TimestampType()), StructField("running_sum", LongType())])

    def init(self, handle):
        self.total = handle.getValueState("total", StructType([StructField("total", LongType())]))

    def handleInputRows(self, key, rows, timerValues):
        pdf = _sorted(rows, ["event_id", "event_time", "value"])
        base = self.total.get()[0] if self.total.exists() else 0
        sums = base + pdf["value"].fillna(0).astype("int64").cumsum()
        if len(sums):
            self.total.update((int(sums.iloc[-1]),))
        yield pd.DataFrame({"key": [_key(key)] * len(pdf), "event_id": pdf["event_id"],
                            "event_time": pdf["event_time"], "running_sum": sums})

    def close(self):
        pass


# ── ST2: running count per record ─────────────────────────────────────────
class PerRecordCountProcessor(StatefulProcessor):
    OUTPUT = StructType([StructField("key", StringType()), StructField("event_id", StringType()),
                         StructField("event_time", TimestampType()),
                         StructField("running_count", LongType())])

    def init(self, handle):
        self.count = handle.getValueState("count",
                                          StructType([StructField("count", LongType())]))

    def handleInputRows(self, key, rows, timerValues):
        pdf = _sorted(rows, ["event_id", "event_time"])
        base = self.count.get()[0] if self.count.exists() else 0
        n = len(pdf)
        self.count.update((base + n,))
        yield pd.DataFrame({"key": [_key(key)] * n, "event_id": pdf["event_id"],
                            "event_time": pdf["event_time"],
                            "running_count": range(base + 1, base + n + 1)})

    def close(self):
        pass


# ── ST3: running count + last event type ──────────────────────────────────
def _latest(state, frame: pd.DataFrame):
    """Rows counted, and the type of the row with the largest (time, id)."""
    n, kind, at, eid = state or (0, None, None, None)
    timed = frame[frame["event_time"].notna()]
    if len(timed):
        us = _us(timed["event_time"])
        tie = timed[us == us.max()]
        best = tie.loc[tie["event_id"].fillna("").idxmax()]
        t, i = int(us.max()), best["event_id"] if pd.notna(best["event_id"]) else ""
        if at is None or (t, i) >= (at, eid):
            kind, at, eid = (best["event_type"] if pd.notna(best["event_type"]) else None), t, i
    return (n + len(frame), kind, at, eid)


class LastTypeProcessor(KeyFold):
    OUTPUT = StructType([StructField("key", StringType()),
                         StructField("running_count", LongType()),
                         StructField("last_event_type", StringType())])

    def __init__(self):
        super().__init__("count_type", StructType([
            StructField("running_count", LongType()), StructField("last_event_type", StringType()),
            StructField("at_us", LongType()), StructField("event_id", StringType())]),
            _latest, ["running_count", "last_event_type"])


# ── ST4 / ST8: accumulators (sum, max, average) ───────────────────────────
class FoldProcessor(StatefulProcessor):
    """Running sum, max and average of ``value`` per key (value state)."""
    OUTPUT = StructType([StructField("key", StringType()), StructField("max_value", IntegerType()),
                         StructField("sum_value", LongType()),
                         StructField("event_count", LongType())])

    def init(self, handle):
        self.state = handle.getValueState("fold", StructType([
            StructField("max", IntegerType()), StructField("sum", LongType()),
            StructField("count", LongType())]))

    def handleInputRows(self, key, rows, timerValues):
        mx, sm, n = self.state.get() if self.state.exists() else (None, 0, 0)
        for pdf in rows:
            v = pdf["value"].dropna()
            if len(v):
                bmax = int(v.max())
                mx = bmax if mx is None else max(mx, bmax)
                sm += int(v.sum())
            n += len(pdf)
        self.state.update((mx, sm, n))
        yield pd.DataFrame({"key": [_key(key)], "max_value": [mx], "sum_value": [sm],
                            "event_count": [n]})

    def close(self):
        pass


# ── ST6: list state, the last n items ─────────────────────────────────────
class RecentListProcessor(StatefulProcessor):
    OUTPUT = StructType([StructField("key", StringType()), StructField("recent", StringType()),
                         StructField("n_recent", LongType())])

    def __init__(self, n: int = 3):
        self.n = n

    def init(self, handle):
        self.items = handle.getListState("recent", StructType([
            StructField("at_us", LongType()), StructField("event_id", StringType())]))

    def handleInputRows(self, key, rows, timerValues):
        kept = [tuple(t) for t in self.items.get()] if self.items.exists() else []
        for pdf in rows:                     # only n rows of a frame can stay
            timed = pdf[pdf["event_time"].notna()]
            last = timed.sort_values(["event_time", "event_id"], na_position="first").tail(self.n)
            ids = last["event_id"].astype(object).where(last["event_id"].notna(), None)
            kept += zip(_us(last["event_time"]).tolist(), ids.tolist())
            kept = sorted(kept, key=_null_first)[-self.n:]
        if kept:
            self.items.put(kept)
        yield pd.DataFrame({"key": [_key(key)], "recent": [",".join(e for _, e in kept if e is not None)],
                            "n_recent": [len(kept)]})

    def close(self):
        pass


# ── ST7: map state, count per event type ──────────────────────────────────
class TypeCountsProcessor(StatefulProcessor):
    OUTPUT = StructType([StructField("key", StringType()), StructField("event_type", StringType()),
                         StructField("type_count", LongType())])

    def init(self, handle):
        self.counts = handle.getMapState(
            "type_counts", StructType([StructField("event_type", StringType())]),
            StructType([StructField("count", LongType())]))

    def handleInputRows(self, key, rows, timerValues):
        batch: dict = {}
        for pdf in rows:
            for t, c in pdf["event_type"].value_counts(dropna=False).items():
                t = None if pd.isna(t) else t
                batch[t] = batch.get(t, 0) + int(c)
        out_t, out_c = [], []
        for t, c in batch.items():
            cur = self.counts.getValue((t,))
            total = (cur[0] if cur else 0) + c
            self.counts.updateValue((t,), (total,))
            out_t.append(t)
            out_c.append(total)
        yield pd.DataFrame({"key": [_key(key)] * len(out_t), "event_type": out_t,
                            "type_count": out_c})

    def close(self):
        pass


# ── ST12: funnel state machine ─────────────────────────────────────────────
class FunnelProcessor(StatefulProcessor):
    OUTPUT = StructType([StructField("key", StringType()), StructField("stage", IntegerType()),
                         StructField("completed", LongType())])

    def __init__(self, steps: Sequence[str] = ("view", "click", "purchase")):
        self.steps = tuple(steps)

    def init(self, handle):
        self.state = handle.getValueState("funnel", StructType([
            StructField("stage", IntegerType()), StructField("completed", LongType())]))

    def handleInputRows(self, key, rows, timerValues):
        pdf = _sorted(rows, ["event_id", "event_time", "event_type"])
        stage, done = self.state.get() if self.state.exists() else (0, 0)
        codes = pdf["event_type"].map({s: i for i, s in enumerate(self.steps)}).fillna(-1).to_numpy("int64")
        if len(codes):
            stages, counts = transition_tables(np.arange(len(codes)) == 0, codes, len(self.steps))
            stage, done = int(stages[0, stage]), done + int(counts[0, stage])
        self.state.update((stage, done))
        yield pd.DataFrame({"key": [_key(key)], "stage": [stage], "completed": [done]})

    def close(self):
        pass


# ── ST11 / ST10: inactivity alerts on timers ──────────────────────────────
class InactivityProcessor(StatefulProcessor):
    """Alert ``gap`` after an event when no newer event follows in time.

    Event-time mode: the state holds the times that the watermark has not yet
    left ``gap`` behind (at least the newest); once it has, a time alerts if
    the next one is further off, and is dropped.  A timer stands at the
    earliest.  Processing-time mode: one timer, ``gap`` after the last batch.
    """
    OUTPUT = StructType([StructField("key", StringType()),
                         StructField("last_event_time", TimestampType()),
                         StructField("alert_time", TimestampType())])

    def __init__(self, gap_ms: int, processing_time: bool = False):
        self.gap_ms, self.processing_time = gap_ms, processing_time

    def init(self, handle):
        self.handle = handle
        self.times = handle.getListState("times", StructType([StructField("ms", LongType())]))
        self.timer = handle.getValueState("timer", StructType([StructField("ms", LongType())]))

    def _alerts(self, key, last, at):
        if len(last):
            yield pd.DataFrame({"key": [_key(key)] * len(last), "last_event_time": _instants(last),
                                "alert_time": _instants(at)})

    def _set_timer(self, ms: int | None) -> None:
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
            self.timer.clear()
        if ms is not None:
            self.handle.registerTimer(ms)
            self.timer.update((ms,))

    def _settle(self, key, times: np.ndarray, watermark: int):
        """Alert and drop the times that the watermark has left behind."""
        done = times + self.gap_ms <= watermark
        quiet = done & (np.r_[np.diff(times), np.iinfo("int64").max] > self.gap_ms)
        rest = times[~done]
        self.times.clear()
        if len(rest):
            self.times.put([(int(t),) for t in rest])
        self._set_timer(int(rest[0]) + self.gap_ms if len(rest) else None)
        yield from self._alerts(key, times[quiet], times[quiet] + self.gap_ms)

    def _stored(self) -> np.ndarray:
        return np.array([t[0] for t in self.times.get()] if self.times.exists() else [], dtype="int64")

    def handleInputRows(self, key, rows, timerValues):
        parts = [self._stored()]
        parts += [_ms(f["event_time"].dropna()).to_numpy() for f in rows]
        times = np.unique(np.concatenate(parts))
        if not len(times):
            return
        if self.processing_time:
            self.times.put([(int(times[-1]),)])
            self._set_timer(timerValues.getCurrentProcessingTimeInMs() + self.gap_ms)
        else:
            yield from self._settle(key, times, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        times = self._stored()
        self.timer.clear()
        if not len(times):
            return
        if self.processing_time:
            self.times.clear()
            yield from self._alerts(key, times[-1:], [expiredTimerInfo.getExpiryTimeInMs()])
        else:
            yield from self._settle(key, times, timerValues.getCurrentWatermarkInMs())

    def close(self):
        pass


# ── T6: sessions kept by hand (list state + event-time timer) ──────────────
def merge_sessions(sessions: list[tuple], gap_ms: int) -> list[tuple]:
    """(start, last, count) pieces → sessions: pieces at most a gap apart join."""
    out: list[tuple] = []
    for start, last, n in sorted(sessions):
        if out and start - out[-1][1] <= gap_ms:
            out[-1] = (out[-1][0], max(out[-1][1], last), out[-1][2] + n)
        else:
            out.append((start, last, n))
    return out


class SessionProcessor(StatefulProcessor):
    """Session = events at most ``gap`` apart.  The state holds the open
    sessions; rows that arrive late, but not behind the watermark, extend or
    join them.  A session leaves when the watermark passes ``last + gap``."""
    OUTPUT = StructType([StructField("key", StringType()),
                         StructField("session_start", TimestampType()),
                         StructField("session_end", TimestampType()),
                         StructField("event_count", LongType())])

    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def init(self, handle):
        self.handle = handle
        self.open = handle.getListState("sessions", StructType([
            StructField("start", LongType()), StructField("last", LongType()),
            StructField("count", LongType())]))
        self.timer = handle.getValueState("timer", StructType([StructField("ms", LongType())]))

    def _stored(self) -> list[tuple]:
        return [tuple(s) for s in self.open.get()] if self.open.exists() else []

    def _close(self, key, sessions: list[tuple], watermark: int):
        done = [s for s in sessions if s[1] + self.gap_ms <= watermark]
        rest = [s for s in sessions if s[1] + self.gap_ms > watermark]
        self.open.clear()
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
            self.timer.clear()
        if rest:
            self.open.put(rest)
            first = min(s[1] for s in rest) + self.gap_ms
            self.handle.registerTimer(first)
            self.timer.update((first,))
        if done:
            starts, lasts, counts = zip(*done)
            yield pd.DataFrame({"key": [_key(key)] * len(done), "session_start": _instants(starts),
                                "session_end": _instants([t + self.gap_ms for t in lasts]),
                                "event_count": list(counts)})

    def handleInputRows(self, key, rows, timerValues):
        pieces = self._stored()
        for pdf in rows:                      # a frame's own sessions, then merged
            t = np.sort(_ms(pdf["event_time"].dropna()).to_numpy())
            if len(t):
                first = np.flatnonzero(np.r_[True, np.diff(t) > self.gap_ms])
                last = np.r_[first[1:], len(t)]
                pieces += zip(t[first].tolist(), t[last - 1].tolist(), (last - first).tolist())
        yield from self._close(key, merge_sessions(pieces, self.gap_ms),
                               timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.timer.clear()
        yield from self._close(key, self._stored(), timerValues.getCurrentWatermarkInMs())

    def close(self):
        pass


# ── ST13: co-processing of two sides ──────────────────────────────────────
class CoProcessor(StatefulProcessor):
    """Union of two sides per key.  The state holds the left rows no older
    than ``bound_ms`` before the watermark, so every right row that is not late
    finds its own; each right row is emitted with the latest of them at or
    before it, at most ``bound_ms`` older.  A timer empties a key that gets no
    more rows.  A right
    row goes out in its own batch, so it sees the left rows that have arrived
    by then; a left row that comes later never changes it, and an older left
    row never hides a newer one.  A left row without an id sorts first at its
    time; a right row without a time is emitted without a match."""
    OUTPUT = StructType([StructField("key", StringType()), StructField("click_id", StringType()),
                         StructField("click_time", TimestampType()),
                         StructField("view_id", StringType()),
                         StructField("view_time", TimestampType())])

    def __init__(self, bound_ms: int):
        self.bound_ms = bound_ms

    def init(self, handle):
        self.handle = handle
        self.views = handle.getListState("views", StructType([
            StructField("t", LongType()), StructField("id", StringType())]))

    def _held(self):
        return sorted((tuple(v) for v in self.views.get()), key=_null_first) if self.views.exists() else []

    def _keep(self, views, timerValues):
        views = [v for v in views if v[0] >= timerValues.getCurrentWatermarkInMs() - self.bound_ms]
        if views:
            self.views.put(views)
        else:
            self.views.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self._keep(self._held(), timerValues)
        return iter(())

    def handleInputRows(self, key, rows, timerValues):
        pdf = _sorted(rows, ["event_id", "event_time", "is_left"])
        timed = pdf["event_time"].notna().to_numpy(bool)
        left = pdf["is_left"].to_numpy(bool)
        ids = pdf["event_id"].astype(object).where(pdf["event_id"].notna(), None).to_numpy()
        t = np.zeros(len(pdf), "int64")
        t[timed] = _ms(pdf["event_time"][timed]).to_numpy()
        held = self._held()
        views = sorted(held + list(zip(t[left & timed].tolist(), ids[left & timed].tolist())), key=_null_first)
        if views:
            if held and held[-1][0] != views[-1][0]:
                self.handle.deleteTimer(held[-1][0] + self.bound_ms + 1)
            if not held or held[-1][0] != views[-1][0]:
                self.handle.registerTimer(views[-1][0] + self.bound_ms + 1)
            self._keep(views, timerValues)
        if left.all():
            return
        rt, rid, known = t[~left], ids[~left], timed[~left]
        # a view at the click's own time counts if its id sorts before the click's
        at = np.array([bisect_right(views, _null_first((int(a), b)), key=_null_first) - 1 for a, b in zip(rt, rid)])
        vt = np.array([views[i][0] if i >= 0 else np.iinfo("int64").min // 2 for i in at])
        ok = (rt - vt <= self.bound_ms) & (at >= 0) & known
        shown = pd.Series(rt, dtype="Int64").where(pd.Series(known))
        yield pd.DataFrame({
            "key": [_key(key)] * len(rt), "click_id": rid, "click_time": pd.to_datetime(shown, unit="ms", utc=True),
            "view_id": [views[i][1] if o else None for i, o in zip(at, ok)],
            "view_time": pd.to_datetime(pd.Series([int(v) if o else None for v, o in zip(vt, ok)],
                                                  dtype="Int64"), unit="ms", utc=True)})

    def close(self):
        pass


# ── ST14: several interacting state variables ─────────────────────────────
class KeyProfileProcessor(StatefulProcessor):
    """Value state (count, max value) plus map state (type → count): emits
    the count, the max value and the number of distinct types seen."""
    OUTPUT = StructType([StructField("key", StringType()), StructField("event_count", LongType()),
                         StructField("max_value", IntegerType()),
                         StructField("n_types", LongType())])

    def init(self, handle):
        self.totals = handle.getValueState("totals", StructType([
            StructField("count", LongType()), StructField("max", IntegerType())]))
        self.types = handle.getMapState(
            "types", StructType([StructField("event_type", StringType())]),
            StructType([StructField("count", LongType())]))

    def handleInputRows(self, key, rows, timerValues):
        count, mx = self.totals.get() if self.totals.exists() else (0, None)
        for pdf in rows:
            count += len(pdf)
            v = pdf["value"].dropna()
            if len(v):
                mx = int(v.max()) if mx is None else max(mx, int(v.max()))
            for t, c in pdf["event_type"].value_counts().items():
                cur = self.types.getValue((t,))
                self.types.updateValue((t,), ((cur[0] if cur else 0) + int(c),))
        self.totals.update((count, mx))
        n_types = sum(1 for _ in self.types.keys())
        yield pd.DataFrame({"key": [_key(key)], "event_count": [count], "max_value": [mx],
                            "n_types": [n_types]})

    def close(self):
        pass


# ── T12: late rows by the engine's own watermark ──────────────────────────
class LateMarkProcessor(StatefulProcessor):
    """Marks rows whose window has closed before the current watermark (or,
    without a window, whose own time lies before it).  Keeps no state."""

    def __init__(self, window_us: int | None):
        self.window_us = window_us

    def init(self, handle):
        pass

    def handleInputRows(self, key, rows, timerValues):
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        for pdf in rows:
            t = pdf["late_time_us"].fillna(np.iinfo("int64").max).astype("int64")
            late = (t // self.window_us + 1) * self.window_us <= mark if self.window_us else t < mark
            yield pdf.drop(columns="late_share").assign(is_late=late & pdf["late_time_us"].notna() & (mark > 0))

    def close(self):
        pass
