"""Stateful processors that handle a bucket of keys in one call.

A processor of :mod:`eddyline.streaming.processors` is called once a key and
batch; its pandas frames and its trips to the state store then cost more than
the work.  Here rows are grouped by a hash bucket of the key
(:func:`bucket_of_key`), a call folds the frames of all its keys by pandas
group operations, and the bucket's state is a small table (Arrow bytes in a
value state) that is read and written once a batch.  Frames come in Arrow
batches, so a hot key is folded piece by piece.  Results are those of the
processors by key: a key's rows never leave its bucket.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from eddyline.streaming import processors as P
from eddyline.streaming.processors import _instants, _ms, _us

BUCKET = "_bucket"
N_BUCKETS = 512              # a batch rewrites the state of the buckets it touches
NEVER = np.iinfo("int64").min
TABLE = StructType([StructField("rows", BinaryType())])


def bucket_of_key(n: int = N_BUCKETS) -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")


def to_bytes(rows: pd.DataFrame, schema: pa.Schema) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as out:
        out.write_table(pa.Table.from_pandas(rows, schema=schema, preserve_index=False))
    return sink.getvalue().to_pybytes()


def from_bytes(data) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(data)).read_all().to_pandas()


class TableState:
    """A pandas table of one bucket in a value state."""

    def __init__(self, handle: StatefulProcessorHandle, name: str, schema: pa.Schema, ttl_ms: int | None = None):
        self.schema, self.value = schema, handle.getValueState(name, TABLE, ttl_ms)

    def get(self) -> pd.DataFrame:
        held = self.value.get() if self.value.exists() else None
        return from_bytes(held[0]) if held else self.schema.empty_table().to_pandas()

    def put(self, rows: pd.DataFrame) -> None:
        if len(rows):
            self.value.update((to_bytes(rows, self.schema),))
        elif self.value.exists():
            self.value.clear()


def _schema(**kinds) -> pa.Schema:
    return pa.schema(list(kinds.items()))


def _objects(s: pd.Series) -> pd.Series:
    """Strings with None for null, whatever the frame made of them."""
    s = s.astype(object)
    return s.where(s.notna(), None)


def by_key(rows: pd.DataFrame):
    return rows.groupby("key", sort=False, dropna=False)


def _codes(rows: pd.DataFrame) -> np.ndarray:
    return pd.factorize(rows["key"], use_na_sentinel=False)[0]


def _touched(rows: pd.DataFrame, keys: pd.Series) -> pd.DataFrame:
    """The rows of ``keys``, which holds null for the null key."""
    known = rows["key"].isin(keys.dropna())
    return rows[known | rows["key"].isna()] if keys.isna().any() else rows[known]


def _concat(parts: list[pd.DataFrame]) -> pd.DataFrame:
    full = [p for p in parts if len(p)]
    return pd.concat(full, ignore_index=True) if full else parts[0]


class BucketProcessor(StatefulProcessor):
    def close(self) -> None:
        pass


class BucketFold(BucketProcessor):
    """A row of state per key: ``part`` folds a frame to such rows and
    ``merge`` the rows of several of them, oldest first, to one row a key.
    Rows of the keys seen in the batch are emitted by ``show``.  With
    ``ttl_ms`` a key's row expires that long after its last update; a
    bucket without updates for so long expires as a whole."""
    STATE: pa.Schema

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = self.STATE.append(pa.field("updated", pa.int64())) if self.ttl_ms else self.STATE
        self.rows = TableState(handle, "rows", schema, self.ttl_ms)

    def part(self, frame: pd.DataFrame) -> pd.DataFrame:
        raise NotImplementedError

    def merge(self, rows: pd.DataFrame) -> pd.DataFrame:
        raise NotImplementedError

    def show(self, rows: pd.DataFrame) -> pd.DataFrame:
        return rows

    def handleInputRows(self, key, rows, timerValues):
        held = self.rows.get()
        now = timerValues.getCurrentProcessingTimeInMs() if self.ttl_ms else 0
        if self.ttl_ms:
            held = held[held["updated"] + self.ttl_ms > now]
        batch = None
        for frame in rows:
            frame = frame.assign(key=_objects(frame["key"]))
            part = self.part(frame)
            batch = part if batch is None else self.merge(_concat([batch, part]))
        if batch is None:
            return
        before = _touched(held, batch["key"])
        new = self.merge(_concat([before[self.STATE.names], batch]))
        if self.ttl_ms:
            new["updated"] = now
        self.rows.put(_concat([held.drop(before.index), new]))
        yield self.show(new)


# ── value state: running count ────────────────────────────────────────────
class BucketCount(BucketFold):
    OUTPUT = P.CountProcessor.OUTPUT
    STATE = _schema(key=pa.string(), running_count=pa.int64())

    def part(self, frame):
        return by_key(frame).size().reset_index(name="running_count")

    def merge(self, rows):
        return by_key(rows)["running_count"].sum().reset_index()

    def show(self, rows):
        return rows[["key", "running_count"]]


# ── value state: running count and last event type ────────────────────────
class BucketLastType(BucketFold):
    """As :class:`eddyline.streaming.processors.LastTypeProcessor`: the type
    of the row with the largest (time, id); rows without a time only count."""
    OUTPUT = P.LastTypeProcessor.OUTPUT
    STATE = _schema(key=pa.string(), running_count=pa.int64(), last_event_type=pa.string(),
                    at_us=pa.int64(), event_id=pa.string())

    def part(self, frame):
        at = pd.Series(NEVER, index=frame.index)
        timed = frame["event_time"].notna()
        if timed.any():
            at[timed] = _us(frame.loc[timed, "event_time"])
        kind, eid = _objects(frame["event_type"].where(timed)), frame["event_id"].astype(object).fillna("").where(timed, "")
        one = pd.DataFrame({"key": frame["key"], "running_count": 1, "last_event_type": kind, "at_us": at, "event_id": eid})
        return self.merge(one[::-1])              # of equal (time, id) in a frame, the first

    def merge(self, rows):
        rows = rows.assign(key=_objects(rows["key"]))     # one null for drop_duplicates
        counts = by_key(rows)["running_count"].sum().reset_index()
        last = rows.sort_values(["at_us", "event_id"], kind="stable").drop_duplicates("key", keep="last")
        return counts.merge(last.drop(columns="running_count"), on="key")[self.STATE.names]

    def show(self, rows):
        return rows[["key", "running_count", "last_event_type"]]


# ── value state: sum, max and count ───────────────────────────────────────
class BucketTotals(BucketFold):
    OUTPUT = P.FoldProcessor.OUTPUT
    STATE = _schema(key=pa.string(), max_value=pa.float64(), sum_value=pa.int64(), event_count=pa.int64())

    def part(self, frame):
        v = frame["value"].astype("float64")      # 32-bit values: exact
        one = pd.DataFrame({"key": frame["key"], "max_value": v, "sum_value": v.fillna(0).astype("int64"), "event_count": 1})
        return self.merge(one)

    def merge(self, rows):
        return by_key(rows).agg({"max_value": "max", "sum_value": "sum", "event_count": "sum"}).reset_index()

    def show(self, rows):
        return rows.assign(max_value=rows["max_value"].astype("Int32"))


# ── the last n items ──────────────────────────────────────────────────────
class BucketRecent(BucketProcessor):
    OUTPUT = P.RecentListProcessor.OUTPUT
    STATE = _schema(key=pa.string(), at_us=pa.int64(), event_id=pa.string())

    def __init__(self, n: int = 3):
        self.n = n

    def init(self, handle):
        self.items = TableState(handle, "recent", self.STATE)

    def _last(self, rows: pd.DataFrame) -> pd.DataFrame:
        return by_key(rows.sort_values(["at_us", "event_id"], kind="stable", na_position="first")).tail(self.n)

    def handleInputRows(self, key, rows, timerValues):
        kept, seen = self.items.get(), []
        for frame in rows:
            frame = frame.assign(key=_objects(frame["key"]))
            seen.append(frame[["key"]].drop_duplicates())
            timed = frame[frame["event_time"].notna()]
            if len(timed):
                new = pd.DataFrame({"key": timed["key"], "at_us": _us(timed["event_time"]), "event_id": _objects(timed["event_id"])})
                kept = self._last(_concat([kept, self._last(new)]))
        self.items.put(kept)
        recent: dict = {k: [] for k in pd.concat(seen)["key"].tolist()}
        for k, e in zip(kept["key"].tolist(), _objects(kept["event_id"]).tolist()):
            if k in recent:
                recent[k].append(e)
        yield pd.DataFrame({"key": list(recent), "recent": [",".join(e for e in r if e is not None) for r in recent.values()],
                            "n_recent": [len(r) for r in recent.values()]})


# ── several state variables: totals beside a map by event type ────────────
class BucketProfile(BucketTotals):
    """Value state (count, max value) plus map state (type → count by key)."""
    OUTPUT = P.KeyProfileProcessor.OUTPUT
    COUNTS = _schema(key=pa.string(), count=pa.int64())

    def init(self, handle):
        super().init(handle)
        self.types = handle.getMapState("types", StructType([StructField("event_type", StringType())]), TABLE)

    def handleInputRows(self, key, rows, timerValues):
        counts = []

        def counted():
            for frame in rows:
                known = frame[frame["event_type"].notna()].assign(key=lambda f: _objects(f["key"]))
                one = known.groupby(["key", "event_type"], sort=False, dropna=False).size()
                counts.append(one.reset_index(name="count"))
                yield frame

        for totals in super().handleInputRows(key, counted(), timerValues):
            for kind, new in _concat(counts).groupby("event_type", sort=False):
                held = self.types.getValue((kind,))
                both = _concat([*([from_bytes(held[0])] if held else []), new[["key", "count"]]])
                self.types.updateValue((kind,), (to_bytes(by_key(both)["count"].sum().reset_index(), self.COUNTS),))
            keys = [from_bytes(table[0])[["key"]] for table in self.types.values()]
            n = by_key(pd.concat(keys)).size().reset_index(name="n_types") if keys else pd.DataFrame({"key": [], "n_types": []}, dtype=object)
            out = totals.merge(n, on="key", how="left")
            out["n_types"] = out["n_types"].fillna(0).astype("int64")
            yield out[["key", "event_count", "max_value", "n_types"]]


# ── initial state that expires ────────────────────────────────────────────
class BucketSeededCount(BucketProcessor):
    """As :class:`eddyline.streaming.processors.SeededCountProcessor`.  All
    seeds are loaded by the first batch, so a bucket's expire together."""
    OUTPUT = P.SeededCountProcessor.OUTPUT
    SEEDS = _schema(key=pa.string(), seed=pa.int64())
    COUNTS = _schema(key=pa.string(), start=pa.int64(), seen=pa.int64())

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle):
        self.seeds = TableState(handle, "seeds", self.SEEDS, self.ttl_ms)
        self.counts = TableState(handle, "counts", self.COUNTS)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        new = initialState[["key", "seed"]].assign(key=_objects(initialState["key"]))
        self.seeds.put(by_key(_concat([self.seeds.get(), new]))["seed"].sum().reset_index())

    def handleInputRows(self, key, rows, timerValues):
        parts = [by_key(f.assign(key=_objects(f["key"]))).size().reset_index(name="n") for f in rows]
        if not parts:
            return
        new = by_key(_concat(parts))["n"].sum().reset_index()
        held = self.counts.get()
        out = new.merge(held, on="key", how="left").merge(self.seeds.get(), on="key", how="left")
        start = out["start"].where(out["seen"].notna(), out["seed"]).fillna(0).astype("int64")
        seen = out["n"] + out["seen"].fillna(0).astype("int64")
        now = pd.DataFrame({"key": out["key"], "start": start, "seen": seen})
        self.counts.put(_concat([held.drop(_touched(held, now["key"]).index), now]))
        yield pd.DataFrame({"key": now["key"], "running_count": start + seen, "seen": seen})


# ── timers: one a bucket, at its earliest time ────────────────────────────
class BucketTimed(BucketProcessor):
    def init(self, handle):
        self.handle = handle
        self.rows = TableState(handle, "rows", self.STATE)
        self.timer = handle.getValueState("timer", StructType([StructField("ms", LongType())]))

    def _store(self, rows: pd.DataFrame, due: int | None) -> None:
        self.rows.put(rows)
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
            self.timer.clear()
        if due is not None:
            self.handle.registerTimer(due)
            self.timer.update((due,))


class BucketSessions(BucketTimed):
    """As :class:`eddyline.streaming.processors.SessionProcessor`."""
    OUTPUT = P.SessionProcessor.OUTPUT
    STATE = _schema(key=pa.string(), start=pa.int64(), last=pa.int64(), count=pa.int64())

    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def _merge(self, pieces: pd.DataFrame) -> pd.DataFrame:
        """Pieces of a key at most a gap apart join."""
        if not len(pieces):
            return pieces
        pieces = pieces.assign(_k=_codes(pieces)).sort_values(["_k", "start"], kind="stable")
        reach = pieces.groupby("_k")["last"].cummax().to_numpy()
        k, start = pieces["_k"].to_numpy(), pieces["start"].to_numpy()
        first = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (start[1:] - reach[:-1] > self.gap_ms)])
        return pd.DataFrame({"key": pieces["key"].to_numpy()[first], "start": start[first],
                             "last": np.maximum.reduceat(pieces["last"].to_numpy(), first),
                             "count": np.add.reduceat(pieces["count"].to_numpy(), first)})

    def _close(self, sessions: pd.DataFrame, watermark: int):
        done = sessions["last"] + self.gap_ms <= watermark
        rest = sessions[~done]
        self._store(rest, int(rest["last"].min()) + self.gap_ms if len(rest) else None)
        closed = sessions[done]
        if len(closed):
            yield pd.DataFrame({"key": closed["key"].to_numpy(), "session_start": _instants(closed["start"].to_numpy()),
                                "session_end": _instants(closed["last"].to_numpy() + self.gap_ms),
                                "event_count": closed["count"].to_numpy()})

    def handleInputRows(self, key, rows, timerValues):
        pieces = self.rows.get()
        for frame in rows:
            timed = frame[frame["event_time"].notna()]
            if len(timed):
                t = _ms(timed["event_time"])
                one = pd.DataFrame({"key": _objects(timed["key"]), "start": t, "last": t, "count": 1})
                pieces = self._merge(_concat([pieces, one]))
        yield from self._close(pieces, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.timer.clear()
        yield from self._close(self.rows.get(), timerValues.getCurrentWatermarkInMs())


class BucketInactivity(BucketTimed):
    """As :class:`eddyline.streaming.processors.InactivityProcessor`: event
    time keeps the times that the watermark has not yet left ``gap`` behind;
    processing time keeps a key's newest time, due ``gap`` after its last batch."""
    OUTPUT = P.InactivityProcessor.OUTPUT
    STATE = _schema(key=pa.string(), ms=pa.int64(), due=pa.int64())

    def __init__(self, gap_ms: int, processing_time: bool = False):
        self.gap_ms, self.processing_time = gap_ms, processing_time

    def _alerts(self, rows: pd.DataFrame):
        if len(rows):
            yield pd.DataFrame({"key": rows["key"].to_numpy(), "last_event_time": _instants(rows["ms"].to_numpy()),
                                "alert_time": _instants(rows["due"].to_numpy())})

    def _settle(self, rows: pd.DataFrame, now: int):
        """Alert and drop what is due at ``now``: in event time, times whose next one is further off than the gap."""
        done = (rows["due"] <= now).to_numpy()
        quiet = done
        if not self.processing_time and len(rows):
            k = _codes(rows)
            order = np.lexsort((rows["ms"].to_numpy(), k))
            rows, done, k = rows.iloc[order], done[order], k[order]
            t = rows["ms"].to_numpy()
            quiet = done & np.r_[(k[1:] != k[:-1]) | (np.diff(t) > self.gap_ms), True]
        rest = rows[~done]
        self._store(rest, int(rest["due"].min()) if len(rest) else None)
        yield from self._alerts(rows[quiet])

    def handleInputRows(self, key, rows, timerValues):
        held, new, seen = self.rows.get(), [], []
        for frame in rows:
            keys = _objects(frame["key"])
            seen.append(keys.drop_duplicates())
            timed = frame["event_time"].notna()
            if timed.any():
                ms = _ms(frame.loc[timed, "event_time"])
                new.append(pd.DataFrame({"key": keys[timed], "ms": ms, "due": ms + self.gap_ms}).drop_duplicates())
        times = _concat([held, *new]).drop_duplicates(["key", "ms"])
        if not self.processing_time:
            yield from self._settle(times, timerValues.getCurrentWatermarkInMs())
            return
        last = times.sort_values("ms", kind="stable").drop_duplicates("key", keep="last")
        last.loc[_touched(last, pd.concat(seen)).index, "due"] = timerValues.getCurrentProcessingTimeInMs() + self.gap_ms
        self._store(last, int(last["due"].min()) if len(last) else None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.timer.clear()
        now = timerValues.getCurrentProcessingTimeInMs() if self.processing_time else timerValues.getCurrentWatermarkInMs()
        yield from self._settle(self.rows.get(), now)
