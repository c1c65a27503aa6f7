"""Range-partitioned segmented scans: ordered per-key state without hot keys.

Rows are range-partitioned on ``(keys, order)`` and sorted, so a key is a run
of neighbouring rows that may cross partitions.  However many rows a key has,
and even if all of them have the same time, they spread evenly (rows that are
equal in every order column are told apart by their place in the input).

1. One pass over each sorted partition (``mapInArrow``, a batch at a time,
   vectorised) scans its segments from an empty state.  The result is written
   to the shared folder, as range bounds are sampled anew in each execution.
2. The first and last row of each partition (two rows a partition, whatever
   the data's size) are folded on the driver: the state that enters a
   partition, where its first key goes on from the one before.
3. That carry (at most a row a partition) is applied to the rows of the first
   segment, in the JVM.

Rows cross the network once, nothing is collected by key, and no task holds
more than one batch.  :func:`segmented_scan` gives a value for every row,
:func:`segmented_fold` one for every key.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eddyline.session import stored

PART, FIRST, EDGE, STATE, CARRY, TIE = "_part", "_in_first", "_edge", "_state", "_carry", "_tie"
AT_START, AT_END = 1, 2


def _ranged(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], partitions: int | None) -> DataFrame:
    by = [*[F.col(k) for k in keys], *[F.col(c) if isinstance(c, str) else c for c in order], F.col(TIE)]
    tied = df.withColumn(TIE, F.monotonically_increasing_id())
    ranged = tied.repartitionByRange(partitions, *by) if partitions else tied.repartitionByRange(*by)
    return ranged.sortWithinPartitions(*by).drop(TIE)


def _starts(keys: list[pa.Array], before: list | None) -> np.ndarray:
    """Rows whose key differs from the row before; nulls are equal."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    for col in keys:
        a, b = col.slice(1), col.slice(0, n - 1)
        differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        new[1:] |= differ | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
    new[0] = before is None or [col[0].as_py() for col in keys] != before
    return new


# ── a value for every row ──────────────────────────────────────────────────
class RowScan:
    """``run(new, columns, state) -> (outputs, state)`` scans a batch whose
    rows flagged ``new`` open a segment; ``state`` is None before the first
    batch.  ``enter`` and ``join`` carry the state over partition ends."""

    inputs: Sequence[str] = ()
    fields: Sequence[T.StructField] = ()
    state_type: T.DataType

    def run(self, new: np.ndarray, cols: list[pa.Array], state) -> tuple[list[pa.Array], object]:
        raise NotImplementedError

    def state_arrow(self, cols: list[pa.Array]) -> pa.DataType:
        raise NotImplementedError

    def enter(self, total, row):
        """State that goes on into a partition that begins with ``row``."""
        return total

    def join(self, carry, state):
        """State after a partition that holds one key, entered with ``carry``."""
        raise NotImplementedError

    def apply(self, carry: Column) -> dict[str, Column]:
        """The outputs of rows of a first segment that was entered with ``carry``."""
        raise NotImplementedError


class RunningSums(RowScan):
    """Running sums of BIGINT columns, the row itself included (nulls add
    nothing); a column None counts rows."""

    def __init__(self, sums: dict[str, str | None]):
        self.sums = sums
        self.inputs = [c for c in sums.values() if c is not None]
        self.fields = [T.StructField(o, T.LongType()) for o in sums]
        self.state_type = T.StructType(list(self.fields))

    def state_arrow(self, cols):
        return pa.struct([(o, pa.int64()) for o in self.sums])

    def run(self, new, cols, state):
        cols, at = iter(cols), np.flatnonzero(new)
        segment = np.cumsum(new) - 1
        out, end = [], {}
        for name, source in self.sums.items():
            v = np.ones(len(new), np.int64) if source is None else pc.fill_null(next(cols), 0).to_numpy(zero_copy_only=False)
            total = np.cumsum(v)
            before = (total - v)[at]
            local = total - (before[np.maximum(segment, 0)] if len(at) else 0)
            going_on = segment < 0
            local[going_on] = total[going_on] + (state[name] if state else 0)
            out.append(pa.array(local, pa.int64()))
            end[name] = int(local[-1])
        return out, end

    def join(self, carry, state):
        return {o: carry[o] + state[o] for o in self.sums}

    def apply(self, carry):
        return {o: F.col(o) + carry[o] for o in self.sums}


class PreviousValue(RowScan):
    """The value of the row before, of the same key."""

    def __init__(self, value: str, out: str, data_type: T.DataType):
        self.out, self.inputs, self.state_type = out, [value], T.StructType([T.StructField("v", data_type)])
        self.fields = [T.StructField(out, data_type), T.StructField("_leads", T.BooleanType())]

    def state_arrow(self, cols):
        return pa.struct([("v", cols[0].type)])

    def run(self, new, cols, state):
        col = cols[0]
        last = pa.array([state["v"] if state else None], col.type)
        shifted = pa.concat_arrays([last, col.slice(0, len(col) - 1)])
        out = pc.if_else(pa.array(new), pa.scalar(None, col.type), shifted)
        leads = np.zeros(len(new), bool)
        leads[0] = state is None
        return [out, pa.array(leads)], {"v": col[-1].as_py()}

    def join(self, carry, state):
        return state

    def apply(self, carry):
        return {self.out: F.when(F.col("_leads"), carry["v"]).otherwise(F.col(self.out))}


class LastSeen(RowScan):
    """The latest non-null value at or before each row, of the same key."""

    def __init__(self, value: str, out: str, data_type: T.DataType):
        self.out, self.inputs, self.state_type = out, [value], T.StructType([T.StructField("v", data_type)])
        self.fields = [T.StructField(out, data_type)]

    def state_arrow(self, cols):
        return pa.struct([("v", cols[0].type)])

    def run(self, new, cols, state):
        col, n = cols[0], len(new)
        rows = np.arange(n)
        last = np.maximum.accumulate(np.where(col.is_valid().to_numpy(zero_copy_only=False), rows, -1))
        start = np.maximum.accumulate(np.where(new, rows, -1))
        known = last >= np.maximum(start, 0)
        carried = ~known & (start < 0)
        pick = pa.array(np.where(known, last + 1, 0), mask=~(known | carried))
        out = pa.concat_arrays([pa.array([state["v"] if state else None], col.type), col]).take(pick)
        return [out], {"v": out[-1].as_py()}

    def join(self, carry, state):
        return carry if state["v"] is None else state

    def apply(self, carry):
        return {self.out: F.coalesce(F.col(self.out), carry["v"])}


class SessionStart(RowScan):
    """The time (BIGINT, not null) at which each row's session began: rows of
    a key at most ``gap`` apart share a session."""

    def __init__(self, time: str, gap: int, out: str):
        self.gap, self.out, self.inputs = gap, out, [time]
        self.fields = [T.StructField(out, T.LongType()), T.StructField("_leads", T.BooleanType())]
        self.state_type = T.StructType([T.StructField("start", T.LongType()), T.StructField("last", T.LongType()),
                                        T.StructField("leads", T.BooleanType())])

    def state_arrow(self, cols):
        return pa.struct([("start", pa.int64()), ("last", pa.int64()), ("leads", pa.bool_())])

    def run(self, new, cols, state):
        t = cols[0].to_numpy(zero_copy_only=False)
        opens = new.copy()
        opens[1:] |= np.diff(t) > self.gap
        opens[0] |= state is not None and t[0] - state["last"] > self.gap
        at = np.maximum.accumulate(np.where(opens, np.arange(len(t)), -1))
        start = np.where(at < 0, state["start"] if state else 0, t[at])
        # in the partition's first session: nothing has opened but that one
        opened = np.cumsum(opens) + (0 if state is None else 1 if state["leads"] else 2)
        leads = opened == 1
        return ([pa.array(start, pa.int64()), pa.array(leads)],
                {"start": int(start[-1]), "last": int(t[-1]), "leads": bool(leads[-1])})

    def enter(self, total, row):
        return total if row[self.inputs[0]] - total["last"] <= self.gap else None

    def join(self, carry, state):
        return {**state, "start": carry["start"]} if state["leads"] else state

    def apply(self, carry):
        return {self.out: F.when(F.col("_leads"), carry["start"]).otherwise(F.col(self.out))}


def _plain(value):
    return value.asDict(recursive=True) if isinstance(value, T.Row) else value


def segmented_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], scan: RowScan, *,
                   partitions: int | None = None) -> DataFrame:
    """``df`` with the scan's outputs, for rows in ``order`` within ``keys``."""
    keys, given = list(keys), df.columns
    key_at, in_at = [given.index(k) for k in keys], [given.index(c) for c in scan.inputs]
    marks = [T.StructField(PART, T.IntegerType()), T.StructField(FIRST, T.BooleanType()),
             T.StructField(EDGE, T.IntegerType()), T.StructField(STATE, scan.state_type)]
    schema = T.StructType([*df.schema.fields, *scan.fields, *marks])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        before, state, segments, held = None, None, 0, None

        def marked(cols, edge, last=None):
            n = len(cols[0])
            edges = np.zeros(n, np.int32)
            if edge & AT_START:
                edges[0] |= AT_START
            states = pa.nulls(n, state_type)
            if edge & AT_END:
                edges[-1] |= AT_END
                states = pa.array([None] * (n - 1) + [last], state_type)
            return pa.RecordBatch.from_arrays([*cols, pa.array(edges), states], names=schema.names)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            if held is not None:
                yield marked(*held)
            own_keys, own = [batch.column(i) for i in key_at], [batch.column(i) for i in in_at]
            state_type = scan.state_arrow(own)
            new = _starts(own_keys, before) if keys else np.r_[before is None, np.zeros(n - 1, bool)]
            out, state = scan.run(new, own, state)
            numbers = segments + np.cumsum(new)
            held = ([*batch.columns, *out, pa.array(np.full(n, part, np.int32)), pa.array(numbers == 1)],
                    AT_START if segments == 0 else 0)
            segments = int(numbers[-1])
            before = [c[-1].as_py() for c in own_keys]
        if held is not None:
            yield marked(held[0], held[1] | AT_END, state)

    rows = stored(_ranged(df, keys, order, partitions).mapInArrow(local, schema), "segments")
    edge_cols = [*dict.fromkeys([*keys, *scan.inputs])]
    carry, total, total_key, first = [], None, None, None
    for r in rows.filter(F.col(EDGE) > 0).select(*edge_cols, *[m.name for m in marks]).orderBy(PART, EDGE).collect():
        key = [r[k] for k in keys]
        if r[EDGE] & AT_START:
            going_on = total_key is not None and key == total_key
            first = scan.enter(total, r) if going_on else None
            if first is not None:
                carry.append((r[PART], first))
        if r[EDGE] & AT_END:
            state = _plain(r[STATE])
            total = scan.join(first, state) if r[FIRST] and first is not None else state
            total_key = key
    names = [f.name for f in scan.fields if not f.name.startswith("_")]
    if not carry:
        return rows.select(*given, *names)
    enters = df.sparkSession.createDataFrame(
        carry, T.StructType([T.StructField(PART, T.IntegerType()), T.StructField(CARRY, scan.state_type)]))
    joined = rows.join(F.broadcast(enters), PART, "left")
    entered = scan.apply(F.col(CARRY))
    use = F.col(FIRST) & F.col(CARRY).isNotNull()
    return joined.select(*given, *[F.when(use, entered[n]).otherwise(F.col(n)).alias(n) for n in names])


# ── a value for every key: the funnel ──────────────────────────────────────
def transition_tables(new: np.ndarray, codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each segment and each stage it may be entered in: the stage at its
    end, and how often the last step was taken.  In stage ``s`` only code
    ``s`` moves on.  Each row that can be a step points to the next row that
    can follow it; pointers are doubled until every chain has ended."""
    size = len(codes)
    at = np.flatnonzero(np.r_[True, new[1:]])
    segment = np.repeat(np.arange(len(at)), np.diff(np.r_[at, size]))
    places = [np.flatnonzero(codes == c) for c in range(n)]

    def after(rows: np.ndarray, own: np.ndarray, c: int) -> np.ndarray:
        """First place of ``c`` at or after each row, in the same segment; else ``size``."""
        p = np.r_[places[c], size]
        found = p[np.searchsorted(places[c], rows)]
        inside = found < size
        inside[inside] = segment[found[inside]] == own[inside]
        return np.where(inside, found, size)

    to, end = np.full(size + 1, size), np.arange(size + 1)
    done = np.zeros(size + 1, np.int64)
    for c in range(n):
        to[places[c]] = after(places[c] + 1, segment[places[c]], (c + 1) % n)
        done[places[c]] = c == n - 1
    while (to[:size] < size).any():
        done = done + np.where(to < size, done[to], 0)
        end = np.where(to < size, end[to], end)
        to = to[to]
    stages, counts = np.empty((len(at), n), np.int32), np.zeros((len(at), n), np.int64)
    for s in range(n):
        first = after(at, np.arange(len(at)), s)
        moved = first < size
        stages[:, s] = s
        stages[moved, s] = (codes[end[first[moved]]] + 1) % n
        counts[moved, s] = done[first[moved]]
    return stages, counts


def step_codes(types: pa.Array, steps: Sequence[str]) -> np.ndarray:
    """Index of each event type among ``steps``; -1 for others and nulls."""
    found = pc.index_in(types, value_set=pa.array(list(steps), types.type))
    return pc.fill_null(found, -1).to_numpy(zero_copy_only=False)


def segmented_fold(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], event: str,
                   steps: Sequence[str], *, partitions: int | None = None) -> DataFrame:
    """``keys, stage, completed``: the machine that waits for each of ``steps``
    in turn, run over every key's rows in ``order``."""
    keys, n = list(keys), len(steps)
    src = df.select(*keys, event, *[c for c in order if isinstance(c, str) and c not in (*keys, event)])
    given = src.columns
    key_at, event_at = [given.index(k) for k in keys], given.index(event)
    table = [T.StructField("_s", T.ArrayType(T.IntegerType())), T.StructField("_c", T.ArrayType(T.LongType()))]
    schema = T.StructType([*[src.schema[k] for k in keys], *table, T.StructField(PART, T.IntegerType()),
                           T.StructField(FIRST, T.BooleanType()), T.StructField(EDGE, T.IntegerType())])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, emitted = TaskContext.get().partitionId(), 0
        before, open_keys, open_s, open_c = None, None, None, None

        def rows(key_cols, s, c, last=False):
            nonlocal emitted
            number = np.arange(emitted, emitted + len(s))
            emitted += len(s)
            edges = np.where(number == 0, AT_START, 0).astype(np.int32)
            if last:
                edges[-1] |= AT_END
            return pa.RecordBatch.from_arrays(
                [*key_cols, pa.array(s.tolist(), pa.list_(pa.int32())), pa.array(c.tolist(), pa.list_(pa.int64())),
                 pa.array(np.full(len(s), part, np.int32)), pa.array(number == 0), pa.array(edges)], names=schema.names)

        for batch in batches:
            if not batch.num_rows:
                continue
            own_keys = [batch.column(i) for i in key_at]
            new = _starts(own_keys, before)
            s, c = transition_tables(new, step_codes(batch.column(event_at), steps), n)
            at = pa.array(np.flatnonzero(np.r_[True, new[1:]]))
            heads = [k.take(at) for k in own_keys]
            if open_s is not None and not new[0]:            # the open segment goes on
                c[0], s[0] = open_c + c[0][open_s], s[0][open_s]
            elif open_s is not None:
                s, c = np.vstack([open_s, s]), np.vstack([open_c, c])
                heads = [pa.concat_arrays([o, h]) for o, h in zip(open_keys, heads)]
            if len(s) > 1:
                yield rows([h.slice(0, len(s) - 1) for h in heads], s[:-1], c[:-1])
            open_keys, open_s, open_c = [h.slice(len(s) - 1) for h in heads], s[-1], c[-1]
            before = [k[-1].as_py() for k in own_keys]
        if open_s is not None:
            yield rows(open_keys, open_s[None, :], open_c[None, :], last=True)

    tables = stored(_ranged(src, keys, order, partitions).mapInArrow(local, schema), "segments")
    enters, goes_on, total, total_key, total_part = {}, set(), None, None, None
    for r in tables.filter(F.col(EDGE) > 0).orderBy(PART, EDGE).collect():
        key, entered = [r[k] for k in keys], (0, 0)
        if r[EDGE] & AT_START and total_key is not None and key == total_key:
            goes_on.add(total_part)
            enters[r[PART]] = total
        if r[FIRST]:
            entered = enters.get(r[PART], entered)
        if r[EDGE] & AT_END:
            total = (r["_s"][entered[0]], entered[1] + r["_c"][entered[0]])
            total_key, total_part = key, r[PART]
    parts = [(p, *enters.get(p, (0, 0)), p in goes_on) for p in sorted({*enters, *goes_on})]
    if parts:
        known = df.sparkSession.createDataFrame(parts, f"{PART} int, _stage int, _done long, _goes_on boolean")
        tables = tables.join(F.broadcast(known), PART, "left").filter(
            ~((F.col(EDGE) >= AT_END) & F.coalesce("_goes_on", F.lit(False))))
        stage = F.when(F.col(FIRST), F.coalesce("_stage", F.lit(0))).otherwise(0)
        done = F.when(F.col(FIRST), F.coalesce("_done", F.lit(0))).otherwise(0)
    else:
        stage, done = F.lit(0), F.lit(0)
    return tables.select(*keys, F.element_at("_s", stage + 1).alias("stage"),
                         (done + F.element_at("_c", stage + 1)).cast("long").alias("completed"))
