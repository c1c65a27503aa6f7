"""Processors over rows that arrive out of order, checked without a stream:
the state handles are plain stand-ins."""

import numpy as np
import pandas as pd

from eddyline.streaming import processors as P


class Value:
    def __init__(self):
        self.v = None

    def exists(self):
        return self.v is not None

    def get(self):
        return self.v

    def update(self, v):
        self.v = v

    put = update

    def clear(self):
        self.v = None


class Handle:
    def __init__(self):
        self.timers = set()

    def getValueState(self, *_):
        return Value()

    getListState = getValueState

    def registerTimer(self, t):
        self.timers.add(t)

    def deleteTimer(self, t):
        self.timers.discard(t)


class Clock:
    def __init__(self, watermark):
        self.w = watermark

    def getCurrentWatermarkInMs(self):
        return self.w


def frame(secs, **cols):
    return pd.DataFrame({"event_id": [f"e{s}" for s in secs],
                         "event_time": pd.to_datetime(pd.Series(secs, dtype="int64"), unit="s", utc=True), **cols})


def feed(proc, batches, watermarks):
    handle = Handle()
    proc.init(handle)
    out = []
    for b, w in zip(batches, watermarks):
        out += list(proc.handleInputRows(("k",), iter([b]), Clock(w * 1000)))
        for t in sorted(x for x in handle.timers if x <= w * 1000):
            handle.timers.discard(t)
            out += list(proc.handleExpiredTimer(("k",), Clock(w * 1000), None))
    return pd.concat(out) if out else pd.DataFrame()


def test_session_starts_at_its_earliest_event():
    got = feed(P.SessionProcessor(60_000), [frame([100]), frame([95, 300]), frame([])], [0, 0, 200])
    assert [(r.session_start.timestamp(), r.session_end.timestamp(), r.event_count)
            for r in got.itertuples()] == [(95, 160, 2)]


def test_sessions_for_any_split_of_shuffled_rows():
    rng = np.random.default_rng(2)
    secs = rng.choice(5000, 80, replace=False).tolist()
    results = []
    for parts in (1, 3, 5):
        cut = [frame(list(c)) for c in np.array_split(secs, parts)] + [frame([])]
        got = feed(P.SessionProcessor(60_000), cut, [0] * parts + [10_000])
        results.append(sorted((r.session_start, r.session_end, r.event_count) for r in got.itertuples()))
    assert results[0] == results[1] == results[2]
    assert sum(r[2] for r in results[0]) == 80


def test_last_type_keeps_the_newest_row():
    got = feed(P.LastTypeProcessor(), [frame([100], event_type=["buy"]), frame([90], event_type=["view"])], [0, 0])
    assert got.iloc[-1].to_dict() == {"key": "k", "running_count": 2, "last_event_type": "buy"}


def test_recent_list_is_ordered_by_time():
    got = feed(P.RecentListProcessor(2), [frame([100, 110]), frame([50, 105])], [0, 0])
    assert got.iloc[-1]["recent"] == "e105,e110"


def test_inactivity_timer_never_moves_back():
    proc = P.InactivityProcessor(60_000)
    got = feed(proc, [frame([100]), frame([95]), frame([])], [0, 0, 158])
    assert [r.last_event_time.timestamp() for r in got.itertuples()] == []
    got = feed(P.InactivityProcessor(60_000), [frame([100, 300]), frame([150]), frame([])], [90, 90, 400])
    assert [r.last_event_time.timestamp() for r in got.itertuples()] == [150, 300]


def test_click_never_takes_a_later_view():
    view, click = frame([100], is_left=[True]), frame([95, 130, 4000], is_left=[False] * 3)
    got = feed(P.CoProcessor(3_600_000), [view, click], [0, 0])
    assert got["view_id"].tolist() == [None, "e100", None]
    late = frame([40], is_left=[True])
    got = feed(P.CoProcessor(3_600_000), [view, late, frame([110], is_left=[False])], [0, 0, 0])
    assert got["view_id"].tolist() == ["e100"]


def test_click_behind_a_newer_view_finds_its_own():
    views = [frame([100], is_left=[True]), frame([500], is_left=[True])]
    got = feed(P.CoProcessor(60_000), [*views, frame([120], is_left=[False])], [0, 90, 90])
    assert got["view_id"].tolist() == ["e100"]
    proc = P.CoProcessor(60_000)
    feed(proc, [*views, frame([450], is_left=[False])], [0, 90, 400])
    assert [v[0] for v in proc._held()] == [500_000]          # state follows the watermark
    feed(proc, [frame([500], is_left=[True]), frame([], is_left=[])], [0, 561])
    assert not proc._held()


def test_null_ids_at_equal_times():
    """A null id sorts first at its time, as in SQL, and nothing fails."""
    rows = frame([100, 100, 100])
    rows["event_id"] = ["b", None, "a"]
    got = feed(P.RecentListProcessor(2), [rows, rows], [0, 0])
    assert got.iloc[-1]["recent"] == "b,b" and got.iloc[-1]["n_recent"] == 2
    got = feed(P.RecentListProcessor(3), [rows], [0])
    assert got.iloc[-1]["recent"] == "a,b" and got.iloc[-1]["n_recent"] == 3
    views = frame([100, 100], is_left=[True, True])
    views["event_id"] = ["v", None]
    clicks = frame([100, 100], is_left=[False, False])
    clicks["event_id"] = ["x", None]
    got = feed(P.CoProcessor(60_000), [pd.concat([views, clicks], ignore_index=True)], [0])
    assert dict(zip(got["click_id"].astype(object).where(got["click_id"].notna(), None), got["view_id"])) == {"x": "v", None: None}


def test_clicks_without_a_time_are_emitted_unmatched():
    rows = frame([100, 110], is_left=[True, False])
    rows.loc[len(rows)] = ["c", pd.NaT, False]
    got = feed(P.CoProcessor(60_000), [rows], [0])
    assert sorted(zip(got["click_id"], got["view_id"].fillna(""), got["click_time"].isna())) == [
        ("c", "", True), ("e110", "e100", False)]


def test_running_sum_goes_on_over_batches():
    got = feed(P.RunningSumProcessor(), [frame([2, 1], value=[5, 7]), frame([3, 4], value=[None, 1])], [0, 0])
    assert got["event_id"].tolist() == ["e1", "e2", "e3", "e4"] and got["running_sum"].tolist() == [7, 12, 12, 13]
