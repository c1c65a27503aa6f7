"""Bucketed processors against the processors by key, without a stream: the
state handles are plain stand-ins."""

from collections import Counter

import numpy as np
import pandas as pd
import pytest

from eddyline.plans import inputs
from eddyline.streaming import bucketed as B
from eddyline.streaming import processors as P
from eddyline.streaming import stateful


class State(dict):
    updateValue = dict.__setitem__

    def exists(self):
        return bool(self)

    def getValue(self, k):
        return self[k] if k in self else None

    def get(self):
        return self["v"]

    def update(self, v):
        self["v"] = v

    put = update


class Handle:
    def __init__(self):
        self.timers = set()

    def getValueState(self, *_):
        return State()

    getListState = getMapState = getValueState

    def registerTimer(self, t):
        self.timers.add(t)

    def deleteTimer(self, t):
        self.timers.discard(t)


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms

    getCurrentProcessingTimeInMs = getCurrentWatermarkInMs

    getExpiryTimeInMs = getCurrentWatermarkInMs


class Run:
    def __init__(self, proc, key):
        self.proc, self.key, self.handle, self.out = proc, (key,), Handle(), []
        proc.init(self.handle)

    def batch(self, frames, ms):
        if frames:
            self.out += self.proc.handleInputRows(self.key, iter(frames), Clock(ms)) or []
        for t in sorted(t for t in self.handle.timers if t <= ms):
            self.handle.timers.discard(t)
            self.out += self.proc.handleExpiredTimer(self.key, Clock(ms), Clock(t))


def plain(frames):
    return Counter(tuple("null" if pd.isna(v) else str(v) if not isinstance(v, (int, float, np.number)) else float(v) for v in r)
                   for f in frames for r in f.itertuples(index=False))


def batches(seed, n=4):
    rng = np.random.default_rng(seed)
    out = []
    for b in range(n):
        frames = []
        for _ in range(2):
            m = 60
            secs = rng.integers(b * 500, b * 500 + 900, m)
            at = pd.Series(pd.to_datetime(secs, unit="s", utc=True)).where(rng.random(m) > 0.1)
            frames.append(pd.DataFrame({
                "key": rng.choice(np.array(["a", "b", "c", None], dtype=object), m), "event_id": [None if rng.random() < 0.05 else str(rng.integers(0, 999)) for _ in range(m)],
                "event_time": at, "event_type": rng.choice(np.array(["view", "buy", None], dtype=object), m),
                "value": pd.Series(rng.integers(-5, 50, m), dtype="float64").where(rng.random(m) > 0.2)}))
        out.append(frames)
    return out


CASES = [
    (B.BucketSessions(60_000), lambda: P.SessionProcessor(60_000)),
    (B.BucketInactivity(60_000), lambda: P.InactivityProcessor(60_000)),
    (B.BucketInactivity(300_000, True), lambda: P.InactivityProcessor(300_000, True)),
    (B.BucketTotals(), P.FoldProcessor),
    (B.BucketProfile(), P.KeyProfileProcessor),
    (B.BucketRecent(3), lambda: P.RecentListProcessor(3)),
    (B.BucketLastType(), P.LastTypeProcessor),
    (B.BucketCount(), P.CountProcessor),
]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("bucket,single", CASES)
def test_a_bucket_gives_what_its_keys_give(bucket, single, seed):
    whole, own = Run(bucket, 0), {}
    for b, frames in enumerate(batches(seed)):
        ms = b * 500_000
        for k in ["a", "b", "c", None]:
            mine = [f[f["key"].isna() if k is None else f["key"] == k].reset_index(drop=True) for f in frames]
            own.setdefault(k, Run(single(), k)).batch([f for f in mine if len(f)], ms)
        whole.batch(frames, ms)
    for run in (whole, *own.values()):
        run.batch([], 10**9)
    assert whole.out and plain(whole.out) == plain([f for r in own.values() for f in r.out])


def test_one_group_serves_many_keys(spark, sf_small):
    out = stateful.manual_sessions_stream(inputs.event_stream(spark, sf_small).withWatermark("event_time", "10 seconds"), "2 hours")
    assert B.BUCKET in out._jdf.queryExecution().logical().toString()


def test_seeds_of_a_bucket():
    proc = B.BucketSeededCount(1000)
    proc.init(Handle())
    for part in (["a", None], ["b", "c"]):
        proc.handleInitialState((0,), pd.DataFrame({"key": part, "seed": 1000}), Clock(0))
    out = list(proc.handleInputRows((0,), iter([pd.DataFrame({"key": ["a", "a", None]})]), Clock(0)))
    proc.seeds.value.clear()                                  # expired
    out += proc.handleInputRows((0,), iter([pd.DataFrame({"key": ["a", "b"]})]), Clock(0))
    assert plain(out) == Counter({("a", 1002.0, 2.0): 1, ("null", 1001.0, 1.0): 1, ("a", 1003.0, 3.0): 1, ("b", 1.0, 1.0): 1})


def test_counts_of_a_bucket_expire_by_key():
    proc = B.BucketCount(ttl_ms=100)
    proc.init(Handle())
    got = []
    for keys, now in ((["a", "b"], 0), (["a"], 60), (["a", "b"], 110), (["b", "a"], 210)):
        got.append(plain(proc.handleInputRows((0,), iter([pd.DataFrame({"key": keys})]), Clock(now))))
    assert got[2] == Counter({("a", 3.0): 1, ("b", 1.0): 1}) and got[3] == Counter({("a", 1.0): 1, ("b", 1.0): 1})
