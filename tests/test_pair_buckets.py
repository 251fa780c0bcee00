"""The keys of a bucket are paired together: the rows of one key at a time, one read and one write of state for all."""

import numpy as np
import pandas as pd

from corpusflow.streaming.jobs import PairBuckets, PairSteps
from corpusflow.streaming.state import TIME


class Value:
    def __init__(self):
        self.held, self.calls = None, 0

    def get(self):
        self.calls += 1
        return self.held

    def update(self, value):
        self.calls += 1
        self.held = value

    def clear(self):
        self.held = None


class Handle:
    def __init__(self):
        self.values, self.timers = [], []

    def getValueState(self, *_):  # noqa: N802
        self.values.append(Value())
        return self.values[-1]

    def listTimers(self):  # noqa: N802
        return iter(list(self.timers))

    def deleteTimer(self, t):  # noqa: N802
        self.timers.remove(t)

    def registerTimer(self, t):  # noqa: N802
        self.timers.append(t)


class At:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.ms

    getExpiryTimeInMs = getCurrentWatermarkInMs  # noqa: N815


COLUMNS = ["run_id", "agent", "phase", "elapsed_ms", "duration_ms", "kind", "status"]


def drawn(rng, n):
    pick = lambda *values: [values[i] for i in rng.integers(0, len(values), n)]
    return pd.DataFrame({"run_id": pick("r1", "r2", "r3", None), "agent": pick("a", "b", None), "phase": pick("start", "end", None), "elapsed_ms": rng.integers(0, 40, n),
                         "duration_ms": pick(None, 7.0, -2.5), "kind": pick("db", "llm", None), "status": pick("ok", "no")}).astype({"duration_ms": float})


def listed(frames):
    return sorted((tuple(None if pd.isna(v) else v for v in r) for f in frames for r in f.itertuples(index=False)), key=str)


def test_a_bucket_gives_the_pairs_of_its_keys_with_one_read_and_one_write():
    rng = np.random.default_rng(1)
    handle, bucket, alone = Handle(), PairBuckets(None), {}
    bucket.init(handle)
    for batch in range(6):
        rows = drawn(rng, int(rng.integers(1, 120)))
        parts = [rows.iloc[:50], rows.iloc[50:]]
        found = listed(bucket.handleInputRows((3,), iter([p for p in parts if len(p)]), None))
        want = []
        for key, part in rows.groupby(["run_id", "agent"], dropna=False, sort=False):
            key = tuple(None if pd.isna(v) else v for v in key)
            if key not in alone:
                alone[key] = PairSteps(None)
                alone[key].init(Handle())
            want += list(alone[key].handleInputRows(key, iter([part]), None))
        assert found == listed(want)
        assert sum(v.calls for v in handle.values) == 2 * (batch + 1)
    assert len(alone) == 12


def test_a_key_that_is_due_is_forgotten_alone():
    handle, bucket = Handle(), PairBuckets(1000)
    bucket.init(handle)
    at = lambda ms: pd.to_datetime([ms], unit="ms")
    row = lambda run, phase, ms, time: pd.DataFrame([(run, "a", phase, ms, None, "k", "ok")], columns=COLUMNS).astype({"duration_ms": float}).assign(**{TIME: at(time)})
    send = lambda *rows: listed(bucket.handleInputRows((0,), iter(rows), None))
    assert send(row("x", "start", 1, 100), row("y", "start", 2, 500), row("z", "start", 3, 90), row("z", "end", 4, 95)) == [("z", "a", 1, "k", 1, "ok")]
    assert handle.timers == [1095]
    list(bucket.handleExpiredTimer((0,), At(1300), At(1095)))  # x and z are past the watermark, y is not
    assert handle.timers == [1500]
    assert send(row("x", "end", 9, 1400), row("y", "end", 9, 1400), row("z", "start", 1, 1400), row("z", "end", 4, 1400)) == [("y", "a", 1, "k", 7, "ok"), ("z", "a", 1, "k", 3, "ok")]
    assert handle.timers == [2400]
    list(bucket.handleExpiredTimer((0,), At(9000), At(2400)))
    assert handle.timers == [] and handle.values[0].held is None
