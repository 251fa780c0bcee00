"""Pairing of steps: one read and one write of state per key and batch."""

import pandas as pd

from corpusflow.streaming.jobs import PairSteps


class Value:
    def __init__(self):
        self.held, self.calls = None, 0

    def get(self):
        self.calls += 1
        return self.held

    def update(self, value):
        self.calls += 1
        self.held = value


class Handle:
    def __init__(self):
        self.values = []

    def getValueState(self, *_):  # noqa: N802
        self.values.append(Value())
        return self.values[-1]


def batch(*rows):
    return iter([pd.DataFrame([r], columns=["phase", "elapsed_ms", "duration_ms", "kind", "status"]) for r in rows])


def test_state_is_read_once_and_written_once():
    handle, steps = Handle(), PairSteps(None)
    steps.init(handle)
    first = batch(("start", 30, None, "c", "ok"), ("end", 50, None, "t", "ok"), ("start", 10, None, "c", "ok"), ("end", 60, 7.0, "t", "no"), ("start", 70, None, "c", "ok"))
    assert [list(map(tuple, out.to_numpy())) for out in steps.handleInputRows(("r", "a"), first, None)] == [[("r", "a", 1, "t", 40, "ok"), ("r", "a", 2, "t", 7, "no")]]
    assert sum(v.calls for v in handle.values) == 2
    second = steps.handleInputRows(("r", "a"), batch(("end", 75, None, "t", "ok")), None)
    assert [list(map(tuple, out.to_numpy())) for out in second] == [[("r", "a", 3, "t", 5, "ok")]]
    assert sum(v.calls for v in handle.values) == 4
