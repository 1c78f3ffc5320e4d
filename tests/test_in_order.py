"""Rows put in order in state, with a handle that counts what it costs."""

from random import Random

import numpy as np
import pandas as pd
import pytest

from graphloom.streaming import changes
from graphloom.streaming.changes import InOrder

SECOND = 1_000_000


class State(dict):
    """A map or value state; every call is one round trip."""

    def __init__(self, calls):
        self.calls = calls

    def getValue(self, key):
        return self[key]

    def updateValue(self, key, value):
        self.calls.append("put")
        self[key] = value

    def removeKey(self, key):
        del self[key]

    def exists(self):
        return () in self

    def get(self):
        return self[()]

    def update(self, value):
        self[()] = value

    def clear(self):
        self.pop((), None)


class Handle:
    def __init__(self):
        self.calls, self.timers = [], []

    def getMapState(self, *_):
        return State(self.calls)

    getValueState = getMapState

    def registerTimer(self, ms):
        self.timers.append(ms)


class Watermark:
    def __init__(self, us):
        self.us = us

    def getCurrentWatermarkInMs(self):
        return self.us // 1000


class Seen(InOrder):
    def start(self, handle):
        self.steps = []

    def step(self, key, frame):
        self.steps.append(len(frame))
        return frame


def processor(width, late):
    out = Seen(width, late, ["v", "ts"])
    out.init(Handle())
    return out


def frame(rows):
    return pd.DataFrame({"v": [v for _, v in rows], "ts": pd.to_datetime([t for t, _ in rows], unit="us")})


def seen(frames):
    frames = list(frames)
    return [] if not frames else list(zip(*(pd.concat(frames)[c].tolist() for c in ("ts", "v"))))


def in_time(rows):
    return seen([frame(sorted(rows, key=lambda r: r[0]))])


def test_a_batch_of_few_rows_is_one_step_without_state():
    """Sixty rows in sixty blocks were sixty entries and sixty steps before."""
    at = processor(SECOND, late=False)
    rows = [((59 - i) * SECOND, i) for i in range(60)]
    assert seen(at.handleInputRows(("k",), iter([frame(rows[:30]), frame([]), frame(rows[30:])]), None)) == in_time(rows)
    assert at.steps == [60] and "put" not in at._handle.calls


@pytest.mark.parametrize("at_once", [1, 7, 50, 4096])
@pytest.mark.parametrize("late", [False, True])
def test_any_rows_come_in_order(monkeypatch, at_once, late):
    """Blocks of many rows, rows of one time in the order they came in, watermarks within blocks."""
    monkeypatch.setattr(changes, "AT_ONCE", at_once)
    rng, at, n, given, out = Random(at_once), processor(10 * SECOND, late), 0, [], []
    batches = []
    for _ in range(12):
        rows = [(rng.choice([rng.randrange(400), 15, 16]) * SECOND, n + i) for i in range(rng.randrange(0, 40))]
        n += len(rows)
        batches.append(rows)
    for rows in batches:
        given += rows
        got = seen(at.handleInputRows(("k",), iter([frame(rows[:9]), frame(rows[9:])]), None))
        if not late:
            assert got == in_time(rows)
    if late:
        for second in (0, 9, 10, 25, 160, 161, 399, 400):
            out += seen(at.handleExpiredTimer(("k",), Watermark(second * SECOND), None))
            done = second // 10 * 10 * SECOND
            assert out == in_time([r for r in given if r[0] < done])
        assert not at._parts
        # The next row wakes the key anew.
        list(at.handleInputRows(("k",), iter([frame([(500 * SECOND, n)])]), None))
        assert at._handle.timers[-1] == 510_000


def test_late_rows_of_a_batch_are_one_entry():
    at = processor(SECOND, late=True)
    list(at.handleInputRows(("k",), iter([frame([(i * SECOND, i) for i in range(60)])]), None))
    assert at._handle.calls == ["put"] and len(at._parts) == 1
    got = seen(at.handleExpiredTimer(("k",), Watermark(30 * SECOND), None))
    assert [v for _, v in got] == list(range(30)) and at._handle.timers == [1000, 31_000]
    assert np.array_equal(at.steps, [30])
