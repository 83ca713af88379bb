"""State of many keys is read and written by the group."""

import pandas as pd

from logsift.streaming.stateful import _FixedCount


class _State:
    def __init__(self, calls):
        self.calls, self.rows = calls, None

    def exists(self):
        return self.rows is not None

    def get(self):
        self.calls.append("get")
        return self.rows

    def put(self, rows):
        self.calls.append("put")
        self.rows = rows

    update = put

    def appendList(self, rows):  # noqa: N802
        self.put([*(self.rows or []), *rows])

    def clear(self):
        self.rows = None


class _Handle:
    def __init__(self):
        self.calls, self.timers = [], set()

    def getListState(self, *_):  # noqa: N802
        return _State(self.calls)

    getValueState = getListState  # noqa: N815

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.timers.remove(at)


class _Now:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.at


def test_calls_follow_groups_not_keys():
    handle, counter = _Handle(), _FixedCount(2, 1_000)
    counter.init(handle)
    keys = [None if k == 7 else str(k) for k in range(300)]
    rows = pd.DataFrame({"key": keys * 3, "at": [10] * 300 + [20] * 300 + [500] * 300, "id": range(900), "y": [0] * 300 + [1] * 300 + [0] * 300})
    list(counter.handleInputRows((0,), iter([rows]), None))
    assert handle.timers == {10}
    handle.timers.clear()  # it has fired
    got = pd.concat(counter.handleExpiredTimer((0,), _Now(30), None))
    assert len(got) == 300 and set(got.n) == {2} and set(got.y) == {1} and set(got.window_no) == {0}
    assert set(got.key.where(got.key.notna(), None)) == set(keys)
    assert handle.timers == {500}
    handle.timers.clear()
    rest = pd.concat(counter.handleExpiredTimer((0,), _Now(1_500), None))  # idle since 500: not full, and forgotten
    assert len(rest) == 300 and set(rest.window_no) == {1} and set(rest.n) == {1}
    assert not handle.timers and counter.open.rows is None and counter.waiting.rows is None
    assert len(handle.calls) < 30
