"""Keyed state is read and written once for a batch's rows of a key: a call to the state's server costs as much as some hundred rows."""

from collections import Counter
from types import SimpleNamespace

import pytest
from pyspark.sql import Row

from krylake.streaming import assimilation as a


class Handle:
    """The state of one key, in memory; counts the calls."""

    def __init__(self):
        self.calls, self.value, self.timers = Counter(), None, set()

    def getValueState(self, name, schema, ttl=None):
        def update(value):
            self.calls["update"] += 1
            self.value = value

        def get():
            self.calls["get"] += 1
            return self.value

        return SimpleNamespace(get=get, update=update)

    def registerTimer(self, ms):
        self.calls["timer"] += 1
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.timers.discard(ms)


@pytest.mark.parametrize("make", [lambda: a.Trails("k", 80), lambda: a.Incidents("k", "error", "signup", 3600), lambda: a.Settings("k", "signup", None)])
def test_state_calls_do_not_grow_with_rows(make):
    handle, processor = Handle(), make()
    processor.init(handle)
    for first in (0, 500):
        handle.calls.clear()
        rows = [Row(at=e * 1_000_000, event_id=e, event_type="error", action="error", value=float(e)) for e in range(first, first + 500)]
        assert len(list(processor.handleInputRows((7,), iter(rows), None))) == 1
        assert sum(handle.calls.values()) <= 3
        assert len(handle.timers) <= 1


def test_timer_frees_what_has_lasted():
    handle, processor = Handle(), a.Incidents("k", "error", "signup", 10)
    processor.init(handle)
    rows = [Row(at=e * 1_000_000, event_id=e, event_type="error") for e in (1, 5)]
    assert next(processor.handleInputRows((7,), iter(rows), None))["active"] == 2
    (ends,) = handle.timers
    assert ends == 15_000
    list(processor.handleExpiredTimer((7,), None, SimpleNamespace(getExpiryTimeInMs=lambda: ends)))
    assert handle.value[3] == [] and handle.value[0] == 5_000_000
