"""The freshness machine works row by row and knows its one timer from its state."""

from pyspark.sql import Row

from tidemark.streaming.streams import FreshnessMachine

HOUR = 3_600_000_000


class Handle:
    """State and timers of one key; timers cannot be listed."""

    def __init__(self):
        self.value, self.timers = None, set()

    def getValueState(self, *_):  # noqa: N802
        return self

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def registerTimer(self, due):  # noqa: N802
        self.timers.add(due)

    def deleteTimer(self, due):  # noqa: N802
        self.timers.remove(due)


def test_one_timer_that_follows_the_state():
    handle, machine = Handle(), FreshnessMachine(24, 1000, True)
    machine.init(handle)
    row = lambda h, x: Row(at=h * HOUR, value=x, verified=x is not None)
    assert [r.status for r in machine.handleInputRows((1,), iter([row(3, 2.0), row(1, 1.0)]), None)] == ["LIVE"]
    assert handle.timers == {27 * 3_600_000 + 1}
    got = list(machine.handleInputRows((1,), iter([row(30, 3.0), row(28, None)]), None))
    assert [(r.status, r.value, r.reason) for r in got] == [("STALE", 2.0, "EXPIRED"), ("STALE", 2.0, "HASH_MISMATCH"), ("LIVE", 3.0, None)]
    assert handle.timers == {54 * 3_600_000 + 1}
