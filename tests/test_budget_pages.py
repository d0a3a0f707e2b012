"""The budget stream's state: few messages for many rows, and pages of ids and charges that lose none."""

import datetime as dt
import random

import pytest
from pyspark.sql import Row

from cinderloom.streaming import budget

DAY = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


class Held:
    """A value or a map that counts what is asked of it."""

    def __init__(self, counts):
        self.counts, self.value, self.map = counts, None, {}

    def __getattribute__(self, name):
        if name not in ("counts", "value", "map", "__class__"):
            object.__getattribute__(self, "counts").append(name)
        return object.__getattribute__(self, name)

    def get(self):
        return self.value

    def exists(self):
        return self.value is not None

    def update(self, value):
        self.value = value

    def getValue(self, key):
        return self.map.get(key)

    def containsKey(self, key):
        return key in self.map

    def updateValue(self, key, value):
        self.map[key] = value

    def removeKey(self, key):
        self.map.pop(key, None)

    def iterator(self):
        return iter(list(self.map.items()))

    def clear(self):
        self.value = None
        self.map.clear()


class Handle:
    def __init__(self):
        self.counts, self.timers = [], set()

    def getValueState(self, *_):
        return Held(self.counts)

    def getMapState(self, *_):
        return Held(self.counts)

    def listTimers(self):
        return iter(list(self.timers))

    def deleteTimer(self, at):
        self.timers.discard(at)

    def registerTimer(self, at):
        self.timers.add(at)


def made(rng, n):
    return [Row(run_id=1, attempt_id=(i * 7919) << 12, ord=i // 2, tokens=rng.choice([None, 0.0, 10.0, 25.0]), ts=DAY + dt.timedelta(minutes=i)) for i in range(n)]


def rule(rows, limit):
    total = 0.0
    for r in sorted({x.attempt_id: x for x in rows}.values(), key=lambda x: (x.ord, x.attempt_id)):
        total += r.tokens or 0.0
        if total >= limit - 1e-9:
            return r.ord
    return None


def ledger(limit):
    one, handle = budget.BudgetLedger(limit), Handle()
    one.init(handle)
    return one, handle


def test_state_is_not_asked_for_each_row():
    one, handle = ledger(1e9)
    rows = made(random.Random(1), 1000)
    assert [r.attempts for r in one.handleInputRows((1,), iter(rows), None)] == [1000]
    assert len(handle.counts) <= 20


@pytest.mark.parametrize("limit", [0.0, 500.0, 3000.0, 1e9])
@pytest.mark.parametrize("block", [5, 64])
def test_pages_give_the_rule(monkeypatch, limit, block):
    monkeypatch.setattr(budget, "PAGE", 4)
    monkeypatch.setattr(budget, "BLOCK", block)
    rng = random.Random(block)
    rows = made(rng, 900)
    dealt = rows[:]
    rng.shuffle(dealt)
    one, handle = ledger(limit)
    sent = []
    for at in range(0, 900, 150):
        part = dealt[at : at + 150] + rng.sample(sent, min(len(sent), 60)) + dealt[at : at + 9]
        sent += dealt[at : at + 150]
        (told,) = one.handleInputRows((1,), iter(part), None)
        assert (told.attempts, told.last_ord, told.stop_at) == (len(sent), max(r.ord for r in sent), rule(sent, limit))
        assert told.spent == sum(r.tokens or 0.0 for r in sent)
        assert handle.timers == {int(max(r.ts for r in sent).timestamp() * 1000) + budget.IDLE}
    assert list(one.handleInputRows((1,), iter(rows), None)) == []
    # An id stands in one page, and none is in two.
    held = [i for page in one.seen.map.values() for i in budget._ids(page[0]).tolist()] + budget._ids(one.total.value[7]).tolist()
    assert sorted(held) == sorted(r.attempt_id for r in rows)
    (closed,) = one.handleExpiredTimer((1,), None, None)
    assert closed.closed and closed.attempts == 900
    assert one.total.value is None and not one.seen.map and not one.open.map
