"""Ordered release against a state held in dictionaries, with its calls counted."""

from types import SimpleNamespace

import pandas as pd

from tidemark.operators.ratelimit import RateConfig
from tidemark.operators.threats import ThreatPattern
from tidemark.streaming import ordered

DAY_US = 86_400_000_000


class Store:
    """Value and map states and timers of one key."""

    def __init__(self):
        self.calls, self.timers, self.kept = 0, set(), {}

    def getValueState(self, name, *schema):
        return Cell(self, self.kept.setdefault(name, {}))

    getMapState = getValueState

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)


class Cell:
    def __init__(self, store, data):
        self.store, self.data = store, data

    def _count(self, result=None):
        self.store.calls += 1
        return result

    def exists(self):
        return self._count(() in self.data)

    def get(self):
        return self._count(self.data.get(()))

    def update(self, value):
        self._count(self.data.update({(): value}))

    def clear(self):
        self._count(self.data.clear())

    def containsKey(self, key):
        return self._count(key in self.data)

    def getValue(self, key):
        return self._count(self.data.get(key))

    def updateValue(self, key, value):
        self._count(self.data.update({key: value}))

    def removeKey(self, key):
        self._count(self.data.pop(key, None))


def feed(processor, batches, store):
    """Each batch is (frames, watermark in ms); timers go off in order."""
    processor.init(store)
    out = []
    for frames, mark in batches:
        times = SimpleNamespace(getCurrentWatermarkInMs=lambda mark=mark: mark)
        out += processor.handleInputRows((7,), iter(frames), times)
        for at in sorted(t for t in store.timers if t <= mark):
            store.timers.discard(at)
            out += processor.handleExpiredTimer((7,), times, SimpleNamespace(getExpiryTimeInMs=lambda at=at: at))
    return pd.concat([f for f in out if len(f)], ignore_index=True)


def requests(days, each, start=0):
    """``each`` requests on every day, newest first."""
    at = [d * DAY_US + i * 1_000_000 for d in range(start, start + days) for i in range(each)][::-1]
    return pd.DataFrame({"at_us": at, "id": range(len(at))})


LIMITS = RateConfig(per_minute=4, per_hour=8, burst=3)


def test_few_rows_in_many_slots_take_few_state_calls():
    store = Store()
    got = feed(ordered.RateProcessor(LIMITS, "client", "id", "bigint", 86_400), [([requests(31, 2)], 40 * 86_400_000)], store)
    assert len(got) == 62 and got["id"].tolist() == sorted(range(62), reverse=True)
    assert store.calls < 31
    assert not any(store.kept.values())


def test_packed_and_slotted_rows_give_the_same(monkeypatch):
    """Rows beyond the packed ones go to slots; some slots stay for a later watermark."""
    batches = lambda: [([requests(5, 20)], 2 * 86_400_000 + 1), ([requests(4, 9, start=3)], 5 * 86_400_000), ([], 40 * 86_400_000)]
    make = lambda: ordered.RateProcessor(LIMITS, "client", "id", "bigint", 86_400)
    want = feed(make(), batches(), Store())
    assert len(want) == 136 and want["verdict"].nunique() > 2
    for chunk in (7, 50, 110):
        monkeypatch.setattr(ordered, "CHUNK", chunk)
        store = Store()
        assert feed(make(), batches(), store).equals(want)
        assert not any(store.kept.values())


def test_threats_look_back_over_packed_and_slotted_rows(monkeypatch):
    patterns = [p for p in (
        ThreatPattern("f", "failures", "High", 300_000_000, 3), ThreatPattern("r", "requests", "Low", 60_000_000, 2),
        ThreatPattern("b", "bytes", "High", 60_000_000, 5.0))]
    rows = pd.DataFrame({"at_us": [i * 17_000_000 for i in range(60)][::-1]})
    rows["failed"], rows["bytes"] = rows["at_us"] % 2_000_000 == 0, [float(i % 4) if i % 5 else None for i in range(60)]
    batches = lambda: [([rows.iloc[30:]], 300_000), ([rows.iloc[:30]], 3_600_000)]
    columns = ["slot", "pattern"]
    want = feed(ordered.ThreatProcessor(patterns, "source", 60), batches(), Store()).sort_values(columns, ignore_index=True)
    assert set(want["pattern"]) == {"f", "r", "b"}
    monkeypatch.setattr(ordered, "CHUNK", 4)
    store = Store()
    assert feed(ordered.ThreatProcessor(patterns, "source", 60), batches(), store).sort_values(columns, ignore_index=True).equals(want)
    at, seen = sorted(rows["at_us"]), 0
    for t in at:
        seen += sum(t - 60_000_000 < u <= t for u in at) > 2
    assert want[want["pattern"] == "r"]["detections"].sum() == seen
