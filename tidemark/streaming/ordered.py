"""Rows of a key in order of event time, whatever order they arrive in.

A processor keeps a key's rows in state: up to ``CHUNK`` of them together, those of a busier key in chunks below
their time slot. Once the watermark has passed a slot's end no more rows of it can come; a timer then hands the rows
of all slots that are over on, sorted by time and tie-breaker, and drops them from the state. Slots of a key are
released in order. What is held at one time are ``CHUNK`` rows, or the rows of one slot of one key. A key with few
rows in many slots so costs a few state calls, not some for each of its slots.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessor

from tidemark.operators.ordering import MICROS
from tidemark.operators.ratelimit import ClientState, RateConfig, decide
from tidemark.operators.threats import ThreatPattern

CHUNK = 10_000


def _plain(values: pd.Series, kind: str) -> list:
    """Python values that a state column of this type takes; missing ones are None."""
    if kind in ("bigint", "int", "smallint", "tinyint"):
        return values.tolist() if values.dtype.kind == "i" else [None if pd.isna(v) else int(v) for v in values]
    if kind in ("double", "float"):
        return [None if pd.isna(v) else float(v) for v in values]
    return [None if v is None or v is pd.NaT else v for v in values]


class OrderedRelease(StatefulProcessor):
    """Base of processors that read a key's rows in order.

    Input rows have ``at_us``, microseconds of event time, and ``columns`` (name, type), of which the first breaks
    ties; nulls come first. Slots are ``release`` seconds long. Subclasses implement ``opened``, ``released`` and,
    for timers of their own, ``expired``.
    """

    def __init__(self, columns: Sequence[tuple[str, str]], release: int):
        if release < 1:
            raise ValueError("a slot lasts a second or more")
        self.columns, self.release = list(columns), release

    def init(self, handle) -> None:
        self.handle = handle
        value = ", ".join(["at_us array<bigint>", *(f"c{i} array<{kind}>" for i, (_, kind) in enumerate(self.columns))])
        # packed rows, their chunks and first slot; or the slots of a key with more
        self.held = handle.getValueState("held", "n int, chunks int, first bigint, slots array<bigint>")
        self.packed = handle.getMapState("packed", "chunk int", value)
        self.parts = handle.getMapState("parts", "slot bigint", "n int")
        self.waiting = handle.getMapState("waiting", "slot bigint, part int", value)
        self.opened(handle)

    def opened(self, handle) -> None:
        """Declare further state."""

    def released(self, key: tuple, batches: Iterator[list[tuple]], now_ms: int) -> Iterator[pd.DataFrame]:
        """Result for rows (at_us, *columns), sorted, in batches of one or more whole slots; the watermark is ``now_ms``."""
        raise NotImplementedError

    def expired(self, key: tuple, now_ms: int) -> None:
        """A timer that is the subclass's own."""

    def _slot(self, at_us: int) -> int:
        return at_us // (self.release * MICROS)

    def _wake(self, slot: int) -> None:
        self.handle.registerTimer((slot + 1) * self.release * 1000)

    def _unpack(self, chunks: int) -> list[tuple]:
        """The packed rows, taken out of the state."""
        rows: list[tuple] = []
        for chunk in range(chunks):
            rows += zip(*self.packed.getValue((chunk,)))
            self.packed.removeKey((chunk,))
        return rows

    def _put(self, rows: list[tuple], counts: dict[int, int], slots: set[int]) -> None:
        """Store rows below their slots."""
        by_slot: dict[int, list[tuple]] = {}
        for row in rows:
            by_slot.setdefault(self._slot(row[0]), []).append(row)
        for slot, own in by_slot.items():
            if slot not in counts:
                counts[slot] = self.parts.getValue((slot,))[0] if slot in slots else 0
                if slot not in slots:
                    slots.add(slot)
                    self._wake(slot)
            for begin in range(0, len(own), CHUNK):
                self.waiting.updateValue((slot, counts[slot]), tuple(list(c) for c in zip(*own[begin : begin + CHUNK])))
                counts[slot] += 1

    def handleInputRows(self, key, rows, timerValues):
        n, chunks, first, slots = self.held.get() or (0, 0, None, [])
        slots, counts = set(slots or []), {}
        for frame in rows:
            frame = frame[frame["at_us"].notna()]
            if not len(frame):
                continue
            values = [_plain(frame["at_us"], "bigint"), *(_plain(frame[name], kind) for name, kind in self.columns)]
            if not slots and n + len(frame) <= CHUNK:
                self.packed.updateValue((chunks,), tuple(values))
                n, chunks, earliest = n + len(frame), chunks + 1, self._slot(min(values[0]))
                if first is None or earliest < first:
                    first = earliest
                    self._wake(first)
                continue
            if n:
                self._put(self._unpack(chunks), counts, slots)
                n, chunks, first = 0, 0, None
            self._put(list(zip(*values)), counts, slots)
        for slot, count in counts.items():
            self.parts.updateValue((slot,), (count,))
        if n or slots:
            self.held.update((n, chunks, first, sorted(slots)))
        yield from ()

    def _taken(self, slots: list[int]) -> Iterator[list[tuple]]:
        """The rows of these slots, one slot at a time, taken out of the state."""
        for slot in slots:
            rows: list[tuple] = []
            for part in range(self.parts.getValue((slot,))[0]):
                rows += zip(*self.waiting.getValue((slot, part)))
                self.waiting.removeKey((slot, part))
            self.parts.removeKey((slot,))
            rows.sort(key=_in_order)
            yield rows

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        # a slot that ends at the watermark is over: rows up to the watermark are late
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        over = now // (self.release * 1000)
        n, chunks, first, slots = self.held.get() or (0, 0, None, [])
        done = [slot for slot in slots or [] if slot < over]
        if first is not None and first < over:
            rows = sorted(self._unpack(chunks), key=_in_order)
            ready = bisect_left(rows, over * self.release * MICROS, key=lambda r: r[0])
            later = rows[ready:]
            if later:
                self.packed.updateValue((0,), tuple(list(c) for c in zip(*later)))
                self.held.update((len(later), 1, self._slot(later[0][0]), []))
                self._wake(self._slot(later[0][0]))
            else:
                self.held.clear()
            yield from self.released(key, iter([rows[:ready]]), now)
        elif done:
            left = [slot for slot in slots if slot >= over]
            if left:
                self.held.update((0, 0, None, left))
            else:
                self.held.clear()
            yield from self.released(key, self._taken(done), now)
        else:
            self.expired(key, now)

    def close(self) -> None:
        pass


def _in_order(row: tuple) -> tuple:
    return row[0], row[1] is not None, row[1] if row[1] is not None else 0


class RateProcessor(OrderedRelease):
    """Accepted times and block end per client; idle clients are forgotten after two hours."""

    def __init__(self, config: RateConfig, client: str, tie: str, kind: str, release: int):
        super().__init__([(tie, kind)], release)
        self.config, self.client, self.tie = config, client, tie
        self.idle_ms = max(2 * 3600, config.memory) * 1000

    def opened(self, handle) -> None:
        self.state = handle.getValueState("limits", "accepted array<bigint>, blocked_until bigint, last_ms bigint")

    def released(self, key, batches, now_ms):
        held = self.state.get()
        client = ClientState(held[0], held[1]) if held else ClientState()
        for rows in batches:
            for begin in range(0, len(rows), CHUNK):
                part = rows[begin : begin + CHUNK]
                verdicts = decide(client, [r[0] for r in part], self.config)
                yield pd.DataFrame({self.client: [key[0]] * len(part), self.tie: [r[1] for r in part], "verdict": verdicts})
            last = rows[-1][0] // 1000
        if last + self.idle_ms > now_ms:
            self.state.update((list(client.accepted), client.blocked_until, last))
            self.handle.registerTimer(last + self.idle_ms)
        elif held:
            self.state.clear()

    def expired(self, key, now_ms):
        # a later request has its own, later timer
        if self.state.exists() and self.state.get()[2] + self.idle_ms <= now_ms:
            self.state.clear()


class ChainProcessor(OrderedRelease):
    """Links a log's entries; the state is the last number and hash, which every later entry goes on from."""

    def __init__(self, id: str, kind: str, release: int):
        super().__init__([(id, kind), ("content", "string"), ("entry", "string")], release)

    def opened(self, handle) -> None:
        self.tail = handle.getValueState("tail", "seq bigint, chain_hash string")

    def released(self, key, batches, now_ms):
        seq, last = self.tail.get() or (-1, None)
        for rows in batches:
            for begin in range(0, len(rows), CHUNK):
                links = []
                for _, _, content, entry in rows[begin : begin + CHUNK]:
                    new = None if content is None else hashlib.sha256((content + (last or "")).encode()).hexdigest()
                    seq += 1
                    links.append((key[0], entry, seq, last, new))
                    last = new
                yield pd.DataFrame(links, columns=["log", "entry", "seq", "previous_hash", "chain_hash"])
        self.tail.update((seq, last))


class ThreatProcessor(OrderedRelease):
    """Windowed patterns over a source's events, each with a window of its own.

    Counts look back over a pattern's window, across slots; the state holds, per pattern, the times that a later
    event can still see. Bytes (NaN counts as missing) are summed over windows that start at multiples of their
    length, so a slot must hold whole ones. Gives a row per slot and pattern that fires.
    """

    def __init__(self, patterns: Sequence[ThreatPattern], source: str, release: int):
        super().__init__([("failed", "boolean"), ("bytes", "double")], release)
        self.patterns, self.source = list(patterns), source
        for p in self.patterns:
            if p.kind not in ("failures", "requests", "bytes"):
                raise ValueError(f"unknown pattern kind: {p.kind}")
            if p.kind == "bytes" and release * MICROS % p.window:
                raise ValueError("a slot must hold whole windows of bytes")
        self.look_back_ms = max((p.window // 1000 for p in self.patterns if p.kind != "bytes"), default=0)

    def opened(self, handle) -> None:
        self.recent = handle.getMapState("recent", "kind string", "at_us array<bigint>")

    def _counted(self, times, p: ThreatPattern, tail):
        """How many events each event sees in ``(t - window, t]``, itself and its equals included."""
        whole = np.concatenate([tail, times])
        return np.searchsorted(whole, times, "right") - np.searchsorted(whole, times - p.window, "right")

    def _fires(self, p: ThreatPattern, slots, values) -> list[tuple]:
        """(pattern, slot, detections, peak) of detections with their slots, ascending."""
        starts = np.flatnonzero(np.diff(slots, prepend=slots[:1] - 1))
        counts = np.diff(np.append(starts, len(slots)))
        peaks = np.maximum.reduceat(values, starts) if len(starts) else []
        return [(p, int(slots[i]), int(n), float(peak)) for i, n, peak in zip(starts, counts, peaks)]

    def released(self, key, batches, now_ms):
        kinds = [k for k in ("requests", "failures") if any(p.kind == k for p in self.patterns)]
        stored = {k: (self.recent.getValue((k,)) or ([],))[0] for k in kinds}
        tails = {k: np.array(list(v), np.int64) for k, v in stored.items()}
        out: list[tuple] = []
        for rows in batches:
            at = np.array([r[0] for r in rows], np.int64)
            end = (self._slot(int(at[-1])) + 1) * self.release * MICROS
            failed = np.array([bool(r[1]) for r in rows])
            for kind in kinds:
                times = at if kind == "requests" else at[failed]
                own = [p for p in self.patterns if p.kind == kind]
                for p in own if len(times) else []:
                    seen = self._counted(times, p, tails[kind])
                    hit = seen >= p.threshold if kind == "failures" else seen > p.threshold
                    out += self._fires(p, self._slot(times[hit]), seen[hit])
                whole = np.concatenate([tails[kind], times])
                tails[kind] = whole[whole > end - max(p.window for p in own)]
            size = np.array([r[2] or 0.0 for r in rows])
            known = np.array([r[2] is not None for r in rows])
            for p in self.patterns:
                if p.kind == "bytes":
                    windows, member = np.unique(at // p.window, return_inverse=True)
                    sums = np.bincount(member, size, len(windows))
                    hit = (sums >= p.threshold) & (np.bincount(member, known, len(windows)) > 0)
                    out += self._fires(p, self._slot(windows[hit] * p.window), sums[hit])
        for kind in kinds:
            # what an event after the watermark can still see
            reach = max(p.window for p in self.patterns if p.kind == kind)
            whole = tails[kind][tails[kind] > now_ms * 1000 - reach]
            if len(whole):
                self.recent.updateValue((kind,), (whole.tolist(),))
                self.handle.registerTimer(now_ms + self.look_back_ms)
            elif len(stored[kind]):
                self.recent.removeKey((kind,))
        if out:
            yield pd.DataFrame({
                self.source: [key[0]] * len(out), "slot": [pd.Timestamp(slot * self.release, unit="s") for _, slot, _, _ in out],
                "pattern": [p.id for p, *_ in out], "severity": [p.severity for p, *_ in out],
                "detections": [n for _, _, n, _ in out], "peak": [peak for *_, peak in out]})

    def expired(self, key, now_ms):
        for kind in ("requests", "failures"):
            if self.recent.containsKey((kind,)):
                times = list(self.recent.getValue((kind,))[0])
                if times and times[-1] // 1000 + self.look_back_ms <= now_ms:
                    self.recent.removeKey((kind,))
