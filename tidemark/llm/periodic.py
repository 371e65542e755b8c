"""Runs of words that repeat with a period: minimizers of many scales as seeds, lag scans for short periods."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import compress

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 4 << 20
FIRST_SCALE = 16  # shorter periods are scanned lag by lag
RUN = "struct<start:long,length:long,period:long>"


def _mixed(x):
    """64-bit integers to well mixed ones, one to one."""
    import numpy as np

    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _ahead(x, by: int, fill: int):
    """``x[i + by]`` for every i, ``fill`` beyond the end."""
    import numpy as np

    out = np.full_like(x, fill)
    out[: max(0, len(x) - by)] = x[by:]
    return out


def _extent(ids, at: int, lag: int) -> tuple[int, int]:
    """The largest range around ``at`` in which every word equals the one ``lag`` words on."""
    import numpy as np

    first, last, step = at, at, 64
    while last + lag < len(ids):
        stop = min(last + step, len(ids) - lag)
        odd = np.flatnonzero(ids[last:stop] != ids[last + lag : stop + lag])
        if len(odd):
            last += int(odd[0])
            break
        last, step = stop, step * 2
    step = 64
    while first > 0:
        begin = max(0, first - step)
        odd = np.flatnonzero(ids[begin:first] != ids[begin + lag : first + lag])
        if len(odd):
            first = begin + int(odd[-1]) + 1
            break
        first, step = begin, step * 2
    return first, last


def _is_smallest(ids, start: int, period: int) -> bool:
    """No proper divisor of ``period`` is a period of the ``period`` words from ``start`` on."""
    import numpy as np

    rest, prime = period, 2
    while rest > 1:
        if prime * prime > rest:
            prime = rest
        if rest % prime:
            prime += 1
            continue
        part = period // prime
        if np.array_equal(ids[start : start + period - part], ids[start + part : start + period]):
            return False
        while rest % prime == 0:
            rest //= prime
    return True


def _seeds(names, scale: int):
    """Pairs (position, lag) with ``scale <= lag < 2 * scale`` of equal minimizers.

    ``names`` holds one value for the ``scale / 4`` words from each position on. A position whose value is the
    least of the ``scale / 2`` positions from it on is a minimizer. Of minimizers of one value that follow each
    other within ``scale / 8``, which happens inside shorter periods, only the first counts, so a value has at
    most 16 of them within two scales. A run of at least three periods holds its least value once a period at
    least, always as a minimizer, and some of those begin a chain; two such, a period apart, lie inside the run.
    """
    import numpy as np

    top = np.iinfo(names.dtype).max
    least, width = names, 1
    while width < scale // 2:
        least = np.minimum(least, _ahead(least, width, top))
        width *= 2
    at = np.flatnonzero(names == least)
    at = at[np.argsort(names[at], kind="stable")]
    value = names[at]
    follows = np.zeros(len(at), bool)
    follows[1:] = (value[1:] == value[:-1]) & (at[1:] - at[:-1] <= scale // 8)
    at, value = at[~follows], value[~follows]
    found = []
    for step in range(1, 17):
        lag = at[step:] - at[: len(at) - step]
        near = (value[step:] == value[: len(at) - step]) & (lag < 2 * scale)
        if not near.any():
            break
        near &= lag >= scale
        found.append((at[: len(at) - step][near], lag[near]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([p for p, _ in found]), np.concatenate([d for _, d in found])


def find_runs(ids, lengths, min_length: int = 24, min_periods: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs in concatenated documents, each followed by an id of its own.

    ``lengths`` counts the words of the documents without that id. A lag that holds over two periods cannot pass
    the id between two documents. Lags below ``FIRST_SCALE`` are compared position by position; beyond, seeds are
    extended. Names are 64-bit hashes and only propose; words decide.
    """
    import numpy as np

    found = []
    long_enough = lambda matched, lag: matched >= max(min_length - lag, (min_periods - 1) * lag)
    for lag in range(1, min(FIRST_SCALE, len(ids))):
        odd = np.concatenate([[-1], np.flatnonzero(ids[:-lag] != ids[lag:]), [len(ids) - lag]])
        gaps = np.diff(odd) - 1
        for i in np.flatnonzero(long_enough(gaps, lag)).tolist():
            start = int(odd[i]) + 1
            if _is_smallest(ids, start, lag):
                found.append((start, int(gaps[i]) + lag, lag))
    lengths = np.asarray(lengths, np.int64)
    origin = np.arange(len(ids))
    names, gram, scale = _mixed(ids.view(np.uint64)), 1, FIRST_SCALE
    while True:
        own = lengths >= min_periods * scale
        if not own.any():
            return found
        if not own.all():
            stay = np.repeat(own, lengths + 1)
            ids, names, origin, lengths = ids[stay], names[stay], origin[stay], lengths[own]
        while gram < scale // 4:
            names = _mixed(names * np.uint64(0xD6E8FEB86659FD93) + _ahead(names, gram, 0))
            gram *= 2
        at, lag = _seeds(names, scale)
        # two periods of matches lie on one side of a seed at least: look at their far ends first
        n = len(ids)
        right = at + 2 * lag - gram
        ahead = (right < n) & (names[np.minimum(at + lag - gram, n - 1)] == names[np.minimum(right, n - 1)])
        behind = (at - lag + 1 >= 0) & (names[np.maximum(at - lag + 1, 0)] == names[np.minimum(at + 1, n - 1)])
        at, lag = at[ahead | behind], lag[ahead | behind]
        order = np.lexsort((at, lag))
        known_lag, known_end = 0, 0
        for p, d in zip(at[order].tolist(), lag[order].tolist()):
            if d == known_lag and p < known_end:
                continue
            first, last = _extent(ids, p, d)
            known_lag, known_end = d, last
            if long_enough(last - first, d) and _is_smallest(ids, first, d):
                found.append((int(origin[first]), last - first + d, d))
        scale *= 2


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest exact length / period; ties: the smallest start, then period."""
    best = None
    for run in runs:
        if best is None or (run[1] * best[2], -run[0], -run[2]) > (best[1] * run[2], -best[0], -best[2]):
            best = run
    return best


def periodic_runs(
    docs: DataFrame, id: str = "doc_id", text: str = "text", min_length: int = 24, min_periods: int = 3,
    rewrite: Callable[[object, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """(doc_id, n_words, n_runs, start, length, period, runs, collapsed) for every row.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. A run is a stretch of words with smallest period q that
    is at least ``min_length`` words and ``min_periods`` (three or more) periods long and that no neighbour extends.
    ``runs`` holds all of them by start, then period; start, length and period are those of the ``strongest``,
    null if there is none. ``collapsed`` is the text without what any run holds after its first period, its
    words joined by one blank. ``rewrite(id, words)`` may change the words first.

    Each document is judged alone and nothing is shuffled; a task holds some megabytes of texts, or one longer
    document. Null text counts as empty: no words, no runs, an empty ``collapsed``. Rows that repeat an id, or
    have none, are rows like any other. Other columns are not read, so none can clash. No rows, no result rows.
    """
    if min_periods < 3:
        raise ValueError("seeds are complete for three periods or more")

    def solve(keys: list, texts: list):
        import numpy as np
        import pyarrow as pa

        words = [(t or "").encode().split() for t in texts]
        if rewrite:
            words = [rewrite(k, w) for k, w in zip(keys, words)]
        lengths = [len(w) for w in words]
        numbers: dict[bytes, int] = {}
        ids = np.empty(sum(lengths) + len(words), np.int64)
        at, starts = 0, []
        for i, own in enumerate(words):
            starts.append(at)
            ids[at : at + len(own)] = [numbers.setdefault(w, len(numbers)) for w in own]
            ids[at + len(own)] = -1 - i
            at += len(own) + 1
        keep = np.ones(len(ids), bool)
        runs: list[list] = [[] for _ in words]
        owner = np.asarray(starts)
        for start, length, period in sorted(find_runs(ids, lengths, min_length, min_periods), key=lambda r: (r[0], r[2])):
            doc = int(np.searchsorted(owner, start, "right")) - 1
            runs[doc].append((start - starts[doc], length, period))
            keep[start + period : start + length] = False
        kept = [
            b" ".join(compress(own, keep[a : a + n].tolist()) if mine else own).decode()
            for own, a, n, mine in zip(words, starts, lengths, runs)
        ]
        best = [strongest(mine) or (None, None, None) for mine in runs]
        numbers_of = lambda k: pa.array([r[k] for mine in runs for r in mine], pa.int64())
        structs = pa.StructArray.from_arrays([numbers_of(0), numbers_of(1), numbers_of(2)], ["start", "length", "period"])
        offsets = pa.array(np.concatenate([[0], np.cumsum([len(mine) for mine in runs])]), pa.int32())
        return [
            pa.array(lengths, pa.int64()), pa.array([len(mine) for mine in runs], pa.int64()),
            *[pa.array([b[k] for b in best], pa.int64()) for k in range(3)],
            pa.ListArray.from_arrays(offsets, structs), pa.array(kept, pa.string()),
        ]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            begin, size = 0, 0
            for row in range(batch.num_rows):
                size += len(batch.column(1)[row].as_buffer() or b"") if batch.column(1)[row].is_valid else 0
                if size >= CHUNK_BYTES or row == batch.num_rows - 1:
                    part = batch.slice(begin, row + 1 - begin)
                    columns = solve(part.column(0).to_pylist(), part.column(1).to_pylist())
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), *columns],
                        ["doc_id", "n_words", "n_runs", "start", "length", "period", "runs", "collapsed"])
                    begin, size = row + 1, 0

    source = docs.select(F.col(id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(
        run, f"doc_id {dict(source.dtypes)['doc_id']}, n_words long, n_runs long, start long, length long, period long, "
        f"runs array<{RUN}>, collapsed string")
