"""Removal of byte strings that repeat from an earlier document, by distributed suffix sorting.

A suffix array of all bytes would sort a row for each byte. Equal strings of ``length`` bytes choose the same
anchor, the least hash of their short k-grams, so the text is dealt out by anchor and only what shares an
anchor with another document is sorted:

1. Runs: the strings that begin next to each other and share an anchor are one run. A run sends its anchor's
   hash and a hash of its bytes, packed with many others (about one run for 15 bytes of text).
2. By anchor: runs whose bytes are those of a run in a smaller document are repeated as a whole. Anchors of
   one document drop out. What is left, runs that share an anchor but not all their bytes, needs sorting.
3. By anchor again, with the bytes: the difference-cover algorithm (sample triples, recurse on names, merge
   the other suffixes) orders the suffixes, neighbours are compared, and suffixes that agree in ``length``
   bytes form a group, of which all but those of the smallest document are repeated.
4. By document: repeated strings become removed spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored, text_or_empty
from tidemark.llm.suffix_array import suffix_order

#: Bytes of text for each bucket of anchors; a task reads a few buckets.
BUCKET_BYTES = 8 << 20
#: Tables up to this size are sent to all tasks, after it has been measured; larger ones are joined by a shuffle.
SENT_BYTES = 64 << 20
CHUNK_BYTES = 8 << 20
_RUNS = "bucket int, matched boolean, doc binary, tag binary, start binary, count binary, anchor binary, body binary"
_FOUND = "bucket int, doc binary, tag binary, start binary, count binary, state binary, anchor binary"
_TEXTS = "bucket int, doc binary, tag binary, start binary, count binary, text binary"


def _pack(values, width: int) -> bytes:
    return np.ascontiguousarray(np.asarray(values).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _unpack(data, width: int):
    raw = np.frombuffer(data, np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return out.view("<u8").reshape(-1)


def gram_hashes(data: bytes, k: int):
    """A 64-bit hash of the ``k`` >= 8 bytes at each position."""
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    count = len(data) - k + 1
    h = words[:count] * np.uint64(0x9E3779B97F4A7C15)
    for at in [*range(8, k - 7, 8), *([k - 8] if k % 8 else [])]:
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + words[at : at + count]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def window_least(values, width: int):
    """The least of each ``width`` values in a row."""
    least, covered = values, 1
    while covered * 2 <= width:
        least, covered = np.minimum(least[:-covered], least[covered:]), covered * 2
    if covered < width:
        count = len(values) - width + 1
        least = np.minimum(least[:count], least[width - covered : width - covered + count])
    return least


def runs_of(data: bytes, length: int, k: int):
    """(anchor, first start, starts) of each run; every string of ``length`` bytes belongs to one."""
    if len(data) < length:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    anchors = window_least(gram_hashes(data, k), length - k + 1)
    first = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]]))
    return anchors[first], first, np.diff(np.concatenate([first, [len(anchors)]]))


def _cut(bucket, order_in=()):
    """Order by bucket, and (bucket, slice) of each."""
    order = np.lexsort((*order_in, bucket))
    ordered = bucket[order]
    at = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]])) if len(ordered) else np.zeros(1, int)
    return order, [(int(ordered[a]), slice(a, b)) for a, b in zip(at[:-1], at[1:])]


def _batch(schema: str, rows: list[tuple]):
    import pyarrow as pa

    kinds = {"int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "long": pa.int64()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[f[1]]) for f, c in zip(fields, zip(*rows))], [f[0] for f in fields])


def _emit_runs(length: int, k: int, buckets: int):
    """Step 1. Copies inside a chunk are settled here, so a hot run sends one row for each chunk."""
    from xxhash import xxh64_intdigest

    def flush(parts):
        doc, tag, start, count, anchor, body = (np.concatenate(c) for c in zip(*parts))
        both = anchor ^ (body * np.uint64(0x9E3779B97F4A7C15))
        order = np.lexsort((doc, both))
        both, ids = both[order], doc[order]
        fresh = np.concatenate([[True], both[1:] != both[:-1]])
        matched = np.empty(len(doc), bool)
        matched[order] = ids > ids[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        bucket = (anchor % np.uint64(buckets)).astype(np.int64)
        order, cuts = _cut(bucket * 2 + matched, (start, tag, doc))
        for code, at in cuts:
            one = order[at]
            local = bool(code & 1)
            yield (code >> 1, local, _pack(doc[one], 8), _pack(tag[one], 4), _pack(start[one], 4), _pack(count[one], 4),
                   b"" if local else _pack(anchor[one] >> np.uint64(16), 6), b"" if local else _pack(body[one], 6))

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            parts, held = [], 0
            for row in range(batch.num_rows):
                data = batch.column(2)[row].as_py()
                anchor, start, count = runs_of(data, length, k)
                if len(anchor):
                    n, whole = len(anchor), memoryview(data)
                    ends = (start + count + (length - 1)).tolist()
                    body = np.fromiter((xxh64_intdigest(whole[a:b]) for a, b in zip(start.tolist(), ends)), np.uint64, n)
                    parts.append((np.full(n, batch.column(0)[row].as_py()), np.full(n, batch.column(1)[row].as_py()), start, count, anchor, body))
                    held += len(data)
                if parts and (held >= CHUNK_BYTES or row == batch.num_rows - 1):
                    yield _batch(_RUNS, list(flush(parts)))
                    parts, held = [], 0

    return run


def _by_bucket(batches: Iterator, solve) -> Iterator:
    """Rows come ordered by their first column; ``solve`` gets the rows of one bucket at a time."""
    bucket, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[0] != bucket and rows:
                yield from solve(bucket, rows)
                rows = []
            bucket = row[0]
            rows.append(row)
    if rows:
        yield from solve(bucket, rows)


def _found(doc, tag, start, count, state, anchor, doc_buckets: int) -> Iterator:
    """Results on their way back to their documents."""
    if len(doc):
        order, cuts = _cut((doc.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % doc_buckets, (start, tag, doc))
        yield _batch(_FOUND, [(b, _pack(doc[o], 8), _pack(tag[o], 4), _pack(start[o], 4), _pack(count[o], 4), _pack(state[o], 1), _pack(anchor[o], 8))
                              for b, at in cuts for o in [order[at]]])


def _classify(doc_buckets: int, hot_runs: int):
    """Step 2. States: 0 repeated as a whole, 1 to be sorted, 2 to be sorted and of a hot anchor."""

    def solve(bucket, rows):
        done = [r for r in rows if r[1]]
        if done:
            doc, tag, start, count = (np.concatenate([_unpack(r[i], w) for r in done]).astype(np.int64) for i, w in ((2, 8), (3, 4), (4, 4), (5, 4)))
            yield from _found(doc, tag, start, count, np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64), doc_buckets)
        rows = [r for r in rows if not r[1]]
        if not rows:
            return
        doc, tag, start, count, anchor, body = (np.concatenate([_unpack(r[i], w) for r in rows]) for i, w in ((2, 8), (3, 4), (4, 4), (5, 4), (6, 6), (7, 6)))
        doc = doc.view(np.int64)
        order = np.lexsort((doc, body, anchor))
        doc, tag, start, count, anchor, body = (x[order] for x in (doc, tag, start, count, anchor, body))
        new = np.concatenate([[True], anchor[1:] != anchor[:-1]])
        fresh = new | np.concatenate([[True], body[1:] != body[:-1]])
        matched = doc > doc[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        group, begins = np.cumsum(new) - 1, np.flatnonzero(new)
        open_ = ~matched & (doc > np.minimum.reduceat(doc, begins)[group])
        sort = ~matched & np.logical_or.reduceat(open_, begins)[group]
        hot = np.add.reduceat(sort.astype(np.int64), begins)[group] > hot_runs
        state = np.where(matched, 0, np.where(hot, 2, 1))
        keep = matched | sort
        yield from _found(doc[keep], tag[keep].astype(np.int64), start[keep].astype(np.int64), count[keep].astype(np.int64), state[keep],
                          anchor[keep].astype(np.int64), doc_buckets)

    return lambda batches: _by_bucket(batches, solve)


_PER_DOC = "doc_id long, tag long, starts binary, open binary"
_OPEN = (4, 4, 1, 6)  # bytes of start, count, state and anchor of a run that needs sorting


def _gather(batches: Iterator) -> Iterator:
    """Per document: intervals of repeated starts (merged), and the runs that need sorting."""

    def solve(bucket, rows):
        doc, tag, start, count, state, anchor = (
            np.concatenate([_unpack(r[i], w) for r in rows]).astype(np.int64) for i, w in ((1, 8), (2, 4), (3, 4), (4, 4), (5, 1), (6, 8)))
        order = np.lexsort((start, tag, doc))
        doc, tag, start, count, state, anchor = (x[order] for x in (doc, tag, start, count, state, anchor))
        fresh = np.concatenate([[True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])])
        cut = np.flatnonzero(fresh)
        # all documents at once, each on a stretch of its own
        own, sure = np.cumsum(fresh) - 1, state == 0
        stretch = int((start + count).max()) + 1
        spans = merged((start + own * stretch)[sure], (start + count + own * stretch)[sure])
        of = spans[:, 0] // stretch
        parts = [np.searchsorted(of, np.arange(len(cut) + 1)).tolist(), np.searchsorted(own[~sure], np.arange(len(cut) + 1)).tolist()]
        starts = (spans - of[:, None] * stretch).astype("<i8").tobytes()
        todo = [(_pack(x[~sure], w), w) for x, w in zip((start, count, state, anchor), _OPEN)]
        yield _batch(_PER_DOC, [
            (d, t, starts[16 * a : 16 * b], b"".join(x[w * c : w * e] for x, w in todo))
            for d, t, a, b, c, e in zip(doc[cut].tolist(), tag[cut].tolist(), parts[0], parts[0][1:], parts[1], parts[1][1:])])

    yield from _by_bucket(batches, solve)


def merged(start, end):
    """Union of half-open intervals as rows (start, end), in order."""
    if not len(start):
        return np.empty((0, 2), np.int64)
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]]))
    return np.stack([start[new], reach[np.concatenate([new[1:] - 1, [len(start) - 1]])]], axis=1)


def _emit_texts(length: int, buckets: int):
    """Step 3, sending: the bytes of the runs that need sorting, by anchor; of a hot anchor string by string."""
    from xxhash import xxh64_intdigest

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            parts: dict[int, list] = {}
            for doc, tag, data, todo in zip(*(c.to_pylist() for c in batch.columns)):
                at, columns, n = 0, [], len(todo) // sum(_OPEN)
                for width in _OPEN:
                    columns.append(_unpack(todo[at : at + n * width], width).tolist())
                    at += n * width
                for start, count, state, anchor in zip(*columns):
                    if state == 1:
                        parts.setdefault(anchor % buckets, []).append((doc, tag, start, count, data[start : start + count + length - 1]))
                    else:
                        for at in range(start, start + count):
                            own = data[at : at + length]
                            parts.setdefault(xxh64_intdigest(own) % buckets, []).append((doc, tag, at, 1, own))
            rows = []
            for bucket, found in parts.items():
                doc, tag, start, count, text = zip(*found)
                rows.append((bucket, _pack(np.array(doc, np.int64), 8), _pack(np.array(tag), 4), _pack(np.array(start), 4), _pack(np.array(count), 4), b"".join(text)))
            if rows:
                yield _batch(_TEXTS, rows)

    return run


def repeated_strings(texts: bytes, begins, counts, docs, length: int):
    """Step 3, sorting: for the concatenated texts, each ``counts + length - 1`` bytes, the places whose string
    of ``length`` bytes also starts in a text of a smaller document."""
    size = counts + (length - 1)
    total = len(texts) + len(begins)  # one 1 after each text parts it from the next
    kind = np.int32 if total < 1 << 31 else np.int64
    text_at = np.repeat(np.arange(len(begins), dtype=kind), size + 1)
    place = np.arange(total, dtype=kind) - np.repeat((begins + np.arange(len(begins))).astype(kind), size + 1)
    symbols = np.ones(total, np.uint16)
    symbols[place < size[text_at]] = np.frombuffer(texts, np.uint8).astype(np.uint16) + 2
    order = suffix_order(symbols, length)
    real = order[place[order] < counts[text_at[order]]]  # suffixes with a whole string in their own text
    del order
    narrow = np.concatenate([symbols.view(np.uint8), np.zeros(8, np.uint8)]).tobytes()
    words = np.ndarray((len(symbols),), "<u8", narrow, strides=(2,))  # four symbols each
    same = np.ones(max(0, len(real) - 1), bool)
    for k in [*range(0, length - 3, 4), length - 4]:
        same &= words[real[:-1] + k] == words[real[1:] + k]
    new = np.flatnonzero(np.concatenate([[True], ~same])) if len(real) else np.empty(0, int)
    group = np.cumsum(np.concatenate([[True], ~same])) - 1 if len(real) else np.empty(0, int)
    ids = docs[text_at[real]]
    later = ids > np.minimum.reduceat(ids, new)[group] if len(real) else np.empty(0, bool)
    hit = real[later]
    return text_at[hit], place[hit]


def _sort(length: int, doc_buckets: int):
    def solve(bucket, rows):
        doc, tag, start, count = (np.concatenate([_unpack(r[i], w) for r in rows]).astype(np.int64) for i, w in ((1, 8), (2, 4), (3, 4), (4, 4)))
        size = count + (length - 1)
        begins = np.concatenate([[0], np.cumsum(size)])[:-1]
        text, place = repeated_strings(b"".join(r[5] for r in rows), begins, count, doc, length)
        order = np.lexsort((place, text))
        text, place = text[order], place[order]
        # strings that begin next to each other are sent as one interval
        first = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (place[1:] != place[:-1] + 1)])) if len(text) else np.empty(0, int)
        count_of, zero = np.diff(np.concatenate([first, [len(text)]])), np.zeros(len(first), np.int64)
        text, place = text[first], place[first]
        yield from _found(doc[text], tag[text], start[text] + place, count_of, zero, zero, doc_buckets)

    return lambda batches: _by_bucket(batches, solve)


def _sent(df: DataFrame, columns: list[str]) -> DataFrame:
    """Broadcast a stored table if its measured size allows it."""
    size = df.agg(F.sum(sum((F.octet_length(c) for c in columns), F.lit(32)).cast("long"))).first()[0] or 0
    return F.broadcast(df) if size <= SENT_BYTES else df


def repeated_spans(docs: DataFrame, length: int = 50, id: str = "doc_id", text: str = "text", hot_runs: int = 200_000) -> DataFrame:
    """(doc_id, tag, spans): per document with any, the byte spans of its UTF-8 text to remove.

    A byte is removed if a string of ``length`` bytes that covers it also starts in a document with a smaller
    id. ``tag`` tells rows apart that share an id (32 bits of the text's hash); such rows do not count as
    smaller than each other. ``spans`` packs little-endian longs (start, end), maximal and in order. Rows
    without an id neither repeat anything nor are repeated. Documents may be of any length and texts null.
    """
    if length < 16:
        raise ValueError("strings of 16 bytes at least")
    k = max(8, length * 24 // 50)
    rows = _rows(docs, id, text).where("doc_id IS NOT NULL")
    total = rows.agg(F.sum(F.octet_length("data").cast("long"))).first()[0] or 0
    buckets = max(16, -(-total // BUCKET_BYTES))
    doc_buckets = max(16, buckets // 8)
    runs = rows.mapInArrow(_emit_runs(length, k, buckets), _RUNS)
    dealt = runs.repartition("bucket").sortWithinPartitions("bucket")
    first = stored(dealt.mapInArrow(_classify(doc_buckets, hot_runs), _FOUND), "runs")
    marks = stored(first.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_gather, _PER_DOC), "run-marks")
    open_ = _sent(stored(marks.where(F.octet_length("open") > 0).select("doc_id", "tag", "open"), "open-runs"), ["open"])
    texts = rows.join(open_, ["doc_id", "tag"]).select("doc_id", "tag", "data", "open").mapInArrow(_emit_texts(length, buckets), _TEXTS)
    later = texts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_sort(length, doc_buckets), _FOUND)
    known = marks.where(F.octet_length("starts") > 0).select("doc_id", "tag", "starts")
    more = later.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_gather, _PER_DOC).select("doc_id", "tag", "starts")
    more = stored(more, "sorted-marks")

    def spans(batches: Iterator) -> Iterator:
        for batch in batches:
            out = []
            for doc, tag, parts in zip(*(c.to_pylist() for c in batch.columns)):
                starts = np.concatenate([np.frombuffer(p, "<i8").reshape(-1, 2) for p in parts])
                out.append((doc, tag, merged(starts[:, 0], starts[:, 1] + (length - 1)).astype("<i8").tobytes()))
            if out:
                yield _batch("doc_id long, tag long, spans binary", out)

    # at most two parts for each document
    both = known.union(more).groupBy("doc_id", "tag").agg(F.collect_list("starts").alias("parts"))
    return stored(both.mapInArrow(spans, "doc_id long, tag long, spans binary"), "spans")


def _rows(docs: DataFrame, id: str, text: str) -> DataFrame:
    raw = text_or_empty(text)
    return docs.select(F.col(id).cast("long").alias("doc_id"), F.xxhash64(raw).bitwiseAND(0xFFFFFFFF).alias("tag"), raw.cast("binary").alias("data"))


def remove_repeats(docs: DataFrame, length: int = 50, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) and spans (array of start, end).

    Null text counts as empty; empty or short texts lose nothing. Rows repeated with one id lose nothing to
    each other. Other columns are not read. An empty table gives an empty result.
    """
    found = _sent(repeated_spans(docs, length, id, text, **options), ["spans"])
    kind = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start: long, end: long>>"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        pair = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            sizes, lost, kept, cuts = [], [], [], []
            for data, packed in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                own = np.frombuffer(packed or b"", "<i8").reshape(-1, 2).tolist()
                edges = [0, *[x for s in own for x in s], len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])) if own else data)
                sizes.append(len(data))
                lost.append(len(data) - len(kept[-1]))
                cuts.append([{"start": a, "end": b} for a, b in own])
            columns = [pa.array(sizes, pa.int64()), pa.array(lost, pa.int64()), pa.array([len(c) for c in cuts], pa.int64()), pa.array(kept, pa.binary()), pa.array(cuts, pair)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans"])

    joined = _rows(docs, id, text).join(found, ["doc_id", "tag"], "left").select("doc_id", "data", "spans")
    return joined.mapInArrow(run, kind)
