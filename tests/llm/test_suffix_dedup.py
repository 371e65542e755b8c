"""Suffix order and repeat removal against plain Python."""

import hashlib
import random

import numpy as np
import pytest

from tidemark.llm import suffix_dedup as S
from tidemark.llm.suffix_array import suffix_order


def test_suffix_order():
    rng = random.Random(1)
    for _ in range(600):
        s = [rng.randint(1, rng.choice([1, 2, 3, 200])) for _ in range(rng.randint(0, 60))]
        assert suffix_order(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:])
        for depth in (1, 2, 5, 9, 10, 30):
            order = suffix_order(s, depth).tolist()
            keys = [s[i : i + depth] for i in order]
            assert sorted(order) == list(range(len(s))) and keys == sorted(keys)


def plain(rows, length):
    """Per row the removed byte positions, by a table of all strings."""
    least = {}
    for key, text in rows:
        data = (text or "").encode()
        if key is not None:
            for i in range(len(data) - length + 1):
                s = data[i : i + length]
                least[s] = min(least.get(s, key), key)
    out = []
    for key, text in rows:
        data, gone = (text or "").encode(), set()
        for i in range(len(data) - length + 1):
            if key is not None and least[data[i : i + length]] < key:
                gone.update(range(i, i + length))
        out.append((key, len(data), len(gone), sum(g - 1 not in gone for g in gone),
                    hashlib.sha256(bytes(b for i, b in enumerate(data) if i not in gone)).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gämma", "d", "epsilon", "the", "of", "zz\n", "日本", "x" * 30]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 40))) for _ in range(12)]
    rows = []
    for i in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.4 else " ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(0, 4))]
        rows.append((rng.choice([i, i * 7 - 50]), " ".join(parts)))
    return rows


@pytest.mark.parametrize("options", [{}, {"hot_runs": 1}])
def test_removal_is_exact(spark, options, monkeypatch):
    rows = corpus(4, 150) + [(9000, None), (9001, ""), (9002, "ab" * 3000), (9003, "q" * 200), (9004, "z" + "ab" * 2000), (None, "q" * 200), (9005, "q" * 49), (9005, "q" * 50)]
    rows += [rows[3], (rows[3][0], rows[5][1])]
    docs = spark.createDataFrame([(*r, "x", 5) for r in rows], "doc_id long, text string, spans string, tag int")
    got = S.remove_repeats(docs, 50, **options).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got), key=repr) == plain(rows, 50)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)


def test_large_tables_are_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(S, "SENT_BYTES", -1)
    rows = corpus(8, 60)
    got = S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 20).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got), key=repr) == plain(rows, 20)
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_window_least():
    v = np.random.default_rng(1).integers(0, 1000, 200)
    for w in (1, 2, 3, 5, 8, 27):
        assert S.window_least(v, w).tolist() == [v[i : i + w].min() for i in range(200 - w + 1)]


def test_suffix_order_of_wide_symbols():
    rng = random.Random(5)
    for top in (1 << 20, 1 << 30, 1 << 45):
        symbols = [rng.randint(1, top) for _ in range(6)]
        s = [rng.choice(symbols) for _ in range(200)]
        assert suffix_order(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def test_merging_suffixes_takes_no_more_steps_for_longer_texts():
    import sys

    def calls(n):
        seen = []
        sys.setprofile(lambda frame, event, arg: seen.append(1) if event in ("call", "c_call") else None)
        try:
            suffix_order(np.ones(n, np.int64), 50)
        finally:
            sys.setprofile(None)
        return len(seen)

    assert calls(100_000) <= calls(1000) + 20


def test_spans_of_a_bucket_are_merged_together(monkeypatch):
    import pyarrow as pa

    rng, rows = random.Random(2), []
    for _ in range(900):
        rows.append((rng.randint(-20, 20), rng.choice([1, 7]), rng.randint(0, 300), rng.randint(1, 30), rng.choice([0, 0, 1, 2]), rng.randint(0, 99)))
    doc, tag, start, count, state, anchor = (np.array(c, np.int64) for c in zip(*rows))
    made = list(S._found(doc, tag, start, count, state, anchor, 1))
    whole, calls = S.merged, []
    monkeypatch.setattr(S, "merged", lambda *a: calls.append(1) or whole(*a))
    got = pa.Table.from_batches(S._gather(iter(made))).to_pylist()
    assert len(calls) == 1 and len(got) == len({r[:2] for r in rows})
    for r in got:
        own = sorted((x for x in rows if x[:2] == (r["doc_id"], r["tag"])), key=lambda x: x[2])
        sure = [x for x in own if x[4] == 0]
        spans = whole(np.array([x[2] for x in sure]), np.array([x[2] + x[3] for x in sure]))
        assert np.frombuffer(r["starts"], "<i8").reshape(-1, 2).tolist() == spans.tolist()
        open_ = [x for x in own if x[4]]
        assert len(r["open"]) == len(open_) * sum(S._OPEN)
        assert S._unpack(r["open"][: 4 * len(open_)], 4).tolist() == [x[2] for x in open_]
