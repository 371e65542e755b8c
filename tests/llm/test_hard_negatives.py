"""Hard negatives against every pair in plain Python, keys, windows, exact products and edges."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import hard_negatives as hn

PARAMS = {"positives": 5, "negatives": 10, "low": 30, "high": 90, "of": 100}


def clean(rows, scale=256):
    """One row for an id, whole numbers; rows that cannot take part are left out."""
    found = {}
    for key, vector, label in rows:
        if key is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        whole = [int(min(max(math.floor(scale * x), -(2**62)), 2**62)) for x in vector]
        small = all(-32768 <= x <= 32767 for x in whole)
        packed = bytes([2 if small else 8]) + b"".join(x.to_bytes(2 if small else 8, "little", signed=True) for x in whole)
        if key not in found or (label, packed) < found[key][:2]:
            found[key] = (label, packed, whole)
    return {k: (label, whole) for k, (label, _, whole) in found.items()}


def plain(rows, is_anchor, positives, negatives, low, high, of):
    v, out = clean(rows), set()
    for a, (label, x) in v.items():
        if not is_anchor(a):
            continue
        score = {b: max(hn.LEAST, min(hn.MOST, sum(p * q for p, q in zip(x, y)))) for b, (_, y) in v.items() if b != a}
        order = sorted(score, key=lambda b: (-score[b], b))
        for p in [b for b in order if v[b][0] == label][:positives]:
            fits = [b for b in order if v[b][0] != label and low * score[p] <= of * score[b] <= high * score[p]]
            out |= {(a, p, i, b, score[p], score[b]) for i, b in enumerate(fits[:negatives], 1)}
    return out


def test_keys_sort_as_numbers():
    rng = random.Random(1)
    edge = [hn.LEAST, hn.LEAST + 1, -1, 0, 1, hn.MOST]
    rows = [tuple(rng.choice([*edge, rng.randint(-9, 9)]) for _ in range(3)) for _ in range(500)]
    keys = hn.pack_keys(*(np.array(c, np.int64) for c in zip(*rows)))
    data = [k.tobytes() for k in keys]
    assert [r for _, r in sorted(zip(data, rows))] == sorted(rows, key=lambda r: (r[0], -r[1], r[2]))
    assert list(zip(*(c.tolist() for c in hn.unpack_keys(pa.array(data, pa.binary()))))) == rows
    assert [len(c) for c in hn.unpack_keys(pa.array([], pa.binary()))] == [0, 0, 0]


def test_products_are_exact():
    rng = random.Random(2)
    for top in (100, 2**25, 2**40, 2**62):
        a, b = ([[rng.randint(-top, top) for _ in range(3)] for _ in range(4)] for _ in range(2))
        want = [[max(hn.LEAST, min(hn.MOST, sum(p * q for p, q in zip(x, y)))) for y in b] for x in a]
        assert hn.inner_products(np.array(a), np.array(b)).tolist() == want


def small(rng, n, dims, spread, labels):
    return [(i, [rng.randint(-spread, spread) / 256 for _ in range(dims)], rng.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize("dims,spread,labels", [(3, 2, 3), (8, 200, 4), (1, 1, 2), (6, 40, 40)])
def test_operator_equals_all_pairs(spark, monkeypatch, dims, spread, labels):
    """Small numbers make ties and zero scores; small tiles and blocks make many cells."""
    monkeypatch.setattr(hn, "CELL_BYTES", 8 * dims * 16)
    monkeypatch.setattr(hn, "TILE_ROWS", 40)
    rows = small(random.Random(dims), 400, dims, spread, labels)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = hn.mine_hard_negatives(df, F.col("vec_id") % 10 == 0).collect()
    want = plain(rows, lambda i: i % 10 == 0, **PARAMS)
    assert len(got) == len(want)
    assert {tuple(r) for r in got} == want
    if spread == 1:
        assert any(r.positive_score == 0 for r in got)


def test_stream_over_all_pairs(spark):
    """The stream alone, fed with every pair unpruned, gives the same rows."""
    rows = small(random.Random(9), 120, 3, 3, 3)
    v = clean(rows)
    pairs = []
    for a in range(0, 120, 10):
        for b in range(120):
            if a != b:
                s = sum(p * q for p, q in zip(v[a][1], v[b][1]))
                key = hn.pack_keys(*(np.array([x], np.int64) for x in (a, s, b)))[0].tobytes()
                pairs.append((a, bytearray(key), v[a][0] == v[b][0]))
    got = hn.mine_pairs(spark.createDataFrame(pairs, hn.PAIR)).collect()
    assert {tuple(r) for r in got} == plain(rows, lambda i: i % 10 == 0, **PARAMS) and got


def test_edges(spark):
    rng, nan, inf = random.Random(4), float("nan"), float("inf")
    rows = small(rng, 60, 4, 90, 3)
    rows += [
        (None, [1.0] * 4, 1), (100, None, 1), (101, [1.0, None, 1.0, 1.0], 1), (102, [nan] * 4, 1), (103, [inf, 0.0, 0.0, 0.0], 1),
        (104, [1.0] * 4, None), (110, [0.4, 0.4], 0), (120, [], 1), (10, [0.9] * 4, 2), (10, [0.9] * 4, 2), (-20, [0.3] * 4, 1),
        (130, [1e30, -1e30, 5e10, 1.0], 0), (140, [2e12, 1.0, 0.0, 1.0], 1),
    ]
    rows += [(500 + i, [0.25] * 4, 1) for i in range(30)] + [(10, [0.9] * 4, 2)] * 20
    schema = "vec_id long, embedding array<double>, label int, score int, anchor string, v int, key int"
    df = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], schema)
    got = hn.mine_hard_negatives(df, F.col("vec_id") % 10 == 0).collect()
    want = plain(rows, lambda i: i % 10 == 0, **PARAMS)
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert hn.mine_hard_negatives(df.limit(0), F.col("vec_id") % 10 == 0).collect() == []
    assert hn.mine_hard_negatives(df, F.col("vec_id") == 999_999).collect() == []
    for wrong in ({"low": 90, "high": 90}, {"high": 101}, {"positives": 0}, {"low": -1}):
        with pytest.raises(ValueError):
            hn.mine_hard_negatives(df, F.col("vec_id") % 10 == 0, **wrong)
