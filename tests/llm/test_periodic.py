"""Periodic runs against a brute-force search of every period."""

import random

import numpy as np
import pytest

from tidemark.llm import periodic, queries


def plain_runs(words, min_length=24, min_periods=3):
    n, found = len(words), {}
    for q in range(1, n // min_periods + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i:
                span = (i, j + q - i)
                if span[1] >= max(min_length, min_periods * q):
                    found.setdefault(span, q)  # the smallest period of a stretch comes first
                i = j
            i += 1
    # a longer period of a stretch inside a stretch of one of its divisors is not its smallest
    smallest = []
    for (start, length), q in found.items():
        u = words[start : start + length]
        if not any(all(u[k] == u[k + d] for k in range(length - d)) for d in range(1, q)):
            smallest.append((start, length, q))
    return sorted(smallest, key=lambda r: (r[0], r[2]))


def numbered(docs):
    ids, lengths = [], []
    for i, d in enumerate(docs):
        ids += [*d, -1 - i]
        lengths.append(len(d))
    return np.array(ids, np.int64), lengths


def made(rng):
    """A text of a small alphabet with repeats of several periods, some nested, some with one word changed."""
    letters = rng.choice([1, 2, 3, 50])
    out = [rng.randrange(letters) for _ in range(rng.randint(0, 60))]
    for _ in range(rng.randint(0, 3)):
        root = [rng.randrange(letters) for _ in range(rng.choice([1, 2, 5, 15, 16, 17, 24, 31, 32, 33, 50, 64, 97]))]
        if rng.random() < 0.5:  # a period inside a period
            root = root[:3] * rng.randint(2, 9) + root
        count = len(root) * rng.choice([2, 3, 4, 9]) + rng.randint(-1, len(root))
        piece = [root[i % len(root)] for i in range(count)]
        if piece and rng.random() < 0.3:
            piece[rng.randrange(len(piece))] = letters
        out += piece + [rng.randrange(letters) for _ in range(rng.randint(0, 20))]
    return out


@pytest.mark.parametrize("seed", range(8))
def test_runs_are_all_found(seed):
    rng = random.Random(seed)
    docs = [made(rng) for _ in range(60)]
    ids, lengths = numbered(docs)
    found, at, want = sorted(periodic.find_runs(ids, lengths), key=lambda r: (r[0], r[2])), 0, []
    for d in docs:
        want += [(at + s, n, q) for s, n, q in plain_runs(d)]
        at += len(d) + 1
    assert found == want
    assert any(q >= 16 for _, _, q in want)


def test_long_low_complexity_text():
    words = [0] * 60_000 + [1, 2, 0] * 20_000 + [i % 7_000 for i in range(60_000)]
    ids, lengths = numbered([words])
    found = sorted(periodic.find_runs(ids, lengths))
    assert found == [(0, 60_000, 1), (59_999, 60_001, 3), (120_000, 60_000, 7_000)]
    for start, n, q in found:
        assert words[start : start + n - q] == words[start + q : start + n]
        assert start == 0 or words[start - 1] != words[start - 1 + q]
        assert start + n == len(words) or words[start + n] != words[start + n - q]


def test_strongest_by_exact_quotient():
    assert periodic.strongest([]) is None
    assert periodic.strongest([(9, 24, 3), (5, 80, 10), (2, 16, 2)]) == (2, 16, 2)
    big = 3 * 10**17
    assert periodic.strongest([(0, big, 10**17), (1, big + 1, 10**17)]) == (1, big + 1, 10**17)


def test_operator_and_edges(spark):
    rng = random.Random(5)
    line = "one TWO drei\x0bvier fünf sechs sieben acht neun".split(" ")
    rows = [
        (1, " ".join(line * 4), 7), (2, None, 7), (3, "", 7), (None, "a " * 24, 7), (1, "a " * 23, 7), (1, "a " * 23, 7),
        (4, "x y " * 30_000 + "z", 7), (5, " \t\n", 7), (6, " ".join(f"w{rng.randrange(9)}" for _ in range(5_000)), 7),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_runs int")
    got = sorted(periodic.periodic_runs(docs).collect(), key=lambda r: (r.doc_id or 0, r.n_words))
    want = []
    for key, text, _ in rows:
        words = (text or "").encode().split()
        runs, keep = plain_runs(words) if len(words) < 10_000 else [(0, 60_000, 2)], [True] * len(words)
        for s, n, q in runs:
            keep[s + q : s + n] = [False] * (n - q)
        kept = b" ".join(w for w, k in zip(words, keep) if k).decode()
        want.append((key, len(words), len(runs), periodic.strongest(runs), [tuple(r) for r in runs], kept))
    want.sort(key=lambda r: (r[0] or 0, r[1]))
    for r, w in zip(got, want, strict=True):
        best = (r.start, r.length, r.period) if r.start is not None else None
        assert (r.doc_id, r.n_words, r.n_runs, best, [tuple(x) for x in r.runs], r.collapsed) == w
    assert periodic.periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic.periodic_runs(docs, min_periods=2)


def test_query_against_brute_force(spark, sf_dir):
    import hashlib
    import zlib

    from tidemark.session import table

    docs = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    got = {r.doc_id: r for r in queries.op13_periodic_runs(spark, sf_dir).collect()}
    assert got.keys() == docs.keys()
    changed = 0
    for key, text in docs.items():
        words = (text or "").encode().split()
        if len(words) > 1_500:
            continue
        h, n = zlib.crc32(str(key).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            changed += 1
        runs, keep = plain_runs(words), [True] * n
        for s, m, q in runs:
            keep[s + q : s + m] = [False] * (m - q)
        best, r = periodic.strongest(runs), got[key]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *(best or (None,) * 3))
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(w for w, k in zip(words, keep) if k)).hexdigest()
    assert changed > 5
