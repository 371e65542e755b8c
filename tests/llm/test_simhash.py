"""SimHash fingerprints, links and components against plain Python."""

import random
import re

import pytest
import xxhash

from tidemark.llm import simhash
from tidemark.llm.graph import components


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    ids = list(fps)
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i: top(i) for i in ids}


def test_fingerprint():
    rng = random.Random(1)
    for text in ["", None, "one", "A B c", "a b C\x0bd é f g", " ".join(rng.choice("abcdefg") for _ in range(70_000))]:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("max_bits", [1, 3, 4, 5])
@pytest.mark.parametrize("tiled_rows", [1, 10_000])
def test_odd_limits_by_tiles_and_by_middles(spark, max_bits, tiled_rows):
    rng, fps = random.Random(max_bits), set()
    for _ in range(8):
        x = rng.getrandbits(64)
        for _ in range(5):
            fps.add(x)
            for _ in range(rng.choice([1, max_bits, max_bits + 1])):
                x ^= 1 << rng.randrange(64)
    fps = sorted(fps)
    signed = {f: f - (1 << 64) if f >> 63 else f for f in fps}
    edges = simhash.hamming_links(spark.createDataFrame([(v,) for v in signed.values()], "fp long"), max_bits, tile=4, tiled_rows=tiled_rows).collect()
    back = {v: f for f, v in signed.items()}
    root = {f: f for f in fps}

    def top(f):
        while root[f] != f:
            f = root[f]
        return f

    def joined(pairs):
        for f in fps:
            root[f] = f
        for a, b in pairs:
            root[max(top(a), top(b))] = min(top(a), top(b))
        return {f: top(f) for f in fps}

    found = [(back[r.a], back[r.b]) for r in edges]
    assert all((a ^ b).bit_count() <= max_bits for a, b in found)
    near = [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= max_bits]
    assert near and joined(found) == joined(near)


@pytest.mark.parametrize("options", [{}, {"tile": 3}, {"tile": 2, "tiled_rows": 4, "blocks": 6}, {"blocks": 7}])
def test_links_join_what_pairs_join(spark, options):
    rng = random.Random(2)
    fps = {}
    for c in range(6):
        x = rng.getrandbits(64)
        for _ in range(40):
            x ^= sum(1 << b for b in rng.sample(range(64), rng.choice([1, 3, 4, 4, 5])))
            fps[x] = x
    want = plain_components(dict(sorted(fps.items())))
    signed = [(simhash._signed(x),) for x in fps]
    edges = simhash.hamming_links(spark.createDataFrame(signed, "fp long"), 4, **options)
    rows = edges.collect()
    assert all(((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 4 for r in rows)
    got = {r.node % 2**64: r.root for r in components(edges).collect()}
    groups = {}
    for x in fps:
        groups.setdefault(want[x], set()).add(x)
    for members in groups.values():
        assert len({got.get(x, simhash._signed(x)) for x in members}) == 1
    assert len({got.get(x, simhash._signed(x)) for x in fps}) == len(groups)


def test_components_of_a_long_path(spark):
    edges = spark.range(300).selectExpr("id AS a", "id + 1 AS b").union(spark.createDataFrame([(900, 901), (5, 5)], "a long, b long"))
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(301)}, 900: 900, 901: 900}
    assert components(edges.limit(0)).count() == 0


def test_near_groups_edges(spark):
    base = "the quick brown fox jumps over the lazy dog and runs away from it all " * 20
    docs = spark.createDataFrame(
        [(5, base, 1), (3, base + "x", 2), (4, base.upper(), 3), (7, None, 4), (6, "", 5), (8, "\t ", 6), (None, base, 7), (9, "w " * 300_000, 8),
         (10, "entirely different words here today", 9), (10, "entirely different words here today", 9)], "doc_id long, text string, component_id int")
    rows = simhash.near_groups(docs).collect()
    assert len(rows) == 10
    fps = {r.doc_id: int(r.fingerprint, 16) for r in rows if r.doc_id is not None}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    assert all(fps[i] == plain_fingerprint(texts[i]) for i in fps)
    want = plain_components(dict(sorted(fps.items())))
    assert all(r.component_id == want[r.doc_id] for r in rows if r.doc_id is not None)
    assert next(r for r in rows if r.doc_id is None).component_id == want[5]
    kept = simhash.near_dedup(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(want.values())
    assert simhash.near_groups(docs.limit(0)).count() == 0
