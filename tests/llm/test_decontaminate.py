"""Decontamination against a plain edit distance over every window."""

import random

from tidemark.llm import decontaminate as D


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, above = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
    return row[-1]


def test_best_match_is_the_least_distance_of_any_part():
    rng = random.Random(1)
    for _ in range(200):
        item, text = ([rng.choice("abc") for _ in range(n)] for n in (rng.randint(1, 6), rng.randint(0, 9)))
        least = min(plain_distance(item, text[i:j]) for i in range(len(text) + 1) for j in range(i, len(text) + 1))
        distance, start, end = D.best_match(item, text, 99)
        assert distance == least == plain_distance(item, text[start:end])
        assert D.best_match(item, text, least - 1) is None


def noisy(rng, words, edits):
    own = list(words)
    for _ in range(edits):
        at, kind = rng.randrange(len(own)), rng.randrange(3)
        if kind == 0:
            own[at] = f"x{rng.random()}"
        elif kind == 1:
            own.insert(at, f"x{rng.random()}")
        else:
            del own[at]
    return own


def test_recall_of_edited_passages():
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [[rng.choice(vocabulary) for _ in range(rng.randint(5, 60))] for _ in range(150)]
    index = D.Index(items, D.walks_for(items, 0.2, 0.95))
    texts = []
    for i in items:
        filler = [[rng.choice(vocabulary) for _ in range(rng.randint(0, 50))] for _ in range(2)]
        texts.append(filler[0] + noisy(rng, i, D.edits_for(len(i), 0.2)) + filler[1])
    found = index.matches(texts, 0.2)
    assert sum((k, k) in found for k in range(150)) >= 0.9 * 150
    exact = index.matches([["a"] + i + ["b"] for i in items], 0.2)
    assert all(exact[k, k][0] == 0 for k in range(150))
    clean = index.matches([[rng.choice(vocabulary) for _ in range(300)] for _ in range(50)], 0.2)
    assert not clean


def test_contaminated_edges(spark):
    item = "The quick brown fox, jumps over; the lazy dog while nobody is looking at all"
    bench = spark.createDataFrame([(1, item, 0), (2, None, 0), (3, "too short", 0), (4, item, 0), (5, "", 0)], "item_id long, text string, doc_id int")
    docs = spark.createDataFrame(
        [(1, f"Before. {item.upper()}! After", "x"), (2, None, "x"), (3, "", "x"), (4, "clean words only " * 50_000, "x"),
         (5, "pad " * 100_000 + item.replace("brown", "red"), "x"), (5, "clean", "x"), (None, item, "x"), (7, "the quick brown fox", "x"), (8, item, "x"), (8, item, "x")],
        "doc_id long, text string, item_id string")
    rows = D.contaminated(docs, bench).collect()
    assert sorted(((r.doc_id or 0), r.item_id, r.distance) for r in rows) == sorted(
        [(d, i, e) for d, e in [(1, 0), (5, 1), (0, 0), (8, 0), (8, 0)] for i in (1, 4)])
    one = next(r for r in rows if r.doc_id == 1)
    assert f"Before. {item.upper()}! After"[one.start : one.end] == item.upper()
    kept = D.decontaminate(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 7]
    assert D.contaminated(docs.limit(0), bench).count() == 0
    assert D.contaminated(docs, bench.limit(0)).count() == 0 and D.decontaminate(docs, bench.limit(0)).count() == 10
    assert {tuple(r) for r in D.contaminated(docs, bench, block_words=10).collect()} == {tuple(r) for r in rows}
