"""Trigram losses against a plain count."""

import math
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

from tidemark.llm import lm_score


def plain_loss(texts, text, weight=4.0):
    c3, c2, c1 = Counter(), Counter(), Counter()
    for t in texts:
        d = b"\0\0" + (t or "").encode()
        for i in range(2, len(d)):
            c3[d[i - 2 : i + 1]] += 1
            c2[d[i - 1 : i + 1]] += 1
            c1[d[i]] += 1
    n = sum(c1.values())
    h2, h3 = Counter(), Counter()
    for g, k in c3.items():
        h3[g[:2]] += k
    for g, k in c2.items():
        h2[g[:1]] += k
    d, total = b"\0\0" + text.encode(), 0.0
    for i in range(2, len(d)):
        p = (c1[d[i]] + 1) / (n + 256)
        p = (c2[d[i - 1 : i + 1]] + weight * p) / (h2[d[i - 1 : i]] + weight)
        p = (c3[d[i - 2 : i + 1]] + weight * p) / (h3[d[i - 2 : i]] + weight)
        total -= math.log2(p)
    return total / max(1, len(d) - 2)


def test_cross_entropy_difference(spark):
    texts = ["the cat sat on the mat", "a cat", "zzz qqq é", None, "", "the cat sat on the mat", "long " * 100_000]
    docs = spark.createDataFrame([(i if i != 1 else None, t, 0.0) for i, t in enumerate(texts)], "doc_id long, text string, tokens double")
    target = docs.where("text LIKE '%cat%'")
    rows = lm_score.cross_entropy_difference(docs, target).collect()
    goal = [t for t in texts if t and "cat" in t]
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[1 if r.doc_id is None else r.doc_id] or ""
        assert r.tokens == len(text.encode())
        assert math.isclose(r.target_loss, plain_loss(goal, text), rel_tol=1e-4, abs_tol=1e-6)
        assert math.isclose(r.background_loss, plain_loss(texts, text), rel_tol=1e-4, abs_tol=1e-6)
        assert r.difference == r.target_loss - r.background_loss
    by = {r.doc_id: r.difference for r in rows}
    assert by[0] < by[2]
    assert lm_score.cross_entropy_difference(docs, target.limit(0)).count() == len(texts)
    assert lm_score.cross_entropy_difference(docs.limit(0), target).count() == 0


def test_token_bigrams_against_a_plain_count(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = ["the cat sat on the mat", "a cat", "zzz qqq é", None, "", "the cat sat on the mat", "mat the on sat cat the", "long " * 20_000]
    docs = spark.createDataFrame([(i if i != 1 else None, t, 0.0) for i, t in enumerate(texts)], "doc_id long, text string, tokens double")
    target = docs.where("text LIKE '%cat sat%'")
    ids = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    vocabulary = len({i for x in ids for i in x})

    def plain(rows, own):
        c2 = Counter((a, b) for x in rows for a, b in zip([None, *x], x))
        before, single = Counter(), Counter()
        for (a, b), n in c2.items():
            before[a] += n
            single[b] += n
        n, total = sum(single.values()), 0.0
        for a, b in zip([None, *own], own):
            total -= math.log2((c2[a, b] + 4 * (single[b] + 1) / (n + vocabulary)) / (before[a] + 4))
        return total / max(1, len(own))

    goal = [x for x, t in zip(ids, texts) if t and "cat sat" in t]
    rows = lm_score.token_cross_entropy_difference(docs, target, path).collect()
    assert len(rows) == len(texts)
    for r in rows:
        own = ids[1 if r.doc_id is None else r.doc_id]
        assert r.tokens == len(own)
        assert math.isclose(r.target_loss, plain(goal, own), rel_tol=1e-5, abs_tol=1e-5)
        assert math.isclose(r.background_loss, plain(ids, own), rel_tol=1e-5, abs_tol=1e-5)
    by = {r.doc_id: r.difference for r in rows}
    assert by[0] < by[6]
    assert lm_score.token_cross_entropy_difference(docs, target.limit(0), path).count() == len(texts)
    assert lm_score.token_cross_entropy_difference(docs.limit(0), target, path).count() == 0


def test_texts_of_a_chunk_send_a_bigram_once(spark, monkeypatch):
    """One row for a bigram and chunk goes through the shuffles, however many texts of the chunk have it."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(i, "the cat sat on the mat") for i in range(100)] + [(100, None)], "doc_id long, text string").coalesce(1)
    sent = lm_score.bigrams(docs, path, "doc_id", "text").selectExpr("sum(size(grams)) AS grams", "sum(aggregate(counts, 0, (a, n) -> a + n)) AS ids").first()
    assert (sent.grams, sent.ids) == (6, 600)
    whole = lm_score.token_cross_entropy_difference(docs, docs.where("doc_id < 3"), path).collect()
    monkeypatch.setattr(lm_score, "CHUNK_IDS", 30)
    assert lm_score.bigrams(docs, path, "doc_id", "text").select("chunk").distinct().count() == 34
    assert sorted(lm_score.token_cross_entropy_difference(docs, docs.where("doc_id < 3"), path).collect()) == sorted(whole)
