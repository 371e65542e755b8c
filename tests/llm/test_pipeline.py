"""Every stage of the corpus pipeline against plain Python, on documents and edge rows."""

from collections import defaultdict

import numpy as np
import public_tokenizers
from test_simhash import plain_components, plain_fingerprint
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import decontaminate, quality
from tidemark.session import table


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def leaks(text, items):
    words = decontaminate.words_of(text)
    grams = {tuple(words[i : i + 3]) for i in range(len(words) - 2)}
    for item in items:
        if len(item) >= decontaminate.MIN_WORDS and any(tuple(item[i : i + 3]) in grams for i in range(len(item) - 2)):
            if decontaminate.best_match(item, words, decontaminate.edits_for(len(item), 0.2)):
                return True
    return False


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    first = docs.where("text IS NOT NULL").orderBy("doc_id").limit(3).collect()
    item = table(spark, sf_dir, "benchmark").orderBy("item_id").first().text
    good = first[0].text
    extra = [(9001, good, None, None, None), (9002, good.upper(), "en", "x", 1), (9003, None, "en", "x", 1), (9004, "", "en", "x", 1),
             (9005, good + " more", "en", "x", 1), (9006, f"{good} {item} {good}", "en", "x", 1), (9007, good + " tail", "en", "x", 1)]
    docs = docs.union(spark.createDataFrame(extra, docs.schema))
    columns = docs.columns
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    score = model.scorer()
    items = [decontaminate.words_of(r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    rows = {r.doc_id: r.text for r in docs.collect()}

    def plain_quality(rows):
        return {k: t for k, t in rows.items() if score(t) >= 0.7}

    def plain_exact(rows):
        groups = defaultdict(list)
        for k, t in rows.items():
            groups[lower(t)].append(k)
        return {max(g): rows[max(g)] for g in groups.values()}

    def plain_near(rows):
        root = plain_components({k: plain_fingerprint(rows[k]) for k in sorted(rows)})
        return {k: t for k, t in rows.items() if root[k] == k}

    def plain_leaks(rows):
        return {k: t for k, t in rows.items() if not leaks(t, items)}

    now = docs
    for (_, stage), plain in zip(corpus_pipeline.STAGES[:4], [plain_quality, plain_exact, plain_near, plain_leaks], strict=True):
        now = corpus_pipeline.stored(stage(spark, now, sf_dir), "test-stage")
        rows = plain(rows)
        assert now.columns == columns
        assert {r.doc_id: r.text for r in now.collect()} == rows
    assert 100 < len(rows) < docs.count()

    pieces = corpus_pipeline.STAGES[4][1](spark, now, sf_dir).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    size = defaultdict(int)
    for r in pieces:
        size[r.doc_id] += r.length
    assert size == {k: len(library.encode(t or "", add_special_tokens=False).ids) + 1 for k, t in rows.items()}
    used = defaultdict(int)
    for r in pieces:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 2048 and np.sum(np.array(list(used.values())) < 2048) <= 1
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


def test_run(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "SimHash near-dedup", "benchmark decontamination", "packing"]
    assert set(corpus_pipeline.run(spark, sf_dir).columns) >= {"doc_id", "start", "length", "sequence_id", "offset"}
