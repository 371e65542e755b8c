"""Packing: exact cover of every id, BM25 against the formula, neighbours in order."""

import math
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tidemark.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_bm25_scores_follow_the_formula():
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 30, rng.integers(1, 40)) if i else np.arange(20, 60) for i in range(50)]
    df = np.array([sum(t in d for d in docs) for t in range(60)])
    idf = np.log1p((50 - df + 0.5) / (df + 0.5))
    mean = sum(map(len, docs)) / 50
    index = packing.Bm25Shard(docs, idf, mean)
    for q in (0, 7, 49):
        for d in range(50):
            want = 0.0
            for t in set(docs[q].tolist()):
                tf = int((docs[d] == t).sum())
                want += idf[t] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(docs[d]) / mean))
            assert math.isclose(index.scores(q)[d], want, abs_tol=1e-4)


def test_document_frequencies_come_with_the_ids(spark):
    """One count per document and id, whatever the batches and tasks; a null id is a document like any other."""
    rng = random.Random(8)
    rows = [(i if i % 9 else None, " ".join(rng.choice(["word", "the", "Zeile,", "x\ny", "été"]) for _ in range(rng.randint(0, 9)))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    encoded, frequencies = packing.encode_documents(docs, PATH, 1)
    library, want = Tokenizer.from_file(PATH), defaultdict(int)
    for _, text in rows:
        for token in {*library.encode(text).ids, 1}:
            want[token] += 1
    assert {r.token: r.documents for r in frequencies.collect()} == want
    assert encoded.count() == 300 and encoded.columns == ["doc_id", "n_tokens", "id_bytes", "ids"]


def test_bm25_of_many_short_documents():
    """More documents than 16 bits count."""
    docs = [np.array([d % 7, 8], "<u2") for d in range(1 << 16)] + [np.array([9, 9], "<u2")]
    index = packing.Bm25Shard(docs, np.arange(10.0), 2.0)
    scores = index.scores(1 << 16)
    assert np.flatnonzero(scores).tolist() == [1 << 16] and math.isclose(scores[-1], 9 * 2 * 2.2 / (2 + 1.2), rel_tol=1e-5)
    assert math.isclose(index.scores(3)[10], 3 + 8, rel_tol=1e-5)


def test_neighbours_fill_a_window_by_score():
    order = {0: [0, 1, 5, 3], 2: [9, 9, 9, 9], 3: [0, 0, 0, 0], 1: [0, 0, 0, 0]}
    pieces = list(packing.pack_shard([4, 3, 5, 4], lambda d: np.array(order[d], float), 10))
    assert pieces == [(0, 0, 4, 0, 0), (2, 0, 5, 0, 4), (3, 0, 1, 0, 9), (3, 1, 3, 1, 0), (1, 0, 3, 1, 3)]
    assert list(packing.pack_shard([25], None, 10)) == [(0, 0, 10, 0, 0), (0, 10, 10, 1, 0), (0, 20, 5, 2, 0)]


def test_every_id_lies_in_one_piece(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["word", "the", "Zeile,", "x y"]) for _ in range(rng.randint(0, 90))), 0) for i in range(250)]
    rows += [(900, None, 1), (901, "", 1), (None, "no id", 1), (7, rows[7][1], 1), (902, "long text " * 5000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int")
    got = packing.pack_documents(docs, PATH, 1, window=128, shard_documents=40).collect()
    library = Tokenizer.from_file(PATH)
    ids = defaultdict(list)
    for key, text, _ in rows:
        ids[key].append(np.array(library.encode(text or "", add_special_tokens=False).ids + [1], "<u4"))
    covered = defaultdict(int)
    sequences = defaultdict(list)
    for r in got:
        own = ids[r.doc_id][0]
        assert r.doc_tokens == len(own) and zlib.crc32(own[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        covered[r.doc_id] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    assert covered == {k: sum(map(len, v)) for k, v in ids.items()}
    open_ = 0
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= 128
        open_ += at < 128
    assert open_ <= 7
    assert packing.pack_documents(docs.limit(0), PATH, 1).count() == 0
