"""Vector best-fit packing: the rule by plain Python, every constraint, exact round trip, fill."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import best_fit, queries, tokens
from tidemark.session import table

PATH = public_tokenizers.path("word_bpe_49k.json")
PIECES = ["a", "B", "é", "É", " ", "  ", "\n", "1", "'s", "'S", "'", ",", "%%%", "<|endoftext|>", "日", " Word", "Σ", "ß", "µ", "́", "\x1c", "\x85", "²", "ſ", ". "]


def plain_best_fit(lengths, capacities, weights, rule):
    bins, chosen = [], []
    for n in lengths:
        demand, best = (n, 1, n * n), None
        for i, rest in enumerate(bins):
            if any(r < d for r, d in zip(rest, demand)):
                continue
            if rule == "norm":
                score = -sum(w * ((r - d) / c) ** 2 for w, r, d, c in zip(weights, rest, demand, capacities))
            else:
                score = sum(w * (d / c) * (r / c) for w, r, d, c in zip(weights, rest, demand, capacities))
            if best is None or score > best[0] + 1e-15:
                best = (score, i)
        if best is None:
            bins.append(list(capacities))
            best = (0, len(bins) - 1)
        bins[best[1]] = [r - d for r, d in zip(bins[best[1]], demand)]
        chosen.append(best[1])
    return chosen, len(bins)


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("capacities", [(64, 64, 4096), (64, 3, 4096), (64, 64, 1000), (1024, 5, 2**18)])
def test_rule_equals_plain_python(rule, capacities):
    rng = random.Random(1)
    top = min(capacities[0], int(capacities[2] ** 0.5))
    for _ in range(6):
        lengths = sorted((rng.randint(1, top) for _ in range(150)), reverse=True)
        weights = (0.5, 0.25, 0.125)
        chosen, bins = best_fit.best_fit(lengths, capacities, weights, rule)
        assert (chosen, bins) == plain_best_fit(lengths, capacities, weights, rule)
        for b in range(bins):
            own = [n for n, c in zip(lengths, chosen) if c == b]
            assert sum(own) <= capacities[0] and len(own) <= capacities[1] and sum(n * n for n in own) <= capacities[2]


def test_nothing_and_unknown_rule():
    assert best_fit.best_fit([], (8, 8, 64), (1, 0, 0)) == ([], 0)
    with pytest.raises(ValueError):
        best_fit.best_fit([1], (8, 8, 64), (1, 0, 0), "first")


def test_word_files_are_encoded_as_the_library_does():
    encode, dtype = tokens.id_encoder(PATH)
    library, rng = Tokenizer.from_file(PATH), random.Random(0)
    for _ in range(6000):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 12)))
        assert np.frombuffer(encode(text), dtype).tolist() == library.encode(text, add_special_tokens=False).ids, text


def _docs(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["Word", "the", "zeile,", "x y", "été"]) for _ in range(rng.randint(0, 90))), i) for i in range(300)]
    rows += [(1000, None, 1), (-5, "", 1), (None, "no id", 1), (7, rows[7][1], 1), (400, "long text " * 700, 1)] + [(9, "same row", 2)] * 300
    return rows, spark.createDataFrame(rows, "doc_id long, text string, offset int")


@pytest.mark.parametrize("options", [{}, {"max_documents": 4}, {"max_attention": 40 * 40}, {"rule": "dot", "shard_pieces": 100}])
def test_operator(spark, options):
    window, library = 128, Tokenizer.from_file(PATH)
    rows, docs = _docs(spark)
    pieces = best_fit.pack_best_fit(docs, PATH, 0, window, with_ids=True, **options)
    got = pieces.collect()
    longest = min(window, int(options.get("max_attention", window * window) ** 0.5))
    want = []
    for key, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        for number, at in enumerate(range(0, len(ids), longest)):
            part = np.array(ids[at : at + longest], "<u4").tobytes()
            want.append((key is None, key or 0, number, at, len(part) // 4, zlib.crc32(part), part))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in got) == sorted(want)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append(r)
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:i]) for i in range(len(own))]
        assert sum(r.length for r in own) <= window and len(own) <= options.get("max_documents", window)
        assert sum(r.length**2 for r in own) <= options.get("max_attention", window * window)
    if not options:
        assert len(sequences) <= -(-sum(r.length for r in got) // window) + 2
    whole = best_fit.assemble(spark.createDataFrame(got, pieces.schema)).collect()
    assert {r.sequence_id: bytes(r.ids) for r in whole} == {k: b"".join(bytes(r.ids) for r in own) for k, own in sequences.items()}


def test_empty_table_and_bad_limits(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert best_fit.pack_best_fit(docs, PATH, 0).collect() == []
    with pytest.raises(ValueError):
        best_fit.pack_best_fit(docs, PATH, 0, max_documents=0)


def test_query(spark, sf_dir):
    got = queries.op12_best_fit(spark, sf_dir).withColumn("end", F.col("offset") + F.col("length")).cache()
    library, rows = Tokenizer.from_file(PATH), got.collect()
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    for d in table(spark, sf_dir, "documents").collect():
        ids = np.array(library.encode(d.text or "", add_special_tokens=False).ids + [0], "<u4")
        own = sorted(pieces.pop(d.doc_id), key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in own] == [
            (i, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for i, a in enumerate(range(0, len(ids), 2048))]
    assert not pieces
    totals = got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max("end").alias("end")).collect()
    assert all(r.n == r.end <= 2048 for r in totals)
    assert len(totals) <= -(-sum(r.n for r in totals) // 2048) + 1
