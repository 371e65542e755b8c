"""Token store: exact round trip against the tokenizer itself."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tidemark.llm import token_store, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["a", "B", "é", " ", "  ", "\n", "\t", "1", "²", "Ⅷ", "'s", "'", ",", "%%%", "<|endoftext|>", "日", "🙂", " word", "-", "_", "\r", "ª", "word."]


def test_encoder_equals_the_library():
    encode, dtype = tokens.id_encoder(PATH)
    library, rng = Tokenizer.from_file(PATH), random.Random(0)
    for _ in range(4000):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14)))
        assert np.frombuffer(encode(text), dtype).tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_columns_equal_the_library():
    """Every kind of white space, special tokens in gaps, letters in and out of the quick set, slices of a column."""
    encode, dtype = tokens.id_encoder(PATH)
    library, rng, stop = Tokenizer.from_file(PATH), random.Random(2), np.array([7], "<u2").tobytes()
    more = [*PIECES, " ", " ", "\n", ".\nThe", "été", "Ж", "ÿ.", "µ", "ͿՀ", "क", "\x0b", "\x1c", "\x85", "\xa0", "\u2028", "\u3000", "  <|endoftext|>", "!!!", "...x"]
    texts = ["", " ", "\n", *("".join(rng.choice(more) for _ in range(rng.randint(0, 14))) for _ in range(6000))]
    want = [[*library.encode(t, add_special_tokens=False).ids, 7] for t in texts]
    column = pa.array(["left out", *texts])[1:]
    for size in (1 << 10, 1 << 25):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(tokens, "SLICE_BYTES", size)
            got = [np.frombuffer(x, dtype).tolist() for part in tokens.encode_column(encode, column, stop) for x in part.to_pylist()]
        assert got == want
    assert [np.frombuffer(encode(t), dtype).tolist() for t in texts] == [w[:-1] for w in want]


def test_a_word_goes_to_the_tokenizer_once():
    """Also with signs, and beside a line break, whose two words used to be cut and merged again with each neighbour."""
    model, asked = Tokenizer.from_file(PATH).model, []

    def merge(written):
        asked.append(written)
        return model.tokenize(written)

    def ids_of(written):
        return np.array([t.id for t in merge(written)], "<u2").tobytes()

    encode = tokens.BlankEncoder(lambda text: pytest.fail(text), ids_of, merge, "<u2", [])
    library = Tokenizer.from_file(PATH)
    texts = [f"Start {a}{b} {b}.\n{a}, {a}" for a in ("alpha", "béta", "gamma") for b in ("delta", "zêta", "eta")]
    for _ in range(2):
        got = [x for part in tokens.encode_column(encode, pa.array(texts), b"") for x in part.to_pylist()]
        assert [np.frombuffer(x, "<u2").tolist() for x in got] == [library.encode(t).ids for t in texts]
    assert len(asked) == len(set(asked)) == 2 + 9 + 3 + 3 + 3 + len(".\n,")  # Start in two ways, pairs, b, a after a line break, a


def test_other_files_are_encoded_whole():
    path = public_tokenizers.path("word_bpe_49k.json")
    encode, dtype = tokens.id_encoder(path)
    assert np.frombuffer(encode("Some  Words here"), dtype).tolist() == Tokenizer.from_file(path).encode(
        "Some  Words here", add_special_tokens=False).ids


@pytest.mark.parametrize("lengths", [[], [0], [1], [0, 0, 5, 0], [3] * 2000, [1, 10**6, 1], list(range(1500))])
def test_image_round_trip(lengths):
    n = sum(lengths)
    ids = (np.arange(n) % 50_000).astype("<u2")
    data = token_store.write_image(ids.tobytes(), lengths, 2)
    image = token_store.Image(data)
    ends = np.cumsum(lengths).astype(int).tolist()
    blocks = [image.block_ends(b).tolist() for b in range(image.samples_n)]
    assert [e for own in blocks for e in own] == ends and all(len(own) == 512 for own in blocks[:-1])
    for i in {0, 1, 511, 512, 513, len(lengths) - 1} & set(range(len(lengths))):
        assert image.end(i) == ends[i]
        assert image.document(i).tolist() == ids[ends[i] - lengths[i] : ends[i]].tolist()
    assert len(data) - 2 * n <= 40 + len(lengths) * (4 + max(1, n // max(1, len(lengths))).bit_length()) / 8 + 16 + len(lengths) / 100


def test_store(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["word", "the", "Zeile,", "x y"]) for _ in range(rng.randint(0, 60))), i) for i in range(300)]
    rows += [(1000, None, 1), (-5, "", 1), (None, "no id", 1), (7, rows[7][1], 1), (400, "long text " * 60_000, 1)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int")
    path = token_store.write_store(docs, PATH, 0, image_ids=500, partitions=7)
    store = spark.read.parquet(path)
    assert store.count() > 20
    got = sorted(token_store.read_boundaries(store).collect(), key=lambda r: r.start)
    library, at = Tokenizer.from_file(PATH), 0
    for r, (key, text, _) in zip(got, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)), strict=True):
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (key, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert token_store.read_boundaries(spark.read.parquet(token_store.write_store(docs.limit(0), PATH, 0))).count() == 0
