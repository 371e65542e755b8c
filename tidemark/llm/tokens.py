"""Encoding whole texts with a public tokenizer file, piece by piece and remembered."""

from __future__ import annotations

import gc
import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager

# GPT-2's pattern, which cuts a text before the merges of a byte-level BPE file; a fixed, published value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_TIED_SPACE = re.compile(r"\s (?:\s|$)")
_SIGNS = ".,%&$#*!?;:|"
_LETTERS = "".join(c for c in map(chr, range(0x530)) if c.isalpha())  # long in Unicode: Latin, Greek, Cyrillic
# White space by Python's ``\s``, for Arrow's expressions.
_SPACES = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
REMEMBERED = 400_000
SLICE_BYTES = 32 << 20


@contextmanager
def without_collector() -> Iterator[None]:
    """Encoding makes no reference cycles, and the collector would walk all remembered pieces again and again."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def byte_letters() -> dict[int, str]:
    """Byte-level BPE writes bytes as letters: printable bytes as themselves, the others from 256 on, in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b if b in printable else next(others)) for b in range(256)}


class _Units(dict):
    """Ids, as bytes, of the texts between blanks; forgets the older half when it is full."""

    def __init__(self, encode: Callable[[str], bytes]):
        self.encode, self.older = encode, {}

    def __missing__(self, unit: str) -> bytes:
        ids = self.older.get(unit)
        if ids is None:
            ids = self.encode(unit)
        if len(self) >= REMEMBERED:
            self.add({})
        self[unit] = ids
        return ids

    def add(self, fresh: dict[str, bytes]) -> None:
        if len(self) + len(fresh) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        self.update(fresh)


# Normalising and cutting of files that drop white space, lower-case and take words apart; fixed, published values.
_WORD_FILE = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}
_NOT_SPACE_THERE = re.compile("[\x1c-\x1f]")  # Python splits at these, the file does not


def word_encoder(whole: Callable[[str], bytes], ids_of: Callable[[str], bytes], special: list[str]) -> Callable[[str], bytes]:
    """Encodes word by word: no step of such a file looks across white space, and words are remembered.

    Latin-1 letters, with signs after them or not, need no normaliser but ``lower``; other words take the long way.
    """
    marks = {s[:2] for s in special}
    letters = dict(enumerate(byte_letters().values()))

    def unit(text: str) -> bytes:
        word = text.rstrip(_SIGNS)
        if not word.isalpha():
            return whole(text)
        if len(word) < len(text):
            return known(word) + tails[text[len(word) :]]
        if word.isascii():
            return ids_of(word.lower())
        try:
            word.encode("latin-1")
        except UnicodeEncodeError:
            return whole(text)
        return ids_of(word.lower().encode().decode("latin-1").translate(letters))

    tails = _Units(ids_of)
    known = _Units(unit).__getitem__

    def encode(text: str) -> bytes:
        if _NOT_SPACE_THERE.search(text) or any(m in text for m in marks):
            return whole(text)
        return b"".join(map(known, text.split()))

    return encode


class BlankEncoder:
    """Encodes blank by blank: a blank that has a character other than white space on one side at least begins a new
    piece, so the ids of a text are those of its start and of each blank with what follows, which are remembered.
    Texts with wider gaps or special tokens go to the tokenizer as a whole. A column is cut, and its distinct units
    are found, in Arrow; Python sees the distinct words of letters, and the few units that are anything else.
    """

    def __init__(self, whole: Callable[[str], bytes], ids_of: Callable[[str], bytes], merge: Callable[[str], list], dtype: str, special: list[str]):
        import regex

        self.whole, self.merge, self.dtype, self.special = whole, merge, dtype, "|".join(map(re.escape, special))
        self.long_way = re.compile("|".join(filter(None, [_TIED_SPACE.pattern, self.special])))
        letters = dict(enumerate(byte_letters().values()))
        self.lines = letters | {10: "\n"}
        pieces = regex.compile(PATTERN).findall

        def merged(piece: str) -> bytes:
            return ids_of(piece.encode().decode("latin-1").translate(letters))

        def remembered(lead: str) -> _Units:
            """Letters are one piece, letters and then signs are two; a line break between other signs is one."""
            written = lead.translate(letters)

            def unit(text: str) -> bytes:
                if text.isalpha():  # printable ASCII is written as itself
                    return ids_of(written + text) if text.isascii() else merged(lead + text)
                word = text.rstrip(_SIGNS)
                if word.isalpha():
                    return units[word] + tails[text[len(word) :]]
                lines = text.split("\n")
                if len(lines) > 1 and all(x and not x[0].isspace() and not x[-1].isspace() for x in lines):
                    return line_break.join([units[lines[0]], *map(self.starts.__getitem__, lines[1:])])
                return b"".join(map(merged, pieces(lead + text)))

            units = _Units(unit)
            return units

        line_break, tails = merged("\n"), _Units(ids_of)
        self.tails = tails
        self.starts, self.units = remembered(""), remembered(" ")

    def __call__(self, text: str) -> bytes:
        if self.long_way.search(text):
            return self.whole(text)
        first, blank, rest = text.partition(" ")
        head = self.starts[first]
        return head + b"".join(map(self.units.__getitem__, rest.split(" "))) if blank else head

    def word_ids(self, words: list[str]) -> list[bytes]:
        """Ids of blanks with these distinct words of letters; those not met before are merged one after the other."""
        from itertools import chain
        from operator import attrgetter

        import numpy as np

        met, older, width = self.units.get, self.units.older.get, int(self.dtype[-1])
        known = {w: met(w) or older(w) for w in words}
        new = [w for w, ids in known.items() if ids is None]
        written = (" " + "\n ".join(new)).encode().decode("latin-1").translate(self.lines).split("\n")
        for at in range(0, len(new), 20_000):
            found = list(map(self.merge, written[at : at + 20_000]))
            ends = (np.cumsum(list(map(len, found))) * width).tolist()
            ids = np.fromiter(map(attrgetter("id"), chain.from_iterable(found)), self.dtype, ends[-1] // width).tobytes()
            known.update(zip(new[at : at + 20_000], [ids[a:b] for a, b in zip([0, *ends], ends)]))
        self.units.add(known)
        return list(known.values())

    def unit_ids(self, units):
        """Ids of blanks with these distinct texts. Letters, with signs after them or not, are put together in Arrow."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        words, tails = pc.utf8_rtrim(units, characters=_SIGNS), pc.utf8_ltrim(units, characters=_LETTERS)
        length = pc.binary_length(words)
        plain = pc.and_(pc.greater(length, 0), pc.equal(pc.add(length, pc.binary_length(tails)), pc.binary_length(units)))
        words, tails = words.filter(plain).dictionary_encode(), tails.filter(plain).dictionary_encode()
        known = pa.array(self.word_ids(words.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.binary())
        signs = pa.array([self.tails[t] if t else b"" for t in tails.dictionary.to_pylist()], pa.binary())
        joined = pc.binary_join_element_wise(known.take(words.indices), signs.take(tails.indices), pa.scalar(b"", pa.binary()))
        others = units.filter(pc.invert(plain)).to_numpy(zero_copy_only=False)
        place = np.argsort(~plain.to_numpy(zero_copy_only=False), kind="stable")
        back = np.empty(len(units), np.int32)
        back[place] = np.arange(len(units), dtype=np.int32)
        return pa.concat_arrays([joined, pa.array(map(self.units.__getitem__, others), pa.binary())]), back

    def column(self, texts, end: bytes):
        """Arrow strings, none null, to Arrow binaries of their ids and ``end``: a distinct unit is looked up once."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        gap = pc.match_substring_regex(texts, f"[{_SPACES}] (?:[{_SPACES}]|$)")
        if self.special:
            gap = pc.or_(gap, pc.match_substring_regex(texts, self.special))
        odd = np.flatnonzero(gap.to_numpy(zero_copy_only=False))
        if len(odd):
            texts, long_way = pc.if_else(gap, "", texts), [self.whole(t) for t in texts.take(pa.array(odd)).to_pylist()]
        else:
            long_way = []
        cut = pc.split_pattern(texts, " ")
        bounds, units = cut.offsets.to_numpy(), cut.flatten().dictionary_encode()
        heads = cut.flatten().take(pa.array(bounds[:-1])).dictionary_encode()
        known, place = self.unit_ids(units.dictionary)
        more = [*map(self.starts.__getitem__, heads.dictionary.to_pylist()), *long_way, end]
        at = place[units.indices.to_numpy()]
        at[bounds[:-1]] = len(known) + heads.indices.to_numpy()
        at[bounds[odd]] = len(known) + len(heads.dictionary) + np.arange(len(odd))
        known = pa.concat_arrays([known, pa.array(more, pa.binary())])
        placed = known.take(pa.array(np.insert(at, bounds[1:], len(known) - 1)))
        _, offsets, data = placed.buffers()
        ends = np.frombuffer(offsets, np.int32)[bounds + np.arange(len(bounds))]
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(ends), data])


def encode_column(encode: Callable[[str], bytes], texts, end: bytes) -> Iterator:
    """Arrow strings to Arrow binaries of their ids and ``end``, in slices of bounded text."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    if not isinstance(encode, BlankEncoder):
        with without_collector():
            ids = pa.array([encode(t.as_py()) + end for t in texts], pa.binary())
        yield ids
        return
    texts = texts.cast(pa.string())
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        done = sizes[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(sizes, done + SLICE_BYTES, "right")))
        with without_collector():
            ids = encode.column(texts.slice(at, upto - at), end)
        yield ids
        at = upto


def id_encoder(path: str) -> tuple[Callable[[str], bytes], str]:
    """(text to its ids as little-endian bytes, numpy type of an id) for a ``tokenizers`` file.

    A byte-level BPE file with the usual pattern is encoded blank by blank, one that drops white space word by word,
    any other text by text. All ways give what ``encode(text, add_special_tokens=False)`` gives.
    """
    import array
    import json

    import numpy as np
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    kind = "H" if tokenizer.get_vocab_size() <= 1 << 16 else "I"
    dtype = "<u2" if kind == "H" else "<u4"

    def whole(text: str) -> bytes:
        return np.asarray(tokenizer.encode(text, add_special_tokens=False).ids, dtype).tobytes()

    with open(path, encoding="utf-8") as file:
        described = json.load(file)
    split = described.get("pre_tokenizer") or {}
    special = [t["content"] for t in described.get("added_tokens", [])]
    plain = (
        described["model"]["type"] == "BPE" and described.get("normalizer") is None and split.get("type") == "ByteLevel"
        and not split.get("add_prefix_space") and split.get("use_regex", True) and not any(" " in t for t in special)
        and all(any(not c.isalpha() and c not in _SIGNS for c in t) for t in special)
        and (described.get("post_processor") or {}).get("type", "ByteLevel") == "ByteLevel"
    )
    merge, typed = tokenizer.model.tokenize, array.array

    def ids_of(written: str) -> bytes:
        return typed(kind, [t.id for t in merge(written)]).tobytes()

    if not plain:
        words = all(described.get(k) == v for k, v in _WORD_FILE.items()) and described["model"]["type"] == "BPE"
        return (word_encoder(whole, ids_of, special) if words and all(special) else whole), dtype
    return BlankEncoder(whole, ids_of, merge, dtype, special), dtype
