"""Benchmark decontamination under edit distance: CGK embedding, bit-sampling LSH, exact verification."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_or_empty

_WORD = re.compile(r"\w+")
#: Items of fewer words are no passages and match nothing.
MIN_WORDS = 5
STRIDE = 4
SAMPLED = 5  # positions of the embedding in a hash
HASHES = 8  # hashes of one walk and window size
MAX_WALKS = 12


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters, digits and underscores."""
    return _WORD.findall((text or "").lower())


def window_of(n: int) -> int:
    """Words of the windows that stand for an item of ``n`` words: the item itself, 8 or 16 words."""
    return n if n < 11 else 8 if n < 20 else 16


def edits_for(n: int, max_edit: float) -> int:
    return int(n * max_edit + 1e-9)


def best_match(item: list, text: list, limit: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the part of ``text`` with the least word edit distance to ``item``, if within ``limit``.

    Of equal distances the part that ends first is taken, and of its starts the last.
    """
    row = [(0, -j) for j in range(len(text) + 1)]  # distance, minus the start
    for i, word in enumerate(item, 1):
        above, row = row, [(i, 0)]
        for j, other in enumerate(text, 1):
            d, s = above[j - 1]
            kept = (d + (word != other), s)
            d, s = above[j]
            if (d + 1, s) < kept:
                kept = (d + 1, s)
            d, s = row[j - 1]
            if (d + 1, s) < kept:
                kept = (d + 1, s)
            row.append(kept)
    distance, end = min((r[0], j) for j, r in enumerate(row))
    return (distance, -row[end][1], end) if distance <= limit else None


class Index:
    """LSH tables of a block of items.

    A walk reads a token at each of its steps and moves on or stays by a random bit of step and token (the CGK
    embedding of the text from that point on); a hash combines the tokens read at a few sampled steps. All
    windows of an item, one at every word, are in the tables, so texts need a window at every fourth word only.
    """

    def __init__(self, items: list[list[str]], walks: int, seed: int = 11):
        import numpy as np

        self.items, self.walks = items, walks
        self.sizes = sorted({window_of(len(i)) for i in items if len(i) >= MIN_WORDS})
        self.steps = {w: max(3, w * 3 // 2) for w in self.sizes}
        self.pad = max(self.steps.values(), default=0) + 1
        self.stride = STRIDE if all(len(i) >= 11 for i in items if len(i) >= MIN_WORDS) else 1
        rng = random.Random(seed)
        self.seeds = [rng.getrandbits(63) | 1 for _ in range(walks)]
        self.samples = [
            {w: [sorted(rng.sample(range(self.steps[w]), min(SAMPLED, self.steps[w]))) for _ in range(HASHES)] for w in self.sizes}
            for _ in range(walks)
        ]
        tokens, begins = self.join(items)
        owner = np.repeat(np.arange(len(items)), [len(i) for i in items])
        offset = np.concatenate([np.arange(len(i)) for i in items]) if items else np.empty(0, int)
        place = np.repeat(begins, [len(i) for i in items]) + offset
        size = np.array([window_of(len(i)) if len(i) >= MIN_WORDS else 0 for i in items], int)
        room = np.array([len(i) for i in items], int)[owner] - offset
        self.tables = []
        for walk, w, _, keys in self._keys(tokens, place):
            fit = (size[owner] == w) & (room >= w)
            own, order = keys[fit], np.argsort(keys[fit], kind="stable")
            bitmap = np.zeros(1 << 20, bool)
            bitmap[own >> np.uint64(44)] = True
            self.tables.append((bitmap, own[order], owner[fit][order], offset[fit][order]))

    def join(self, texts: list[list[str]]):
        """Token hashes of all texts in one array, apart by more pads than a walk has steps; where each begins."""
        import numpy as np

        sizes = np.array([len(t) for t in texts], np.int64)
        begins = np.concatenate([[0], np.cumsum(sizes + self.pad)])[:-1]
        tokens = np.zeros(int((sizes + self.pad).sum()) + self.pad, np.int64)
        for begin, words in zip(begins.tolist(), texts):
            tokens[begin : begin + len(words)] = np.fromiter(map(hash, words), np.int64, len(words))
        return tokens.view(np.uint64), begins

    def _keys(self, tokens, starts) -> Iterator:
        import numpy as np

        for walk in range(self.walks):
            bits = (tokens ^ np.uint64(self.seeds[walk])) * np.uint64(0x9E3779B97F4A7C15)
            bits ^= bits >> np.uint64(29)
            bits *= np.uint64(0xBF58476D1CE4E5B9)
            bits ^= bits >> np.uint64(32)
            wanted: dict[int, list] = {}
            for w, hashes in self.samples[walk].items():
                for z, steps in enumerate(hashes):
                    for s in steps:
                        wanted.setdefault(s, []).append((w, z))
            keys: dict = {}
            at = starts.copy()
            for step in range(max(wanted, default=-1) + 1):
                if step in wanted:
                    read = tokens[at]
                    for name in wanted[step]:
                        before = keys.get(name)
                        keys[name] = read * np.uint64(0xD6E8FEB86659FD93) if before is None else (
                            (before ^ (before >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) + read)
                at += ((bits[at] >> np.uint64(step)) & np.uint64(1)).astype(np.int64)
            for (w, z), key in sorted(keys.items()):
                key ^= key >> np.uint64(33)
                yield walk, w, z, key * np.uint64(0xFF51AFD7ED558CCD)

    def candidates(self, texts: list[list[str]]) -> set[tuple[int, int, int]]:
        """(text, item, where the item would begin in it) of everything that shares a hash."""
        import numpy as np

        if not self.tables:
            return set()
        tokens, begins = self.join(texts)
        starts = np.arange(0, len(tokens) - self.pad, self.stride)
        starts = starts[tokens[starts] != 0]
        found = set()
        for (bitmap, keys, owner, offset), (_, _, _, own) in zip(self.tables, self._keys(tokens, starts)):
            hit = np.flatnonzero(bitmap[own >> np.uint64(44)])
            low, high = np.searchsorted(keys, own[hit]), np.searchsorted(keys, own[hit], "right")
            real = high > low
            hit, low, count = hit[real], low[real], (high - low)[real]
            if not len(hit):
                continue
            ends = np.cumsum(count)
            row = np.arange(ends[-1]) + np.repeat(low - (ends - count), count)
            place = np.repeat(starts[hit], count)
            text = np.searchsorted(begins, place, "right") - 1
            found.update(zip(text.tolist(), owner[row].tolist(), (place - begins[text] - offset[row]).tolist()))
        return found

    def matches(self, texts: list[list[str]], max_edit: float) -> dict[tuple[int, int], tuple[int, int, int]]:
        """(text, item) to the best verified (distance, start, end) in words."""
        best: dict = {}
        last: dict = {}
        for text, item, at in sorted(self.candidates(texts)):
            words, whole = self.items[item], texts[text]
            limit = edits_for(len(words), max_edit)
            checked = last.get((text, item))
            if checked is not None and at - checked <= limit // 2:
                continue  # the part looked at last reaches over this one
            low, high = max(0, at - 2 * limit - 1), min(len(whole), at + len(words) + 2 * limit + 1)
            part = whole[low:high]
            begin = max(0, at)
            if whole[begin : begin + len(words)] == words:
                result = (0, begin, begin + len(words))
            else:
                have = set(part)
                if sum(w not in have for w in words) > limit:
                    continue
                got = best_match(words, part, limit)
                result = got and (got[0], got[1] + low, got[2] + low)
                last[text, item] = at
            if result and ((text, item) not in best or result < best[text, item]):
                best[text, item] = result
        return best


def walks_for(items: list[list[str]], max_edit: float, target_recall: float, trials: int = 4, seed: int = 3) -> int:
    """The fewest walks that find, on random edits of these items up to the limit, the wanted share; at most MAX_WALKS."""
    rng = random.Random(seed)
    long_ones = [i for i in items if len(i) >= MIN_WORDS]
    sample = rng.sample(long_ones, min(200, len(long_ones)))
    noisy, of = [], []
    for k, words in enumerate(sample):
        for _ in range(trials):
            own = ["~"] * rng.randrange(STRIDE) + list(words)
            for _ in range(edits_for(len(words), max_edit)):
                at = rng.randrange(len(own))
                kind = rng.randrange(3)
                if kind == 0:
                    own[at] = f"~{rng.random()}"
                elif kind == 1:
                    own.insert(at, f"~{rng.random()}")
                elif len(own) > 1:
                    del own[at]
            noisy.append(own)
            of.append(k)
    for walks in range(1, MAX_WALKS):
        seen = {(t, i) for t, i, _ in Index(sample, walks).candidates(noisy)}
        if sum((t, k) in seen for t, k in enumerate(of)) >= target_recall * len(noisy):
            return walks
    return MAX_WALKS


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    max_edit: float = 0.2, target_recall: float = 0.95, block_words: int = 1_000_000,
) -> DataFrame:
    """One row per document and benchmark item whose words it holds with at most ``max_edit`` edits per word.

    Columns: doc_id, item_id, distance and item_words (words), start and end (characters of the text).

    The items are the query set. They go out in blocks of at most ``block_words`` words, a bounded table, and
    each block is held against all documents where they lie: no shuffle, and no task sees more than its own
    rows. The number of walks is measured on random edits of the items so that ``target_recall`` is reached;
    every candidate is verified by its edit distance, so rows are never wrong. Unedited passages are always
    found.

    Null texts hold nothing; null or short items (under MIN_WORDS words) match nothing. Items with equal texts
    each get their row; of several places in a document the best is given, the first on ties. Repeated rows
    give repeated results. Other columns are not read. Empty tables give an empty result.
    """
    doc_type, item_type = dict(docs.dtypes)[id], dict(benchmark.dtypes)[item_id]
    schema = f"doc_id {doc_type}, item_id {item_type}, distance int, item_words int, start long, end long"
    rows = docs.select(F.col(id).alias("doc_id"), text_or_empty(text).alias("text"))
    result = None
    for keys, items in _blocks(benchmark.select(item_id, item_text), block_words):
        walks = walks_for(items, max_edit, target_recall)
        part = rows.mapInArrow(_search(keys, items, walks, max_edit), schema)
        result = part if result is None else result.union(part)
    return result if result is not None else docs.sparkSession.createDataFrame([], schema)


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[tuple[list, list[list[str]]]]:
    keys, items, held = [], [], 0
    for key, text in benchmark.toLocalIterator():
        words = words_of(text)
        if len(words) >= MIN_WORDS:
            keys.append(key)
            items.append(words)
            held += len(words)
        if held >= block_words:
            yield keys, items
            keys, items, held = [], [], 0
    if keys:
        yield keys, items


def _search(keys: list, items: list[list[str]], walks: int, max_edit: float, chunk_words: int = 1_000_000):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        index = Index(items, walks)

        def report(ids, raw, texts):
            out = [[] for _ in range(6)]
            for (t, i), (distance, first, last) in sorted(index.matches(texts, max_edit).items()):
                spans = [m.span() for m in _WORD.finditer(raw[t].lower())]
                for column, value in zip(out, (ids[t], keys[i], distance, len(items[i]), spans[first][0], spans[last - 1][1])):
                    column.append(value)
            return out

        for batch in batches:
            ids, raw, texts, held = [], [], [], 0
            for n, (key, value) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1)), 1):
                ids.append(key)
                raw.append(value.as_py())
                texts.append(words_of(raw[-1]))
                held += len(texts[-1])
                if held >= chunk_words or n == batch.num_rows:
                    out = report(ids, raw, texts)
                    types = [batch.schema.field(0).type, pa.array(keys).type, pa.int32(), pa.int32(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["doc_id", "item_id", "distance", "item_words", "start", "end"])
                    ids, raw, texts, held = [], [], [], 0

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with their own columns; rows without an id are judged together."""
    found = contaminated(docs, benchmark, id, text, **options).select(F.col("doc_id").alias("__leak")).distinct()
    return docs.join(found, F.col(id).eqNullSafe(F.col("__leak")), "left_anti")
