"""Packing documents into training windows with lexical neighbours from a sharded BM25 index."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored, text_or_empty
from tidemark.llm.tokens import encode_column, id_encoder

PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Bm25Shard:
    """Inverted index of one shard: a posting per document and distinct id, weighted when it is built."""

    def __init__(self, documents: list, idf, mean_length: float, k1: float = 1.2, b: float = 0.75):
        import numpy as np

        ids = np.concatenate(documents)
        bits, kind = (16, np.uint32) if max(len(documents), int(ids.max()) + 1) <= 1 << 16 else (32, np.uint64)
        keys = np.repeat(np.arange(len(documents), dtype=kind) << kind(bits), [len(d) for d in documents]) | ids.astype(kind)
        keys.sort()
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        tf = np.diff(np.append(first, len(keys))).astype(np.float64)
        terms, doc = (keys[first] & kind((1 << bits) - 1)).astype(np.int64), (keys[first] >> kind(bits)).astype(np.int64)
        sizes = np.bincount(doc, minlength=len(documents))
        norm = k1 * (1 - b + b * np.array([len(d) for d in documents], np.float64) / mean_length)
        order = np.argsort(terms, kind="stable")
        doc_of, weight = doc[order].astype(np.int32), (idf[terms] * tf * (k1 + 1) / (tf + norm[doc]))[order].astype(np.float32)
        vocabulary, first, count = np.unique(terms[order], return_index=True, return_counts=True)
        place = np.searchsorted(vocabulary, terms)  # each document's terms as rows of the index
        # long postings are added up as whole rows, short ones one by one
        wide = count * 32 >= len(documents)
        row = np.where(wide, np.cumsum(wide) - 1, -1)
        inside = wide[place[order]]
        self.rows = np.zeros((int(wide.sum()), len(documents)), np.float32)
        self.rows[row[place[order][inside]], doc_of[inside]] = weight[inside]
        self.posting_doc, self.weight = doc_of, weight
        self.row, self.first, self.count, self.size = row[place], first[place], count[place], len(documents)
        self.begin = np.concatenate([[0], np.cumsum(sizes)])

    def scores(self, doc: int):
        """BM25 of every document of the shard for all distinct ids of ``doc`` as the query."""
        import numpy as np

        own = slice(self.begin[doc], self.begin[doc + 1])
        row = self.row[own]
        total = self.rows[row[row >= 0]].sum(axis=0)
        first, count = self.first[own][row < 0], self.count[own][row < 0]
        if not len(first):
            return total
        ends = np.cumsum(count)
        at = np.arange(ends[-1]) + np.repeat(first - (ends - count), count)
        return total + np.bincount(self.posting_doc[at], self.weight[at], self.size)


def pack_shard(lengths: list[int], scores: Callable, window: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece of a shard.

    Seeds are taken in order. A seed longer than the window first fills windows of its own; what is left begins
    a window, which unused neighbours fill in order of their score (then of their place). The neighbour that
    no longer fits is cut, and its rest is the next seed. So only the shard's last window is not full.
    """
    import numpy as np

    free = np.ones(len(lengths), bool)
    sequence, upcoming, rest = 0, 0, None
    while True:
        if rest is None:
            while upcoming < len(lengths) and not free[upcoming]:
                upcoming += 1
            if upcoming == len(lengths):
                return
            rest = (upcoming, 0)
            free[upcoming] = False
        doc, start = rest
        rest = None
        while lengths[doc] - start >= window:
            yield doc, start, window, sequence, 0
            sequence, start = sequence + 1, start + window
        filled = lengths[doc] - start
        if not filled:
            continue
        yield doc, start, filled, sequence, 0
        if free.any():
            ranked = np.where(free, scores(doc), -1.0)
            while filled < window:
                best = int(ranked.argmax())
                if ranked[best] < 0:
                    break
                ranked[best], free[best] = -1.0, False
                took = min(lengths[best], window - filled)
                yield best, 0, took, sequence, filled
                filled += took
                if took < lengths[best]:
                    rest = (best, took)
        sequence += 1


def count_documents(total, ids, dtype: str):
    """``total`` and the number of Arrow binaries of ids that hold each id."""
    import numpy as np

    _, offsets, data = ids.buffers()
    bounds = np.frombuffer(offsets, np.int32, len(ids) + 1, 4 * ids.offset) // np.dtype(dtype).itemsize
    values = np.frombuffer(data, dtype, bounds[-1])
    size = 1 + int(values[bounds[0] :].max(initial=0))
    if size > len(total):
        total = np.concatenate([total, np.zeros(size - len(total), np.int64)])
    found = np.empty((64, size), bool)
    for at in range(0, len(ids), len(found)):
        found[:] = False
        for row, i in enumerate(range(at, min(at + len(found), len(ids)))):
            found[row, values[bounds[i] : bounds[i + 1]]] = True
        total[:size] += found.sum(axis=0, dtype=np.uint8)
    return total


def encode_documents(
    docs: DataFrame, tokenizer: str | Callable[[], str], end_id: int, id: str = "doc_id", text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_tokens, id_bytes, ids): whole texts as little-endian ids with ``end_id`` after them, stored; and
    (token, documents) over all documents, for which a task adds a row of at most one count per id of the vocabulary.
    """
    kind = dict(docs.dtypes)[id]

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        encode, dtype = id_encoder(tokenizer if isinstance(tokenizer, str) else tokenizer())
        stop, total = np.array([end_id], dtype).tobytes(), np.zeros(0, np.int64)
        names, counted = ["doc_id", "n_tokens", "id_bytes", "ids", "tokens", "documents"], pa.list_(pa.int64())
        for batch in batches:
            key_type, at = batch.schema.field(0).type, 0
            for ids in encode_column(encode, batch.column(1), stop):
                total = count_documents(total, ids, dtype)
                counts = pc.divide(pc.cast(pc.binary_length(ids), pa.int64()), len(stop))
                width = pa.array(np.full(len(ids), len(stop), np.int32))
                none = pa.nulls(len(ids), counted)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(ids)), counts, width, ids, none, none], names)
                at += len(ids)
        if len(total):
            seen = np.flatnonzero(total)
            types = [key_type, pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [*[pa.nulls(1, t) for t in types], *[pa.array([x], counted) for x in (seen, total[seen])]], names)

    rows = docs.select(F.col(id).alias("doc_id"), text_or_empty(text).alias("text"))
    table = stored(rows.mapInArrow(
        run, f"doc_id {kind}, n_tokens long, id_bytes int, ids binary, tokens array<long>, documents array<long>"), "token-ids")
    each = table.where("n_tokens IS NULL").select(F.explode(F.arrays_zip("tokens", "documents")).alias("c")).select("c.*")
    frequencies = each.withColumnRenamed("tokens", "token").groupBy("token").agg(F.sum("documents").alias("documents"))
    return table.where("n_tokens IS NOT NULL").drop("tokens", "documents"), frequencies


def pack_documents(
    docs: DataFrame, tokenizer: str | Callable[[], str], end_id: int, window: int = 2048, id: str = "doc_id", text: str = "text",
    shard_documents: int = 1000,
) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of all documents.

    Every id of every document, with ``end_id`` after each, lies in exactly one piece; a sequence holds at most
    ``window`` ids. Shards of about ``shard_documents`` documents are drawn by a hash of id and text, so that no
    key or group decides their size; a shard is one group of rows in a task, with its own inverted index and
    seeds. Document frequencies and the mean length are those of all documents: a table of at most one row per
    id of the vocabulary, which travels with the tasks. Only the last sequence of a shard has padding.

    Null text counts as empty and is packed as ``end_id`` alone. Ties of score go to the smaller place in
    (id, ids) order. Repeated rows are packed once each. Other columns are not read. No rows, no pieces.
    """
    encoded, frequencies = encode_documents(docs, tokenizer, end_id, id, text)
    rows, tokens = encoded.agg(F.count(F.lit(1)), F.sum("n_tokens")).first()
    frequencies = frequencies.collect()  # bounded by the vocabulary
    shards, mean = max(1, -(-rows // shard_documents)), (tokens or 0) / max(1, rows)
    size = 1 + max((r.token for r in frequencies), default=0)
    kind = dict(encoded.dtypes)["doc_id"]
    known = [(r.token, r.documents) for r in frequencies]

    def run(batches: Iterator) -> Iterator:
        import zlib

        import numpy as np
        import pyarrow as pa

        idf = np.zeros(size)
        if known:
            at, n = np.array(known).T
            idf[at] = np.log1p((rows - n + 0.5) / (n + 0.5))

        def solve(shard, keys, ids):
            index = Bm25Shard(ids, idf, mean)
            pieces = list(pack_shard([len(x) for x in ids], index.scores, window))
            doc, start, length, sequence, offset = (list(c) for c in zip(*pieces))
            crcs = [zlib.crc32(ids[d][s : s + n].astype("<u4").tobytes()) for d, s, n in zip(doc, start, length)]
            columns = [start, length, crcs, [len(ids[d]) for d in doc], [(shard << 32) + s for s in sequence], offset]
            return pa.RecordBatch.from_arrays(
                [pa.array([keys[d] for d in doc], key_type), *[pa.array(c, pa.int64()) for c in columns]],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        shard, keys, ids = None, [], []
        for batch in batches:
            key_type = batch.schema.field(1).type
            for own, key, width, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                if own != shard and keys:
                    yield solve(shard, keys, ids)
                    keys, ids = [], []
                shard = own
                keys.append(key)
                ids.append(np.frombuffer(data.as_py(), f"<u{width}"))
        if keys:
            yield solve(shard, keys, ids)

    placed = encoded.select(F.pmod(F.xxhash64("doc_id", "ids"), F.lit(shards)).alias("shard"), "doc_id", "id_bytes", "ids")
    dealt = placed.repartition("shard").sortWithinPartitions("shard", "doc_id", "ids")
    return dealt.mapInArrow(run, f"doc_id {kind}, {PIECES}")
