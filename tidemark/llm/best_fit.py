"""Vector best-fit packing: tokens, documents and attention cost of a sequence are bounded together."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import isqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored, text_or_empty
from tidemark.llm.tokens import id_encoder, without_collector

SHARD_PIECES = 16_384


def best_fit(lengths, capacities: tuple[int, int, int], weights: tuple[float, float, float], rule: str = "norm") -> tuple[list[int], int]:
    """(bin of every piece, number of bins) for lengths in descending order.

    A piece of n tokens asks for (n, 1, n * n) of a bin's tokens, documents and attention cost. Of the bins with
    room for all three it takes, by ``norm``, the one whose weighted rest is shortest afterwards, by ``dot`` the
    one with the largest weighted product of demand and rest; both in shares of the capacities, ties to the older
    bin. Without such a bin it opens one, so a piece must fit an empty bin. Bins that not even the shortest piece
    fits are closed.
    """
    import numpy as np

    if rule not in ("norm", "dot"):
        raise ValueError(f"unknown rule: {rule}")
    capacity = np.asarray(capacities, np.float64)
    rest = np.empty((3, 1024), np.int64)  # exact amounts decide what fits
    name = np.empty(1024, np.int64)
    opened, bins, chosen = 0, 0, []
    least = int(lengths[-1]) if len(lengths) else 0
    scale = np.asarray(weights, np.float64) / capacity**2
    for n in (int(x) for x in lengths):
        demand = (n, 1, n * n)
        at = -1
        if opened:
            free = rest[:, :opened]
            fits = np.flatnonzero((free[0] >= n) & (free[1] >= 1) & (free[2] >= demand[2]))
            if len(fits):
                room = free[:, fits].astype(np.float64)
                if rule == "norm":
                    room -= np.asarray(demand, np.float64)[:, None]
                    at = int(fits[np.argmin(scale @ (room * room))])
                else:
                    at = int(fits[np.argmax((scale * demand) @ room)])
        if at < 0:
            if opened == rest.shape[1]:
                rest, name = np.concatenate([rest, rest], axis=1), np.concatenate([name, name])
            at, opened = opened, opened + 1
            rest[:, at], name[at] = capacities, bins
            bins += 1
        chosen.append(int(name[at]))
        rest[:, at] -= demand
        if rest[0, at] < least or rest[1, at] < 1 or rest[2, at] < least * least:
            opened -= 1
            rest[:, at : opened] = rest[:, at + 1 : opened + 1].copy()
            name[at:opened] = name[at + 1 : opened + 1].copy()
    return chosen, bins


def encode_pieces(
    docs: DataFrame, tokenizer: str | Callable[[], str], end_id: int, longest: int, id: str = "doc_id", text: str = "text", with_ids: bool = False
) -> DataFrame:
    """(place, doc_id, piece, start, length, ids_crc32[, ids]): whole texts as ids with ``end_id``, cut, stored.

    ``place`` is another number for every row, whatever rows repeat; it is written once and then stays.
    """
    kind = dict(docs.dtypes)[id]

    def run(batches: Iterator) -> Iterator:
        import zlib

        import numpy as np
        import pyarrow as pa

        encode, dtype = id_encoder(tokenizer if isinstance(tokenizer, str) else tokenizer())
        stop = np.array([end_id], dtype).tobytes()
        for batch in batches:
            source, piece, start, length, crc, ids = [], [], [], [], [], []
            with without_collector():
                for row, value in enumerate(batch.column(1)):
                    own = np.frombuffer(encode(value.as_py()) + stop, dtype).astype("<u4")
                    for number, at in enumerate(range(0, len(own), longest)):
                        part = own[at : at + longest].tobytes()
                        source.append(row)
                        piece.append(number)
                        start.append(at)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            ids.append(part)
            columns = [batch.column(0).take(pa.array(source, pa.int64())), pa.array(piece, pa.int32()), *[pa.array(c, pa.int64()) for c in (start, length, crc)]]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array(ids, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(id).alias("doc_id"), text_or_empty(text).alias("text"))
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return stored(rows.mapInArrow(run, schema).select(F.monotonically_increasing_id().alias("place"), "*"), "pieces")


def pack_best_fit(
    docs: DataFrame, tokenizer: str | Callable[[], str], end_id: int, window: int = 2048, max_documents: int | None = None,
    max_attention: int | None = None, rule: str = "norm", id: str = "doc_id", text: str = "text", with_ids: bool = False,
    shard_pieces: int = SHARD_PIECES,
) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) of all documents.

    A sequence holds at most ``window`` tokens, ``max_documents`` pieces (default: no bound below the window) and
    an attention cost, the sum of squared piece lengths, of at most ``max_attention`` (default: the window's
    square, which every sequence keeps). A document is its ids and ``end_id``; only one too long for a sequence
    of its own is cut, into pieces as long as can be and a rest. ``ids`` are little-endian 32-bit values.

    Pieces are dealt out by a hash of their stored place, so that neither keys nor repeated rows decide the size
    of a shard (about ``shard_pieces``); a shard is one sorted group of small rows in a task, and packs longest
    first. A dimension's weight is the mean share of its capacity that a piece of the whole table asks for. A
    shard leaves a few sequences unfilled, whatever the table's size; full pieces need no search.

    Null text counts as empty: ``end_id`` alone. Repeated rows and null ids are packed once each. Pieces of one
    length go by place. Other columns are not read. No rows, no pieces.
    """
    cost = window * window if max_attention is None else max_attention
    count = window if max_documents is None else max_documents
    longest = min(window, isqrt(cost))
    if longest < 1 or count < 1:
        raise ValueError("a sequence must have room for a token and a document")
    pieces = encode_pieces(docs, tokenizer, end_id, longest, id, text, with_ids)
    rows, tokens, squares = pieces.agg(F.count(F.lit(1)), F.sum("length"), F.sum(F.col("length").cast("double") * F.col("length"))).first()
    shards = max(1, -(-rows // shard_pieces))
    capacities = (window, count, cost)
    weights = tuple((x or 0) / max(1, rows) / c for x, c in zip((tokens, rows, squares), capacities))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def solve(shard: int, parts: list):
            table = pa.Table.from_batches(parts)
            chosen, _ = best_fit(table["length"].to_numpy(), capacities, weights, rule)
            chosen, length = np.asarray(chosen, np.int64), table["length"].to_numpy()
            order = np.argsort(chosen, kind="stable")
            before = np.cumsum(length[order]) - length[order]
            first = np.r_[True, np.diff(chosen[order]) != 0]
            offset = np.empty(len(order), np.int64)
            offset[order] = before - np.repeat(before[first], np.diff(np.r_[np.flatnonzero(first), len(order)]))
            table = table.drop_columns(["shard", "place"])
            table = table.append_column("sequence_id", pa.array((shard << 32) + chosen)).append_column("offset", pa.array(offset))
            return table.select(names).to_batches()

        shard, held = None, []
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if own[a] != shard and held:
                    yield from solve(shard, held)
                    held = []
                shard = int(own[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from solve(shard, held)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else [])]
    kind = dict(pieces.dtypes)["doc_id"]
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + (", ids binary" if with_ids else "")
    dealt = pieces.select(F.pmod(F.xxhash64("place"), F.lit(shards)).alias("shard"), *pieces.columns)
    return dealt.repartition("shard").sortWithinPartitions("shard", F.desc("length"), "place").mapInArrow(run, schema)


def assemble(pieces: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, n_documents, attention, ids) from pieces packed ``with_ids``; a sequence is one bounded row."""
    in_order = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"), F.count(F.lit(1)).alias("n_documents"), F.sum(F.col("length") * F.col("length")).alias("attention"),
        F.aggregate(in_order, F.lit(b""), lambda all, one: F.concat(all, one["ids"])).alias("ids"))
