"""Token ids in binary images with Elias-Fano encoded document boundaries.

An image is one file of the store (little-endian):

    "TMKT" | version u2 | id bytes u2 | documents u8 | ids u8 | low bits u4 | spare u4 |
    low parts, padded to bytes | high parts, padded to 8 bytes | select samples u4 per 512 ones | ids

Boundaries are the end positions of the documents. With n documents and u ids, the lower log2(u / n) bits of
each end are stored as they are and the rest in unary, about 2 + log2(u / n) bits for a document; a document's
end is found by the sample of its 512-block and a select inside that block.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import fresh_path, stored, text_or_empty
from tidemark.llm.tokens import encode_column, id_encoder

MAGIC, VERSION, HEAD, SAMPLE = b"TMKT", 1, "<4sHHQQII", 512


def write_image(ids: bytes, lengths, id_bytes: int) -> bytes:
    """The image of the concatenated ids of documents of these lengths."""
    import numpy as np

    ends = np.cumsum(np.asarray(lengths, np.int64)).astype(np.uint64)
    n, u = len(ends), int(ends[-1]) if len(ends) else 0
    low = max(0, (u // n).bit_length() - 1) if n else 0
    bits = ((ends[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    lows = np.packbits(bits.reshape(-1), bitorder="little").tobytes()
    ones = (ends >> np.uint64(low)).astype(np.int64) + np.arange(n)
    high = np.zeros(-(-(int(ones[-1]) + 1 if n else 0) // 64) * 64, np.uint8)
    high[ones] = 1
    samples = ones[::SAMPLE].astype("<u4").tobytes()
    head = struct.pack(HEAD, MAGIC, VERSION, id_bytes, n, u, low, 0)
    return b"".join([head, lows, np.packbits(high, bitorder="little").tobytes(), samples, ids])


class Image:
    """Reads an image without expanding its boundaries into a table."""

    def __init__(self, data: bytes):
        import numpy as np

        magic, version, self.id_bytes, self.documents, self.ids, self.low, _ = struct.unpack_from(HEAD, data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token image")
        self.samples_n = -(-self.documents // SAMPLE)
        at = struct.calcsize(HEAD)
        low_bytes = -(-self.documents * self.low // 8)
        body = len(data) - self.ids * self.id_bytes
        high_bytes = body - 4 * self.samples_n - at - low_bytes
        self.lows = np.frombuffer(data, np.uint8, low_bytes, at)
        self.high = np.frombuffer(data, np.uint8, high_bytes, at + low_bytes)
        self.samples = np.frombuffer(data, "<u4", self.samples_n, at + low_bytes + high_bytes)
        self.values = np.frombuffer(data, f"<u{self.id_bytes}", self.ids, body)

    def _low_part(self, i: int) -> int:
        first = i * self.low
        chunk = int.from_bytes(self.lows[first // 8 : (first + self.low + 7) // 8].tobytes(), "little")
        return chunk >> first % 8 & (1 << self.low) - 1

    def end(self, i: int) -> int:
        """Select: where document ``i`` ends."""
        import numpy as np

        at, rank = int(self.samples[i // SAMPLE]), i % SAMPLE
        position = at - at % 8
        left = rank + int(np.unpackbits(self.high[at // 8 : at // 8 + 1], bitorder="little")[: at % 8].sum())
        while True:  # a block of 64 bytes at a time
            block = self.high[position // 8 : position // 8 + 64]
            counts = np.cumsum(np.bitwise_count(block))
            byte = int(np.searchsorted(counts, left + 1))
            if byte < len(block):
                left -= int(counts[byte - 1]) if byte else 0
                bit = int(np.flatnonzero(np.unpackbits(block[byte : byte + 1], bitorder="little"))[left])
                return (position + 8 * byte + bit - i << self.low) | self._low_part(i)
            left -= int(counts[-1])
            position += 512

    def block_ends(self, block: int):
        """Ends of the documents of one block: select by its sample, then by the bits up to the next one."""
        import numpy as np

        first = block * SAMPLE
        n = min(SAMPLE, self.documents - first)
        at = int(self.samples[block])
        stop = int(self.samples[block + 1]) if block + 1 < self.samples_n else 8 * len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[at // 8 : -(-stop // 8)], bitorder="little")[at % 8 :])[:n] + at
        low = np.unpackbits(self.lows[first * self.low // 8 : -(-(first + n) * self.low // 8)], bitorder="little")[: n * self.low]
        low = (low.reshape(n, self.low).astype(np.int64) << np.arange(self.low)).sum(axis=1)
        return ((ones - first - np.arange(n)) << self.low) | low

    def document(self, i: int):
        return self.values[self.end(i - 1) if i else 0 : self.end(i)]


def write_store(
    docs: DataFrame, tokenizer: str | Callable[[], str], end_id: int, id: str = "doc_id", text: str = "text", path: str | None = None,
    image_ids: int = 2 << 20, partitions: int | None = None,
) -> str:
    """Encode whole texts and write images in ascending id order; returns the store's path.

    Texts are put in order by range before they are encoded, so ids are made once and never shuffled. A
    partition is a run of ids in order; it writes an image whenever ``image_ids`` ids are reached (a longer
    document has an image of its own), so a task holds one image. The store is a Parquet folder, as that is
    what every executor can write to any shared store: one row per image, with its first id and counts.

    Null text counts as empty and gets ``end_id`` alone. Null ids come first, repeated rows follow each other.
    Other columns are not read. An empty table gives a store without images.
    """
    spark = docs.sparkSession
    path = path or fresh_path(spark, "token-store")
    kind = dict(docs.dtypes)[id]

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        encode, dtype = id_encoder(tokenizer if isinstance(tokenizer, str) else tokenizer())
        stop = np.array([end_id], dtype).tobytes()
        keys, parts, lengths, held, number = [], [], [], 0, 0

        def image():
            nonlocal keys, parts, lengths, held, number
            width = int(dtype[-1])
            row = pa.RecordBatch.from_arrays(
                [pa.array(keys[:1], key_type), pa.array([number], pa.int32()), pa.array([len(keys)], pa.int64()),
                 pa.array([held], pa.int64()), pa.array([keys], pa.list_(key_type)),
                 pa.array([write_image(b"".join(parts), lengths, width)], pa.binary())],
                ["first", "number", "documents", "ids", "keys", "image"])
            keys, parts, lengths, held, number = [], [], [], 0, number + 1
            return row

        for batch in batches:
            key_type = batch.schema.field(0).type
            encoded = (own for part in encode_column(encode, batch.column(1), stop) for own in part.to_pylist())
            for key, own in zip(batch.column(0).to_pylist(), encoded):
                keys.append(key)
                parts.append(own)
                lengths.append(len(own) // len(stop))
                held += lengths[-1]
                if held >= image_ids:
                    yield image()
        if keys:
            yield image()

    rows = docs.select(F.col(id).alias("key"), text_or_empty(text).alias("text"))
    # many small ranges: Spark packs them no further, so a range of long texts stays small too
    count = partitions or max(rows.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism)
    ordered = rows.repartitionByRange(count, F.col("key").asc_nulls_first()).sortWithinPartitions(F.col("key").asc_nulls_first(), "text")
    images = ordered.mapInArrow(
        run, f"first {kind}, number int, documents long, ids long, keys array<{kind}>, image binary")
    images.write.option("compression", "zstd").option("parquet.block.size", 32 << 20).parquet(path)
    return path


def read_boundaries(store: DataFrame, checksum: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) for every document, selected from the images block by block.

    ``start`` counts all ids before the document in the whole store. Only image sizes (a row for millions of
    ids) meet in one task to be added up.
    """
    key_type = store.schema["first"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import zlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for keys, data, base in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist()):
                image, begin = Image(memoryview(data.as_buffer())), 0
                for block in range(image.samples_n):  # boundaries are never held for a whole image
                    ends = image.block_ends(block)
                    starts = np.concatenate([[begin], ends[:-1]]).astype(np.int64)
                    first, begin = begin, int(ends[-1])
                    ids = image.values[first:begin].astype("<u4").tobytes() if checksum else b""
                    crcs = [zlib.crc32(memoryview(ids)[4 * (a - first) : 4 * (b - first)]) for a, b in zip(starts.tolist(), ends.tolist())]
                    own = keys.values.slice(block * SAMPLE, len(ends))
                    yield pa.RecordBatch.from_arrays(
                        [own, pa.array(starts + base), pa.array(ends - starts), pa.array(crcs, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"])

    order = Window.orderBy("known", "at_first", "at_last", "at_number").rowsBetween(Window.unboundedPreceding, -1)
    named = [F.col("first").isNotNull().alias("known"), F.col("first").alias("at_first"), F.element_at("keys", -1).alias("at_last"),
             F.col("number").alias("at_number")]
    bases = store.select(*named, "ids").select("known", "at_first", "at_last", "at_number", F.coalesce(F.sum("ids").over(order), F.lit(0)).alias("base"))
    bases = stored(bases, "image-bases")
    if bases.count() <= 1 << 22:  # a checked size: at most some 200 MB, for 8 trillion ids; beyond that the images are shuffled
        bases = F.broadcast(bases)
    placed = store.withColumn("last", F.element_at("keys", -1)).join(
        bases, F.col("first").eqNullSafe(F.col("at_first")) & F.col("last").eqNullSafe(F.col("at_last")) & (F.col("number") == F.col("at_number")))
    return placed.select("keys", "image", "base").mapInArrow(
        run, f"doc_id {key_type}, start long, n_tokens long, ids_crc32 long")
