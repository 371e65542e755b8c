"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, then the Hamming distance."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored
from tidemark.llm.graph import components


def fingerprint(text: str | None, width: int = 4) -> int:
    """64 bits, each set if it is set in over half the XXH64 values of the text's word shingles."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxh64_intdigest(joined, 42)
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) + 1 for w in words], out=starts[1:])
    first, last = starts[: len(words) - width + 1].tolist(), (starts[width:] - 1).tolist()
    hashes = np.fromiter((xxh64_intdigest(joined[a:b], 42) for a, b in zip(first, last)), np.uint64, len(first))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 255 * 256):
        part = hashes[at : at + 255 * 256]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64)
        sums = np.add.reduceat(bits, np.arange(0, len(part), 255), axis=0)  # 255 ones fit a byte
        counts += np.ascontiguousarray(sums).view(np.uint8).sum(axis=0, dtype=np.int64)
    over = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(over.view(np.uint64)[0])


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 4) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long. Null text counts as empty and has fingerprint 0."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), width) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    source = docs.select(F.col(id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(run, f"doc_id {dict(source.dtypes)['doc_id']}, fp long")


def block_masks(blocks: int, max_bits: int) -> list[int]:
    """Masks of all choices of ``blocks - max_bits`` blocks: ``max_bits`` differing bits leave one choice untouched."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    return [sum(choice) for choice in combinations(parts, blocks - max_bits)]


def _blocks_for(rows: int, max_bits: int) -> int:
    """Blocks so that about two unrelated fingerprints share a key, or the least number of keys that comes near."""
    blocks = max_bits + 2
    while 2 ** (64 * (blocks - max_bits) // blocks) * 2 < rows and comb(blocks + 1, max_bits) <= 500:
        blocks += 1
    return blocks


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def forest(group, fps, max_bits: int):
    """Index pairs that tie together, inside each run of equal ``group``, all fingerprints that links connect."""
    import numpy as np

    n = len(fps)
    change = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
    size = np.diff(change)
    end = np.repeat(change[1:], size)
    label, ties, at = np.arange(n), [], np.arange(n)
    for step in range(1, int(size.max(initial=1))):
        at = at[at + step < end[at]]
        near = at[np.bitwise_count(fps[at] ^ fps[at + step]) <= max_bits]
        near = near[label[near] != label[near + step]]
        for i in near.tolist():
            a, b = i, i + step
            while label[a] != a:
                a = label[a]
            while label[b] != b:
                b = label[b]
            if a != b:
                label[max(a, b)] = min(a, b)
                ties.append((i, i + step))
        if len(near):
            while True:
                short = label[label]
                if np.array_equal(short, label):
                    break
                label = short
    return ties


def _solve(batches: Iterator, max_bits: int) -> Iterator:
    """Edges of rows sorted by group; a group may cross batches, and is of bounded size."""
    import numpy as np
    import pyarrow as pa

    keys, fps = np.empty(0, np.int64), np.empty(0, np.uint64)

    def edges(group, values):
        ties = forest(group, values, max_bits)
        signed = values.view(np.int64)
        left, right = (signed[[t[k] for t in ties]] if ties else signed[:0] for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(left), pa.array(right)], ["a", "b"])

    for batch in batches:
        keys = np.concatenate([keys, batch.column(0).to_numpy(zero_copy_only=False)])
        fps = np.concatenate([fps, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
        if len(keys):
            cut = int(np.searchsorted(keys, keys[-1]))  # the last group may go on
            if cut:
                yield edges(keys[:cut], fps[:cut])
                keys, fps = keys[cut:], fps[cut:]
    if len(keys):
        yield edges(keys, fps)


def hamming_links(fps: DataFrame, max_bits: int = 4, blocks: int | None = None, tile: int = 512, tiled_rows: int = 32_768) -> DataFrame:
    """Edges (a, b) between distinct fingerprints of at most ``max_bits`` differing bits.

    The edges connect what all such pairs connect, but are only a forest for each task: no group emits its
    pairs. ``fps`` has distinct fingerprints in column ``fp``. Each one goes to a bucket per choice of blocks;
    buckets of one are dropped after a count. A bucket of up to ``tile`` rows is solved in one task, up to
    ``tiled_rows`` it is cut into pairs of tiles, and beyond that two fingerprints are linked through the
    fingerprints half way between them, whose number for each row is fixed. All three ways are exact.
    """
    blocks = blocks or _blocks_for(fps.count(), max_bits)
    masks = block_masks(blocks, max_bits)
    keyed = fps.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")).alias("key")) for i, m in enumerate(masks)
    ])).alias("b")).select("fp", "b.choice", "b.key")
    shared = stored(keyed.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    rows = stored(keyed.join(shared, ["choice", "key"]), "bucket-rows")
    tiles = F.ceil(F.col("n") / tile).cast("int")
    own = F.pmod(F.xxhash64("fp"), tiles).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), tiles - 1), lambda x: F.struct(F.least(x, own).alias("i"), F.greatest(x, own).alias("j")))
    cut = rows.where(F.col("n") <= tiled_rows).withColumn("t", F.explode(pairs))
    # groups are told apart by a 64-bit hash; if two ever met, their pairs would be compared as well, no harm
    cut = cut.select(F.xxhash64("choice", "key", "t.i", "t.j").alias("g"), "fp")
    solved = cut.repartition("g").sortWithinPartitions("g").mapInArrow(lambda b: _solve(b, max_bits), "a long, b long")
    big = rows.where(F.col("n") > tiled_rows)
    half = (max_bits + 1) // 2
    flips = [sum(1 << b for b in c) for k in range(half + 1) for c in combinations(range(64), k)]
    table = fps.sparkSession.createDataFrame([(_signed(x),) for x in flips], "flip long") if big.take(1) else None
    if table is None:
        return solved.distinct()
    free = F.element_at(F.array(*[F.lit(_signed(m ^ (2**64 - 1))).cast("long") for m in masks]), F.col("choice") + 1)
    # at most a few thousand flips, a number fixed by max_bits: a small side by proof
    middle = big.join(F.broadcast(table), F.col("flip").bitwiseAND(free) == F.col("flip")).select(
        "fp", "choice", "key", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid"), (F.bit_count("flip") <= max_bits // 2).alias("close"))
    # two rows within an odd limit have a middle that one of them is a bit closer to: all link to the least close one
    lowest = stored(middle.groupBy("choice", "key", "mid").agg(F.min(F.when(F.col("close"), F.col("fp"))).alias("a"), F.count(F.lit(1)).alias("m"))
                    .where("m > 1 AND a IS NOT NULL"), "middles")
    near = middle.join(lowest, ["choice", "key", "mid"]).where("fp <> a").select("a", F.col("fp").alias("b"))
    return solved.union(near).distinct()


def near_groups(
    docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 4, max_bits: int = 4, **options
) -> DataFrame:
    """(doc_id, fp, fingerprint, component_id) for every row.

    Fingerprints link at ``max_bits`` or fewer differing bits; a component is what links connect, and its id is
    the smallest doc_id in it. Equal fingerprints are one node, so copies cost nothing but their own row. Texts
    without words have fingerprint zero and link like any other. Null ids belong to their component but never
    name it. Other columns are not read, so none can clash. An empty table gives an empty result.
    """
    marked = stored(fingerprints(docs, id, text, width), "fingerprints")
    nodes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    found = stored(components(hamming_links(nodes.select("fp"), max_bits, **options)), "components")
    member = stored(nodes.join(found, nodes.fp == found.node).select("fp", "root", "least"), "members")
    named = stored(member.groupBy("root").agg(F.min("least").alias("linked_id")), "named")
    linked = member.join(named, "root").select("fp", "linked_id")
    label = stored(nodes.join(linked, "fp", "left").select("fp", F.coalesce("linked_id", "least").alias("component_id")), "labels")
    return marked.join(label, "fp").select(
        "doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 4, max_bits: int = 4, **options) -> DataFrame:
    """The rows of ``docs`` whose id names its component: one document of each, with all its columns.

    Rows that repeat an id are one document. A row without an id stays if nothing with an id is near it.
    """
    groups = near_groups(docs, id, text, width, max_bits, **options)
    stay = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__keep")).distinct()
    return docs.join(stay, F.col(id).eqNullSafe(F.col("__keep")), "left_semi")
