"""Hard negatives by a secondary sort: scored pairs stream past an anchor's open windows in order of score."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored

CELL_BYTES = 16 << 20  # what a task holds of anchors, and of rows, as 64-bit numbers
TILE_ROWS, TILE_ANCHORS = 4096, 256
PAIR = "anchor long, key binary, positive boolean"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
LEAST, MOST = -(1 << 63), (1 << 63) - 1


# ------------------------------------------------------------------------ keys


def pack_keys(anchor, score, other):
    """24-byte keys whose byte order is (anchor, descending score, id); one array of bytes objects."""
    import numpy as np

    sign = np.uint64(1 << 63)
    parts = np.empty((len(anchor), 3), ">u8")
    parts[:, 0] = anchor.view(np.uint64) ^ sign
    parts[:, 1] = ~(score.view(np.uint64) ^ sign)
    parts[:, 2] = other.view(np.uint64) ^ sign
    return parts.view("V24").ravel()


def unpack_keys(keys):
    """(anchor, score, id) of an Arrow column of keys."""
    import numpy as np

    data = np.frombuffer(b"".join(keys.to_pylist()), ">u8").reshape(-1, 3).astype(np.uint64)
    sign = np.uint64(1 << 63)
    return (data[:, 0] ^ sign).view(np.int64), (~data[:, 1] ^ sign).view(np.int64), (data[:, 2] ^ sign).view(np.int64)


# --------------------------------------------------------------------- windows


class Windows:
    """One anchor's stream: opens a window for each positive, hands out negatives, keeps no pairs.

    Pairs arrive by descending score, then ascending id. A window lies at or below its positive's score, so what
    it takes comes later; only negatives of the positive's own score can come before it (a window may begin
    there, for instance at score zero), and of those the first few are remembered.
    """

    def __init__(self, positives: int, negatives: int, low: int, high: int, of: int):
        self.positives, self.negatives, self.low, self.high, self.of = positives, negatives, low, high, of
        self.seen, self.open, self.level, self.tied = 0, [], None, []

    def _take(self, window: list, other: int, score: int):
        positive, own, taken = window
        if taken < self.negatives and self.low * own <= self.of * score <= self.high * own:
            window[2] += 1
            return positive, window[2], other, own, score
        return None

    def pair(self, positive: bool, other: int, score: int) -> Iterator[tuple[int, int, int, int, int]]:
        if score != self.level:
            self.level, self.tied = score, []
        if not positive:
            if len(self.tied) < self.negatives and self.seen < self.positives:
                self.tied.append(other)
            for window in self.open:
                if (found := self._take(window, other, score)) is not None:
                    yield found
        elif self.seen < self.positives:
            self.seen += 1
            self.open.append([other, score, 0])
            for one in self.tied:
                if (found := self._take(self.open[-1], one, score)) is not None:
                    yield found
            return
        self.open = [w for w in self.open if w[2] < self.negatives and self.of * score >= self.low * w[1]]


def stream_windows(batches: Iterator, positives: int, negatives: int, low: int, high: int, of: int) -> Iterator:
    """Result rows of sorted pairs; an anchor may cross batches."""
    import pyarrow as pa

    current, windows = None, None
    for batch in batches:
        out = []
        anchors, scores, others = (x.tolist() for x in unpack_keys(batch.column(0)))
        for anchor, score, other, positive in zip(anchors, scores, others, batch.column(1).to_pylist()):
            if anchor != current:
                current, windows = anchor, Windows(positives, negatives, low, high, of)
            out += [(anchor, p, rank, n, ps, ns) for p, rank, n, ps, ns in windows.pair(positive, other, score)]
        columns = zip(*out) if out else [[]] * 6
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], [f.split()[0] for f in RESULT.split(", ")])


def secondary_sort(pairs: DataFrame) -> DataFrame:
    """All pairs of an anchor in one partition, in order of their keys; the sort is Spark's and spills."""
    return pairs.repartition("anchor").sortWithinPartitions("key")


def mine_pairs(pairs: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, of: int = 100) -> DataFrame:
    """Result rows from any (anchor, key, positive) pairs: secondary sort and one pass with bounded state."""
    _check(positives, negatives, low, high, of)
    return secondary_sort(pairs).select("key", "positive").mapInArrow(lambda b: stream_windows(b, positives, negatives, low, high, of), RESULT)


def _check(positives: int, negatives: int, low: int, high: int, of: int) -> None:
    if positives < 1 or negatives < 1 or not 0 <= low < high <= of:
        raise ValueError("asks for 0 <= low < high <= of and at least one positive and negative")


# --------------------------------------------------------------------- scoring


def whole_vectors(vectors: DataFrame, anchors: Column, id: str, vector: str, label: str, scale: int) -> DataFrame:
    """(vec_id, label, v, anchor), stored: ``floor(scale * x)`` of every component, one row for an id.

    ``v`` is a width byte and little-endian integers of that width.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            column, packed = batch.column(2), []
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            with np.errstate(over="ignore"):
                whole = np.floor(flat * float(scale)).clip(-(2.0**62), 2.0**62).astype(np.int64)
            at = 0
            for n in (len(x) for x in column):
                own = whole[at : at + n]
                small = not n or (-32768 <= own.min() and own.max() <= 32767)
                packed.append((b"\x02" + own.astype("<i2").tobytes()) if small else (b"\x08" + own.astype("<i8").tobytes()))
                at += n
            columns = [batch.column(0), batch.column(1), pa.array(packed, pa.binary()), batch.column(3)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "v", "anchor"])

    rows = vectors.select(
        F.col(id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("x"),
        F.coalesce(anchors, F.lit(False)).alias("anchor"))
    unfit = F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    clean = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & ~unfit)
    packed = clean.mapInArrow(run, "vec_id long, label long, v binary, anchor boolean")
    one = packed.groupBy("vec_id").agg(F.min(F.struct("label", "v", "anchor")).alias("r"))
    return stored(one.select("vec_id", "r.*"), "vectors")


def _matrix(values: list[bytes], width: int):
    """Vectors as rows of 64-bit integers; shorter ones end in zeros."""
    import numpy as np

    out = np.zeros((len(values), width), np.int64)
    for row, v in zip(out, values):
        own = np.frombuffer(v, f"<i{v[0]}", offset=1)
        row[: len(own)] = own
    return out


def inner_products(a, b):
    """Exact integer products of the rows of two matrices, held at the ends of the 64-bit range."""
    import numpy as np

    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    bound = max(abs(int(a.min())), int(a.max())) * max(abs(int(b.min())), int(b.max())) * a.shape[1]
    if bound < 1 << 53:  # sums of doubles are exact up to here
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return np.clip(a.astype(object) @ b.T.astype(object), LEAST, MOST).astype(np.int64)


class Cell:
    """A block of anchors that a stripe of rows streams past; keeps per anchor what can still matter."""

    def __init__(
        self, ids: list, labels: list, values: list, tops: list, width: int, positives: int, negatives: int, low: int, high: int, of: int,
    ):
        import numpy as np

        self.ids, self.labels, self.width = ids, labels, width
        self.matrix = _matrix(values, width)
        self.positives, self.negatives = positives, negatives
        # the first pass has no windows and looks for the best rows of the anchor's own label
        self.windows = None if tops[0] is None else [
            [(-(-low * s // of), high * s // of) for s in own if s >= 0] for own in tops]
        self.floor = [LEAST] * len(ids) if self.windows is None else [min((a for a, _ in w), default=MOST) for w in self.windows]
        self.kept = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in ids]

    def add(self, ids, labels, values: list) -> None:
        """Rows of the stripe, in ascending order of id over all calls."""
        import numpy as np

        rows = _matrix(values, self.width)
        kinds, member = np.unique(labels, return_inverse=True)
        groups = {k: np.flatnonzero(member == i) for i, k in enumerate(kinds.tolist())}
        others = {}
        for begin in range(0, len(self.ids), TILE_ANCHORS):
            scores = inner_products(self.matrix[begin : begin + TILE_ANCHORS], rows)
            for k, score in enumerate(scores, begin):
                label = self.labels[k]
                if self.windows is None:
                    at = groups.get(label)
                    if at is None:
                        continue
                    at = at[(score[at] >= self.floor[k]) & (ids[at] != self.ids[k])]
                elif not self.windows[k]:
                    continue
                else:
                    if label not in others:
                        others[label] = labels != label
                    top = max(b for _, b in self.windows[k])
                    at = np.flatnonzero((score >= self.floor[k]) & (score <= top) & others[label])
                if len(at):
                    self._merge(k, score[at], ids[at])

    def _merge(self, k: int, scores, ids) -> None:
        import numpy as np

        scores, ids = np.concatenate([self.kept[k][0], scores]), np.concatenate([self.kept[k][1], ids])
        order = np.lexsort((ids, ~scores))
        scores, ids = scores[order], ids[order]
        if self.windows is None:
            scores, ids = scores[: self.positives], ids[: self.positives]
            if len(scores) == self.positives:
                self.floor[k] = int(scores[-1])
        else:
            stay, falling, floor = np.zeros(len(scores), bool), ~scores, MOST
            for low, high in self.windows[k]:
                first = int(np.searchsorted(falling, ~high, "left"))
                last = int(np.searchsorted(falling, ~low, "right"))
                stop = min(last, first + self.negatives)
                stay[first:stop] = True
                floor = min(floor, int(scores[stop - 1]) if stop - first == self.negatives else low)
            scores, ids, self.floor[k] = scores[stay], ids[stay], floor
        self.kept[k] = scores, ids

    def pairs(self) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for begin in range(0, len(self.ids), TILE_ANCHORS):
            part = self.kept[begin : begin + TILE_ANCHORS]
            anchor = np.repeat(np.array(self.ids[begin : begin + TILE_ANCHORS], np.int64), [len(s) for s, _ in part])
            key = pack_keys(anchor, np.concatenate([s for s, _ in part]), np.concatenate([i for _, i in part]))
            columns = [pa.array(anchor), pa.array([k.tobytes() for k in key], pa.binary()), pa.array([self.windows is None] * len(anchor), pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["anchor", "key", "positive"])


def _score_cells(batches: Iterator, width: int, limits: tuple) -> Iterator:
    """Rows sorted by (cell, is_row, vec_id): first a cell's anchors, which are held, then its rows, in tiles."""
    import numpy as np

    tile = max(1, min(TILE_ROWS, CELL_BYTES // (8 * max(1, width))))
    current, cell, anchors, rows = None, None, [], []

    def flush():
        nonlocal rows
        if rows and cell is not None:
            cell.add(np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64), [r[2] for r in rows])
        rows = []

    for batch in batches:
        for own, is_row, vec_id, label, v, tops in zip(*(c.to_pylist() for c in batch.columns)):
            if own != current:
                flush()
                if cell is not None:
                    yield from cell.pairs()
                current, cell, anchors = own, None, []
            if not is_row:
                anchors.append((vec_id, label, v, tops))
                continue
            if cell is None and anchors:
                cell, anchors = Cell(*(list(c) for c in zip(*anchors)), width, *limits), []
            rows.append((vec_id, label, v))
            if len(rows) == tile:
                flush()
    flush()
    if cell is not None:
        yield from cell.pairs()


def scored_pairs(rows: DataFrame, anchors: DataFrame, counts: tuple[int, int], width: int, limits: tuple) -> DataFrame:
    """(anchor, key, positive): of every anchor and stripe of rows the pairs that can be in the result.

    Anchors come in blocks of bounded bytes, and every block meets every row: the rows are sent once per block,
    the anchors once per stripe. Stripes are only as many as keep the cores busy. Within a stripe only its first
    pairs of each kind can be among the first of all, so a cell combines before the shuffle by anchor.
    """
    n, a = counts
    blocks = max(1, -(-a // max(1, CELL_BYTES // (8 * max(1, width)))))
    stripes = max(1, min(-(-n // TILE_ROWS), -(-3 * rows.sparkSession.sparkContext.defaultParallelism // blocks)))
    place = lambda many: F.pmod(F.xxhash64("vec_id"), F.lit(many)).cast("long")
    all_of = lambda many: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(many - 1).cast("long")))
    held = anchors.withColumn("block", place(blocks)).withColumn("stripe", all_of(stripes)).withColumn("is_row", F.lit(False))
    past = rows.withColumn("stripe", place(stripes)).withColumn("block", all_of(blocks)).withColumn("is_row", F.lit(True))
    past = past.withColumn("tops", F.lit(None).cast("array<long>"))
    columns = [(F.col("block") * stripes + F.col("stripe")).alias("cell"), "is_row", "vec_id", "label", "v", "tops"]
    cells = held.select(*columns).unionAll(past.select(*columns))
    dealt = cells.repartition(blocks * stripes, "cell").sortWithinPartitions("cell", "is_row", "vec_id")
    return dealt.mapInArrow(lambda b: _score_cells(b, width, limits), PAIR)


def _first_positives(batches: Iterator, most: int) -> Iterator:
    """The first pairs of every anchor in sorted pairs."""
    import numpy as np
    import pyarrow as pa

    current, taken = None, 0
    for batch in batches:
        stay = np.zeros(batch.num_rows, bool)
        for i, anchor in enumerate(batch.column(0).to_pylist()):
            if anchor != current:
                current, taken = anchor, 0
            stay[i] = taken < most
            taken += 1
        kept = batch.filter(pa.array(stay))
        scores = pa.array(unpack_keys(kept.column(1))[1], pa.int64())
        yield pa.RecordBatch.from_arrays([*kept.columns, scores], ["anchor", "key", "positive", "score"])


def mine_hard_negatives(
    vectors: DataFrame, anchors: Column, id: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = 5,
    negatives: int = 10, scale: int = 256, low: int = 30, high: int = 90, of: int = 100,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A row's score is the integer inner product of ``floor(scale * x)`` with the anchor's; higher first, ties by
    smaller id. An anchor's positives are its first ``positives`` other rows of its label. For each, the first
    ``negatives`` rows of another label with ``low * positive <= of * negative <= high * positive`` are numbered
    from 1. All anchors (rows for which ``anchors`` holds) meet all rows, in blocks.

    Two passes score the pairs: the first finds the positives, the second what lies in their windows. Both put
    pairs in order by packed keys (anchor, descending score, id) in a shuffle that sorts, and a stream with a
    state of ``positives`` windows reads them.

    Rows with a null id, label or vector, or a component that is null or not finite, take no part. Of rows that
    repeat an id the one with the least label, then the least vector as bytes, counts. Ids and labels are integers.
    Shorter vectors count as ending in zeros; components beyond 2**62 and scores beyond 64 bits stop there.
    An anchor without positives, or without negatives, has no rows. Other columns are not read. No rows, no result.
    """
    _check(positives, negatives, low, high, of)
    rows = whole_vectors(vectors, anchors, id, vector, label, scale)
    each = F.when(F.substring("v", 1, 1) == F.lit(b"\x08"), 8).otherwise(2)
    n, a, size = rows.agg(F.count(F.lit(1)), F.count_if("anchor"), F.max(F.floor((F.length("v") - 1) / each))).first()
    width, limits = int(size or 0), (positives, negatives, low, high, of)
    plain = rows.drop("anchor")
    chosen = rows.where("anchor").drop("anchor")
    found = scored_pairs(plain, chosen.withColumn("tops", F.lit(None).cast("array<long>")), (n, a), width, limits)
    first = secondary_sort(found).mapInArrow(lambda b: _first_positives(b, positives), PAIR + ", score long")
    first = stored(first, "positives")
    tops = first.groupBy(F.col("anchor").alias("vec_id")).agg(F.collect_list("score").alias("tops"))
    windowed = scored_pairs(plain, chosen.join(tops, "vec_id"), (n, a), width, limits)
    return mine_pairs(first.drop("score").unionAll(windowed), positives, negatives, low, high, of)
