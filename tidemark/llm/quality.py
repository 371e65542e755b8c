"""Quality classifier: naive Bayes support vectors on n-gram indicators."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import stored, text_or_empty

HASH_BITS = 18
#: Rows a fit may use at most; they are those with the smallest hash of their id.
FIT_ROWS = 10_000
_TOKENS = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^\s0-9A-Za-z\x80-\xff]+")


def ngram_ids(text: str | None):
    """Distinct hashed unigrams and bigrams of a text; a token that repeats its predecessor is a gram of its own."""
    from zlib import crc32

    import numpy as np

    tokens = _TOKENS.findall((text or "").encode())
    one = np.fromiter(map(crc32, tokens), np.uint64, len(tokens))
    two = (one[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (one[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
    two[one[:-1] == one[1:]] = np.uint64(0x5851F42D4C957F2D)
    grams = np.concatenate([one * np.uint64(0xD6E8FEB86659FD93), two])
    return np.unique((grams >> np.uint64(64 - HASH_BITS)).astype(np.int32))


@dataclass(frozen=True)
class Model:
    """Weights per gram (log-count ratio times the blended linear weight), bias and the sigmoid's two numbers."""

    ratio: bytes
    weights: bytes
    bias: float
    slope: float
    offset: float

    def scorer(self):
        import numpy as np

        ratio, weights = np.frombuffer(self.ratio), np.frombuffer(self.weights)

        def score(text: str | None) -> float:
            grams = ngram_ids(text)
            x = ratio[grams]
            norm = float(np.sqrt(x @ x))
            margin = float(x @ weights[grams]) / norm + self.bias if norm else self.bias
            return float(1 / (1 + np.exp(-min(30.0, max(-30.0, self.slope * margin + self.offset)))))

        return score


def dual_descent(rows: list, y, dims: int, cost: float = 1.0, epochs: int = 30, tolerance: float = 0.02, seed: int = 7):
    """Weights and bias of a linear model with hinge loss, one dual variable at a time.

    ``rows`` holds (indices, values) pairs. The last weight belongs to a constant feature, the bias.
    """
    import numpy as np

    w, bias, alpha = np.zeros(dims), 0.0, np.zeros(len(rows))
    square = np.array([float(v @ v) + 1.0 for _, v in rows])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)).tolist():
            at, value = rows[i]
            slope = y[i] * (float(w[at] @ value) + bias) - 1.0
            new = min(max(alpha[i] - slope / square[i], 0.0), cost)
            if new != alpha[i]:
                move = (new - alpha[i]) * y[i]
                w[at] += move * value
                bias += move
                worst = max(worst, abs(new - alpha[i]))
                alpha[i] = new
        if worst < tolerance:
            break
    return w, bias


def _sigmoid(margins, y) -> tuple[float, float]:
    """Platt's two numbers by Newton steps on smoothed targets."""
    import numpy as np

    high, low = (np.sum(y > 0) + 1) / (np.sum(y > 0) + 2), 1 / (np.sum(y < 0) + 2)
    target, a, b = np.where(y > 0, high, low), 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g, h = p - target, np.maximum(p * (1 - p), 1e-9)
        hess = np.array([[np.sum(h * margins**2) + 1e-6, np.sum(h * margins)], [np.sum(h * margins), np.sum(h) + 1e-6]])
        step = np.linalg.solve(hess, np.array([np.sum(g * margins) + 1e-6 * a, np.sum(g)]))
        step *= min(1.0, 5.0 / max(1e-12, float(np.abs(step).max())))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def train(grams: list, labels: list[int], smoothing: float = 1.0, blend: float = 0.75) -> Model:
    """Naive Bayes log-count ratios scale the indicators; hinge-loss weights are blended with their mean size.

    A fifth of the rows sets the sigmoid. With no rows of one class every text gets the smoothed share of
    label 1 (a half without any rows).
    """
    import numpy as np

    dims = 1 << HASH_BITS
    y = np.where(np.array(labels, int) > 0, 1.0, -1.0)
    held = np.arange(len(y)) % 5 == 4
    if len(set(y[~held].tolist())) < 2:
        share = (np.sum(y > 0) + 1) / (len(y) + 2)
        return Model(np.zeros(dims).tobytes(), np.zeros(dims).tobytes(), 0.0, 0.0, float(np.log(share / (1 - share))))
    counts = {1.0: np.full(dims, smoothing), -1.0: np.full(dims, smoothing)}
    for g, t, h in zip(grams, y, held):
        if not h:
            counts[t][g] += 1
    ratio = np.log(counts[1.0] / counts[1.0].sum()) - np.log(counts[-1.0] / counts[-1.0].sum())

    def unit(g):
        x = ratio[g]
        return g, x / (np.sqrt(x @ x) or 1.0)

    rows = [unit(g) for g in grams]
    fit = [r for r, h in zip(rows, held) if not h]
    w, bias = dual_descent(fit, y[~held], dims, cost=4.0)
    w = (1 - blend) * np.abs(w).mean() + blend * w
    margins = np.array([float(v @ w[g]) + bias for g, v in rows])
    both = len(set(y[held].tolist())) == 2
    slope, offset = _sigmoid(margins[held], y[held]) if both else _sigmoid(margins, y)
    return Model(ratio.tobytes(), w.tobytes(), float(bias), slope, offset)


def held_out(id: str) -> Column:
    """Rows that no fit may see: crc32 of the id as text leaves 2 when divided by 4."""
    return F.crc32(F.coalesce(F.col(id).cast("string"), F.lit(""))) % 4 == 2


def fit_quality(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", fit_rows: int = FIT_ROWS) -> Model:
    """Fit on at most ``fit_rows`` labelled rows that are not held out, in one task.

    Rows without a label or text to learn from are left out. A document labelled twice counts once per label.
    """
    known = labels.where(F.col(label).isNotNull() & ~held_out(id)).select(F.col(id).alias("__id"), F.col(label).cast("int").alias("__y"))
    chosen = stored(known.orderBy(F.xxhash64("__id"), "__id", "__y").limit(fit_rows), "fit-rows")
    sample = docs.select(F.col(id).alias("__id"), text_or_empty(text).alias("__text")).join(chosen, "__id")

    def grams(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = pa.array([ngram_ids(t.as_py()).tobytes() for t in batch.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], ["h", "y", "grams"])

    def fit(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        seen, labels = [], []
        for batch in batches:
            seen += [np.frombuffer(g.as_buffer(), np.int32) for g in batch.column(2)]
            labels += batch.column(1).to_pylist()
        m = train(seen, labels)
        values = [[m.ratio], [m.weights], [m.bias], [m.slope], [m.offset]]
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in values], ["ratio", "weights", "bias", "slope", "offset"])

    # grams of a text are bounded by the hash, rows by fit_rows
    hashed = sample.select(F.xxhash64("__id").alias("h"), "__y", "__text").mapInArrow(grams, "h long, y int, grams binary")
    model = hashed.repartition(1).sortWithinPartitions("h", "y", "grams").mapInArrow(
        fit, "ratio binary, weights binary, bias double, slope double, offset double").first()
    return Model(**{k: bytes(v) if isinstance(v, (bytes, bytearray)) else v for k, v in model.asDict().items()}) if model else train([], [])


def quality_score(model: Model, text: str = "text", spark: SparkSession | None = None) -> Column:
    """Probability of label 1 for a text column; null counts as empty."""
    spark = spark or SparkSession.getActiveSession()
    sent = spark.sparkContext.broadcast(model)  # two vectors of 2**HASH_BITS numbers, whatever the data

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = sent.value.scorer()
        for series in texts:
            yield pd.Series([one(t) for t in series], dtype="float64")

    return score(text_or_empty(text))


def score_documents(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = 0.7, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; only the text decides the score.

    Null text counts as empty and gets the score of no grams. Texts are read whole. Repeated rows get equal
    scores. A null id is not held out. Other columns are not read.
    """
    model = fit_quality(docs, labels, id, text, label, **options)
    scored = docs.select(F.col(id).alias("doc_id"), held_out(id).alias("held_out"), quality_score(model, text, docs.sparkSession).alias("score"))
    return scored.select("*", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = 0.7, **options) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with their own columns."""
    model = fit_quality(docs, labels, id, text, label, **options)
    return docs.where(quality_score(model, text, docs.sparkSession) >= threshold)
