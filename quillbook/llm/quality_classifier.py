"""Quality scores by supervised subword embeddings.

A document is the average of learned vectors of its hashed words, pairs of
neighbouring words and character n-grams; a softmax layer over the average gives the
score.  Vectors and layer are trained by numpy stochastic gradient descent on a bounded
sample (``PER_LABEL`` documents a label).  To score, vectors and layer are multiplied into one number
per bucket, so a document costs one lookup per n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import features, scratch
from .memory import release

#: The bound of the training sample.
PER_LABEL = 2000
#: A document counts as good from this score on.
THRESHOLD = 0.3
_WORD_BITS, _GRAM_BITS, _GRAMS = 16, 15, (3, 4)
_BUCKETS = (1 << _WORD_BITS) + len(_GRAMS) * (1 << _GRAM_BITS)
_SIZE, _EPOCHS, _RATE = 12, 8, 1.0


def featurise(text: str) -> Iterator[np.ndarray]:
    """Buckets of all words and word pairs and of all character trigrams and 4-grams, in parts."""
    text = text or ""
    yield from features.word_buckets(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), _WORD_BITS)
    # code points; of ASCII texts bytes are the same
    codes = np.frombuffer(text.encode(), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    for k, n in enumerate(_GRAMS):
        for part in features.ngrams(codes, n, _GRAM_BITS, 0x01000193):
            yield part + (1 << _WORD_BITS) + (k << _GRAM_BITS)


@dataclass
class QualityModel:
    """``logit``: by bucket, how much the odds of label 1 gain over label 0."""

    logit: np.ndarray
    bias: float

    def score(self, text: str) -> float:
        total, n = 0.0, 0
        for index in featurise(text):
            total += float(self.logit[index].sum(dtype=np.float64))
            n += len(index)
        z = total / max(n, 1) + self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], seed: int = 11) -> QualityModel:
    """Softmax regression over averaged embeddings; no rows give a score of 0.5."""
    if not rows:
        return QualityModel(np.zeros(_BUCKETS, np.float32), 0.0)
    random = np.random.default_rng(seed)
    vectors = random.uniform(-1 / _SIZE, 1 / _SIZE, (_BUCKETS, _SIZE)).astype(np.float32)
    layer, bias = random.uniform(-0.5, 0.5, (_SIZE, 2)).astype(np.float32), np.zeros(2, np.float32)
    steps, done = max(1, _EPOCHS * len(rows)), 0
    for _ in range(_EPOCHS):
        for at in random.permutation(len(rows)):
            label, index, share = rows[at]
            rate, done = _RATE * (1 - done / steps), done + 1
            if not len(index):
                continue
            mean = share @ vectors[index]
            z = mean @ layer + bias
            odds = np.exp(z - z.max())
            error = odds / odds.sum()
            error[int(label)] -= 1
            back = layer @ error
            layer -= 0.1 * rate * np.outer(mean, error)
            bias -= 0.1 * rate * error
            # buckets are distinct within a row; shares are scaled as if the row had few parts
            vectors[index] -= (rate * share * min(len(index), 100.0))[:, None] * back[None, :]
    way = layer[:, 1] - layer[:, 0]
    return QualityModel((vectors @ way).astype(np.float32), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, folds: int = 5, held_out: int = 0) -> QualityModel:
    """Learn ``labels.quality`` from documents whose fold is not ``held_out``.  Of an id
    that is labelled more than once the commoner label counts, and 0 of a tie."""
    known = labels.where(F.col("quality").isin(0, 1) & (features.fold("doc_id", folds) != held_out)).select("doc_id", "quality")
    known = known.groupBy("doc_id").agg((F.avg("quality") > 0.5).cast("int").alias("quality"))
    chosen = features.bounded_sample(known, "quality", per_label)
    chosen = chosen.select("doc_id", F.col("quality").alias("label"))
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return fit(features.training_rows(texts, "label", featurise))


def score(docs: DataFrame, model: QualityModel, text: Column | str = "text") -> Column:
    """The score of a text column (null counts as empty)."""
    scratch.bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        for batch in batches:
            yield pd.Series([model.score(t or "") for t in batch], dtype="float64")
        release()

    return run(F.col(text) if isinstance(text, str) else text)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row.  Repeated rows and null
    ids stay; without labels every score is 0.5; other columns are ignored."""
    model = train(docs, labels)
    rows = docs.select("doc_id", score(docs, model).alias("score"))
    return rows.select(
        "doc_id",
        F.coalesce(features.fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
