"""Language identification in two levels.

A linear classifier over hashed byte n-grams predicts the language family; then
one-versus-one linear support vector machines tell the languages of that family
apart.  Both levels are trained here by averaged stochastic subgradient descent
on the hinge loss, over a bounded sample (``PER_LANGUAGE`` texts a language).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import features, scratch
from .memory import release

#: Languages by family; a language of no family here is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "af", "sv", "da", "no", "nb", "nn", "is"),
    "romance": ("fr", "es", "pt", "it", "ca", "gl", "ro"),
    "slavic": ("ru", "uk", "be", "bg", "sr", "mk", "pl", "cs", "sk", "sl", "hr"),
    "uralic": ("fi", "et", "hu"),
}
#: The bound of the training sample.
PER_LANGUAGE = 800
_BITS = 15
_EPOCHS, _RATE, _DECAY, _SCALE = 6, 0.5, 1e-4, 30.0
_FAMILY = {lang: name for name, langs in FAMILIES.items() for lang in langs}
#: All that is no ASCII letter becomes a space; bytes of other letters stay.
_LETTERS = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))


def featurise(text: str) -> Iterator[np.ndarray]:
    """Buckets of all byte bigrams and trigrams of the lower-cased letters, in parts."""
    raw = np.frombuffer(b" " + (text or "").lower().encode("utf-8", "replace").translate(_LETTERS) + b" ", np.uint8)
    raw = raw[~((raw == 32) & (np.concatenate((raw[:1] * 0, raw[:-1])) == 32))]  # runs of spaces count once
    yield from features.ngrams(raw, 2, _BITS)
    for part in features.ngrams(raw, 3, _BITS):
        yield part + (1 << _BITS)


def _svm(rows: list[tuple[np.ndarray, np.ndarray, int]], seed: int) -> tuple[np.ndarray, float]:
    """Averaged weights and bias of a linear SVM for targets of +1 and -1."""
    weight, total, bias, bias_total = np.zeros(2 << _BITS), np.zeros(2 << _BITS), 0.0, 0.0
    order, steps = np.random.default_rng(seed), 0
    balance = {y: len(rows) / (2 * max(1, sum(r[2] == y for r in rows))) for y in (1, -1)}
    for epoch in range(_EPOCHS):
        rate = _RATE / (1 + epoch)
        for at in order.permutation(len(rows)):
            index, share, y = rows[at]
            x = share * _SCALE
            steps += 1
            if y * (weight[index] @ x + bias) < 1:
                move = rate * balance[y] * y
                weight[index] += move * x
                bias += 0.1 * move
                # the average of all steps, kept as a correction by the step's number
                total[index] += steps * move * x
                bias_total += steps * 0.1 * move
        weight *= 1 - _DECAY
        total *= 1 - _DECAY
    steps = max(1, steps)
    return (weight - total / (steps + 1)).astype(np.float32) * _SCALE, bias - bias_total / (steps + 1)


@dataclass
class LanguageModel:
    """``table`` holds a column of weights for each family, then for each pair."""

    families: list[str]
    members: dict[str, list[str]]
    pairs: list[tuple[str, str]]
    table: np.ndarray
    bias: np.ndarray
    _at: dict = field(default_factory=dict)

    def margins(self, text: str) -> np.ndarray:
        total, n = np.zeros(self.table.shape[1], np.float64), 0
        for index in featurise(text):
            total += self.table[index].sum(axis=0, dtype=np.float64)
            n += len(index)
        return (total / max(n, 1)).astype(np.float32) + self.bias

    def predict(self, text: str) -> tuple[str, float]:
        """The language and a score in 0 to 1: the share of the family among the
        families times the mean share of the language against its relatives."""
        if not self.families:
            return "und", 0.0
        margin = self.margins(text)
        n = len(self.families)
        odds = np.exp(2 * (margin[:n] - margin[:n].max()))
        best = int(np.argmax(margin[:n]))
        family, score = self.families[best], float(odds[best] / odds.sum())
        langs = self.members[family]
        votes = dict.fromkeys(langs, 0.0)
        for k, (a, b) in enumerate(self.pairs):
            if a in votes and b in votes:
                share = 1 / (1 + np.exp(-2 * np.clip(margin[n + k], -20, 20)))
                votes[a] += share
                votes[b] += 1 - share
        lang = max(langs, key=lambda x: (votes[x], x))
        return lang, score * (votes[lang] / (len(langs) - 1) if len(langs) > 1 else 1.0)


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, folds: int = 4, held_out: int = 2) -> LanguageModel:
    """Learn from texts with a language whose fold is not ``held_out``."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (features.fold("doc_id", folds) != held_out))
    chosen = features.bounded_sample(known, "lang", per_language).select("doc_id", F.col("lang").alias("label"))
    texts = known.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = features.training_rows(texts, "label", featurise)
    langs = sorted({r[0] for r in rows})
    members: dict[str, list[str]] = {}
    for lang in langs:
        members.setdefault(_FAMILY.get(lang, lang), []).append(lang)
    families = sorted(members)
    pairs = [p for f in families for p in combinations(members[f], 2)]
    machines = [
        _svm([(i, s, 1 if _FAMILY.get(lang, lang) == f else -1) for lang, i, s in rows], k) for k, f in enumerate(families)
    ] + [_svm([(i, s, 1 if lang == a else -1) for lang, i, s in rows if lang in (a, b)], k) for k, (a, b) in enumerate(pairs)]
    table = np.stack([w for w, _ in machines], axis=1) if machines else np.zeros((2 << _BITS, 0), np.float32)
    return LanguageModel(families, members, pairs, np.ascontiguousarray(table), np.array([b for _, b in machines], np.float32))


def predict(docs: DataFrame, model: LanguageModel, text: Column | str = "text") -> Column:
    """A struct ``lang_pred, score`` for a text column of ``docs``: ``und`` and 0
    where the text is null or has no letter (or nothing could be learned)."""
    scratch.bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            found = [("und", 0.0) if t is None else model.predict(t) for t in batch]
            yield pd.DataFrame(found, columns=["lang_pred", "score"])
        release()

    text = F.col(text) if isinstance(text, str) else text
    return run(F.when(text.rlike(r"\p{L}"), text))


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row.  Repeated rows and null
    ids stay (a null id is not held out and teaches nothing); with no row to
    learn from every prediction is ``und``; other columns are ignored."""
    model = train(docs)
    rows = docs.select("doc_id", "text").withColumn("found", predict(docs, model))
    return rows.select(
        "doc_id", F.coalesce(features.fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "found.lang_pred", "found.score"
    )
