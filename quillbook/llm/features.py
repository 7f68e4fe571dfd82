"""Hashed n-grams of texts as numpy arrays, and bounded training samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch
from .memory import tidy

_SPREAD = np.uint32(0x9E3779B1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Random odd weights by place in a word, and random values by byte.
_random = np.random.default_rng(20)
_BYTE = _random.integers(0, 2**32, 256, dtype=np.uint32)
_PLACE = _random.integers(0, 2**31, 64, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


#: Items of a text that are turned at a time, so that a very long text takes a few times
#: its own size, whatever is computed from it.
CHUNK = 1 << 20


def _spread(code: np.ndarray, bits: int) -> np.ndarray:
    code = (code ^ (code >> np.uint32(15))) * _SPREAD
    return (code >> np.uint32(32 - bits)).astype(np.int64)


def ngrams(codes: np.ndarray, n: int, bits: int, factor: int = 257) -> Iterator[np.ndarray]:
    """Buckets of ``bits`` bits for every run of ``n`` codes (bytes or code points), by chunk."""
    for begin in range(0, len(codes) - n + 1, CHUNK):
        size = min(CHUNK, len(codes) - n + 1 - begin)
        code = np.full(size, n, np.uint32)
        for k in range(n):
            code = code * np.uint32(factor) + codes[begin + k : begin + k + size]
        yield _spread(code, bits)


def word_chunks(raw: np.ndarray) -> Iterator[np.ndarray]:
    """The bytes in parts of about ``CHUNK`` that end between words."""
    begin = 0
    while begin < len(raw):
        end = begin + CHUNK
        while end < len(raw) and not _SPACE[raw[end]].any():
            ahead = np.flatnonzero(_SPACE[raw[end : end + CHUNK]])
            end = end + int(ahead[0]) if len(ahead) else end + CHUNK
        yield raw[begin : min(end, len(raw))]
        begin = end


def _words(raw: np.ndarray) -> np.ndarray:
    inside = ~_SPACE[raw]
    edges = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(starts):
        return np.zeros(0, np.uint32)
    place = np.arange(len(raw)) - np.repeat(np.concatenate((starts[:1] * 0, starts)), np.diff(np.concatenate(([0], starts, [len(raw)]))))
    part = np.where(inside, _BYTE[raw] * _PLACE[place & 63], 0).astype(np.uint32)
    return np.add.reduceat(part, starts, dtype=np.uint32) + (ends - starts).astype(np.uint32)


def word_buckets(raw: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Buckets of ``bits`` bits for every word (bytes between white space) and for
    every two neighbours, by chunk; all pairs of a word and itself share one bucket."""
    before = np.zeros(0, np.uint32)
    for part in word_chunks(raw):
        word = _words(part)
        line = np.concatenate((before, word))
        pair = np.where(line[1:] == line[:-1], np.uint32(1), line[1:] * np.uint32(0x85EBCA6B) + line[:-1])
        before = line[-1:]
        yield _spread(np.concatenate((word, pair)), bits)


def fold(id_col: str, folds: int) -> Column:
    """CRC-32 of the id as text, modulo ``folds``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def bounded_sample(rows: DataFrame, label: str, per_label: int, id_col: str = "doc_id") -> DataFrame:
    """At most ``per_label`` ids of each label: those with the smallest hashes.  Of
    a label with many rows only hashes below a bound that ``4 * per_label`` of them
    are expected to meet are ranked, so no task ranks more than that for a label."""
    rows = rows.where(F.col(id_col).isNotNull()).select(id_col, label)
    place = F.pmod(F.xxhash64(id_col, F.lit(7)), F.lit(1 << 31))
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))  # a row for each label
    bound = F.least(F.lit(1.0), 4.0 * per_label / F.col("n")) * (1 << 31)
    near = rows.join(scratch.small_side(counts), label).withColumn("place", place).where(F.col("place") < bound)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy(label).orderBy("place", id_col)))
    return ranked.where(F.col("rank") <= per_label).select(id_col, label)


#: The buckets of a text, in parts.
Featurise = Callable[[str], Iterator[np.ndarray]]


def counted(parts: Iterator[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets and how often each occurs."""
    index, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for part in parts:
        own, n = np.unique(part, return_counts=True)
        index, place = np.unique(np.concatenate((index, own)), return_inverse=True)
        count = np.bincount(place, np.concatenate((count, n)), len(index)).astype(np.int64)
    return index, count


def training_rows(texts: DataFrame, label: str, featurise: Featurise) -> list[tuple[object, np.ndarray, np.ndarray]]:
    """``(label, buckets, shares)`` of each sampled text, in a fixed order.  The
    texts are reduced on the executors, so a row's size is bounded by the number
    of buckets however long its text is."""

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["text"]:
                index, count = counted(featurise(text))
                share = (count / max(1, count.sum())).astype("<f4")
                out.append((index.astype("<i4").tobytes(), share.tobytes()))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["label"], "i": [x[0] for x in out], "s": [x[1] for x in out]})

    kinds = dict(texts.dtypes)
    schema = f"doc_id {kinds['doc_id']}, label {kinds[label]}, i binary, s binary"
    rows = texts.select("doc_id", F.col(label).alias("label"), "text").mapInPandas(tidy(reduce), schema)
    found = sorted(rows.collect(), key=lambda r: (str(r["doc_id"]), r["i"]))  # bounded by the sample
    return [(r["label"], np.frombuffer(r["i"], "<i4").astype(np.int64), np.frombuffer(r["s"], "<f4")) for r in found]
