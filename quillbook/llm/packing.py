"""Best-fit packing by a configuration linear program.

Only the histogram of lengths (at most ``SEQUENCE`` numbers) reaches the driver,
however many documents there are.  There the covering program over packings of
one sequence is solved by multiplicative weights: each round prices lengths by
their weights, a knapsack dynamic program bounded by the counts finds the packings
that are worth most, and the weights of the lengths that they cover fall.  The
fractional solution, scaled by its least coverage, is rounded to whole sequences, of
which those stay that are as full as the program's lower bound asks for; what is left
is solved again, ``PASSES`` times in all.  Most of the shortest pieces are held back
from the program: they are the filler that lets best fit, longest first, pack the last
pieces with next to no room lost.
The result, a table of slots by length, is broadcast (its size is bounded by the
sequence length, not by the data), and every piece takes the slot of its rank
among the pieces of its length.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import scratch
from .byte_bpe import _Memo, parts
from .memory import tidy

SEQUENCE = 2048
#: The program ends within ``ACCURACY`` of its lower bound, or after it has priced so many
#: lengths in all (a round prices every length once, and there are at most ``SEQUENCE``).
ACCURACY, PRICED = 0.05, 60 * SEQUENCE
#: What the rounding leaves is solved again, in so many passes in all.
PASSES = 2
#: Pieces of at most this share of a sequence are filler, and the share of them that the
#: program does not see.
FILLER, HELD = 1 / 16, 0.9
#: How fast the weights fall with coverage, the most that a length is covered by in a
#: round, and what packings must be worth to be taken, as a share of the best.
SHARPNESS, STEP, NEARLY = 40.0, 0.1, 0.9
#: Words that a task remembers.
WORDS = 400_000
#: The pieces of a length are dealt into shares of about this many to be ranked, or
#: more where ``RANK_SHARES`` shares in all would not do.
SHARE_ROWS, RANK_SHARES = 4096, 65_536
_END = (0).to_bytes(4, "little")


# -- token ids ---------------------------------------------------------------


class _Words:
    """The ids of single words by a tokenizer, as bytes.

    A word of Latin letters is one pre-token, which goes straight to the
    tokenizer's model, its bytes written as the pre-tokenizer writes them; a
    full stop or comma behind a letter is a pre-token of its own.  All else, and
    every word if the tokenizer does not work that way, takes the whole tokenizer.
    """

    def __init__(self, blob: bytes):
        self.tokenizer = Tokenizer.from_str(blob.decode("utf-8"))
        self.model = self.tokenizer.model
        self.written = _Memo(lambda char: self.tokenizer.pre_tokenizer.pre_tokenize_str(char)[0][0])
        self.simple = all(self._letters(w.lower()) == self._whole(w) for w in ("Word", "straße", "été", "dont", "ñÿs", "x"))
        self.marks = {m: self._whole(m) for m in ".,"}
        self.simple = self.simple and all(self._whole(f"é{m}") == self._whole("é") + self.marks[m] for m in ".,")
        self.memo = _Memo(self._ids, WORDS)

    def _whole(self, word: str) -> bytes:
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def _letters(self, word: str) -> bytes:
        if not word.isascii():  # the pre-tokenizer writes ASCII letters as they are
            word = "".join(map(self.written.__getitem__, word))
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def _ids(self, word: str) -> bytes:
        if self.simple and word and (word.isascii() or max(word) < "\u0250"):
            mark = self.marks.get(word[-1], b"")
            lower = (word[:-1] if mark else word).lower()
            if lower.isalpha():
                return self._letters(word) if lower == word else self.memo[lower] + mark
        return self._whole(word)


@lru_cache(maxsize=2)
def _words(digest: str, blob: bytes) -> _Memo:
    return _Words(blob).memo


def tokenise(
    docs: DataFrame, tokenizer_path: str, sequence: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, piece, start, length, ids`` for every piece of every row.

    ``ids`` holds little-endian unsigned 32-bit token ids.  A document is its
    tokens and a closing id 0 (null text is empty: the closing id alone); only
    one longer than ``sequence`` is cut, every ``sequence`` ids.  The tokenizer
    must drop spaces and line feeds and never merge across them, as one with word
    ends does: words are encoded once and remembered.
    """
    scratch.bounded_batches(docs.sparkSession)
    with open(tokenizer_path, "rb") as file:
        blob = file.read()
    shared, digest = docs.sparkSession.sparkContext.broadcast(blob), hashlib.sha256(blob).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(digest, shared.value)
        for batch in parts(batches):
            row, piece, ids = [], [], []
            for at, text in enumerate(batch.column("text")):
                whole = b"".join(map(words.__getitem__, (text.as_py() or "").replace("\n", " ").split(" "))) + _END
                cut = [whole[k : k + 4 * sequence] for k in range(0, len(whole), 4 * sequence)]
                row += [at] * len(cut)
                piece += range(len(cut))
                ids += cut
            number = pa.array(piece, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(row, pa.int64())),
                    number,
                    pa.array(np.array(piece, "int64") * sequence),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array(ids, pa.binary()),
                ],
                names=["doc_id", "piece", "start", "length", "ids"],
            )
        words.clear()  # a worker that lives on keeps the tokenizer only

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(tidy(run), f"doc_id {kind}, piece int, start long, length long, ids binary")


# -- the program over the histogram ------------------------------------------


def _priced(value: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[float, dict[tuple, float]]:
    """Bounded knapsack: what the packing worth most is worth, and packings with what
    they are worth: that one, and for each length the best with one of it.  None has a
    length more often than it exists."""
    best, items, lengths = np.zeros(capacity + 1), [], np.flatnonzero(counts)
    worth = np.empty(capacity + 1)
    for length in lengths.tolist():
        most, times = min(int(counts[length]), capacity // length), 1
        while most > 0:  # 1, 2, 4, ... of a length are items of their own
            times = min(times, most)
            room = times * length
            old, new = best[room:], worth[room:]
            np.add(best[: capacity + 1 - room], times * value[length], out=new)
            better = new > old
            np.maximum(old, new, out=old)
            items.append((length, times, room, better))
            most, times = most - times, times * 2
    rooms = np.append(capacity - lengths, capacity)
    taken: list[dict[int, int]] = [{} for _ in rooms]
    widest = int(rooms.max())
    for length, times, room, better in reversed(items):
        if room > widest:
            continue
        fits = (rooms >= room).nonzero()[0]
        fits = fits[better[rooms[fits] - room]]
        if fits.size:
            rooms[fits] -= room
            widest = int(rooms.max())
            for i in fits.tolist():
                taken[i][length] = taken[i].get(length, 0) + times
    out = {tuple(sorted(taken[-1].items())): float(best[capacity])}
    for length, packing in zip(lengths.tolist(), taken):
        packing[length] = packing.get(length, 0) + 1
        if packing[length] <= counts[length]:
            out[tuple(sorted(packing.items()))] = float(value[length] + best[capacity - length])
    return float(best[capacity]), out


def program(counts: np.ndarray, capacity: int, rounds: int | None = None) -> tuple[dict[tuple, float], float]:
    """A fractional solution that covers every length, and a lower bound of the program.

    A round prices lengths by how little they are covered, and takes all packings worth
    nearly the most, each in small shares.  Any prices bound the program from below: what
    all pieces are worth over what the best packing is worth.  It ends when the solution,
    scaled by its least coverage, is within ``ACCURACY`` of the best bound, or after
    ``rounds`` rounds (as many as ``PRICED`` allows).
    """
    present = np.flatnonzero(counts)
    rounds = rounds or PRICED // len(present)
    bound = float((counts * np.arange(capacity + 1)).sum()) / capacity
    covered, found, total = np.zeros(capacity + 1), {}, 0.0
    for _ in range(rounds):
        value, now = np.zeros(capacity + 1), covered[present]
        behind = np.exp(-SHARPNESS * (now - now.min()) / now.mean()) if total else present * counts[present]
        value[present] = behind / counts[present]
        most, packings = _priced(value, counts, capacity)
        bound = max(bound, float((value * counts).sum()) / most)
        chosen = [key for key, worth in packings.items() if worth >= NEARLY * most]
        load = np.zeros(capacity + 1)
        for key in chosen:
            for length, times in key:
                load[length] += times / counts[length]
        for key in chosen:
            size = STEP / max(load[length] for length, _ in key)
            found[key] = found.get(key, 0.0) + size
            total += size
            for length, times in key:
                covered[length] += size * times / counts[length]
        least = float(covered[present].min())
        if least > 0 and total / least <= (1 + ACCURACY) * bound:
            break
    least = max(float(covered[present].min()), 1e-9)
    return {key: much / least for key, much in found.items()}, bound


def solve(histogram: dict[int, int], capacity: int = SEQUENCE, rounds: int | None = None) -> list[tuple[dict[int, int], int]]:
    """Packings ``({length: times}, sequences)`` that hold the histogram exactly."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    packings, rest = by_program(counts, capacity, rounds)
    return packings + _best_fit(rest, capacity)


def by_program(counts: np.ndarray, capacity: int, rounds: int | None = None) -> tuple[list[tuple[dict[int, int], int]], np.ndarray]:
    """The program's own packings, and the counts that they leave."""
    held = np.where(np.arange(capacity + 1) <= capacity * FILLER, (counts * HELD).astype(np.int64), 0)
    left, packings = counts - held, []
    for _ in range(PASSES):
        if not left.any():
            break
        found, bound = program(left, capacity, rounds)
        taken, left = _rounded(found, left, capacity, bound)
        packings += taken
    return packings, left + held


def _rounded(found: dict[tuple, float], left: np.ndarray, capacity: int, bound: float) -> tuple[list[tuple[dict[int, int], int]], np.ndarray]:
    """The fractional packings in whole sequences, and the counts that are left: what is
    below one is carried to the next packing, so that small shares add up.  Fullest go
    first.  Of a solution that is not yet within ``ACCURACY`` of ``bound``, packings with
    more room left than sequences have on average, were there only ``bound`` of them,
    are not taken."""
    solved = sum(found.values()) <= (1 + ACCURACY) * bound
    fill = 0 if solved else int((left * np.arange(capacity + 1)).sum() / bound + 1e-6)
    left, packings, carried = left.copy(), [], 0.0
    for key, much in sorted(found.items(), key=lambda x: (-sum(k * n for k, n in x[0]), x[0][::-1])):
        if sum(k * times for k, times in key) < fill:
            break
        carried += much
        n = min(int(carried), min(int(left[k]) // times for k, times in key))
        carried = min(carried - n, 1.0)
        if n > 0:
            packings.append((dict(key), n))
            for k, times in key:
                left[k] -= n * times
    return packings, left


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best fit, longest first, of counts by length; equal sequences go together."""
    open_: list[dict[tuple, int]] = [{} for _ in range(capacity + 1)]  # by room: packing -> sequences
    rooms = 0  # bit r is set where open_[r] has sequences

    def put(room: int, key: tuple, many: int) -> None:
        nonlocal rooms
        open_[room][key] = open_[room].get(key, 0) + many
        rooms |= 1 << room

    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n > 0 and (fitting := rooms >> length):
            room = length + (fitting & -fitting).bit_length() - 1  # the tightest
            key, many = open_[room].popitem()
            taken = min(n, many)
            if taken < many:
                open_[room][key] = many - taken
            elif not open_[room]:
                rooms ^= 1 << room
            last, times = key[-1]
            grown = (*key[:-1], (length, times + 1)) if last == length else (*key, (length, 1))
            put(room - length, grown, taken)
            n -= taken
        each = capacity // length
        for times, many in ((each, n // each), (n % each, 1)):
            if times and many:
                put(capacity - times * length, ((length, times),), many)
    return [(dict(key), many) for group in open_ for key, many in group.items()]


def slots(packings: list[tuple[dict[int, int], int]]) -> pd.DataFrame:
    """``length, first, sequence, offset``: the pieces of a length with ranks from
    ``first`` on lie in the sequences from ``sequence`` on, at ``offset``."""
    rows, rank, sequence = [], {}, 0
    for packing, many in packings:
        offset = 0
        for length, times in sorted(packing.items(), reverse=True):
            for _ in range(times):
                rows.append((length, rank.get(length, 0), sequence, offset))
                rank[length] = rank.get(length, 0) + many
                offset += length
        sequence += many
    return pd.DataFrame(rows, columns=["length", "first", "sequence", "offset"]).sort_values(["length", "first"])


# -- placement ---------------------------------------------------------------


def _ranked(pieces: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """``pieces`` with ``rank``, from 0 without gaps among pieces of equal length.
    A length that many pieces share is dealt into shares, which are counted and
    numbered apart, and moved up by the shares before."""
    size = max(SHARE_ROWS, sum(histogram.values()) // RANK_SHARES)
    shares = pieces.sparkSession.createDataFrame([(k, -(-n // size)) for k, n in histogram.items()], "length long, shares long")
    dealt = pieces.join(F.broadcast(shares), "length")  # at most a row for each length
    dealt = dealt.withColumn("share", F.pmod(F.xxhash64("doc_id", "piece", "uid"), "shares")).drop("shares")
    counts = dealt.groupBy("length", "share").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "share", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "share").orderBy("doc_id", "piece", "uid")
    numbered = dealt.withColumn("within", F.row_number().over(within) - 1)
    # at most RANK_SHARES rows and one for each length, however many pieces there are
    return numbered.join(F.broadcast(bases), ["length", "share"]).withColumn("rank", F.col("base") + F.col("within")).drop(
        "share", "within", "base"
    )


def _placed(spark: SparkSession, ranked: DataFrame, table: pd.DataFrame) -> DataFrame:
    shared = spark.sparkContext.broadcast([table[c].to_numpy(np.int64) for c in ("length", "first", "sequence", "offset")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        length, first, sequence, offset = shared.value
        begin = np.searchsorted(length, np.arange(length.max() + 2 if len(length) else 1))
        for batch in batches:
            want, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            at = np.empty(len(batch), np.int64)
            for k in np.unique(want):
                own = want == k
                at[own] = begin[k] + np.searchsorted(first[begin[k] : begin[k + 1]], rank[own], side="right") - 1
            batch["sequence_id"], batch["offset"] = sequence[at] + rank - first[at], offset[at]
            yield batch.drop(columns="rank")

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.drop("rank").schema)
    return ranked.mapInPandas(tidy(run), f"{fields}, sequence_id long, offset long")


def _placed_rows(rows: DataFrame, sequence: int) -> DataFrame:
    """``rows`` (``uid``, ``doc_id``, ``piece``, ``length``, ...) with their places."""
    counted = rows.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most ``sequence`` rows
    histogram = {r["length"]: r["n"] for r in counted}
    return _placed(rows.sparkSession, _ranked(rows, histogram), slots(solve(histogram, sequence)))


def pack(pieces: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """``pieces`` (``doc_id, piece, length`` and any other narrow columns) with
    ``sequence_id`` and ``offset``.  Lengths are 1 to ``sequence``; offsets in a
    sequence have no gaps from 0.  Repeated rows and null ids are packed like any
    other; an empty table gives an empty result."""
    rows = scratch.table(pieces.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    return _placed_rows(rows, sequence).drop("uid")


def sequences(pieces: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """``sequence_id, ids``: the packed sequences themselves, of what ``tokenise`` gives.
    Pieces are named by row, so repeated rows and null ids are packed like any other;
    an empty table gives an empty result."""
    rows = scratch.table(pieces.select("doc_id", "piece", "length", "ids", F.monotonically_increasing_id().alias("uid")), "pieces")
    placed = _placed_rows(rows.drop("ids"), sequence).select("uid", "sequence_id", "offset")
    met = rows.select("uid", "ids").join(placed, "uid")
    ordered = F.sort_array(F.collect_list(F.struct("offset", "ids")))  # at most SEQUENCE ids
    joined = F.aggregate(ordered, F.lit(b""), lambda out, x: F.concat(out, x["ids"]))
    return met.groupBy("sequence_id").agg(joined.alias("ids"))


def pack_report(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece."""
    pieces = tokenise(docs, tokenizer_path)
    narrow = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(narrow).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
