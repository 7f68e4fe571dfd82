"""Byte-level BPE by backtracking over longest matches.

Bytes become Latin-1 characters, so that pyahocorasick finds every vocabulary
token of a piece in one pass.  The encoder takes the longest token at each
position whose neighbour to the left it may follow, and steps back where it gets
stuck.  Two tokens may be neighbours iff BPE would never merge across their
border; that is found by undoing merges from the latest on, and memoised.  For
each prefix of a piece one token sequence at most is possible, so a position that
failed once is never tried again, and the work is linear in the piece.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .memory import tidy

#: Pieces, and pairs of tokens, that one Python worker remembers.
MEMO = 300_000
#: Rows that a worker turns at a time: ids and bytes of whole texts are in them.
ROWS = 512


class _Memo(dict):
    """A dict that fills itself from ``compute`` and starts anew when full."""

    def __init__(self, compute, limit: int = MEMO):
        self.compute, self.limit = compute, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.compute(key)
        return value


class Bpe:
    """Encodes and decodes by the ranks of a vocabulary of byte strings."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.longest = ahocorasick.Automaton()
        for token, i in ranks.items():
            self.longest.add_word(token.decode("latin-1"), (len(token), i))
        self.longest.make_automaton()
        self.halves = _Memo(self._halves)
        self.neighbours = _Memo(lambda pair: self._compatible(pair >> 20, pair & 0xFFFFF))
        self.pieces = _Memo(lambda piece: array("i", self.encode_bytes(piece.encode("utf-8", "replace"))).tobytes())

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for a single byte."""
        parts = [bytes([b]) for b in self.tokens[token]]
        if len(parts) < 2:
            return None
        while len(parts) > 2:
            at = min(range(len(parts) - 1), key=lambda i: (self.ranks.get(parts[i] + parts[i + 1], 1 << 40), i))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def _compatible(self, left: int, right: int) -> bool:
        bound = 1 << 40
        while True:
            across = self.ranks.get(self.tokens[left] + self.tokens[right])
            if across is not None and across < bound:
                return False
            # undo the later of the two merges; of equal ones the right was made later
            for side in ("left", "right") if left > right else ("right", "left"):
                whole = left if side == "left" else right
                if (parts := self.halves[whole]) is not None:
                    break
            else:
                return True
            if side == "left":
                bound, left = whole, parts[1]
            else:
                bound, right = whole + 1, parts[0]

    def encode_bytes(self, piece: bytes) -> list[int]:
        if (known := self.ranks.get(piece)) is not None:
            return [known]
        n = len(piece)
        starts: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, match in self.longest.iter(piece.decode("latin-1")):
            starts[end - match[0] + 1].append(match)  # shorter ones first
        failed = bytearray(n + 1)
        chosen: list[tuple[int, int, int]] = []
        at, option = 0, len(starts[0]) - 1 if n else 0
        while at < n:
            while option >= 0:
                length, token = starts[at][option]
                if not failed[at + length] and (not chosen or self.neighbours[chosen[-1][0] << 20 | token]):
                    break
                option -= 1
            if option >= 0:
                chosen.append((token, at, option))
                at += length
                option = len(starts[at]) - 1 if at < n else 0
            elif not chosen:
                raise ValueError("the vocabulary lacks a byte")
            else:
                failed[at] = 1
                _, at, option = chosen.pop()
                option -= 1
        return [token for token, _, _ in chosen]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def parse_ranks(blob: bytes) -> dict[bytes, int]:
    """Ranks from lines ``base64 rank``."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, blob.splitlines()) if token}


@lru_cache(maxsize=2)
def _encoder(digest: str, read) -> Bpe:
    return Bpe(parse_ranks(read()))


@lru_cache(maxsize=2)
def _token_bytes(digest: str, read) -> dict[int, bytes]:
    return {i: t for t, i in parse_ranks(read()).items()}


def parts(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """Batches of ``rows`` rows at most."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class _Vocabulary:
    """A broadcast vocabulary; a Python worker builds its tables once."""

    def __init__(self, docs: DataFrame, path: str):
        with open(path, "rb") as file:
            blob = file.read()
        self.blob = docs.sparkSession.sparkContext.broadcast(blob)
        self.digest = hashlib.sha256(blob).hexdigest()

    def __hash__(self):
        return hash(self.digest)

    def __eq__(self, other):
        return self.digest == other.digest

    def __call__(self) -> bytes:
        return self.blob.value

    def bpe(self) -> Bpe:
        return _encoder(self.digest, self)

    def token_bytes(self) -> dict[int, bytes]:
        return _token_bytes(self.digest, self)


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids``: the token ids of every whole text.  Null and empty texts
    have no ids; repeated rows and null ids stay; other columns are ignored."""
    scratch.bounded_batches(docs.sparkSession)
    vocabulary = _Vocabulary(docs, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, cut = vocabulary.bpe(), regex.compile(pattern).findall
        for batch in parts(batches):
            texts = batch.column("text")
            found = [b"".join(map(bpe.pieces.__getitem__, cut(t.as_py() or ""))) for t in texts]
            ends = np.cumsum([0, *(len(x) // 4 for x in found)], dtype="int64")
            values = pa.array(np.frombuffer(b"".join(found), "<i4"))
            ids = pa.ListArray.from_arrays(pa.array(ends.astype("int32")), values)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], names=["doc_id", "ids"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidy(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """``doc_id, ids, decoded``: the bytes that the ids stand for (null ids: none)."""
    vocabulary = _Vocabulary(encoded, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = vocabulary.token_bytes().__getitem__
        for batch in parts(batches):
            lists = batch.column("ids")
            decoded = [b"".join(map(token, x.values.to_numpy().tolist())) if x.is_valid else b"" for x in lists]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), lists, pa.array(decoded, pa.binary())], names=["doc_id", "ids", "decoded"]
            )

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(tidy(run), f"doc_id {kind}, ids array<int>, decoded binary")


def token_report(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row."""
    rows = decode(encode(docs, ranks_path, pattern), ranks_path)
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
