"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its distinct word shingles (64-bit hashes).  Two sets
link when their Jaccard similarity reaches the threshold; the result names, for
each document, the smallest document reachable over links.

1. *Sets.*  One pass over the texts gives each row its set's size and a 128-bit
   digest of the set.  Rows with equal digests are one class.
2. *Frequencies.*  A second pass deals all tokens by hash range, packed into
   binary blocks of (token, place of the document), and counts in how many
   documents each occurs.  Only tokens of two or more documents come back.  A set
   with fewer of those than the threshold asks for cannot link and goes; classes
   shrink to one row each, and the count is repeated among those.
   Tokens that a Misra-Gries summary finds very frequent never meet in one block.
3. *Families.*  In the order rarest first, linked sets share a token of their
   plain prefixes, so links stay within components over those tokens.
4. *Multi-match prefixes.*  Within a family, the longer a document's postings are,
   the more its prefix is lengthened (by ``depth - 1`` tokens) and the more shared
   prefix tokens (``depth``) a pair must have before it is verified against the
   whole sets.  In a large family, members are first held against a hub; those that
   link with it are one component and need not meet each other.  The others meet
   them and each other in blocks, two by two, so that no task holds more than two
   blocks; each pair of blocks returns a spanning forest, not pairs.
5. *Components* over the forests, carried to all rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .components import components
from .features import word_chunks
from .memory import tidy

#: Tokens of a packed chunk of documents, and of a hash range: this many at least,
#: and so many that a chunk has ``BLOCK_TOKENS`` in each range on average.  At a
#: trillion tokens that makes 32 million, 256 MB; packed blocks never get tiny.
CHUNK_TOKENS, BLOCK_TOKENS = 1 << 19, 1 << 10
#: Most classes whose copies, and tokens whose postings, are resolved by broadcast.
HEAVY_CLASSES, HEAVY_TOKENS = 10_000, 32_768
#: Documents of a block of a large family, and large families whose hubs' sets may be
#: broadcast.
BLOCK, HUB_FAMILIES = 256, 2000
#: Postings per required match, and the most matches that are required (a power of two).
POSTINGS, DEEPEST = 64, 16

_random = np.random.default_rng(2)
_BYTE = _random.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLACE = _random.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_powers = np.ones(1, np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash for every word of the bytes."""
    global _powers
    inside = ~_SPACE[raw]
    edges = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    starts = np.flatnonzero(edges == 1)
    if not len(starts):
        return np.zeros(0, np.uint64)
    begin = np.zeros(len(raw), np.int64)
    begin[starts[1:]] = np.diff(starts)
    begin[starts[0]] = starts[0]
    place = np.arange(len(raw)) - np.cumsum(begin)
    if (most := int(place.max()) + 1) > len(_powers):
        _powers = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(2 * most, _STEP, np.uint64))))
    part = np.where(inside, _BYTE[raw] * _powers[np.maximum(place, 0)], np.uint64(0))
    return _mix(np.add.reduceat(part, starts))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct hashes of all runs of ``words`` words of the text, with
    A-Z lower-cased; with fewer words, of the whole sequence; without words, none.
    A long text is hashed in parts that end between words."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace").translate(_LOWER), np.uint8)
    parts = [_word_hashes(part) for part in word_chunks(raw)]
    word = parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    if not len(word):
        return word
    if len(word) < words:
        weights = np.resize(_PLACE, len(word))
        return _mix(np.array([np.sum(word * weights) + np.uint64(len(word))], np.uint64))
    total = np.full(len(word) - words + 1, words, np.uint64)
    for k in range(words):
        total += word[k : len(word) - words + 1 + k] * _PLACE[k % 64] if k < 64 else _mix(word[k : len(word) - words + 1 + k] + np.uint64(k))
    return np.unique(_mix(total))


def _set_digest(tokens: np.ndarray) -> tuple[int, int]:
    one, two = np.sum(_mix(tokens ^ _BYTE[0])), np.sum(_mix(tokens + _BYTE[1]))
    return int(one.astype(np.int64)), int(two.astype(np.int64))


def _sets(words: int):
    """Pass 1: a row of kind 0 per document (``id, n, h1, h2``), and rows of kind 1
    (``token, seen``) for tokens that are frequent: those of the ``HEAVY_TOKENS``
    counters that are left after all chunks.  A token that no chunk holds twice
    does not count; it is in one document per chunk at most."""

    def merged(counts: pd.Series, held: list[np.ndarray]) -> pd.Series:
        token, n = np.unique(np.concatenate(held), return_counts=True)
        many = n > 1
        counts = counts.add(pd.Series(n[many], token[many].astype(np.int64)), fill_value=0).astype("int64")
        if len(counts) > HEAVY_TOKENS:
            cut = counts.nlargest(HEAVY_TOKENS + 1).iloc[-1]
            counts = counts[counts > cut] - cut
        return counts

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frequent, held, amount = pd.Series(dtype="int64"), [], 0
        for batch in batches:
            out = []
            for doc, known, text in zip(batch["doc_id"], batch["known"], batch["text"], strict=True):
                tokens = shingle_set(text, words)
                out.append((0, doc, known, len(tokens), *_set_digest(tokens)))
                held.append(tokens)
                amount += len(tokens)
                if amount >= CHUNK_TOKENS:
                    frequent, held, amount = merged(frequent, held), [], 0
            yield pd.DataFrame(out, columns=["kind", "id", "known", "n", "h1", "h2"])
        if held:
            frequent = merged(frequent, held)
        if len(frequent):
            yield pd.DataFrame({"kind": 1, "id": frequent.index, "known": True, "n": frequent.to_numpy(), "h1": 0, "h2": 0})

    return run


_SETS = "kind int, id long, known boolean, n long, h1 long, h2 long"
_BLOCKS = "chunk long, share int, tokens binary, places binary, frequencies binary, meta binary"
_MEMBERS = "doc_id long, n long, tokens binary, frequencies binary"


def _pack(values: np.ndarray) -> bytes:
    """Unsigned integers as differences, byte by byte of equal weight, compressed:
    of sorted hashes in one range the upper bytes vanish."""
    steps = np.diff(values, prepend=values.dtype.type(0))
    raw = steps.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()
    return len(raw).to_bytes(4, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(blob: bytes, kind: str) -> np.ndarray:
    size, width = int.from_bytes(blob[:4], "little"), np.dtype(kind).itemsize
    raw = np.frombuffer(pa.decompress(blob[4:], size, codec="zstd"), np.uint8) if size else np.zeros(0, np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(width, -1).T).reshape(-1).view(kind), dtype=kind)


#: Yields each document's id, the size of its set, and the tokens that may be shared.
Reader = Callable[[pd.DataFrame], Iterator[tuple[int, int, np.ndarray]]]


def _deal(read: Reader, heavy: np.ndarray, shares: int, width: int):
    """Chunks of documents, packed by hash range; heavy tokens stay with the chunk."""

    def packed(chunk: int, ids: list[int], whole: list[int], sets: list[np.ndarray]) -> pd.DataFrame:
        tokens, places = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype="<u4"), [len(s) for s in sets])
        order = np.argsort(tokens)
        tokens, places = tokens[order], places[order]
        at = np.searchsorted(heavy, tokens)
        often = np.zeros(len(tokens), bool) if not len(heavy) else heavy[np.minimum(at, len(heavy) - 1)] == tokens
        meta = np.array(ids + whole, "<i8").tobytes()
        rows = [(chunk, shares + chunk % shares, _pack(tokens[often]), _pack(places[often]), b"", meta)]
        tokens, places = tokens[~often], places[~often]
        share = ((tokens >> np.uint64(32)) * np.uint64(shares)) >> np.uint64(32)
        cuts = np.searchsorted(share, np.arange(shares + 1))
        rows += [
            (chunk, k, _pack(tokens[a:b]), _pack(places[a:b]), b"", b"")
            for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))
            if a < b
        ]
        return pd.DataFrame(rows, columns=["chunk", "share", "tokens", "places", "frequencies", "meta"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk = TaskContext.get().partitionId() << 24
        ids: list[int] = []
        whole: list[int] = []
        sets: list[np.ndarray] = []
        amount = 0
        for batch in batches:
            for doc, n, tokens in read(batch):
                ids.append(doc)
                whole.append(n)
                sets.append(tokens)
                amount += len(tokens)
                if amount >= width:
                    yield packed(chunk, ids, whole, sets)
                    chunk, ids, whole, sets, amount = chunk + 1, [], [], [], 0
        if ids:
            yield packed(chunk, ids, whole, sets)

    return run


def _count(shares: int):
    """Of one hash range: the tokens of two or more documents, back to their chunks."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        if group["share"].iloc[0] >= shares:
            return group
        parts = [_unpack(x, "<u8") for x in group["tokens"]]
        sizes = [len(p) for p in parts]
        tokens = np.concatenate(parts)
        order = np.argsort(tokens)
        ordered = tokens[order]
        new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
        run_of = np.cumsum(new) - 1
        frequency = np.empty(len(tokens), "<u4")
        frequency[order] = np.bincount(run_of)[run_of]
        ends = np.cumsum([0, *sizes])
        rows = []
        for k, (chunk, places) in enumerate(zip(group["chunk"], group["places"], strict=True)):
            own = slice(ends[k], ends[k + 1])
            shared = frequency[own] > 1
            if shared.any():
                place = _unpack(places, "<u4")[shared]
                rows.append((chunk, 0, _pack(tokens[own][shared]), _pack(place), _pack(frequency[own][shared]), b""))
        return pd.DataFrame(rows, columns=["chunk", "share", "tokens", "places", "frequencies", "meta"])

    return run


def _needed(n: np.ndarray | int, num: int, den: int):
    """The overlap that a set of ``n`` tokens has with any set that it links with."""
    return -(-num * n // den)


def _gather(num: int, den: int, often: dict[int, int], final: bool):
    """Of one chunk: each document's shared tokens, if they are enough; ``final``:
    rarest first, with their frequencies, else packed."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        head = group[group["meta"].str.len() > 0].iloc[0]
        meta = np.frombuffer(head["meta"], "<i8")
        ids, sizes = meta[: len(meta) // 2], meta[len(meta) // 2 :]
        tokens = np.concatenate([_unpack(x, "<u8") for x in group["tokens"]])
        places = np.concatenate([_unpack(x, "<u4") for x in group["places"]])
        known = np.array([often[t] for t in _unpack(head["tokens"], "<u8").tolist()], "<u4")
        counted = [_unpack(x, "<u4") if x else known for x in group["frequencies"]]
        frequency = np.concatenate(counted)
        enough = np.bincount(places, minlength=len(ids)) >= np.maximum(1, _needed(sizes, num, den))
        keep = enough[places]
        tokens, places, frequency = tokens[keep], places[keep], frequency[keep]
        order = np.lexsort((tokens, frequency, places))
        tokens, places, frequency = tokens[order], places[order], frequency[order]
        who = np.flatnonzero(enough)
        cuts = np.searchsorted(places, np.append(who, len(ids)))
        rows = []
        for k, a, b in zip(who.tolist(), cuts[:-1], cuts[1:], strict=True):
            blobs = (tokens[a:b].tobytes(), frequency[a:b].tobytes()) if final else (_pack(np.sort(tokens[a:b])), b"")
            rows.append((int(ids[k]), int(sizes[k]), *blobs))
        return pd.DataFrame(rows, columns=["doc_id", "n", "tokens", "frequencies"])

    return run


def _linkable(
    rows: DataFrame, read: Reader, total: int, heavy: list[tuple[int, int]], num: int, den: int, final: bool
) -> DataFrame:
    """``doc_id, n, tokens, frequencies`` of the sets that share enough tokens with others
    (tokens packed and no frequencies unless ``final``)."""
    width = max(CHUNK_TOKENS, math.isqrt(BLOCK_TOKENS * total))
    shares = max(16, -(-total // width))
    often = {t & (2**64 - 1): max(2, min(seen, 2**32 - 1)) for t, seen in heavy}
    order = np.sort(np.array(list(often), np.uint64))
    blocks = rows.mapInPandas(tidy(_deal(read, order, shares, width)), _BLOCKS)
    counted = blocks.groupBy("share").applyInPandas(_count(shares), _BLOCKS)
    return counted.groupBy("chunk").applyInPandas(_gather(num, den, often, final), _MEMBERS)


# -- within families -----------------------------------------------------------


class _Set:
    """A class's set: ``tokens`` are those shared with others, rarest first."""

    __slots__ = ("depth", "doc", "n", "order", "prefix", "sorted")

    def __init__(self, doc: int, n: int, tokens: bytes, frequencies: bytes, num: int, den: int):
        self.doc, self.n, self.order = doc, n, np.frombuffer(tokens, "<u8")
        alone = n - len(self.order)  # they come first, and match nothing
        plain = n - int(_needed(n, num, den)) + 1 - alone
        cost = int(np.frombuffer(frequencies, "<u4")[:plain].sum(dtype=np.int64))
        self.depth = 1
        while self.depth < DEEPEST and cost > POSTINGS * self.depth and 2 * self.depth <= _needed(n, num, den):
            self.depth *= 2
        self.prefix = plain
        self.sorted = None

    def tokens(self) -> np.ndarray:
        if self.sorted is None:
            self.sorted = np.sort(self.order)
        return self.sorted


def _matches(sets: list[_Set], depth: int) -> np.ndarray:
    """How many tokens the prefixes for ``depth`` of each two sets share."""
    parts = [s.order[: s.prefix + depth - 1] if s.depth >= depth else s.order[:0] for s in sets]
    tokens, owner = np.concatenate(parts), np.repeat(np.arange(len(sets)), [len(p) for p in parts])
    _, column, many = np.unique(tokens, return_inverse=True, return_counts=True)
    shared = many[column] > 1
    column, owner = np.unique(column[shared], return_inverse=True)[1], owner[shared]
    out = np.zeros((len(sets), len(sets)), np.float32)
    width = 1 << 13
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for low in range(0, int(column.max()) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (low, low + width))
        table = np.zeros((len(sets), width), np.float32)
        table[owner[a:b], column[a:b] - low] = 1
        out += table @ table.T
    return out


def _forest(sets: list[_Set], left: int | None, num: int, den: int) -> list[tuple[int, int]]:
    """Links that span the components of ``sets``; with ``left``, only links between
    the first ``left`` sets and the others are looked for."""
    size = np.array([s.n for s in sets], np.int64)
    depth = np.array([s.depth for s in sets])
    wanted = np.minimum(depth[:, None], depth[None, :])
    close = den * np.minimum(size[:, None], size[None, :]) >= num * np.maximum(size[:, None], size[None, :])
    found = np.zeros((len(sets), len(sets)), np.float32)
    for d in np.unique(wanted).tolist():
        found = np.where(wanted == d, _matches(sets, d), found)
    ok = np.triu(close & (found >= wanted), 1)
    if left is not None:
        ok[:left, :left] = False
        ok[left:, :] = False
    root = list(range(len(sets)))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    pairs = np.argwhere(ok)
    for a, b in pairs[np.argsort(-found[ok], kind="stable")].tolist():
        ra, rb = top(a), top(b)
        if ra == rb:
            continue
        both = len(np.intersect1d(sets[a].tokens(), sets[b].tokens(), assume_unique=True))
        if den * both >= num * (sets[a].n + sets[b].n - both):
            root[ra] = rb
            out.append((sets[a].doc, sets[b].doc))
    return out


def _links(num: int, den: int):
    """Rows sorted by ``family, left, right``: the forest of each of these groups."""

    def solve(key: tuple, rows: list[tuple]) -> list[tuple[int, int]]:
        first = [r for r in rows if r[0] == key[1]]
        other = [r for r in rows if r[0] != key[1]]
        sets = [_Set(*r[1:], num, den) for r in first + other]
        return _forest(sets, len(first) if key[1] != key[2] else None, num, den)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, rows = None, []
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if (r.family, r.left, r.right) != key:
                    if len(rows) > 1:
                        out += solve(key, rows)
                    key, rows = (r.family, r.left, r.right), []
                rows.append((r.block, r.doc_id, r.n, r.tokens, r.frequencies))
            if out:
                yield pd.DataFrame(out, columns=["a", "b"])
        if len(rows) > 1 and (out := solve(key, rows)):
            yield pd.DataFrame(out, columns=["a", "b"])

    return run


def _prefixes(num: int, den: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [_Set(r.doc_id, r.n, r.tokens, r.frequencies, num, den) for r in batch.itertuples(index=False)]
            parts = [s.order[: s.prefix].astype(np.int64) for s in sets]
            if parts:
                yield pd.DataFrame({"doc_id": np.repeat([s.doc for s in sets], [len(p) for p in parts]), "token": np.concatenate(parts)})

    return run


def _near_hub(num: int, den: int):
    """``doc_id, hub`` of the rows whose set links with their family's hub."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                one, two = (np.sort(np.frombuffer(x, "<u8")) for x in (r.tokens, r.hub_tokens))
                both = len(np.intersect1d(one, two, assume_unique=True))
                if den * both >= num * (r.n + r.hub_n - both):
                    out.append((r.doc_id, r.hub))
            yield pd.DataFrame(out, columns=["a", "b"])

    return run


def _hub_links(placed: DataFrame, families: int, num: int, den: int) -> DataFrame:
    """Links ``a, b`` of the large families' members with their family's hub, its
    smallest member, after which the family is named (the hub links with itself)."""
    hubs = placed.where("doc_id = component").select(
        "component", F.col("doc_id").alias("hub"), F.col("n").alias("hub_n"), F.col("tokens").alias("hub_tokens")
    )
    met = placed.join(F.broadcast(hubs) if families <= HUB_FAMILIES else hubs, "component")
    return met.select("doc_id", "n", "tokens", "hub", "hub_n", "hub_tokens").mapInPandas(_near_hub(num, den), "a long, b long")


def _edges(members: DataFrame, num: int, den: int) -> DataFrame:
    """Links ``a, b`` that span the components of the classes in ``members``."""
    entries = scratch.table(members.mapInPandas(tidy(_prefixes(num, den)), "doc_id long, token long"), "prefixes")
    hubs = entries.groupBy("token").agg(F.min("doc_id").alias("hub"), F.count("*").alias("n")).where("n > 1")
    stars = entries.join(hubs, "token").where("doc_id <> hub").select(F.col("doc_id").alias("a"), F.col("hub").alias("b"))
    families = scratch.table(components(stars).withColumnRenamed("id", "doc_id"), "families")
    large = families.groupBy("component").agg(F.count("*").alias("size")).where(F.col("size") > BLOCK)
    large = scratch.table(large.select("component"), "large")
    n_large = large.count()
    placed = scratch.table(members.join(families, "doc_id"), "placed")
    in_large = placed.join(scratch.small_side(large, n_large), "component", "left_semi")
    near = scratch.table(_hub_links(in_large, n_large, num, den), "hub_links")
    # members that link with the hub are one component already: their blocks need not
    # meet each other.  Blocks of the others have the lower numbers.
    core = near.select(F.col("a").alias("doc_id"), F.lit(1).alias("core"))
    placed = placed.join(scratch.small_side(core), "doc_id", "left").withColumn("core", F.coalesce("core", F.lit(0)))
    sizes = placed.join(scratch.small_side(large, n_large), "component", "left_semi").groupBy("component").agg(
        F.ceil(F.count_if(F.col("core") == 0) / BLOCK).cast("int").alias("others"), F.ceil(F.sum("core") / BLOCK).cast("int").alias("cores")
    )
    placed = placed.join(scratch.small_side(sizes, n_large), "component", "left")
    others, cores = F.coalesce("others", F.lit(1)), F.coalesce("cores", F.lit(0))
    dealt = F.xxhash64("doc_id")
    block = F.when(F.col("core") == 0, F.pmod(dealt, others)).otherwise(others + F.pmod(dealt, F.greatest(cores, F.lit(1))))
    partners = F.when(F.col("core") == 0, others + cores).otherwise(others)
    groups = (
        placed.withColumn("block", block.cast("int")).withColumn("partners", partners).where("partners > 0")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("partners") - 1)))
        .select(
            F.col("component").alias("family"), F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"),
            "block", "doc_id", "n", "tokens", "frequencies",
        )
    )
    keys = ["family", "left", "right"]
    rows = groups.repartition(*keys).sortWithinPartitions(*keys)
    return rows.mapInPandas(tidy(_links(num, den)), "a long, b long").unionByName(near)


def _blobs(batch: pd.DataFrame) -> Iterator[tuple[int, int, np.ndarray]]:
    for r in batch.itertuples(index=False):
        yield r.doc_id, r.n, _unpack(r.tokens, "<u8")


def jaccard_components(
    docs: DataFrame, words: int = 5, threshold: tuple[int, int] = (4, 5), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row.

    Sets link when ``den * intersection >= num * union`` for the threshold
    ``(num, den)``.  A text without words (or null) has an empty set and links with
    nothing, so its component is its own id.  Ids are integers; a row with a null
    id takes part in nothing and has a null component.  Repeated rows stay, each
    with the component of its text; other columns are ignored; an empty table gives
    an empty result.
    """
    num, den = threshold
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNotNull().alias("known"), "text")
    sets = scratch.table(rows.mapInPandas(tidy(_sets(words)), _SETS), "sets")
    key = ["n", "h1", "h2"]
    of_docs = sets.where("kind = 0").select(F.col("id").alias("doc_id"), "known", *key)
    classes = of_docs.where("known AND n > 0").groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    classes = scratch.table(classes, "classes")
    heavy = classes.where("copies >= 16").orderBy(F.desc("copies"), "rep").limit(HEAVY_CLASSES)
    heavy = scratch.table(heavy.drop("copies"), "heavy")
    stated = docs.sparkSession.sparkContext.broadcast({(r.n, r.h1, r.h2): r.rep for r in heavy.collect()})
    frequent = sets.where("kind = 1").groupBy("id").agg(F.sum("n").alias("seen")).where("seen >= 64")
    frequent = [(r.id, r.seen) for r in frequent.orderBy(F.desc("seen"), "id").limit(HEAVY_TOKENS).collect()]

    def read(batch: pd.DataFrame) -> Iterator[tuple[int, int, np.ndarray]]:
        copies = stated.value
        for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
            tokens = shingle_set(text, words)
            if len(tokens) and copies.get((len(tokens), *_set_digest(tokens)), doc) == doc:
                yield doc, len(tokens), tokens

    total = of_docs.agg(F.sum("n")).first()[0] or 0
    linkable = _linkable(rows.where("known").drop("known"), read, total, frequent, num, den, final=False)
    # one row per class goes on; among those, frequencies are counted anew
    reps = linkable.join(classes.select(F.col("rep").alias("doc_id"), "n").distinct(), ["doc_id", "n"], "left_semi")
    reps = scratch.table(reps.select("doc_id", "n", "tokens").dropDuplicates(["doc_id", "n"]), "reps")
    again = reps.agg(F.sum("n")).first()[0] or 0
    members = scratch.table(_linkable(reps, _blobs, again, frequent, num, den, final=True), "members")
    linked = scratch.table(components(_edges(members, num, den)), "linked").withColumnRenamed("id", "rep")

    named = F.coalesce("component", "rep").alias("component_id")
    label = classes.drop("copies").join(linked, "rep", "left").select(*key, named)
    label_heavy = heavy.join(linked, "rep", "left").select(*key, named)
    met = of_docs.where("n > 0").join(F.broadcast(label_heavy), key, "left")
    others = of_docs.where("n > 0").join(F.broadcast(heavy.select(*key)), key, "left_anti").join(label, key, "left")
    empty = of_docs.where("n = 0").withColumn("component_id", F.col("doc_id"))
    found = met.where("component_id IS NOT NULL").unionByName(others).unionByName(empty)
    return found.select(
        F.when(F.col("known"), F.col("doc_id")).alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(F.col("known"), F.coalesce("component_id", "doc_id")).alias("component_id"),
    )
