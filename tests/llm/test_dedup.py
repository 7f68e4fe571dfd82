import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quillbook.llm import exact_dedup, line_dedup, lookup, ngram_join
from quillbook.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
KINDS = "doc_id long, text string"


# -- exact ---------------------------------------------------------------------


def exact(rows):
    groups = collections.defaultdict(list)
    for at, (doc, text) in enumerate(rows):
        norm = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        groups[norm].append((-len(text or ""), doc is None, doc or 0, at))
    out = collections.Counter()
    for norm, members in groups.items():
        keep = min(members)
        for m in members:
            out[None if m[1] else m[2], None if keep[1] else keep[2], len(members), hashlib.sha256(norm.encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("counters", [1, 3, exact_dedup.COUNTERS])
def test_exact(spark, counters):
    random.seed(counters)
    rows = [(random.randrange(400), random.choice(["a", "a b", " a", "b", None, "", "\v\f", "c" * random.randrange(9)])) for _ in range(900)]
    df = spark.createDataFrame(rows, KINDS).repartition(5)
    got = exact_dedup.exact_dedup(df, counters=counters).collect()
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == exact(rows)
    assert collections.Counter(r.text_sha256 for r in got if r.kept) == dict.fromkeys({r.text_sha256 for r in got}, 1)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_frequent_digests_only_are_broadcast(spark, monkeypatch):
    """Digests above the verified bound are winners; those seen once, or no oftener than
    the bound, take the shuffle."""
    written = {}
    keep = exact_dedup.scratch.table
    monkeypatch.setattr(exact_dedup.scratch, "table", lambda df, label: written.setdefault(label, keep(df, label)))
    rows = [(i, "hot") for i in range(300)] + [(1000 + i, "warm") for i in range(30)] + [(2000 + i, f"once {i}") for i in range(300)]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, KINDS).repartition(4), counters=10).collect()
    assert [(r.group_size, r.keep_id) for r in written["winners"].collect()] == [(300, 0)]
    assert collections.Counter(r.group_size for r in got) == {300: 300, 30: 30, 1: 300}
    monkeypatch.undo()
    written.clear()
    monkeypatch.setattr(exact_dedup.scratch, "table", lambda df, label: written.setdefault(label, keep(df, label)))
    exact_dedup.exact_dedup(spark.createDataFrame(rows, KINDS)).collect()
    assert sorted(r.group_size for r in written["winners"].collect()) == [30, 300]  # what is seen once is never broadcast


def test_exact_edges(spark, nasty):
    got = exact_dedup.exact_dedup(nasty).collect()
    same = [r for r in got if r.group_size == 5]
    assert {r.keep_id for r in same} == {2} and sum(r.kept for r in same) == 1  # most code points
    assert exact_dedup.exact_dedup(nasty.limit(0)).count() == 0


def test_misra_gries_bound():
    import pandas as pd

    k, n = 10, 5000
    data = ["hot"] * (n // 3) + [f"x{i}" for i in range(n - n // 3)]
    random.seed(1)
    random.shuffle(data)
    batches = (pd.DataFrame({"text_sha256": data[i : i + 100]}) for i in range(0, n, 100))
    (out,) = exact_dedup._misra_gries(k)(batches)
    seen = dict(zip(out["text_sha256"], out["seen"]))
    assert len(out) <= k and n // 3 - n / k <= seen["hot"] <= n // 3


# -- near ----------------------------------------------------------------------


def near(rows, words, num, den):
    sets = {}
    for doc, text in rows:
        w = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
        sets[doc] = frozenset(tuple(w[j : j + words]) for j in range(max(1, len(w) - words + 1))) if w else frozenset()
    parent = {d: d for d in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    docs = sorted(sets)
    for i, a in enumerate(docs):
        for b in docs[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and den * both >= num * len(sets[a] | sets[b]):
                ra, rb = top(a), top(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {d: (len(sets[d]), top(d)) for d in sets}


def mutated(seed, n, vocabulary=60):
    random.seed(seed)
    word = lambda: random.choice("abcdefghij") * random.randrange(1, 4) + str(random.randrange(vocabulary))
    bases = [[word() for _ in range(random.choice([3, 8, 40, 90]))] for _ in range(6)]
    rows = []
    for doc in range(n):
        w = list(random.choice(bases))
        for _ in range(random.choice([0, 0, 1, 2, 4])):
            at = random.randrange(len(w))
            w[at : at + random.choice([0, 1])] = random.choice([[], [word()], [word().upper()]])
            w = w or [word()]
        rows.append((doc, " ".join(w)))
    return rows


@pytest.mark.parametrize("words, threshold, block, heavy", [(4, (85, 100), 256, True), (5, (4, 5), 8, False), (2, (1, 2), 16, True)])
def test_near(spark, monkeypatch, words, threshold, block, heavy):
    rows = mutated(words, 260)
    monkeypatch.setattr(ngram_join, "BLOCK", block)  # small blocks: many block pairs
    monkeypatch.setattr(ngram_join, "POSTINGS", 4)  # deep prefixes
    if not heavy:
        monkeypatch.setattr(ngram_join, "HEAVY_CLASSES", 1)
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, KINDS).repartition(3), words, threshold).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == near(rows, words, *threshold)


def test_near_tables(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    got = ngram_join.jaccard_components(documents, 4, (85, 100)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == near(rows, 4, 85, 100)


def test_near_edges(spark, nasty):
    got = ngram_join.jaccard_components(nasty).collect()
    assert len(got) == nasty.count()
    of = {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None}
    assert of[1] == of[2] == of[3] == (1, 1) and of[4] == (0, 4) and of[5] == (0, 5) and of[6] == (0, 6)
    assert of[7][1] == of[8][1] == 7 and of[2**60] == (1, 2**60)
    assert all(r.component_id is None for r in got if r.doc_id is None)
    assert ngram_join.jaccard_components(nasty.limit(0)).count() == 0


def test_packed_numbers():
    import numpy as np

    for kind in ("<u2", "<u4", "<u8"):
        values = np.random.default_rng(1).integers(0, np.iinfo(kind).max, 999, dtype=kind)
        for x in (values, np.sort(values), values[:0], values[:1]):
            assert (ngram_join._unpack(ngram_join._pack(x), kind) == x).all()


def test_words_of_any_length():
    one = ngram_join.shingle_set("x" * 5000 + " b", 4)
    assert len(one) == 1 and (one != ngram_join.shingle_set("x" * 4999 + "y b", 4)).all()
    assert (ngram_join.shingle_set("\n A  b\t", 4) == ngram_join.shingle_set("a b", 4)).all()
    assert len(ngram_join.shingle_set("É b", 4)) == 1 and (ngram_join.shingle_set("É b", 4) != ngram_join.shingle_set("é b", 4)).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(70)] + [(100, 200), (200, 150), (5, 5), (300, 300), (None, 7)]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = {i: 0 for i in range(71)} | {100: 100, 150: 100, 200: 100}
    assert {r.id: r.component for r in got} == want and len(got) == len(want)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- lines ---------------------------------------------------------------------


def lines(rows):
    """``{(row, line): reason}``; rows are named by their place in the list."""
    first, out = {}, {}
    for at, (doc, text) in sorted(enumerate(rows), key=lambda x: (x[1][0] is None, x[1][0] or 0, x[0])):
        for k, line in enumerate((text or "").split("\n")):
            if WORD.search(line):
                if line in first:
                    out[at, k] = "exact"
                else:
                    if any(one_edit(line, o) for o in first):
                        out[at, k] = "near"
                    first[line] = (at, k)
    return out


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i:] == b[i + 1 :] or a[i + 1 :] == b[i + 1 :]


def reported(rows):
    """What ``line_report`` and ``clean`` must return, as multisets."""
    gone, report, texts = lines(rows), collections.Counter(), collections.Counter()
    for at, (doc, text) in enumerate(rows):
        parts = (text or "").split("\n")
        own = [k for k in range(len(parts)) if (at, k) in gone]
        kinds = collections.Counter(gone[at, k] for k in own)
        report[doc, sum(bool(WORD.search(x)) for x in parts), kinds["exact"], kinds["near"], ",".join(map(str, own))] += 1
        texts[doc, text if not own else "\n".join(x for k, x in enumerate(parts) if k not in own)] += 1
    return report, texts


def edited_rows(seed, n, ids):
    random.seed(seed)
    bases = ["the quick brown fox jumps", "pack my box with five é漢😀", "x" * 70 + "abc", "short", "aaaaaaaa", "aaaaaaaaa", "y" * 32, "y" * 33, "ab", "é"]

    def edited(line):
        at, c = random.randrange(len(line) + 1), random.choice("abé漢xy ")
        return random.choice([line, line[:at] + c + line[at:], line[:at] + line[at + 1 :], line[:at] + c + line[at + 1 :]])

    return [(ids(i), "\n".join(random.choice(["", " ", edited(edited(random.choice(bases)))]) for _ in range(random.randrange(9)))) for i in range(n)]


@pytest.mark.parametrize("broadcast", [True, False])
def test_lines(spark, monkeypatch, broadcast):
    from quillbook.plans import scratch

    monkeypatch.setattr(line_dedup, "CHUNK", 16)  # many chunks a line
    if not broadcast:
        monkeypatch.setattr(scratch, "BROADCAST_ROWS", 0)
    # ids that repeat with other texts, and null ids
    rows = edited_rows(8, 120, lambda i: random.choice([None, i, i % 7])) + [(500, None), (501, ""), (1, "one two three four\none two three four"), (1, "stays\nplease")]
    df = spark.createDataFrame(rows, KINDS).coalesce(1)
    report, texts = reported(rows)
    got = collections.Counter((r.doc_id, r.line_no, r.reason) for r in line_dedup.dedup_lines(df).collect())
    assert got == collections.Counter((rows[at][0], k, reason) for (at, k), reason in lines(rows).items())
    assert collections.Counter(tuple(r) for r in line_dedup.line_report(df).collect()) == report
    assert collections.Counter(tuple(r) for r in line_dedup.clean(df).collect()) == texts


def test_line_edges(spark, nasty):
    for rows in ([(1, "one two three four\none two three four"), (1, "different text here\nsecond stays please\nx")], [(None, "a b c\na b c"), (None, "d e f\ng h i j k")]):
        df = spark.createDataFrame(rows, KINDS).coalesce(1)
        report, texts = reported(rows)
        assert collections.Counter(tuple(r) for r in line_dedup.line_report(df).collect()) == report
        assert collections.Counter(tuple(r) for r in line_dedup.clean(df).collect()) == texts
    got = line_dedup.dedup_lines(nasty).collect()
    assert all(r.reason in ("exact", "near") for r in got)
    assert any(r.doc_id is None and r.reason == "exact" for r in got)  # null ids come last
    assert line_dedup.line_report(nasty).count() == nasty.count()
    assert line_dedup.dedup_lines(nasty.limit(0)).count() == 0 == line_dedup.line_report(nasty.limit(0)).count()


def test_key_filter(spark, monkeypatch):
    """A filter passes every row with a key, and few others."""
    rows = spark.range(40_000).select("id", F.xxhash64("id").alias("k"))
    keys = rows.where("id % 10 = 0").select("k")
    passed = lookup.passing(rows, "k", keys, keys.count()).cache()
    assert passed.where("id % 10 = 0").count() == 4000 and passed.columns == rows.columns
    assert passed.count() < 4000 + 0.06 * 36_000
    monkeypatch.setattr(lookup, "WORDS", 1)  # more keys than a filter may hold
    assert lookup.passing(rows, "k", keys, keys.count()).count() == 40_000
