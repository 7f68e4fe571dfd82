"""Secret scans by a trigram inverted index, in DataFrame functions only.

* ``boolean_query`` derives from each rule's regex a Boolean query over trigrams
  that every match must contain (AND of trigrams within a literal run, OR over
  alternatives).
* The index holds, for each trigram that some query names, its postings in
  shards of about ``SHARD`` documents; posting lists are intersected and united
  shard by shard, so no list or task grows with the corpus.
* Only candidates run a rule's regex; a rule without mandatory trigrams (hex
  runs) scans every text.  Postings hold hashes of ids and a candidate is only
  ever verified, so clashing or repeated ids cost time and no result.
* Texts stay where they are: candidates reach them by broadcast, few as they are
  and many as a filter of their hashes; only past 44 million do rows meet them by
  a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lookup, scratch

#: Expected documents per shard of the index.
SHARD = 8192
#: Spans that are joined at a time.
CHUNK = 256
#: Most strings that a literal run may stand for while a query is derived.
_EXACT = 64


@dataclass(frozen=True)
class Rule:
    """``group`` is measured: matches with fewer than ``least`` code points there are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


_WORDS = ("password", "passwd", "secret", "token", "api_?key")
_ANY_CASE = "|".join(re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", w) for w in _WORDS)
BASE_RULES = (
    Rule("assign", rf"""({_ANY_CASE})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", "AKIA[A-Z0-9]+", 0, 18),
    # the runs of [0-9a-f]+ that have 16 or more characters
    Rule("hex", "[0-9a-f]{16,}", 0, 16),
)
EXTRA_RULES = (
    Rule("forge", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("pem", "-----BEGIN [A-Z\\x20]*PRIVATE KEY-----"),
)
RULES = BASE_RULES + EXTRA_RULES

# A query is True (no demand), a trigram, or ("and" | "or", parts).


def _both(*parts):
    kept = list(dict.fromkeys(p for p in parts if p is not True))
    return True if not kept else kept[0] if len(kept) == 1 else ("and", tuple(kept))


def _either(*parts):
    if any(p is True for p in parts):
        return True
    kept = list(dict.fromkeys(parts))
    return kept[0] if len(kept) == 1 else ("or", tuple(kept))


def _strings_query(strings):
    needs = {tuple(dict.fromkeys(s[i : i + 3] for i in range(len(s) - 2))) for s in strings}
    # what demands all that another alternative demands, and more, adds nothing to an OR
    needs = [n for n in sorted(needs) if not any(set(m) < set(n) for m in needs)]
    return _either(*(_both(*n) for n in needs))


def _item(op, arg):
    """``(all strings it can match, None)`` or ``(None, query)``."""
    name = str(op)
    if name == "LITERAL":
        return {chr(arg).lower()}, None
    if name == "AT":
        return {""}, None
    if name == "IN":
        chars: set[str] = set()
        for kind, value in arg:
            if str(kind) == "LITERAL":
                chars.add(chr(value).lower())
            elif str(kind) == "RANGE" and value[1] - value[0] < 8:
                chars |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None, True
        return (chars, None) if len(chars) <= 8 else (None, True)
    if name == "BRANCH":
        options = [_sequence(o) for o in arg[1]]
        if all(exact is not None for exact, _ in options) and sum(len(exact) for exact, _ in options) <= _EXACT:
            return set().union(*(exact for exact, _ in options)), None
        return None, _either(*(_strings_query(exact) if exact is not None else q for exact, q in options))
    if name == "SUBPATTERN":
        return _sequence(arg[3])
    if name == "MAX_REPEAT":
        low, high, inner = arg
        exact, query = _sequence(inner)
        if exact is not None and (low, int(high)) in ((0, 1), (1, 1)):
            return exact | ({""} if low == 0 else set()), None
        if low == 0:
            return None, True
        return None, _strings_query({s * min(low, 3) for s in exact}) if exact is not None else query
    return None, True


def _sequence(items):
    runs, clauses, whole = {""}, [], True
    for op, arg in items:
        exact, query = _item(op, arg)
        if exact is not None and len(runs) * len(exact) <= _EXACT:
            runs = {a + b for a in runs for b in exact}
            continue
        whole = False
        clauses += [_strings_query(runs), True if exact is not None else query]
        runs = exact if exact is not None else {""}
    return (runs, None) if whole else (None, _both(*clauses, _strings_query(runs)))


def boolean_query(pattern: str):
    """The trigrams, over lower-cased text, that any match of ``pattern`` implies."""
    exact, query = _sequence(re._parser.parse(pattern))
    return _strings_query(exact) if exact is not None else query


def _trigrams(query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(_trigrams, query[1]))


def _postings(query, index: Column) -> Column:
    if isinstance(query, str):
        return F.coalesce(F.try_element_at(index, F.lit(query)), F.array().cast("array<bigint>"))
    combine = F.array_intersect if query[0] == "and" else F.array_union
    return reduce(combine, (_postings(q, index) for q in query[1]))


def candidates(docs: DataFrame, rules: Sequence[Rule], key: str = "key", text: str = "text") -> DataFrame:
    """``key, rules``: bit ``i`` is set where rule ``i`` may match a text of that key."""
    queries = {i: q for i, r in enumerate(rules) if (q := boolean_query(r.pattern)) is not True}
    wanted = sorted(set().union(*map(_trigrams, queries.values())))
    shards = max(1, -(-docs.count() // SHARD))
    lowered = docs.select(key, F.lower(text).alias("lowered"))
    hits = F.filter(F.array(*[F.when(F.contains("lowered", F.lit(t)), F.lit(t)) for t in wanted]), lambda t: t.isNotNull())
    postings = (
        lowered.select(key, F.explode(hits).alias("trigram"))
        .groupBy("trigram", F.pmod(key, F.lit(shards)).alias("shard"))
        .agg(F.collect_set(key).alias("ids"))
    )
    index = postings.groupBy("shard").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "ids"))).alias("index"))

    def flagged(i: int, query) -> Column:
        return F.transform(_postings(query, F.col("index")), lambda k: F.struct(k.alias(key), F.lit(1 << i).alias("bit")))

    found = F.flatten(F.array(*[flagged(i, q) for i, q in queries.items()]))
    return index.select(F.inline(found)).groupBy(key).agg(F.bit_or("bit").alias("rules"))


def _folded(items: Column, empty: Column, step) -> Column:
    """``at, out`` after folding ``items`` from the left.  ``step`` moves ``at`` and adds
    to ``out``; what grows is joined per ``CHUNK`` items, so that a text with very many
    spans does not copy all earlier ones for each."""
    chunks = F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil(F.size(items) / CHUNK).cast("int"), F.lit(1)) - 1), lambda c: F.slice(items, c * CHUNK + 1, CHUNK)
    )

    def more(state, chunk):
        inner = F.aggregate(chunk, F.struct(state["at"].alias("at"), empty.alias("out")), step)
        joined = F.transform(F.array(inner), lambda i: F.struct(i["at"].alias("at"), F.concat(state["out"], i["out"]).alias("out")))
        return F.element_at(joined, 1)

    return F.aggregate(chunks, F.struct(F.lit(0).alias("at"), empty.alias("out")), more)


def _spans(rule: Rule, order: int, text: Column, wanted: Column) -> Column:
    """Spans of one rule in code points: what lies between matches gives their places."""
    none = F.array().cast("array<string>")
    whole = F.when(wanted, F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))).otherwise(none)
    value = F.when(wanted, F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))).otherwise(none)
    between = F.when(F.size(whole) > 0, F.split(text, rule.pattern, -1)).otherwise(none)
    steps = F.zip_with(
        F.arrays_zip(whole.alias("whole"), value.alias("value")),
        F.slice(between, 1, F.size(whole)),
        lambda m, gap: F.struct(
            F.char_length(gap).alias("gap"), F.char_length(m["whole"]).alias("long"), F.char_length(m["value"]).alias("value")
        ),
    )
    empty = F.array().cast("array<struct<start:int,kind_order:int,end:int,kind:string,value:int>>")

    def step(state, m):
        at = state["at"] + m["gap"]
        span = F.struct(
            at.alias("start"), F.lit(order).alias("kind_order"), (at + m["long"]).alias("end"),
            F.lit(rule.kind).alias("kind"), m["value"].alias("value"),
        )
        return F.struct((at + m["long"]).alias("at"), F.concat(state["out"], F.array(span)).alias("out"))

    return F.filter(_folded(steps, empty, step)["out"], lambda s: s["value"] >= rule.least)


def _told(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` with ``rules``: those that may match, as told by ``candidates``.  What
    passes a filter of the candidates' keys is told all rules, for each is verified."""
    n = found.count()
    if scratch.rows_that_may_be_broadcast() < n and lookup.holds(n):
        flagged = lookup.flagged(rows, "key", found.select("key"), n, "maybe")
        return flagged.withColumn("rules", F.when(F.col("maybe"), -1).otherwise(0)).drop("maybe")
    return rows.join(scratch.small_side(found, n), "key", "left").withColumn("rules", F.coalesce("rules", F.lit(0)))


def scan_secrets(
    docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()
) -> DataFrame:
    """``doc_id, text, carried, secrets``: every row with its spans, ordered by start,
    then rule.  A span is ``start, kind_order, end, kind, value`` (code points, end
    exclusive; ``value`` is the measured length).  ``carried`` is a struct of the
    columns in ``carry``, so that their names clash with none here; others are
    ignored.  Null text is empty and has no span; repeated rows and null ids stay."""
    carried = F.struct(*carry) if carry else F.lit(None).cast("boolean")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), carried.alias("carried"))
    rows = rows.withColumn("key", F.xxhash64("doc_id"))
    met = _told(rows, scratch.table(candidates(rows, rules), "candidates"))
    spans = [
        _spans(r, i, F.col("text"), F.lit(True) if boolean_query(r.pattern) is True else F.col("rules").bitwiseAND(1 << i) != 0)
        for i, r in enumerate(rules)
    ]
    return met.select("doc_id", "text", "carried", F.sort_array(F.concat(*spans)).alias("secrets"))


def redact(found: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``doc_id, text, carried``: the texts of ``scan_secrets`` with every span replaced
    by ``mark``; spans that overlap or touch become one mark."""
    def step(state, s):
        covered = (s["start"] <= state["at"]) & (state["at"] > 0)
        kept = F.substring(F.col("text"), state["at"] + 1, s["start"] - state["at"])
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"),
            F.when(covered, state["out"]).otherwise(F.concat(state["out"], kept, F.lit(mark))).alias("out"),
        )

    folded = F.transform(F.array(_folded(F.col("secrets"), F.lit(""), step)), lambda s: F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, F.char_length("text"))))
    clean = F.element_at(folded, 1)
    return found.select("doc_id", F.when(F.size("secrets") == 0, F.col("text")).otherwise(clean).alias("text"), "carried")


def secret_report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` of every row."""

    def listed(spans: Column) -> Column:
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
        )

    found = scan_secrets(docs).select("doc_id", "secrets")
    base = F.filter("secrets", lambda s: s["kind_order"] < len(BASE_RULES))
    def counted(i: int, rule: Rule) -> Column:
        return F.size(F.filter("secrets", lambda s: s["kind_order"] == i)).cast("long").alias(f"n_{rule.kind}")

    counts = [counted(i, r) for i, r in enumerate(BASE_RULES)]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"))


def _sql() -> str:
    kinds = " UNION ALL ".join(
        f"SELECT doc_id, {i} AS kind_order, '{r.kind}' AS kind, regexp_extract_all(t, p, 0) AS m, "
        f"regexp_extract_all(t, p, {r.group}) AS v, string_split_regex(t, p) AS s, {r.least} AS least "
        f"FROM (SELECT doc_id, t, '{r.pattern.replace(chr(39), chr(39) * 2)}' AS p FROM d)"
        for i, r in enumerate(RULES)
    )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
k AS ({kinds}),
e AS (
  SELECT doc_id, kind_order, kind, v[i] AS value, least, length(m[i]) AS long,
         (list_sum(list_transform(s[1:i], lambda x: length(x)))
          + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS start
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM k)
),
f AS (SELECT *, concat(kind, ':', start, ':', start + long) AS span FROM e WHERE length(value) >= least),
g AS (
  SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
         count(*) FILTER (WHERE kind = 'hex') AS n_hex,
         string_agg(span, ',' ORDER BY start, kind_order) FILTER (WHERE kind_order < {len(BASE_RULES)}) AS base,
         string_agg(span, ',' ORDER BY start, kind_order) AS spans
  FROM f GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""


SQL = _sql()
