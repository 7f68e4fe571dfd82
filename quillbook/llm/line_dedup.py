"""Line deduplication by a deletion-neighbourhood join, in DataFrame functions only.

Lines within one edit (a code point inserted, deleted or replaced) of an earlier
line go, as do exact repeats; the earliest stays.

1. Lines are named by their row and number, and equal lines become one class (by
   SHA-256; partial aggregation, so a line that is everywhere is counted map-side),
   known by the place of its first occurrence.
2. Two lines within one edit share, cut in the middle of the shorter, a first or a
   last half.  Lines that share neither with any line have no neighbour and go no
   further; this loses nothing.
3. The others emit every variant with one code point deleted, and themselves, as
   hashed keys.  Lines that delete the same place of one variant differ by a
   replacement; a line that equals a variant lacks one code point.  So equal keys
   need no pairs: the earliest member per key (and place) is each line's witness.
   Lines are hashed by chunks of ``CHUNK``, which keeps variants of a long line
   from costing its whole length each.
4. Edit distance to the witness is verified on the lines themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import lookup, scratch

#: Code points of a chunk of which variants are hashed.
CHUNK = 256


def _place() -> Column:
    """Document (null ids last), row, line: what orders occurrences."""
    return F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("uid"), F.col("line_no"))


def _halves(line: Column, n: Column) -> list[Column]:
    """Keys of the halves: as the shorter (or an equally long) line, and as the longer."""
    out = []
    for target, skip in ((n, 0), (n - 1, 1)):
        cut = F.floor(target / 2).cast("int")
        out.append(F.xxhash64(target, F.lit(0), F.substring(line, F.lit(1), cut)))
        out.append(F.xxhash64(target, F.lit(1), F.substring(line, cut + 1 + skip, n)))
    return out


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``uid, doc_id, text``: rows named by their place in the input, which the same
    scan always gives."""
    return docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def _lines(rows: DataFrame, *keep: str) -> DataFrame:
    """``keep``, ``line_no`` (from 0) and ``line`` of every line that has a word."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return rows.select(*keep, F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line")).where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))


def _key(line: Column) -> Column:
    return F.unhex(F.sha2(line, 256))


def _variants(lines: DataFrame) -> DataFrame:
    """``key, first, variant, at``: a row per deletion (``at``: the code point's
    place) and, with ``at`` -1, per chunk of the line itself."""
    n = F.char_length("line")
    parts = []
    for longer in (1, 0):  # with one code point deleted; whole
        target = n - longer
        chunks = F.greatest(F.ceil(target / CHUNK).cast("int"), F.lit(1))
        cut = lines.withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1)))
        begin = F.col("chunk") * CHUNK
        cut = cut.select(
            "key", "first", "chunk", target.alias("target"),
            F.substring("line", begin + 1, F.lit(CHUNK + longer)).alias("piece"),
            F.xxhash64(F.substring("line", F.lit(1), begin)).alias("before"),
            F.xxhash64(F.substring("line", begin + CHUNK + longer + 1, n)).alias("after"),
            (F.col("chunk") == chunks - 1).alias("last"),
        )
        if longer:
            size = F.char_length("piece")
            places = F.sequence(F.lit(0), F.when(F.col("last"), size - 1).otherwise(F.lit(CHUNK - 1)))
            cut = cut.withColumn("at", F.explode(places))
            piece = F.concat(F.substring("piece", F.lit(1), F.col("at")), F.substring("piece", F.col("at") + 2, size))
            at = (begin + F.col("at")).cast("int")
        else:
            piece, at = F.col("piece"), F.lit(-1)
        parts.append(cut.select("key", "first", F.xxhash64("target", "chunk", "before", "after", piece).alias("variant"), at.alias("at")))
    return parts[0].unionByName(parts[1])


def _near(lines: DataFrame, classes: DataFrame) -> DataFrame:
    """``key`` of the classes within one edit of an earlier class."""
    halves = classes.select("key", F.explode(F.array("h0", "h1", "h2", "h3")).alias("half"))
    halves = halves.withColumn("code", F.xxhash64("key"))
    shared = halves.groupBy("half").agg(F.min("code").alias("low"), F.max("code").alias("high")).where("low <> high").select("half")
    kept = halves.join(shared, "half").select("key").distinct()
    some = scratch.table(classes.join(kept, "key").select("key", "first", "place"), "alike")

    # the lines themselves, only those at the place of their class's first occurrence
    firsts = lines.withColumn("place", F.xxhash64("uid", "line_no"))
    found = lookup.matched(firsts, "place", some.select("place", "key", "first"))
    found = found.where(_key(F.col("line")) == F.col("key")).select("key", "first", "line").dropDuplicates(["key"])
    found = scratch.table(found, "lines")

    # at most (points + 1) * alphabet distinct lines share a variant, however many documents there are
    member = F.struct("first", "key")
    by_variant, by_place = Window.partitionBy("variant"), Window.partitionBy("variant", "at")
    whole = F.min(F.when(F.col("at") < 0, member)).over(by_variant)
    less = F.min(F.when(F.col("at") >= 0, member)).over(by_variant)
    witness = F.when(F.col("at") < 0, less).otherwise(F.least(F.min(member).over(by_place), whole))
    met = _variants(found).withColumn("witness", witness).where(F.col("witness.first") < F.col("first"))
    pairs = met.select("key", F.col("witness.key").alias("witness")).distinct()
    lines = found.select("key", "line")
    earlier = found.select(F.col("key").alias("witness"), F.col("line").alias("earlier"))
    checked = pairs.join(lines, "key").join(earlier, "witness").where(F.levenshtein("line", "earlier", 1) >= 0)
    return scratch.table(checked.select("key").distinct(), "near")


def _judged(rows: DataFrame) -> DataFrame:
    """``uid, doc_id, line_no, reason`` for every line of ``_rows`` that goes."""
    n = F.char_length("line")
    found = _lines(rows, "uid", "doc_id").select(
        "uid", "doc_id", "line_no", _key(F.col("line")).alias("key"),
        *[h.alias(f"h{i}") for i, h in enumerate(_halves(F.col("line"), n))],
    )
    found = scratch.table(found, "occurrences")
    classes = found.groupBy("key").agg(F.min(_place()).alias("first"), *[F.max(f"h{i}").alias(f"h{i}") for i in range(4)])
    classes = classes.withColumn("place", F.xxhash64("first.uid", "first.line_no"))
    classes = scratch.table(classes, "line_classes")
    near = _near(_lines(rows, "uid"), classes).withColumn("near", F.lit(True))
    marked = classes.select("key", "first").join(scratch.small_side(near), "key", "left")
    met = found.select("uid", "doc_id", "line_no", "key", _place().alias("place")).join(marked, "key")
    reason = F.when(F.col("place") > F.col("first"), "exact").when(F.col("near"), "near")
    return met.select("uid", "doc_id", "line_no", reason.alias("reason")).where("reason IS NOT NULL")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, line_no, reason`` for every line that goes: ``exact`` if an equal
    line stands earlier, else ``near`` if an earlier line is within one edit.

    Earlier: in a document with a smaller id (integers; null ids last), in an earlier
    row of the same id, or above in the same row.  Lines are parts between line feeds;
    those without a word stay; all others, short ones too, are compared.  Rows that
    repeat an id, and rows with a null id, are documents of their own.  Null and empty
    texts have no lines; other columns are ignored; an empty table gives an empty result.
    """
    return _judged(_rows(docs, id_col, text_col)).drop("uid")


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text`` of every row without the lines that go; a text that loses none
    stays as it is (null too)."""
    rows = _rows(docs, id_col, text_col)
    gone = _judged(rows).groupBy("uid").agg(F.collect_set("line_no").alias("gone"))
    met = rows.join(scratch.small_side(scratch.table(gone, "gone")), "uid", "left")
    lines = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("gone", i))
    return met.select("doc_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(lines, "\n")).alias("text"))


def line_report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_exact, n_near, dropped`` of every row: its lines with a word,
    how many of them go for which reason, and their numbers joined by commas.  Rows
    that repeat an id, and rows with a null id, each have their own lines."""
    rows = _rows(docs, "doc_id", "text")
    gone = _judged(rows).groupBy("uid").agg(
        F.count_if(F.col("reason") == "exact").alias("n_exact"), F.count_if(F.col("reason") == "near").alias("n_near"),
        F.array_join(F.sort_array(F.collect_set("line_no")).cast("array<string>"), ",").alias("dropped"),
    )
    lines = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    counted = rows.select("uid", "doc_id", lines.cast("long").alias("n_lines"))
    return counted.join(gone, "uid", "left").select(
        "doc_id", "n_lines", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_exact", "n_near")], F.coalesce("dropped", F.lit("")).alias("dropped")
    )
