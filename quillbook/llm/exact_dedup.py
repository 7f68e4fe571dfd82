"""Exact deduplication with a heavy-hitter split.

1. Every row becomes a narrow ``(id, digest, length)`` row; texts are not moved.
2. A Misra-Gries summary of ``k`` counters per partition, merged by digest,
   finds every digest that holds more than ``2 N / k`` of ``N`` rows.
3. Those candidates are counted exactly (partial aggregation leaves at most
   ``k`` rows a task).  Verified winners are those that more than ``N / k`` rows, and
   more than one, have; they are fewer than ``k`` and are broadcast: rows of frequent
   digests are resolved map-side, without a shuffle.
4. The remaining digests, each of at most ``2 N / k`` rows, are shuffled: aggregated
   (combined map-side) to one row a digest, which the rows then meet; no task holds
   the rows of a digest.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch
from .memory import tidy

#: Misra-Gries counters per partition, and the most digests that are broadcast.
COUNTERS = 4096
_SPACE = r"[\x20\x09-\x0D]+"


def _misra_gries(k: int):
    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = pd.Series(dtype="int64")
        for batch in batches:
            counts = counts.add(batch["text_sha256"].value_counts(), fill_value=0).astype("int64")
            if len(counts) > k:
                cut = counts.nlargest(k + 1).iloc[-1]
                counts = counts[counts > cut] - cut
        yield pd.DataFrame({"text_sha256": counts.index.astype(object), "seen": counts.to_numpy("int64")})

    return summarise


def digest_of(text: Column) -> Column:
    """SHA-256 of the text without ASCII white space (null counts as empty)."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), _SPACE, ""), 256)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_sha256, n_points``: the digest of the text without white
    space, and the code points of the text as it is.  Null text is empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        digest_of(F.col(text_col)).alias("text_sha256"),
        F.char_length(text).cast("long").alias("n_points"),
    )


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS
) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after deleting ASCII white space (null counts
    as empty).  Of equal texts the row with the most code points, then the
    smallest id stays; null ids come last.  Of rows repeated with one id exactly
    one stays.  An empty table gives an empty result; other columns are ignored.
    """
    rows = digests(docs, id_col, text_col).withColumn("uid", F.monotonically_increasing_id())
    rows = scratch.table(rows, "digests")
    rank = F.struct(-F.col("n_points"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("uid"))
    out = ["doc_id", "keep_id", "group_size", F.col("uid").eqNullSafe(F.col("keep_uid")).alias("kept"), "text_sha256"]

    summary = rows.select("text_sha256").mapInPandas(tidy(_misra_gries(counters)), "text_sha256 string, seen long")
    frequent = (
        summary.groupBy("text_sha256").agg(F.sum("seen").alias("seen")).orderBy(F.desc("seen"), "text_sha256").limit(counters)
    )
    best = [F.count("*").alias("group_size"), F.min_by(F.struct("doc_id", "uid"), rank).alias("keep")]
    named = ["text_sha256", "group_size", F.col("keep.doc_id").alias("keep_id"), F.col("keep.uid").alias("keep_uid")]
    bound = max(rows.count() // counters, 1)
    counted = rows.join(F.broadcast(frequent.select("text_sha256")), "text_sha256").groupBy("text_sha256").agg(*best)
    winners = scratch.table(counted.where(F.col("group_size") > bound).select(*named), "winners")  # fewer than ``counters`` rows

    split = rows.join(F.broadcast(winners), "text_sha256", "left")
    heavy = split.where(F.col("keep_uid").isNotNull()).select(*out)
    others = rows.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti")
    groups = others.groupBy("text_sha256").agg(*best).select(*named)
    rare = others.join(groups, "text_sha256").select(*out)
    return heavy.unionByName(rare)


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id)
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
