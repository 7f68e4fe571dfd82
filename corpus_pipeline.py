"""From raw documents to packed sequences, stage by stage.

Every stage but the last returns the columns of ``documents``; each works on all
that its predecessor kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillbook.llm import exact_dedup, language_id, ngram_join, packing, scratch, secret_scan

#: Score below which a predicted language counts as rejected.
LEAST_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a letter (null and empty ones too), and those whose
    language is predicted with a score below ``LEAST_SCORE``.  If no language could
    be learned, texts with letters stay."""
    model = language_id.train(docs)
    if not model.families:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = docs.select(F.struct(*docs.columns).alias("doc"), language_id.predict(docs, model).alias("found"))
    return found.where((F.col("found.lang_pred") != "und") & (F.col("found.score") >= LEAST_SCORE)).select("doc.*")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of equal texts.  Rows are named by id and digest, nulls included;
    of rows repeated with the keeper's id and text one stays."""
    judged = exact_dedup.exact_dedup(docs)
    named = judged.groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    named = scratch.table(named.where(~F.col("kept") | (F.col("n") > 1)), "exact")
    rows = docs.select(F.struct(*docs.columns).alias("doc"), exact_dedup.digest_of(F.col("text")).alias("text_sha256"))

    def same(side: DataFrame):
        return rows["doc.doc_id"].eqNullSafe(side["doc_id"]) & (rows["text_sha256"] == side["text_sha256"])

    gone, twice = named.where(~F.col("kept")), named.where("kept")
    kept = rows.join(scratch.small_side(gone), same(gone), "left_anti")
    if not twice.isEmpty():
        once = rows.join(scratch.small_side(twice), same(twice), "left_semi")
        once = once.withColumn("id", F.col("doc.doc_id")).dropDuplicates(["id", "text_sha256"]).drop("id")
        named_ids = named.select("doc_id", "text_sha256")
        kept = rows.join(scratch.small_side(named_ids), same(named_ids), "left_anti").unionByName(once)
    return kept.select("doc.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of each group of linked documents (five-word shingles,
    similarity of 0.8 or more).  Rows with a null id are in no group and stay."""
    judged = ngram_join.jaccard_components(docs)
    heads = judged.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("head"))
    gone = scratch.table(heads.where(~F.col("head")).select("doc_id"), "near_copies")
    return docs.join(scratch.small_side(gone), docs["doc_id"] == gone["doc_id"], "left_anti")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret in the texts by a mark, and count ``n_chars`` anew."""
    found = secret_scan.scan_secrets(docs, carry=docs.columns)
    masked = secret_scan.redact(found)
    same_text = F.col("carried.text").isNull() & (F.col("text") == "")
    columns = {c: F.col(f"carried.`{c}`") for c in docs.columns}
    columns["text"] = F.when(~same_text, F.col("text"))
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("text") == F.col("carried.text"), F.col("carried.n_chars")).otherwise(
            F.char_length("text").cast(docs.schema["n_chars"].dataType)
        )
    return masked.select(*[c.alias(name) for name, c in columns.items()])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document, with its place in a sequence."""
    return packing.pack_report(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("secret_scan", mask_secrets),
    ("packing", pack_sequences),
]

#: SQL cannot express the trained and solved stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again,
    and what it was made from is deleted then."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
        if before is not None:
            scratch.forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
