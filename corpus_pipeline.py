"""Corpus cleaning pipeline: quality, toxicity, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept, rows with null ids, repeated ids and repeated
rows included; a stage judges a row by its text, so null and empty texts are scored as empty ones. The caller's row travels
as one struct, so columns of any name (also names that an operator uses itself) come back as they were. An empty table
gives an empty result of the same columns.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.llm import bytecnn, ordinal, packing, secrets, simhash_ball
from auditloom.llm.common import written


def rows_of(docs):
    """One struct column `_doc` that holds the caller's row."""
    return docs.select(F.struct("*").alias("_doc"))


def quality(spark, docs, sf_dir):
    """Documents that the byte-level network rejects go (score below its threshold); the score of a text decides, so copies stay or go together."""
    model = bytecnn.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality")
    return bytecnn.with_score(rows_of(docs), model, "_doc.text").where(F.col("score") >= bytecnn.THRESHOLD).select("_doc.*")


def toxicity(spark, docs, sf_dir):
    """Documents that the ordinal regression calls toxic go; without toxic labels to learn from none does."""
    model = ordinal.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return ordinal.with_severity(rows_of(docs), model, "_doc.text").where(~F.col("toxic")).select("_doc.*")


def near_duplicates(spark, docs, sf_dir):
    """One row of each SimHash group stays: that of the smallest id, a null id last; among rows that share it, the first written.

    Rows are told apart by a number of their own, so of repeated rows, ids and null ids exactly one row of a group stays.
    Texts are shuffled once, to meet the list of rows that stay, which grows with the input."""
    rows = simhash_ball.with_fingerprint(rows_of(docs), "_doc.text", "fp").withColumn("_row", F.monotonically_increasing_id())
    rows = written(rows, "fingerprints")
    groups = simhash_ball.fingerprint_groups(rows.select(F.col("_row").alias("id"), "fp")).select(F.col("id").alias("_row"), "component_id")
    ids = rows.select("_row", F.col("_doc.doc_id").alias("doc_id")).join(groups, "_row")
    first = ids.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("m")).select("m._row")
    return rows.join(first, "_row", "left_semi").select("_doc.*")


def secret_scan(spark, docs, sf_dir):
    """Reported secrets are masked in the text, and n_chars, where there is one, follows; every row stays."""
    clean = secrets.redacted(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def pack(spark, docs, sf_dir):
    """Pieces of the remaining documents in sequences of several context lengths; a null or empty text is the one id 0."""
    import public_tokenizers

    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("secrets", secret_scan), ("packing", pack)]

#: SQL can express neither the network nor the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs, name)
    return docs
