"""A corpus from raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs.
All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import decontamination, near_dedup, packing, quality, suffix_dedup
from tallyforge.llm.shared import held_out, read, staged


def unused(docs: DataFrame, name: str) -> str:
    """name, lengthened until no column of docs has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier takes (score >= 0.5); it learns from the labels that op6 learns from."""
    model = quality.train(docs, read(spark, sf_dir, "labels").where(~held_out("doc_id", 3, 1)))
    return quality.scored(docs, model).where("score >= 0.5").select("rest.*")


def near_dedup_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that op4 keeps, one of each group of near duplicates by the least doc_id; of rows equal in doc_id and text one.

    Documents without doc_id, and several texts of one doc_id, each go by their own text.
    """
    key = unused(docs, "_key")
    kept = near_dedup.near_duplicates(docs, keyed=True).where("kept").select(F.col("row_key").alias(key)).distinct()
    found = docs.withColumn(key, near_dedup.row_key()).join(kept, key, "left_semi")
    return found.dropDuplicates([key]).select(*docs.columns)


def suffix_dedup_cut(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that also start elsewhere; n_chars is that of what is left."""
    out = suffix_dedup.remove_repeats(docs, with_text=True).withColumn("text", F.col("kept_text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs; each goes by its own text, whatever its doc_id."""
    key = unused(docs, "_hit")
    by_text = docs.select(F.xxhash64("text").alias("doc_id"), "text")
    hit = decontamination.contamination(by_text, read(spark, sf_dir, "benchmark")).where("contaminated").select(F.col("doc_id").alias(key)).distinct()
    return docs.withColumn(key, F.xxhash64("text")).join(hit, key, "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents with their sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_filter),
    ("near-duplicate removal", near_dedup_filter),
    ("suffix-array dedup", suffix_dedup_cut),
    ("benchmark decontamination", decontaminate),
    ("best-fit packing", pack),
]

#: SQL can't express a trained classifier, similarity components or suffix arrays: the tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
