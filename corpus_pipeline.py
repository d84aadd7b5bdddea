"""From raw documents to token files: the stages of the training-data pipeline.

Rows are told apart by doc_id and the hash of their text, so a null or repeated
doc_id neither loses nor multiplies rows. Extra columns of documents pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagelake.inputs import table
from pagelake.llm import decontaminate, mixing, near_dedup, quality, token_files
from pagelake.llm.words import WORD
from pagelake.session import cut_lineage


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """The rows whose (doc_id, h) is not rejected, in their own columns."""
    out = rejected.select(F.col("doc_id").alias("_mix_id"), F.col("h").alias("_mix_h")).distinct().hint("shuffle_hash")
    same = docs["doc_id"].eqNullSafe(out["_mix_id"]) & (F.xxhash64(docs["text"]) == out["_mix_h"])
    return docs.join(out, same, "left_anti")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the plain rules or stray from their language go."""
    return _without(docs, quality.judge(docs).where("NOT kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8) stays."""
    return _without(docs, near_dedup.near_duplicates(docs).where("NOT kept"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage that aligns with a test item go."""
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(found.hint("shuffle_hash"), "doc_id", "left_anti")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    A document that the last pass over its source takes in part comes once more, cut
    after the words taken. Rows that agree in id and text share their words evenly; a
    remainder smaller than their number is left out.
    """
    taken = mixing.mix(docs).groupBy("doc_id", "source", "h", "size").agg(F.sum("taken").alias("sum"), F.count(F.lit(1)).alias("rows"))
    plan = taken.where("sum > 0").select(
        F.col("doc_id").alias("_mix_id"), F.col("source").alias("_mix_source"), F.col("h").alias("_mix_h"), F.col("size").alias("_mix_size"),
        F.expr("sum div rows").alias("_mix_taken"),
    ).hint("shuffle_hash")
    same = docs["doc_id"].eqNullSafe(plan["_mix_id"]) & docs["source"].eqNullSafe(plan["_mix_source"]) & (
        mixing.row_hash(docs["doc_id"], docs["text"]) == plan["_mix_h"])
    part = F.expr("_mix_taken % _mix_size")
    passes = F.sequence(F.lit(0), F.expr("_mix_taken div _mix_size") - F.when(part > 0, 0).otherwise(1))
    rows = docs.join(plan, same).where("_mix_taken > 0").withColumn("_mix_pass", F.explode(passes))
    pieces = F.regexp_extract_all("text", F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    cut = F.array_join(F.slice(pieces, F.lit(1), part.cast("int")), "")
    whole = F.col("_mix_pass") < F.expr("_mix_taken div _mix_size")
    rows = rows.withColumn("text", F.when(whole, F.col("text")).otherwise(cut))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files below the shared folder; returns what reading them back gives per document."""
    return token_files.token_files(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mix", source_mix),
    ("token_output", token_output),
]

#: Hashing, alignment and tokenising have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return docs
