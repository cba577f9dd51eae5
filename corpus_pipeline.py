"""A training-data pipeline over ``documents``: toxicity, near duplicates, benchmark passages, secrets, packing.

Each stage reads all that the stage before it kept, from Parquet in the shared folder; all but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.llm import decontaminate, jaccard, packing, secret_scan, toxicity
from rollcall.llm.common import stored
from rollcall.llm.queries import tokenizer_path
from rollcall.sources.tables import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold of a model trained on labels that are not held out."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), usable=~toxicity.held_out())
    return toxicity.remove_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, the one with the smallest id, of each group of rows linked by a similarity of 0.75 or more.

    Repeated and null ids: rows are told apart by numbers, null ids come last, and of equal ids one row stays.
    Rows without words are linked with nothing and all stay.
    """
    columns = docs.columns
    if docs.groupBy("doc_id").count().where("doc_id IS NULL OR count > 1").isEmpty():
        groups = jaccard.jaccard_components(docs.select("doc_id", "text"))
        return docs.join(groups.where("component_id <> doc_id").select("doc_id"), "doc_id", "left_anti").select(*columns)
    docs = stored(docs.withColumn("_row", F.monotonically_increasing_id()))
    groups = jaccard.jaccard_components(docs.select("_row", "text"), id_col="_row").withColumnRenamed("doc_id", "_row")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")
    kept = docs.select("_row", "doc_id").join(groups, "_row").groupBy("component_id").agg(F.min(order)["_row"].alias("_row"))
    return docs.join(kept.select("_row"), "_row", "left_semi").select(*columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with marks in place of secrets; n_chars follows the changed texts."""
    return secret_scan.redact(docs, "text", "n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 ids."""
    return packing.harmonic_pack(docs, tokenizer_path("word_bpe_49k.json"), end_id=1)


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard", drop_near_duplicates), ("decontamination", drop_benchmark),
          ("secret_scan", redact_secrets), ("packing", pack)]
ORACLE_SQL = None           # tokenizers and a trained model have no SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
