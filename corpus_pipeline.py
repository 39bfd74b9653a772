"""A corpus pipeline over the training-data operators.

Stages: language ID, line dedup, SimHash near-dedup, benchmark decontamination, mixing. Each takes (spark, docs,
sf_dir), where docs has the columns of ``documents``, and returns those columns again; the last adds what the mix
takes. Every stage's result is written as Parquet before the next one reads it. Columns of any other name are carried
along; an empty table gives an empty result; a null doc_id counts as larger than any other.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolith.llm import language_id
from repolith.llm.common import broadcast_if_small, fresh, once, quoted, shared_folder, table
from repolith.llm.decontamination import decontaminated
from repolith.llm.line_dedup import dedup_lines
from repolith.llm.mixing import taken_copies
from repolith.llm.simhash import near_copies

#: SQL can express neither the fitted language model nor MinHash and SimHash groups; tests compare with brute force.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows; null text and text without letters or in no known language goes.

    Where no document has a language the model knows none, and all go.
    """
    model = language_id.fit(language_id.training_rows(docs, language_id.held_out()))
    return language_id.accepted(docs, model)


def dedup_document_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; rows that repeat doc_id and text keep the same lines. n_chars follows the text; a document that loses all its words goes."""
    out = dedup_lines(docs).where((F.col("_n_removed") == 0) | F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    n_chars = F.when(F.col("_n_removed") > 0, F.char_length("text")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n_chars.cast("long")).select(*quoted(docs.columns))


def dedup_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies by SimHash, that of the smallest doc_id (null last), once.

    Rows of one doc_id but different texts are different documents.
    """
    id_, proof = fresh(docs.columns, "_id", "_proof")
    found = near_copies(docs)
    gone = found.where((F.col("id") != F.col("keep_id")) | (F.col("proof") != F.col("keep_proof")))
    gone = gone.select(F.col("id").alias(id_), F.col("proof").alias(proof))
    rows = once(docs, id_, proof).join(broadcast_if_small(gone), [id_, proof], "left_anti")
    return rows.select(*quoted(docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no item of the benchmark. Rows are judged one by one; null texts stay."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with size, source_size, target, copies and taken.

    Of these five, names that the documents have already get underscores in front.
    """
    return taken_copies(docs)


STAGES = [
    ("language", identify_language),
    ("lines", dedup_document_lines),
    ("near copies", dedup_near_copies),
    ("benchmark", decontaminate),
    ("mix", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each written to the shared folder and read again."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid4().hex}"
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{name.replace(' ', '-')}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
