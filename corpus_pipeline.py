"""A corpus pipeline of five stages: rules, classifier, line dedup, near-duplicate removal, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before kept. All but the last return the columns of
``documents``. What a stage learns from labels or the trusted set it learns from the tables in ``sf_dir``; corpus statistics
come from the documents it is given.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import remove, shared_folder, table
from lattica.llm.compression_classifier import classify, fit_tables
from lattica.llm.line_dedup import line_dedup
from lattica.llm.ngram_jaccard import jaccard_components
from lattica.llm.packing import packed
from lattica.llm.quality_rules import quality_rules, trusted_rows

#: Near duplicates share four fifths of their five-word shingles.
SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80


def _with_own_columns(docs: DataFrame, operator: Callable[[DataFrame], DataFrame], keep: str) -> DataFrame:
    """The rows of ``operator(docs)`` where ``keep`` holds; other columns of ``docs`` come through even if they are named like one that the operator adds."""
    aside = {c: f"__own_{k}" for k, c in enumerate(docs.columns) if c not in ("doc_id", "text", "source")}
    found = operator(docs.withColumnsRenamed(aside)).where(keep)
    return found.select(*(F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep: null and empty texts, and all with fewer than ten words, go. Repeated rows are judged alike."""
    return _with_own_columns(docs, lambda x: quality_rules(x, trusted_rows(table(spark, sf_dir, "labels"))), "kept")


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good; a null text is judged as an empty one, repeated rows alike.

    It is fitted on labelled rows of the raw table: this stage's own input has hardly any bad ones left.
    """
    model = fit_tables(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return _with_own_columns(docs, lambda x: classify(x, model), "predicted = 1")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without boilerplate lines, with the ``n_chars`` of changed ones counted anew. One that had nothing else goes: each of its lines stays in another document. Null and empty texts stay."""
    counted = lambda x: x.withColumn(chars, F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col(chars)).cast(x.schema[chars].dataType))
    chars = f"__own_{docs.columns.index('n_chars')}"
    return _with_own_columns(docs, lambda x: counted(line_dedup(x)), "n_removed = 0 OR text IS NULL OR trim(translate(text, '\\n\\r\\t', '   ')) <> ''")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id; documents without words or id stay, rows with equal id and text become one."""
    found = jaccard_components(docs, SHINGLE_WORDS, SIMILARITY_PERCENT)
    gone = found.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").dropDuplicates(["doc_id", "text"]).select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences, with their token ids: what a trainer reads. A null text is its end token alone."""
    return packed(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("quality_classifier", classifier_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard", near_duplicate_stage),
    ("packing", packing_stage),
]

#: Rules, classifier and packing are beyond SQL; tests/llm has the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each written as Parquet in the shared folder and read again; a stage's input goes once the stage is written."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
        if k:
            remove(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
