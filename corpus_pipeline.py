"""Corpus pipeline over `documents`: quality classifier, line dedup, n-gram Jaccard join, best-fit packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of `documents`.  `run` writes each stage's result as Parquet in the cluster's shared folder, reads it again
and removes it once the next stage's is written.

Defined cases: a null or empty text passes the first three stages and is packed as its end id alone; equal rows (same id
and text) stay or go together; a row without an id has no copies; an empty table gives an empty table of
the last stage's columns; columns beside those of `documents` pass through the first three stages, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.llm.common import let_go, stored
from millrace.llm.line_dedup import dedup_lines
from millrace.llm.ngram_join import jaccard_components
from millrace.llm.packing import pack
from millrace.llm.quality import selected_documents
from millrace.llm.queries import good_labels


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that importance resampling draws."""
    return selected_documents(docs, good_labels(spark, sf_dir))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out; a document all of whose lines stand elsewhere goes."""
    out = dedup_lines(docs).filter("n_lines > n_dropped_lines OR n_lines = 0")
    return out.withColumn("n_chars", F.when(F.col("n_dropped_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies (Jaccard similarity of 0.8 or more over 5-word shingles) the document of least id."""
    copies = jaccard_components(docs, n=5, threshold=(80, 100)).filter("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of at most 2048 ids."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality classifier", quality), ("line dedup", line_dedup), ("n-gram Jaccard join", ngram_join), ("best-fit packing", packing)]

#: Importance resampling, SimHash groups, tokenising and packing can't be put in SQL: tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        let_go(spark, before)
    return docs
