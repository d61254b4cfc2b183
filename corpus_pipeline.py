"""From raw documents to packed training sequences: toxicity, quality, near duplicates, packing.

Every stage works on all rows that the one before kept, is written as Parquet and read again. A stage writes what Python
makes itself: the size of the batches that Python gets is read when rows are made, so a frame handed out lazily would get
Spark's 10,000 whole texts at a time. What it wrote on its way is deleted then. All but the last return the columns of ``documents``. Nulls, empty texts, repeated rows and extra columns are
treated as the stages' operators say; rows without doc_id stay unless they repeat another document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegrid.llm import op4_packing, op7_jaccard, op8_toxicity, op9_quality
from tidegrid.llm.common import table
from tidegrid.session import cut, last_cut, small_batches


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chance of a toxic token is below a half."""
    with small_batches(spark), last_cut(spark):
        return cut(op8_toxicity.keep_clean(docs, op8_toxicity.learn(docs, table(spark, sf_dir, "labels"))))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the perplexity limits of their language."""
    with small_batches(spark), last_cut(spark):
        return cut(op9_quality.keep_good(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near duplicates."""
    with small_batches(spark), last_cut(spark):
        return cut(op7_jaccard.keep_one(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens."""
    with small_batches(spark), last_cut(spark):
        return cut(op4_packing.pack(docs))


STAGES = [("toxicity", toxicity), ("quality", quality), ("near_duplicates", near_duplicates), ("packing", packing)]

# A fitted random field and a tokenizer aren't SQL; tests/llm compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
