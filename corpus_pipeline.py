"""A training-corpus pipeline of five llm operators: each stage's result is written as Parquet and read by the next.

Every function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
Nulls, empty texts, repeated rows and empty tables have the results that the operators state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotwise.llm import decontaminate, mixing, ngram_join, quality, tokens
from lotwise.llm.common import load, stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the attention classifier scores 0.5 or more."""
    model = quality.train(docs, load(spark, sf_dir, "labels"))
    return quality.score(docs, model, *COLUMNS).where("score >= 0.5").select(*COLUMNS)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of every group of near copies (five words, similarity 0.8); rows repeating an id stay once.

    Rows without doc_id can't be linked and stay.
    """
    groups = ngram_join.ngram_join(docs, k=5, percent=80)
    first = groups.where("doc_id = component_id").select("doc_id").distinct()
    once = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))
    kept = docs.join(first, "doc_id", "left_semi").withColumn("__n", once).where("__n = 1").select(*COLUMNS)
    return kept.unionByName(docs.where("doc_id IS NULL").select(*COLUMNS))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, load(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source weights 5, 2, 1: a row for every reading of a document, at most three.

    The order of shards and places isn't kept, as token files are in the order of doc_id.
    """
    return mixing.mixed_documents(docs).select(*COLUMNS)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left, described from what is read back."""
    return tokens.token_index(docs, tokens.default_tokenizer())


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_each_group),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("token_ids", write_token_ids),
]

#: SQL expresses neither the classifier nor the tokenizer; tests/llm checks the operators on their own and the stages' counts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
