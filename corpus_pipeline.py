"""The training-data pipeline: quality rules, toxicity, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a table; each but the last returns the columns of docs.
`run` writes every stage's table to the shared folder and reads it again, so a stage reads what is stored and
survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import packing, quality, simhash, toxicity
from corpusloom.llm.common import table, written
from corpusloom.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the isolation forest reject go."""
    stats = written(quality.statistics(docs), "pipeline-quality")
    model = quality.fit(stats, table(spark, sf_dir, "labels"))
    return quality.judged(stats, model).filter("kept").select("row.*")


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity of 0.5 or more go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).filter(F.col("toxicity.score") < 0.5).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays, that with the smallest id."""
    return simhash.deduplicated(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents' pieces in sequences of 2048 ids."""
    tokens = written(packing.tokenized(docs, tokenizer_path(spark, "word_bpe_49k.json")), "pipeline-tokens")
    return packing.packed(tokens)


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxic_documents),
    ("near_duplicates", near_duplicates),
    ("packing", packed_sequences),
]

#: Models and linear programs aren't SQL: tests hold the stages against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
