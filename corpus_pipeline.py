"""A training-data pipeline over `documents`: each stage takes all rows that the stage before kept.

What holds for every stage: null text counts as empty, and empty texts are documents like others; texts are read whole,
however long; an empty table gives an empty table; other columns pass through and none can clash with a stage's own.
Repeated rows and ids are rows of their own until a dedup stage drops all but one of their text; a null id comes after
all others, so a row that has an id stays instead. Without labels nothing counts as toxic; benchmark rows whose id or text
is null hold no passage. All stages but the last give the columns of `documents`; the last gives the columns of pack().
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiergraph.llm.common import materialise
from tiergraph.llm.decontaminate import clean
from tiergraph.llm.dedup_exact import keep_unique
from tiergraph.llm.packing import pack
from tiergraph.llm.similar import WIDTH, similar_components
from tiergraph.llm.simhash import keep_one_of_each
from tiergraph.llm.tokens import tokenizer_path
from tiergraph.llm.toxicity import keep_clean, learn


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return keep_clean(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return keep_unique(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share 0.8 or more of their five-word shingles, and all linked through such, the first stays."""
    return keep_one_of_each(docs, width=WIDTH, find=similar_components)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; a document that is half benchmark text or more goes. n_chars follows the text."""
    columns = docs.columns
    docs = clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return docs.select(*columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences."""
    return pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", packing),
]

#: Learned scores, fingerprints and token ids can't be said in SQL; the tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
