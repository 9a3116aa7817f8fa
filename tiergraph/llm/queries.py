"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import chat_format
from .decontaminate import report
from .dedup_exact import exact_dedup
from .dedup_substring import remove_repeats
from .html_text import main_text
from .language import identify
from .packing import pack
from .simhash import near_components
from .token_store import token_digests
from .tokens import tokenizer_path
from .toxicity import toxicity


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(_documents(spark, sf_dir), tokenizer_path())


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_documents(spark, sf_dir)).drop("kept")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_documents(spark, sf_dir)).drop("lang_words")


#: Both texts of the added conversation, which hold the template's own marks.
MARKS = "\\### Assistant: </turn> ok"


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(MARKS).alias("text"))
    return chat_format(rows.unionByName(added))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_documents(spark, sf_dir), tokenizer_path())


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_documents(spark, sf_dir))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(_documents(spark, sf_dir))


QUERIES = {
    "op1_token_store": op1_token_store,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_decontamination": op3_decontamination,
    "op4_language_id": op4_language_id,
    "op5_chat_format": op5_chat_format,
    "op6_main_text": op6_main_text,
    "op7_toxicity": op7_toxicity,
    "op8_packing": op8_packing,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_simhash": op10_simhash,
}

SQL = {
    "op5_chat_format": """
        WITH rows AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
        ), escaped AS (
            SELECT *, replace(replace(replace(text, '\\', '\\b'), '<', '\\l'), '#', '\\h') AS body,
                   replace(replace(replace(replace(role, '\\', '\\b'), '<', '\\l'), '#', '\\h'), ':', '\\c') AS head
            FROM rows
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
               sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
               CAST(sum(4 + length(head) + 2 + length(body) + 8) AS BIGINT) AS formatted_chars
        FROM escaped GROUP BY conv_id
    """,
    "op9_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
}
