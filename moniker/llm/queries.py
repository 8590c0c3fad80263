"""The corpus operators' queries by name, each over its whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, jaccard, mixing, packing, pivots, quality, secrets, sharding, tokencount, toxicity
from . import common as C

Query = Callable[[SparkSession, str], DataFrame]


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.copies(C.table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(C.table(spark, sf_dir, "documents"), repo=F.concat_ws("/", "source", "lang"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(C.table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is retained."""
    docs = C.table(spark, sf_dir, "documents")
    model = quality.fitted(docs, C.table(spark, sf_dir, "labels"))
    return quality.measures(docs, model).where((F.col("n_lines") > 0) & (F.col("content_share") >= model.least))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(C.table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is flagged."""
    docs = C.table(spark, sf_dir, "documents")
    return toxicity.flagged(docs, toxicity.fitted(docs, C.table(spark, sf_dir, "labels")))


def op7_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_duplicates(C.table(spark, sf_dir, "embeddings"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(chat.log_of_turns(C.table(spark, sf_dir, "conversations")), partitioned=True)


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.ngram_jaccard_join(C.table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(C.table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (op1_mixing, op2_secret_scan, op3_sharding, op4_quality_rules, op5_best_fit_packing, op6_toxicity, op7_embedding_near_duplicates, op8_chat_formatting, op9_ngram_jaccard_join, op10_token_counts)
}
SQL: dict[str, str] = {"op2_secret_scan": secrets.SQL, "op8_chat_formatting": chat.SQL}
