"""The registered queries of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.llm import (
    decontaminate,
    hard_negatives,
    language_id,
    license_scan,
    packing,
    prefix_trie,
    quality_model,
    quality_rules,
    sanitise,
    simhash_dups,
    token_files,
    url_filter,
    vector_dups,
)
from sediment.llm.common import fold_of, table
from sediment.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function):
    QUERIES[function.__name__] = lambda spark, folder: function(prepare(spark), folder)
    return function


def _held_out(id_col: str):
    return F.coalesce(fold_of(F.col(id_col)) == 2, F.lit(False)).alias("held_out")


@query
def op1_benchmark_leaks(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "start", "n_words", "hamming", "similarity", "route")


@query
def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = language_id.identify(docs, language_id.learn(docs), spans=False)
    return found.select(F.col("id").alias("doc_id"), _held_out("id"), "lang_pred", "score")


@query
def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(table(spark, folder, "documents"), ids=False)
    return pieces.withColumnRenamed("id", "doc_id")


@query
def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return quality_rules.judge(docs, quality_rules.learn(docs, labels)).withColumnRenamed("id", "doc_id")


@query
def op5_token_files(spark: SparkSession, folder: str) -> DataFrame:
    rows = token_files.round_trip(table(spark, folder, "documents"))
    return token_files.checksums(rows).withColumnRenamed("id", "doc_id")


#: The rules of the URL query.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


@query
def op6_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    found = url_filter.filter_urls(table(spark, folder, "pages").select("page_id", "url"), rules)
    return found.select("page_id", "host", "path", "rule", "verdict")


@query
def op7_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


@query
def op8_quality_model(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    found = quality_model.classify(docs, quality_model.learn(docs, labels))
    return found.select(F.col("id").alias("doc_id"), _held_out("id"), "score", "predicted")


@query
def op9_private_data(spark: SparkSession, folder: str) -> DataFrame:
    return sanitise.digest(sanitise.find(table(spark, folder, "documents"))).withColumnRenamed("id", "doc_id")


@query
def op10_simhash_dups(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash_dups.near_duplicates(table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), "fingerprint", "component_id")


@query
def op11_vector_dups(spark: SparkSession, folder: str) -> DataFrame:
    return vector_dups.near_duplicates(table(spark, folder, "embeddings")).withColumnRenamed("id", "vec_id")


@query
def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, folder, "embeddings"), F.col("id") % 100 == 0, label=label)


@query
def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations")
    nodes = prefix_trie.conversation_trie(turns, rebuild=prefix_trie.shared_starts)
    return nodes.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )
