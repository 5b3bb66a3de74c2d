"""One query per operator over the given tables, with production parameters."""
from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealflow.llm import (decontamination, fill_in_middle, importance_resampling, jaccard_join, line_dedup, mixing, pii,
                          quality_classifier, quality_rules, sharding, substring_dedup, token_counts, token_files)
from dealflow.llm.common import read_table, ship
from dealflow.llm.oracle import ORACLE_SQL  # noqa: F401  read by __spark_entry__
from dealflow.session import ensure_checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


@_query
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.dedup(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


@_query
def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    slim, plan = mixing.mix_plan(read_table(spark, sf_dir, "documents"))
    return mixing.with_copies(slim, plan).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


@_query
def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = decontamination.judged(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return df.select("doc_id", "n_words", "n_hit", "n_items",
                     F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), "contaminated")


@_query
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup(docs).select("doc_id", "n_lines", "n_removed", "removed_lines", "kept_sha256")


@_query
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@_query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"))


@_query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts(read_table(spark, sf_dir, "documents"), common=False).select(
        "doc_id", *quality_rules.BASE, "base_failed", "char_distance", "word_distance", "kept")


@_query
def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join.linked(docs).select("doc_id", "n_shingles", "component_id")


@_query
def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.scan(read_table(spark, sf_dir, "documents"))
    text = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    base = F.filter("found", lambda s: s["kind"].isin(*pii.BASE_KINDS))
    of = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    n = [of(kind).alias(f"n_{kind}") for kind in pii.BASE_KINDS]
    return found.select("doc_id", *n, F.sha2(text(base).cast("binary"), 256).alias("base_sha256"),
                        text(F.col("found")).alias("spans"))


@_query
def op10_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "hilbert")


@_query
def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    path = f"{ensure_checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.write(docs, path)
    shards = token_files.read(spark, path, docs.schema["doc_id"].dataType.simpleString())
    return token_files.documents(shards).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@_query
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.fill_in_middle(read_table(spark, sf_dir, "documents"))
    again = fill_in_middle.restored(F.col("form"), F.col("output"))
    sha = lambda c, name: F.sha2(c.cast("binary"), 256).alias(name)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output"), "output_sha256"),
                       sha(again, "restored_sha256"))


@_query
def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    return importance_resampling.scored(docs, target).select("doc_id", "n_features", "weight", "score", "rank")
