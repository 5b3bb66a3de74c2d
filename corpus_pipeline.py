"""A corpus pipeline of five stages, each one operator of ``dealflow.llm``.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next one's ``docs``. Every stage works
on all rows the one before it kept. All stages but the last return the columns of ``documents``, the last one adds to them:

1. quality rules: documents that fail the base rules or lie far from every language go;
2. n-gram Jaccard join: of each component of near-duplicates (``NEAR``: runs of five words, 80 % of
   them shared) one document stays;
3. benchmark decontamination: contaminated documents go;
4. mixing: each document comes as often as the mix takes it (possibly not at all);
5. sharding: each row, text included, gets its place on the Hilbert curve, its shard and its slot.

Columns beyond those of ``documents`` are handed on. An empty table stays empty.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dealflow.llm import decontamination, jaccard_join, mixing, quality_rules, sharding
from dealflow.llm.common import cut, read_table, ship

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: What counts as a near-duplicate in a corpus; the query op8 has values of its own.
NEAR = {"ngram": 5, "percent": 80}


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return jaccard_join.one_of_each(docs, **NEAR)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, read_table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.sharded(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark),
    ("source_mixing", mix),
    ("hilbert_sharding", shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written to the shared checkpoint folder."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs


#: The mix draws documents by a seeded hash that DuckDB lacks; see tests/llm/test_pipeline.py.
ORACLE_SQL: str | None = None
