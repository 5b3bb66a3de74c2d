"""Token counts: the exact histogram of encoded lengths (operator 6).

Every text is encoded once; documents are counted by their number of tokens. Suffix sums over
the histogram answer, for every context limit, how many documents and tokens lie at or above
it and how many tokens are left when longer documents are cut there; totals and quantiles come
from the same table.

Null and empty texts have length 0. Strings of special tokens are ordinary text. An empty table
gives an empty histogram.
"""
from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Vocabulary of byte strings and ranks; must be readable on every executor.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the published byte-level BPE vocabulary splits a text into pieces.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Lengths are summed in blocks of so many.
BLOCK = 4096


@lru_cache(maxsize=4)
def encoding(vocabulary: str, pattern: str):
    import tiktoken

    with open(vocabulary, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def lengths(texts: list[str | None], vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> np.ndarray:
    encode = encoding(vocabulary, pattern).encode_ordinary
    return np.fromiter((len(encode(t)) if t else 0 for t in texts), np.int64, len(texts))


def histogram(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """n_tokens, n_docs: documents of each encoded length (counted per batch before the shuffle)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, count = np.unique(lengths(batch.column("text").to_pylist(), vocabulary, pattern), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(size), pa.array(count)], names=["n_tokens", "n_docs"])

    rows = docs.select("text").mapInArrow(run, "n_tokens long, n_docs long")
    return rows.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """``hist`` with, for the limit n_tokens: docs_at_least and tokens_at_least (documents of that
    length or more), docs_up_to, and truncated_total (tokens left when each document is cut there).

    Sums run inside blocks of lengths and over one row per block, never over all lengths at once."""
    table = hist.withColumn("_block", F.expr(f"n_tokens div {BLOCK}"))
    blocks = table.groupBy("_block").agg(F.sum("n_docs").alias("_docs"), F.sum(F.col("n_tokens") * F.col("n_docs")).alias("_tokens"))
    every = Window.orderBy(F.desc("_block"))
    after, whole = every.rowsBetween(Window.unboundedPreceding, -1), every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select("_block", *[F.coalesce(F.sum(f"_{c}").over(after), F.lit(0)).alias(f"_{c}_after") for c in ("docs", "tokens")],
                           F.sum("_docs").over(whole).alias("_all_docs"), F.sum("_tokens").over(whole).alias("_all_tokens"))
    down = Window.partitionBy("_block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return table.join(blocks, "_block").select(
        "n_tokens", "n_docs",
        (F.sum("n_docs").over(down) + F.col("_docs_after")).alias("docs_at_least"),
        (F.sum(F.col("n_tokens") * F.col("n_docs")).over(down) + F.col("_tokens_after")).alias("tokens_at_least"),
        "_all_docs", "_all_tokens").select(
        "n_tokens", "n_docs", "docs_at_least", "tokens_at_least",
        (F.col("_all_docs") - F.col("docs_at_least") + F.col("n_docs")).alias("docs_up_to"),
        (F.col("_all_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_total"))


def truncated_total(sums: DataFrame, limit: int) -> int:
    """Tokens left when every document is cut at ``limit`` (any limit, not only lengths that occur)."""
    at = sums.where(F.col("n_tokens") >= limit).orderBy("n_tokens").select("tokens_at_least", "docs_at_least").first()
    total = sums.agg(F.max("tokens_at_least")).first()[0] or 0
    return total if at is None else total - at[0] + limit * at[1]


def quantile(sums: DataFrame, q: float) -> int | None:
    """Least length that at least the share ``q`` of the documents does not exceed."""
    n = sums.agg(F.max("docs_at_least")).first()[0]
    return None if n is None else sums.where(F.col("docs_up_to") >= q * n).agg(F.min("n_tokens")).first()[0]


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    return suffix_sums(histogram(docs, vocabulary, pattern))
