"""Quality classifier: hashed word n-gram logistic regression trained by FTRL (operator 5).

Features of a text are its words, word pairs, word shapes (kind of first and last character,
length) and shape pairs, each hashed to one of 2^BITS weights; a pair of equal words is one
feature whatever the word. A text's value of a feature is its share of the text's words. The
weights are learned by FTRL-proximal steps (adaptive per-coordinate rates, L1 and L2), in
SHARDS parallel runs over parts of a bounded sample whose weights are averaged. A score is the
logistic function of a sparse dot product, so scoring reads each text once.

The sample holds at most SAMPLE labelled rows, taken by hash of the id; labels of ids with
crc32(id as text) mod 3 = 1 are held out. Null and empty texts score the bias alone. Rows
without a label, or with a null label, are not learned from; with no label at all every score
is 0.5. Null ids are not held out.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealflow.llm.tokens import FIRST, Words, mix, slices

BITS = 18
SAMPLE, SHARDS, EPOCHS = 24_000, 8, 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.002, 0.001
SCALE = 10.0

# Kinds of bytes for word shapes: lower, upper, digit, other ASCII, byte of a longer character.
_KIND = np.full(256, 3, np.uint64)
_KIND[ord("a"):ord("z") + 1], _KIND[ord("A"):ord("Z") + 1], _KIND[ord("0"):ord("9") + 1], _KIND[128:] = 0, 1, 2, 4


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text number, weight number) of every feature occurrence."""
    doc, value = words.doc(), words.hashes(FIRST)
    size = np.minimum(words.end - words.start, 12).astype(np.uint64)
    shape = mix((_KIND[words.buf[words.start]] * np.uint64(5) + _KIND[words.buf[words.end - 1]]) * np.uint64(16) + size)
    pair = np.flatnonzero(doc[1:] == doc[:-1])
    step = np.uint64(0x9E3779B97F4A7C15)
    two = np.where(value[pair] == value[pair + 1], np.uint64(1), mix(value[pair] * step + value[pair + 1]))
    parts = [value, two, shape, mix(shape[pair] * step + shape[pair + 1])]
    docs = [doc, doc[pair], doc, doc[pair]]
    index = np.concatenate([mix(x + np.uint64(k)) >> np.uint64(64 - BITS) for k, x in enumerate(parts)])
    return np.concatenate(docs), index.astype(np.int64)


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """FTRL over a shard of the sample; yields its weights (the bias is the last one)."""
    rows = []
    for part, buf, offsets in slices(batches):
        words = Words(buf, offsets)
        doc, index = features(words)
        order = np.argsort(doc, kind="stable")
        each = np.split(index[order], np.searchsorted(doc[order], np.arange(1, part.num_rows)))
        for label, idx, n in zip(part.column("quality").to_pylist(), each, np.diff(words.first), strict=True):
            where, count = np.unique(idx, return_counts=True)
            rows.append((float(label), np.append(where, 1 << BITS).astype(np.int32),
                         np.append(count * (SCALE / max(1, n)), 1.0).astype(np.float32)))
    if not rows:
        return
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    for _ in range(EPOCHS):
        for label, idx, x in rows:
            w = _weights(z[idx], n[idx])
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - label) * x
            more = n[idx] + g * g
            z[idx] += g - (np.sqrt(more) - np.sqrt(n[idx])) / ALPHA * w
            n[idx] = more
    yield pa.RecordBatch.from_arrays([pa.array([_weights(z, n).astype(np.float32).tobytes()], pa.binary())], names=["weights"])


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights learned from at most ``sample`` labelled rows that are not held out."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = known.select("doc_id", "quality", F.xxhash64("doc_id").alias("_o")).orderBy("_o", "quality").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``sample`` rows of two numbers
    shards = rows.repartition(SHARDS, F.pmod(F.xxhash64(F.col("_o"), F.lit(1)), F.lit(SHARDS))) \
                 .sortWithinPartitions("_o", "quality", "text").select("quality", "text")
    found = [np.frombuffer(r["weights"], np.float32) for r in shards.mapInArrow(_train, "weights binary").collect()]
    return np.mean(found, axis=0) if found else np.zeros((1 << BITS) + 1, np.float32)


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, score of every row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 2^BITS numbers, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for rows, buf, offsets in slices(batches):
            words = Words(buf, offsets)
            doc, index = features(words)
            sums = np.bincount(doc, weights=w[index], minlength=rows.num_rows)
            logit = sums * SCALE / np.maximum(1, np.diff(words.first)) + w[-1]
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(1.0 / (1.0 + np.exp(-np.clip(logit, -30, 30))))], names=["doc_id", "score"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, score double")


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    return score(docs, train(docs, labels, sample)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
