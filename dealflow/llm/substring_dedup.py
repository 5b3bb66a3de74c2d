"""Substring dedup by anchor-grouped window matching (operator 1).

This replaces a relative Lempel-Ziv parse: no document is parsed into longest matches, since the
spans wanted are exactly the windows that occur again, and those need no greedy parse. Anchors cut every document into phrases:
among the 8-word grams of each window of ``window`` words the one with the least hash is the
window's anchor, so equal windows have equal anchors at equal places, wherever they stand. All
windows with one anchor form a run, a phrase of consecutive words around it. The index of the
reference is dealt by anchor into hash partitions (the blocks); each document's phrases are
looked up in every block that can hold them:

* an anchor that occurs once matches nothing;
* where the phrases of an anchor are all equal, all their windows occur again;
* where they differ, the single windows are checked: each is looked up by a second, independent
  hash, 128 bits in all.

Words covered by a window that occurs again are duplicate spans, merged where windows overlap. Nothing is capped;
work and shuffle are proportional to the words (about one phrase per 14 words).

Null texts have no words. Repeated rows are repeats of each other. A text of fewer words than a
window keeps all its words.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealflow.llm.common import cut, same_doc, text_key, uncut
from dealflow.llm.tokens import FIRST, SECOND, Grams, Words, mix, signed, slices

WINDOW, ANCHOR = 35, 8


def anchors(words: Words, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: first window, number of windows, anchor position."""
    n = np.diff(words.first)
    grams = Grams(words.hashes(FIRST), FIRST)
    total = len(words)
    if total < window:
        return (np.zeros(0, np.int64),) * 3
    value = grams(np.arange(total - anchor + 1), anchor)
    place = np.arange(len(value))
    width, span = window - anchor + 1, 1  # least gram of each window, the leftmost of equals
    while span < width:
        step = min(span, width - span)
        a, b, p, q = value[:-step], value[step:], place[:-step], place[step:]
        take = b < a
        value, place = np.where(take, b, a), np.where(take, q, p)
        span += step
    inside = np.zeros(total, np.int64)  # windows must not run over the end of a text
    long = n >= window
    np.add.at(inside, words.first[:-1][long], 1)
    np.add.at(inside, (words.first[:-1] + n - window + 1)[long], -1)
    start = np.flatnonzero(np.cumsum(inside)[:total - window + 1])
    place = place[start]
    new = np.ones(len(start), bool)
    new[1:] = (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    return start[first], np.diff(np.append(first, len(start))), place[first]


def _phrases(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, offsets in slices(batches):
            words = Words(buf, offsets)
            start, n, place = anchors(words, window, anchor)
            if not len(start):
                continue
            doc = np.searchsorted(words.first, start, side="right") - 1
            key = Grams(words.hashes(FIRST), FIRST)(place, anchor)
            whole = Grams(words.hashes(SECOND), SECOND)(start, n + (window - 1)) + mix((place - start).astype(np.uint64))
            take = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [signed(key), signed(whole), rows.column("doc_id").take(take), rows.column("_th").take(take),
                 pa.array((start - words.first[doc]).astype(np.int32)), pa.array(n.astype(np.int32))],
                names=["anchor", "phrase", "doc_id", "_th", "start", "n"])
    return run


def _windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, offsets in slices(batches):
            words = Words(buf, offsets)
            runs = rows.column("open")
            counts = np.diff(runs.offsets.to_numpy())
            flat = runs.flatten()
            if not len(flat):
                continue
            doc = np.repeat(np.arange(rows.num_rows), counts)
            start, n = flat.field("start").to_numpy(), flat.field("n").to_numpy()
            key = np.repeat(flat.field("anchor").to_numpy(), n)
            doc, start = np.repeat(doc, n), np.repeat(start, n) + _count_up(n)
            at = words.first[doc] + start
            value = Grams(words.hashes(SECOND), SECOND)(at, window)
            take = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), signed(value), rows.column("doc_id").take(take), rows.column("_th").take(take),
                 pa.array(start.astype(np.int32))], names=["anchor", "value", "doc_id", "_th", "start"])
    return run


def _count_up(n: np.ndarray) -> np.ndarray:
    """0..n[0]-1, 0..n[1]-1, ..."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n)


def _kept(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, sha, kept, spans = [], [], [], [], []
            for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                parts = (text or "").encode().split()  # splits at exactly the six gap characters
                n_words.append(len(parts))
                merged: list[list[int]] = []
                for r in sorted(runs or (), key=lambda r: r["start"]):
                    end = r["start"] + r["n"] + window - 1
                    if merged and r["start"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], end)
                    else:
                        merged.append([r["start"], end])
                for start, end in reversed(merged):
                    del parts[start:end]
                left = b" ".join(parts)
                n_removed.append(n_words[-1] - len(parts))
                sha.append(hashlib.sha256(left).hexdigest())
                kept.append(left.decode())
                spans.append(merged)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                 pa.array(spans, pa.list_(pa.list_(pa.int32()))), pa.array(kept, pa.string()), pa.array(sha, pa.string())],
                names=["doc_id", "n_words", "n_removed", "spans", "kept_text", "kept_sha256"])
    return run


def duplicate_runs(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, _th, runs): runs of duplicated windows per document that has any."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", text_key(F.col("text")).alias("_th"), "text")
    phrases = keyed.mapInArrow(_phrases(window, anchor), f"anchor long, phrase long, doc_id {id_type}, _th long, start int, n int")
    # the index: anchors that occur again; ``open`` where their phrases differ
    index = cut(phrases.groupBy("anchor").agg(F.count(F.lit(1)).alias("c"), F.min("phrase").alias("lo"),
                                              F.max("phrase").alias("hi"))
                .where("c > 1").select("anchor", (F.col("lo") != F.col("hi")).alias("open")))
    met = phrases.join(index, "anchor").groupBy("doc_id", "_th", "start") \
                 .agg(F.first("n").alias("n"), F.first("anchor").alias("anchor"), F.first("open").alias("open"))
    run = F.struct("anchor", "start", "n")
    per_doc = cut(met.groupBy("doc_id", "_th").agg(
        F.collect_list(F.when(~F.col("open"), F.struct("start", "n"))).alias("copied"),
        F.collect_list(F.when(F.col("open"), run)).alias("open")))
    # boundaries: the single windows of open phrases
    some = per_doc.where(F.size("open") > 0).select("doc_id", "_th", "open")
    windows = cut(keyed.join(some, same_doc(keyed, some)).select(keyed["doc_id"], keyed["_th"], "text", "open")
                  .mapInArrow(_windows(window), f"anchor long, value long, doc_id {id_type}, _th long, start int"))
    again = cut(windows.groupBy("anchor", "value").agg(F.count(F.lit(1)).alias("c")).where("c > 1").drop("c"))
    single = windows.join(again, ["anchor", "value"]).select("doc_id", "_th", "start").distinct()
    copied = per_doc.where(F.size("copied") > 0).select("doc_id", "_th", F.inline("copied"))
    runs = cut(copied.unionByName(single.withColumn("n", F.lit(1))).groupBy("doc_id", "_th")
               .agg(F.collect_list(F.struct("start", "n")).alias("runs")))
    uncut(index, per_doc, windows, again)
    return runs


def dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, spans (word ranges removed,
    end exclusive), kept_text (kept words joined by one space) and its kept_sha256."""
    runs = duplicate_runs(docs, window, anchor)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", text_key(F.col("text")).alias("_th"), "text")
    return keyed.join(runs, same_doc(keyed, runs), "left").select(keyed["doc_id"], "text", "runs").mapInArrow(
        _kept(window), f"doc_id {id_type}, n_words long, n_removed long, spans array<array<int>>, "
        "kept_text string, kept_sha256 string")
