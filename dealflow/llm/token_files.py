"""Token files: one wavelet matrix per shard (operator 11).

``write`` encodes every text once, appends the end id, sorts the documents by id and cuts them
into shards of whole documents (``shard_tokens`` tokens, or one longer document). A shard is one
compressed Parquet file of one row, written through Spark's committer, so any file system that
Spark reaches will do and a lost executor's shards are written again. The row holds

    part, seq       place of the shard: files in this order hold the documents in ascending order
    before          tokens of the same part in the shards before
    n_tokens        tokens of the shard
    zeros           per bit plane, highest first: the number of zeros
    planes          per bit plane: its bits, little-endian, padded to blocks of 512
    ranks           per bit plane: ones before each block, little-endian unsigned 32-bit
    doc_ids, ends   per document: its id and the shard position behind its last token

``documents`` decodes whole documents, ``tokens_at`` reads single positions, ``counts`` and
``occurrences`` count and find tokens; the last three use rank and select and decode no shard.

Null and empty texts have the end id alone. Documents of one id follow each other in the order of
their text hashes; null ids come first. Whole rows that repeat are documents of their own. An empty
table gives no files and empty results. No other column is read.
"""
from __future__ import annotations

import gc
import json
import os
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from dealflow.llm.common import cut, groups, text_key, uncut
from dealflow.llm.wavelet import WaveletMatrix

#: The id that ends every document, and the most tokens of a shard of several documents.
END, SHARD_TOKENS = 2, 1 << 23
# Fixed value: how the published vocabulary splits a lower-cased text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
GAPS, LETTERS = " \t\n\r\x0b\x0c", "A-Za-zÀ-ÖØ-öø-ÿ"
#: Printable ASCII and the letters and marks of western European languages: lower case is letter by
#: letter here, and nothing combines.
PLAIN = LETTERS + "!-@[-`{-~¡«»¿"
#: What the pattern makes of text of such characters, in either case.
UNITS = re.compile(f"'(?:[sStTmMdD]|[rRvV][eE]|[lL][lL])|[{LETTERS}]+|[0-9]|[^{GAPS}{LETTERS}0-9]+")
#: The same, with every run between white space that holds other characters left whole.
UNITS_AND_PIECES = re.compile(f"[{PLAIN}]*[^{GAPS}{PLAIN}][^{GAPS}]*|" + UNITS.pattern)
ALL_PLAIN = re.compile(f"[{PLAIN}]+")
#: An encoder remembers the ids of so many units of at most so many characters, then starts anew.
REMEMBERED, UNIT_CHARS = 600_000, 40
#: Decoded documents leave a task in batches of about so many tokens.
BATCH_TOKENS = 1 << 20


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


class Known(dict):
    """Ids by unit, found by ``fresh`` on first use; long units are not kept."""

    def __init__(self, fresh):
        self.fresh = fresh

    def __missing__(self, unit: str) -> bytes:
        ids = self.fresh(unit)
        if len(unit) <= UNIT_CHARS:
            self[unit] = ids
        return ids


class Encoder:
    """Ids of texts as little-endian bytes of ``dtype``.

    Where the vocabulary lowers case, drops white space and splits by ``PATTERN``, a text of ``PLAIN``
    characters is taken apart into its units, and one with others into units and the pieces between
    white space that hold the others. Equal ones are encoded once: units by the vocabulary's model,
    pieces by the whole tokenizer. Other vocabularies, and texts with the string of a special token,
    are encoded as they are."""

    def __init__(self, path: str, dtype: str):
        from tokenizers import pre_tokenizers

        self.tokenizer, self.known = _tokenizer(path), Known(self._fresh)
        self.code = {"<u2": "H", "<u4": "I"}[dtype]
        self.model, byte_level = self.tokenizer.model, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        # the model's letter for each byte beyond ASCII that these characters have in UTF-8
        self.letters = {ord(c): byte_level.pre_tokenize_str(c)[0][0] for c in map(chr, range(128, 256))}
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        steps = (rules.get("pre_tokenizer") or {}).get("pretokenizers", [])
        lowers = [n["type"] for n in (rules.get("normalizer") or {}).get("normalizers", [])]
        self.by_unit = "Lowercase" in lowers and [s["type"] for s in steps] == ["Split", "ByteLevel"] \
            and steps[0]["pattern"] == {"Regex": PATTERN}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _bytes(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def _whole(self, text: str) -> bytes:
        return self._bytes(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids)

    def _fresh(self, unit: str) -> bytes:
        if not ALL_PLAIN.fullmatch(unit):
            return self._whole(unit)
        return self._bytes([t.id for t in self.model.tokenize(unit.lower().translate(self.letters))])

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.by_unit:
            return [self._whole(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        return [self._whole(t) if any(s in t for s in self.special) else
                b"".join(map(self.known.__getitem__, (UNITS if t.isascii() else UNITS_AND_PIECES).findall(t))) for t in texts]


@lru_cache(maxsize=2)
def _encoder(path: str, dtype: str) -> Encoder:
    return Encoder(path, dtype)


def encoded(docs: DataFrame, vocabulary: str | None = None, end_id: int = END) -> DataFrame:
    """Per row of ``docs``: doc_id, _th (text hash), ids (with the end id, little-endian, 2 bytes an id
    if the vocabulary fits, else 4). The vocabulary file travels with the job."""
    vocabulary = vocabulary or default_vocabulary()
    docs.sparkSession.sparkContext.addFile(vocabulary)
    name, dtype = os.path.basename(vocabulary), "<u2" if bits_of(vocabulary, end_id) <= 16 else "<u4"
    tail = np.array([end_id], dtype).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(SparkFiles.get(name), dtype)
        gc.disable()  # nothing here makes cycles, and collections would walk all that is remembered
        try:
            for batch in batches:
                texts = [t or "" for t in batch.column("text").to_pylist()]
                for part in groups(map(len, texts), 1 << 21):
                    ids = [i + tail for i in encode(texts[part])]
                    rows = batch.slice(part.start, len(ids))
                    yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("_th"), pa.array(ids, pa.binary())],
                                                     names=["doc_id", "_th", "ids"])
        finally:
            gc.enable()

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_key(F.col("text")).alias("_th"), "text") \
               .mapInArrow(run, f"doc_id {id_type}, _th long, ids binary")


def bits_of(vocabulary: str, end_id: int = END) -> int:
    """Bit planes that every id of the vocabulary and the end id fit into."""
    return max(_tokenizer(vocabulary).get_vocab_size() - 1, end_id, 1).bit_length()


def _schema(id_type: str) -> str:
    return (f"part int, seq int, before long, n_tokens long, zeros array<long>, planes array<binary>, ranks array<binary>, "
            f"doc_ids array<{id_type}>, ends array<long>")


def write(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END,
          shard_tokens: int = SHARD_TOKENS) -> None:
    """Write the token files of ``docs`` (doc_id, text) under ``path``, a shard a file."""
    vocabulary = vocabulary or default_vocabulary()
    bits = bits_of(vocabulary, end_id)
    dtype = np.dtype("<u2" if bits <= 16 else "<u4")
    # written once: the range partitioner reads its input twice, and texts are to be encoded once
    table = cut(encoded(docs, vocabulary, end_id).withColumn("_mid", F.monotonically_increasing_id()))
    order = ["doc_id", "_th", "_mid"]  # the last deals out rows that repeat

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        ids, names, kind = [], [], None

        def shard() -> pa.RecordBatch:
            nonlocal seq, before
            matrix = WaveletMatrix.build(np.frombuffer(b"".join(ids), dtype), bits)
            ends = np.cumsum([len(i) // dtype.itemsize for i in ids], dtype=np.int64)
            row = {"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()),
                   "before": pa.array([before], pa.int64()), "n_tokens": pa.array([matrix.n], pa.int64()),
                   "zeros": pa.array([matrix.zeros], pa.list_(pa.int64())),
                   "planes": pa.array([[p.tobytes() for p in matrix.planes]], pa.list_(pa.binary())),
                   "ranks": pa.array([[r.astype("<u4").tobytes() for r in matrix.ranks]], pa.list_(pa.binary())),
                   "doc_ids": pa.array([names], pa.list_(kind)), "ends": pa.array([ends], pa.list_(pa.int64()))}
            seq, before = seq + 1, before + matrix.n
            ids.clear()
            names.clear()
            return pa.RecordBatch.from_pydict(row)

        held = 0
        for batch in batches:
            kind = batch.column("doc_id").type
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                n = len(raw) // dtype.itemsize
                if ids and held + n > shard_tokens:
                    yield shard()
                    held = 0
                ids.append(raw)
                names.append(doc_id)
                held += n
        if ids:
            yield shard()

    rows = table.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "ids")
    (rows.mapInArrow(run, _schema(docs.schema["doc_id"].dataType.simpleString()))
         .write.option("maxRecordsPerFile", 1).option("compression", "zstd").parquet(path))
    uncut(table)


def read(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """The shards under ``path``, each with ``start``, the number of tokens in all shards before it."""
    shards = spark.read.schema(_schema(id_type)).parquet(path)
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range partition of the writing sort, so bounded by the shuffle partitions
    starts = parts.select("part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    return shards.join(F.broadcast(starts), "part").withColumn("start", F.col("_start") + F.col("before")).drop("_start")


def _matrix(row: dict) -> WaveletMatrix:
    return WaveletMatrix(row["n_tokens"], [np.frombuffer(p, "<u8") for p in row["planes"]],
                         [np.frombuffer(r, "<u4") for r in row["ranks"]], row["zeros"])


def _per_shard(shards: DataFrame, fn, schema: str) -> DataFrame:
    """``fn(shard row)`` yields record batches; one shard is unpacked at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from fn(batch.slice(i, 1).to_pylist()[0])

    return shards.mapInArrow(run, schema)


def documents(shards: DataFrame) -> DataFrame:
    """Per document, from the files alone: doc_id, start (tokens of all documents before it),
    n_tokens (with the end id), ids (little-endian unsigned 32-bit)."""
    id_type = shards.schema["doc_ids"].dataType.elementType
    kind = to_arrow_type(id_type)

    def fn(row: dict) -> Iterator[pa.RecordBatch]:
        matrix = _matrix(row)
        raw = matrix.values(np.uint16 if matrix.bits <= 16 else np.uint32).astype("<u4", copy=False).tobytes()
        ends = np.array(row["ends"], np.int64)
        begins = np.concatenate([[0], ends[:-1]])
        for part in groups(ends - begins, BATCH_TOKENS):
            a, z = begins[part], ends[part]
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["doc_ids"][part], kind), pa.array(a + row["start"]), pa.array(z - a),
                 pa.array([raw[4 * i:4 * j] for i, j in zip(a, z, strict=True)], pa.binary())],
                names=["doc_id", "start", "n_tokens", "ids"])

    return _per_shard(shards, fn, f"doc_id {id_type.simpleString()}, start long, n_tokens long, ids binary")


def tokens_at(shards: DataFrame, positions: list[int]) -> DataFrame:
    """position, token of the asked positions, counted over all shards; one outside has no row."""
    asked = np.unique(np.array(positions, np.int64))

    def fn(row: dict) -> Iterator[pa.RecordBatch]:
        here = asked[np.searchsorted(asked, row["start"]):np.searchsorted(asked, row["start"] + row["n_tokens"])]
        if len(here):
            yield pa.RecordBatch.from_arrays([pa.array(here), pa.array(_matrix(row).access(here - row["start"]))],
                                             names=["position", "token"])

    return _per_shard(shards, fn, "position long, token long")


def counts(shards: DataFrame, tokens: list[int]) -> DataFrame:
    """token, n: how often each of ``tokens`` stands in all shards."""
    def fn(row: dict) -> Iterator[pa.RecordBatch]:
        matrix, whole = _matrix(row), np.array([row["n_tokens"]])
        n = [int(matrix.rank(t, whole)[0]) for t in tokens]
        yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array(n, pa.int64())], names=["token", "n"])

    return _per_shard(shards, fn, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def occurrences(shards: DataFrame, tokens: list[int]) -> DataFrame:
    """token, position (over all shards), doc_id of every occurrence of ``tokens``."""
    id_type = shards.schema["doc_ids"].dataType.elementType
    kind = to_arrow_type(id_type)

    def fn(row: dict) -> Iterator[pa.RecordBatch]:
        matrix, ends = _matrix(row), np.array(row["ends"], np.int64)
        for t in sorted(set(tokens)):
            n = int(matrix.rank(t, np.array([row["n_tokens"]]))[0])
            for first in range(0, n, BATCH_TOKENS):
                at = matrix.select(t, np.arange(first, min(n, first + BATCH_TOKENS)))
                owner = np.searchsorted(ends, at, side="right")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), t, np.int64)), pa.array(at + row["start"]),
                     pa.array([row["doc_ids"][i] for i in owner], kind)], names=["token", "position", "doc_id"])

    return _per_shard(shards, fn, f"token long, position long, doc_id {id_type.simpleString()}")
