"""Target-distribution importance resampling over hashed n-grams (operator 13).

The features of a text are its runs of 1 to ``ngram`` words; a feature's bucket is the CRC-32 of
its bytes modulo ``buckets``. A bucket's gain says how much commoner it is in the target texts
than in the corpus, a text's weight is the floored mean of the gains of its features, and Gumbel
noise from the seeded hash of its id makes the highest scores a sample without replacement.

CRC-32 is affine in the bits of a message, so the checksum of a span is the exclusive or of one
table entry per byte, chosen by the byte and its distance from the end, and of a constant of the
span's length. All spans of a batch are looked up in one position table at once and put together
by ``bitwise_xor.reduceat``. A span longer than the table is taken in blocks of the table's size:
the checksum so far is moved on by one block of zeros (four table entries) and the next block's is
added.

Counts and weights come from whole texts, in two passes; between them are ``buckets`` sums. Null and
empty texts have no words and weight 0. A null id is hashed as the empty string and comes after
all others in a tie; rows that agree in everything have ranks of their own. An empty corpus gives no
rows; with an empty target the gains are those of its zero counts. No column but doc_id and text
is read.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealflow.llm.common import cut, groups, ranked, restrict, text_key

NGRAM, BUCKETS, MIN_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, 2024
#: Distances from a span's end that the position table covers.
REACH = 64
#: Bytes of the texts that are hashed together (or one longer text), and features at a time.
BATCH_BYTES, BATCH_FEATURES = 1 << 21, 1 << 18

_BYTE = np.arange(256)
# Word characters: digits, letters, everything beyond ASCII; upper-case letters are lowered.
_LOWER = np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, _BYTE).astype(np.uint8)
_IS_WORD = (_BYTE >= 48) & (_BYTE <= 57) | (_BYTE >= 97) & (_BYTE <= 122) | (_BYTE >= 128)


# ---- CRC-32 of many spans --------------------------------------------------------------

def _moved(state: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The register after one more zero byte."""
    return (state >> 8) ^ table[state & 0xFF]


@lru_cache(maxsize=1)
def position_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``at[d, b]``: what byte b at distance d from the end adds. ``constant[n]``: the checksum of n zero
    bytes, n up to REACH. ``jump[k, b]``: where REACH zero bytes take register byte k of value b."""
    step = _BYTE.astype(np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1)  # the reflected polynomial
    at = np.empty((REACH, 256), np.uint32)
    at[0] = step
    for d in range(1, REACH):
        at[d] = _moved(at[d - 1], step)
    jump = np.stack([_BYTE.astype(np.uint32) << np.uint32(8 * k) for k in range(4)])
    for _ in range(REACH):
        jump = _moved(jump, step)
    return at, np.array([zlib.crc32(bytes(n)) for n in range(REACH + 1)], np.uint32), jump


def _block_sums(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Exclusive or of the position-table entries of each span of 1 to REACH bytes."""
    at = position_tables()[0]
    first = np.cumsum(sizes) - sizes
    inside = np.arange(first[-1] + sizes[-1]) - np.repeat(first, sizes)
    byte = data[np.repeat(starts, sizes) + inside]
    return np.bitwise_xor.reduceat(at[np.repeat(sizes, sizes) - 1 - inside, byte], first)


def crc32_spans(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32 of each span ``data[start:start + size]`` (sizes of 1 or more; spans may overlap)."""
    if not len(starts):
        return np.zeros(0, np.uint32)
    _, constant, jump = position_tables()
    head = (sizes - 1) % REACH + 1  # the first block takes what whole blocks leave
    state = _block_sums(data, starts, head) ^ constant[head]
    at, left = starts + head, sizes - head
    todo = np.flatnonzero(left)
    while len(todo):
        # the register is the checksum inverted, at both ends of the move
        s = ~state[todo]
        s = jump[0, s & 0xFF] ^ jump[1, s >> 8 & 0xFF] ^ jump[2, s >> 16 & 0xFF] ^ jump[3, s >> 24]
        state[todo] = ~(s ^ _block_sums(data, at[todo], np.full(len(todo), REACH)))
        at[todo] += REACH
        left[todo] -= REACH
        todo = todo[left[todo] > 0]
    return state


# ---- features --------------------------------------------------------------------------

def features(texts: list[bytes], ngram: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(words per text, text number, bucket) of the features of some texts: the first item's words count,
    further ones are empty; features come in bounded pieces."""
    ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    data = _LOWER[np.frombuffer(b" ".join([*texts, b""]), np.uint8)]
    word = _IS_WORD[data]
    before = np.concatenate([[False], word[:-1]])
    gap = before & ~word  # the byte behind a word, always there
    begins, stops = np.flatnonzero(word & ~before), np.flatnonzero(gap)
    owner = np.searchsorted(ends, begins, side="right")
    n_words = np.bincount(owner, minlength=len(texts))
    # words of a text, one space between them, so that a feature is one run of bytes
    place = np.cumsum(word | gap) - (word | gap)
    line = np.where(gap, np.uint8(32), data)[word | gap]
    begins, stops = place[begins], place[stops]
    for n in range(1, ngram + 1):
        for i in range(0, max(0, len(begins) - n + 1), BATCH_FEATURES):
            k = np.arange(i, min(i + BATCH_FEATURES, len(begins) - n + 1))
            k = k[owner[k] == owner[k + n - 1]]
            yield n_words, owner[k], crc32_spans(line, begins[k], stops[k + n - 1] - begins[k]) % np.uint32(buckets)
            n_words = n_words[:0]
    if len(n_words):
        yield n_words, owner[:0], np.zeros(0, np.uint32)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[slice, list[bytes]]]:
    texts = [t or b"" for t in batch.column("text").to_pylist()]
    for part in groups(map(len, texts), BATCH_BYTES):
        yield part, texts[part]


def bucket_counts(docs: DataFrame, ngram: int = NGRAM, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: features of all texts in each bucket that has any (summed per task before the shuffle)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, texts in _texts(batch):
                for _, _, bucket in features(texts, ngram, buckets):
                    n += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(n[some])], names=["bucket", "n"])

    rows = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "bucket long, n long")
    return rows.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, ngram: int = NGRAM, buckets: int = BUCKETS) -> DataFrame:
    """bucket, s, t, gain of every bucket: its features in ``docs`` and ``target`` and
    floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) with S and T their sums."""
    both = bucket_counts(docs, ngram, buckets).select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(
        bucket_counts(target, ngram, buckets).select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t"))).unionByName(
        docs.sparkSession.range(buckets).select(F.col("id").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t")))
    table = cut(both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")))  # counted once
    table = table.withColumns({f"all_{c}": table.agg(F.sum(c)).scalar() for c in "st"})
    n = lambda c, more: F.col(c).cast("double") + more
    ratio = n("t", 1) * n("all_s", buckets) / (n("s", 1) * n("all_t", buckets))
    return table.select("bucket", "s", "t", F.floor(1000 * F.ln(ratio)).alias("gain"))


def weights(docs: DataFrame, gain: np.ndarray, ngram: int = NGRAM) -> DataFrame:
    """Per row of ``docs``: doc_id, _th (text hash), n_words, n_features, weight (floored mean gain)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _texts(batch):
                words, n, total = (np.zeros(len(texts), np.int64) for _ in range(3))
                for n_words, owner, bucket in features(texts, ngram, len(gain)):
                    words[:len(n_words)] += n_words
                    n += np.bincount(owner, minlength=len(texts))
                    # sums of integers, exact in doubles
                    total += np.bincount(owner, weights=gain[bucket], minlength=len(texts)).astype(np.int64)
                rows = batch.slice(part.start, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), rows.column("_th"), pa.array(words), pa.array(n), pa.array(total // np.maximum(n, 1))],
                    names=["doc_id", "_th", "n_words", "n_features", "weight"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_key(F.col("text")).alias("_th"), F.col("text").cast("binary").alias("text")) \
               .mapInArrow(run, f"doc_id {id_type}, _th long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of the hash of seed and id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def scored(docs: DataFrame, target: DataFrame, ngram: int = NGRAM, buckets: int = BUCKETS, min_words: int = MIN_WORDS,
           percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """Per row of ``docs``: doc_id, _th, n_words, n_features, weight, score and rank: of the N rows with
    ``min_words`` words or more the floor(percent * N / 100) highest scores are drawn and numbered from
    1 (ties: the smaller doc_id first); the others have no rank."""
    gain = np.zeros(buckets, np.int64)
    for row in gains(docs, target, ngram, buckets).collect():  # ``buckets`` rows
        gain[row.bucket] = row.gain
    table = cut(weights(docs, gain, ngram).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
                .withColumn("_mid", F.monotonically_increasing_id()))
    able = F.col("n_words") >= min_words
    drawn = table.agg(F.expr(f"({percent}L * count_if(n_words >= {min_words})) div 100").alias("n")).scalar()
    placed = ranked(table.withColumnRenamed("_mid", "_row"), able.desc(), F.col("score").desc(),
                    F.col("doc_id").asc_nulls_last(), F.col("_th"), F.col("_row"))
    return placed.withColumn("_drawn", drawn).select(
        "doc_id", "_th", "n_words", "n_features", "weight", "score",
        F.when(F.col("_rank") < F.col("_drawn"), F.col("_rank") + 1).alias("rank"))


def resampled(docs: DataFrame, target: DataFrame, **parameters) -> DataFrame:
    """The whole rows of ``docs`` that ``scored`` draws; rows equal in id and text come together."""
    drawn = cut(scored(docs, target, **parameters).where("rank is not null").select("doc_id", "_th").distinct())
    return restrict(docs, drawn, "left_semi")
