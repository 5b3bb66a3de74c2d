"""Fuzzy line dedup by MinHash (operator 4).

Lines that hold a word are compared by their sets of character n-grams (bytes of the UTF-8
line, gaps at both ends taken off). Equal lines are one node. A one-permutation MinHash signature (one
hash per gram, the least of each bin, empty bins filled from a seeded other bin) is cut into
bands; lines with an equal band are candidates. At similarity 0.8 the bands find a pair with
probability 0.999, at 0.1 with one in 40,000, so unrelated lines of one language hardly meet.
Signatures are computed once; band keys travel packed, a row for each bucket of a batch. Keys of a
few lines give their pairs at once. Only lines that share a key have their text shuffled, each once.
Candidates whose gram counts and parity bitmaps (as large as the line, inside the join) allow the
similarity are verified by exact Jaccard similarity, linked lines are united by distributed union-find,
and of every component the first line in (doc_id, line number) order stays.

Null texts have no lines. Lines without a word always stay and are compared with nothing. A
line shorter than a gram is one gram. Repeated rows (equal id and text) count as one document:
all of them keep or lose the same lines. Null ids come last.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealflow.llm.common import cut, of_pairs, same_doc, text_key, uncut
from dealflow.llm.jaccard_join import _wide_apart
from dealflow.llm.links import FEW, link
from dealflow.llm.tokens import SECOND, SPACES, mix, signed, slices

GRAM, PERCENT = 5, 80
BANDS, ROWS = 24, 6
#: Grams of so many bytes at most are held as they are, in CODE_BITS bits with the length of a shorter line.
PACK, CODE_BITS = 5, 43
#: Longs of a line's parity bitmap, at least and at most (powers of two); between them two cells a gram.
LONGS = 4, 64
#: Slots, by hash, that say which lines share a key: 8 MB of bits however many lines there are.
SLOT_BITS = 26
#: Bytes handled at once, so that the arrays stay in the cache, and the lines that a task remembers as done.
CHUNK, SEEN = 1 << 17, 300_000
#: Buckets of band keys per shuffle partition, and the (key, line) pairs that a task packs at once. A key is its
#: bucket and so many bytes more.
SPREAD, PACKED, KEY_BYTES = 8, 1 << 21, 5


def _bounds(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines with a word, gaps at both ends taken off: (text number, line number, start, end)."""
    ends = np.flatnonzero(buf == 10)
    count = 1 + np.diff(np.searchsorted(ends, offsets))
    doc = np.repeat(np.arange(len(count)), count)
    line = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    start = np.sort(np.concatenate([offsets[:-1], ends + 1]))
    end = np.sort(np.concatenate([offsets[1:], ends]))
    some = np.flatnonzero(start < end)
    doc, line, start, end = doc[some], line[some], start[some], end[some]
    if SPACES[buf[start]].any() or SPACES[buf[end - 1]].any():
        inside = np.flatnonzero(~SPACES[buf])
        first, last = np.searchsorted(inside, start), np.searchsorted(inside, end)
        some = np.flatnonzero(first < last)
        doc, line, start, end = doc[some], line[some], inside[first[some]], inside[last[some] - 1] + 1
    return doc, line, start, end


def _line_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128 bits of a hash of each line's bytes, in two numbers."""
    raw = buf.tobytes()
    digests = [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True)]
    return np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)


def _within(start: np.ndarray, end: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, position) of every gram, and the bytes of a gram of each line."""
    size = np.minimum(end - start, gram)
    count = end - start - size + 1
    ends = np.cumsum(count)
    at = np.arange(ends[-1] if len(ends) else 0)
    at += np.repeat(start - ends + count, count)
    return np.repeat(np.arange(len(start)), count), at, size


def _codes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(line, bytes as a number) of every gram of PACK bytes at most, repeats included."""
    line, at, size = _within(start, end, gram)
    padded = np.append(buf, np.zeros(8, np.uint8))
    window = np.ndarray(len(buf) + 1, "<u8", padded, strides=(1,)) & np.uint64(256**gram - 1)
    code = window[at]
    short = np.flatnonzero(size < gram)
    if len(short):  # one gram each
        where, width = np.searchsorted(line, short), size[short].astype(np.uint64)
        code[where] &= (np.uint64(1) << np.uint64(8) * width) - np.uint64(1)
        code[where] |= width << np.uint64(8 * PACK)
    return line, code


def _grams(buf: np.ndarray, start: np.ndarray, end: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(line, hash) of every character n-gram, repeats included."""
    if gram <= PACK:
        line, code = _codes(buf, start, end, gram)
        code += np.uint64(0x9E3779B97F4A7C15)
        code *= np.uint64(0xBF58476D1CE4E5B9)
        code ^= code >> np.uint64(32)
        code *= np.uint64(0x94D049BB133111EB)
        code ^= code >> np.uint64(29)
        return line, code
    line, at, size = _within(start, end, gram)
    up, down = SECOND.powers(SECOND.base, len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(SECOND.codes[buf] * up[:-1], out=sums[1:])
    return line, mix((sums[at + size[line]] - sums[at]) * down[at] + size[line].astype(np.uint64))


def _distinct(buf: np.ndarray, start: np.ndarray, end: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(line, gram) of the distinct grams of each line, sorted."""
    if gram <= PACK:
        key = _packed(buf, start, end, gram)
        return (key >> np.uint64(CODE_BITS)).astype(np.int64), key & np.uint64(2**CODE_BITS - 1)
    line, value = _grams(buf, start, end, gram)
    order = np.lexsort((value, line))
    line, value = line[order], value[order]
    new = np.append(True, (line[1:] != line[:-1]) | (value[1:] != value[:-1]))[:len(line)]
    return line[new], value[new]


def _packed(buf: np.ndarray, start: np.ndarray, end: np.ndarray, gram: int) -> np.ndarray:
    """Line and gram of the distinct grams as one number each (under 2^21 lines), sorted."""
    line, code = _codes(buf, start, end, gram)
    code |= line.astype(np.uint64) << np.uint64(CODE_BITS)
    code.sort()
    return code[np.append(True, code[1:] != code[:-1])[:len(code)]]


def _as_binary(value: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(value), [None, pa.py_buffer(value.tobytes())]).cast(pa.binary())


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, buf, offsets in slices(batches, "text", CHUNK):
        doc, line, start, end = _bounds(buf, offsets)
        who = pa.array(doc)
        yield pa.RecordBatch.from_arrays(
            [rows.column("doc_id").take(who), rows.column("_th").take(who), pa.array(line.astype(np.int32)),
             _as_binary(_line_hash(buf, start, end))], names=["doc_id", "_th", "line", "hash"])


def _fresh(mark: np.ndarray, seen: set[int]) -> np.ndarray:
    """Places of the marks that are not in ``seen``, the first of each, in order; they are added to it."""
    if len(seen) > SEEN:
        seen.clear()
    mark, one = np.unique(mark, return_index=True)
    known = mark.tolist()
    one = one[np.fromiter((m not in seen for m in known), bool, len(known))]
    seen.update(known)
    return np.sort(one)


_SOURCES: dict[int, np.ndarray] = {}


def _sources(bins: int, turns: int) -> np.ndarray:
    """The places at which each bin looks, by turn."""
    have = _SOURCES.get(bins)
    if have is None or len(have) < turns:
        seeds = np.arange(bins, bins * (2 * turns + 64 + 1), dtype=np.uint64)
        have = _SOURCES[bins] = (mix(seeds) % np.uint64(bins)).astype(np.int64).reshape(-1, bins)
    return have


def signature(line: np.ndarray, value: np.ndarray, lines: int, bins: int) -> np.ndarray:
    """One-permutation MinHash: least hash of each bin; an empty bin takes over another one's by a
    fixed sequence of places, so similar sets fill their empty bins alike."""
    none = np.uint64(2**64 - 1)
    least = np.full(lines * bins, none)
    place = value - value // np.uint64(bins) * np.uint64(bins)
    np.minimum.at(least, line * bins + place.view(np.int64), value)
    filled = least.copy()
    have = (least != none).reshape(lines, bins)
    empty = todo = np.flatnonzero(~have & have.any(axis=1, keepdims=True))
    place = todo % bins
    first, at, turn = todo - place, place, 0
    while len(todo):
        # one turn, or for the last bins many turns at once: the first filled place counts
        turns = max(1, min(64, 16_000 // len(todo)))
        sources = _sources(bins, turn + turns)[turn:turn + turns]
        if turns == 1:
            value = least[first + sources[0][at]]
        else:
            values = least[first + sources[:, at]]
            value = values[(values != none).argmax(axis=0), np.arange(len(todo))]
        filled[todo] = value
        left = np.flatnonzero(value == none)
        todo, first, at = todo[left], first[left], at[left]
        turn += turns
    filled[empty] = mix(filled[empty] + place.astype(np.uint64))
    return filled.reshape(lines, bins)


def band_keys(sign: np.ndarray) -> np.ndarray:
    """The key of each band of each signature: (lines, BANDS)."""
    sign = sign.reshape(len(sign), BANDS, ROWS)
    key = np.full((len(sign), BANDS), np.uint64(0)) + np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sign[:, :, r])
    return key


def _bands(gram: int, buckets: int):
    """Band keys and marks (half a hash) of the lines, a row for each bucket of keys."""
    def packed(keys: list[np.ndarray], marks: list[np.ndarray]) -> pa.RecordBatch:
        key, mark = np.concatenate(keys), np.concatenate(marks)
        bucket = ((key >> np.uint64(8 * KEY_BYTES)) % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int32)
        order = np.argsort(bucket, kind="stable")  # 16 bits are sorted by radix
        bucket = bucket[order].astype(np.int32)
        first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        ends = np.append(first, len(bucket))
        low = np.ascontiguousarray(key[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES])
        column = lambda data, width: pa.Array.from_buffers(
            pa.binary(), len(first), [None, pa.py_buffer((ends * width).astype(np.int32)), pa.py_buffer(data)])
        return pa.RecordBatch.from_arrays(
            [pa.array(bucket[first]), column(low, KEY_BYTES), column(mark[order].astype("<u8"), 8)], names=["bucket", "keys", "marks"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, marks, held, seen = [], [], 0, set()
        for _, buf, offsets in slices(batches, "text", CHUNK):
            _, _, start, end = _bounds(buf, offsets)
            if not len(start):
                continue
            mark = _line_hash(buf, start, end)[:, 0]
            one = _fresh(mark, seen)  # equal lines have equal keys
            if not len(one):
                continue
            mark = mark[one]
            line, value = _grams(buf, start[one], end[one], gram)
            key = band_keys(signature(line, value, len(one), BANDS * ROWS))
            keys.append(key.reshape(-1))
            marks.append(np.repeat(mark, BANDS))
            held += key.size
            if held >= PACKED:
                yield packed(keys, marks)
                keys, marks, held = [], [], 0
        if held:
            yield packed(keys, marks)
    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each bucket (key, mark, number of marks) of the keys with several marks, sorted; rows come sorted by bucket."""
    def shared(bucket: int, keys: list[bytes], marks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        low = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, KEY_BYTES)
        key = np.zeros((len(low), 8), np.uint8)
        key[:, :KEY_BYTES] = low
        key = key.view("<u8").reshape(-1)
        mark = np.frombuffer(b"".join(marks), "<u8")
        order = np.argsort(key)
        key = key[order]
        same = key[1:] == key[:-1]
        twice = np.append(same, False) | np.append(False, same)[:len(key)]  # most keys are one line's alone
        key, mark = key[twice], mark[order][twice]
        order = np.lexsort((mark, key))
        key, mark = key[order], mark[order]
        new = np.append(True, (key[1:] != key[:-1]) | (mark[1:] != mark[:-1]))[:len(key)]
        key, mark = key[new], mark[new]
        _, at, size = np.unique(key, return_inverse=True, return_counts=True)
        size = size[at]
        some = size > 1
        return key[some] | np.uint64(bucket << 8 * KEY_BYTES), mark[some], size[some]

    now, keys, marks = None, [], []
    for batch in batches:
        for bucket, key, mark in zip(*(batch.column(c).to_pylist() for c in ("bucket", "keys", "marks")), strict=True):
            if bucket != now and keys:
                yield shared(now, keys, marks)
                keys, marks = [], []
            now = bucket
            keys.append(key)
            marks.append(mark)
    if keys:
        yield shared(now, keys, marks)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, mark, number of marks, at most FEW + 1) of the keys with several marks."""
    for key, mark, size in _shared(batches):
        yield pa.RecordBatch.from_arrays(
            [signed(key), signed(mark), pa.array(np.minimum(size, FEW + 1).astype(np.int32))], names=["key", "mark", "size"])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows as ``_met`` gives them, those of one key in one batch: (null, mark, other) of all pairs under the
    keys of a few marks, (key, mark, null) of the others."""
    for batch in batches:
        key, mark, size = (batch.column(c).to_numpy() for c in ("key", "mark", "size"))
        few = size <= FEW
        k, m = key[few], mark[few]
        ahead = [(m[:-d][same], m[d:][same]) for d in range(1, FEW) if (same := k[:-d] == k[d:]).any()]
        for a, b in ahead:
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(a), pa.int64()), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["key", "mark", "other"])
        if not few.all():
            k, m = key[~few], mark[~few]
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(m), pa.nulls(len(k), pa.int64())], names=["key", "mark", "other"])


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _pairs(_met(batches))


def _slots(met: DataFrame) -> np.ndarray:
    """Bits of the slots of all marks in ``met``. The driver gets 2^SLOT_BITS bits at most."""
    slot = met.select(F.explode(F.array("mark", "other")).alias("mark")).where("mark is not null") \
              .select(F.expr(f"mark & {2**SLOT_BITS - 1}").alias("slot"))
    words = slot.groupBy(F.shiftright("slot", 6).cast("int").alias("word")) \
                .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")).toArrow()
    bits = np.zeros(1 << SLOT_BITS - 6, np.int64)
    bits[words["word"].to_numpy()] = words["bits"].to_numpy()
    return bits.view(np.uint64)


def _line_texts(slots):
    """The lines whose slot is set (broadcast), with their hashes; a line that comes again soon is left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = slots.value, set()
        for _, buf, offsets in slices(batches, "text", CHUNK):
            _, _, start, end = _bounds(buf, offsets)
            value = _line_hash(buf, start, end)
            slot = value[:, 0] & np.uint64(2**SLOT_BITS - 1)
            pick = np.flatnonzero(bits[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1))
            if not len(pick):
                continue
            pick = pick[_fresh(value[pick, 0], seen)]
            raw = buf.tobytes()
            yield pa.RecordBatch.from_arrays(
                [_as_binary(value[pick]), signed(value[pick, 0].copy()),
                 pa.array([raw[a:b].decode() for a, b in zip(start[pick].tolist(), end[pick].tolist(), strict=True)], pa.string())],
                names=["hash", "mark", "text"])
    return run


def wide_bitmaps(line: np.ndarray, value: np.ndarray, n: np.ndarray) -> pa.Array:
    """Per line the parity of its gram count in each hash cell, as longs: about two cells a gram within LONGS, their
    number a power of two, so that a bitmap folds to half its size."""
    size = np.clip(1 << np.ceil(np.log2(np.maximum(n, 1) / 32)).clip(0).astype(np.int64), *LONGS)
    ends = np.cumsum(size)
    cell = (mix(value ^ np.uint64(0xE7037ED1A0B428DB)) & (64 * size[line] - 1).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(64 * (ends - size)[line] + cell, minlength=64 * int(size.sum())) & 1).astype(np.uint8)
    longs = np.packbits(odd, bitorder="little").view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(longs))


def _sets(gram: int):
    """Each line once (all rows of a hash come to one task), with its number of distinct grams and its bitmap."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            new = []
            for k, value in enumerate(batch.column("hash").to_pylist()):
                if value not in seen:
                    seen.add(value)
                    new.append(k)
            for rows, buf, offsets in slices(iter([batch.take(pa.array(new, pa.int64()))]), "text", CHUNK):
                line, value = _distinct(buf, offsets[:-1], offsets[1:], gram)
                n = np.bincount(line, minlength=rows.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(c) for c in ("hash", "mark", "text")), pa.array(n), wide_bitmaps(line, value, n)],
                    names=["hash", "mark", "text", "n", "wide"])
    return run


def _fits(percent: int):
    """Gram counts and bitmaps, compared inside the join: lines that share a band by chance make no pair. A bit that
    differs stands for at least one gram that only one of the lines has."""
    def fits(x: str, y: str) -> Column:
        n1, n2 = F.col(f"{x}.n"), F.col(f"{y}.n")
        return (100 * n1 >= percent * n2) & (100 * n2 >= percent * n1) & \
               ((100 + percent) * _wide_apart(x, y) <= (100 - percent) * (n1 + n2))
    return fits


def _similar(gram: int, percent: int):
    def both(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], rows: int) -> np.ndarray:
        x, y = (_packed(buf, offsets[:-1], offsets[1:], gram) for buf, offsets in (a, b))
        all_keys = np.concatenate([x, y])
        all_keys.sort()
        n, common = (np.bincount((k >> np.uint64(CODE_BITS)).astype(np.int64), minlength=rows)
                     for k in (all_keys, all_keys[1:][all_keys[1:] == all_keys[:-1]]))
        return 100 * common >= percent * (n - common)

    def each(a: list[str], b: list[str]) -> np.ndarray:
        keep = np.zeros(len(a), bool)
        for i, (s, t) in enumerate(zip(a, b, strict=True)):
            s, t = s.encode(), t.encode()
            x = {s[k:k + gram] for k in range(max(1, len(s) - gram + 1))}
            y = {t[k:k + gram] for k in range(max(1, len(t) - gram + 1))}
            keep[i] = 100 * len(x & y) >= percent * len(x | y)
        return keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, offsets in slices(batches, "text_a", CHUNK):
            if gram > PACK:
                keep = each(rows.column("text_a").to_pylist(), rows.column("text_b").to_pylist())
            else:
                _, *other = next(slices(iter([rows]), "text_b", 1 << 62))
                keep = both((buf, offsets), tuple(other), rows.num_rows)
            yield rows.select(["a", "b"]).filter(pa.array(keep))
    return run


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_lines, n_removed, kept, sha = [], [], [], []
        for text, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist(), strict=True):
            lines = [] if text is None else text.split("\n")
            drop = set(gone or ())
            left = "\n".join(x for i, x in enumerate(lines) if i not in drop)
            n_lines.append(len(lines))
            n_removed.append(len(drop))
            kept.append(None if text is None else left)
            sha.append(hashlib.sha256(left.encode()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64()), batch.column("gone"),
             pa.array(kept, pa.string()), pa.array(sha, pa.string())],
            names=["doc_id", "n_lines", "n_removed", "removed_lines", "kept_text", "kept_sha256"])


def dedup(docs: DataFrame, gram: int = GRAM, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_lines, n_removed, removed_lines (numbers from
    0, null where none), kept_text and its kept_sha256."""
    spark, id_type = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", text_key(F.col("text")).alias("_th"), "text")
    lines = cut(keyed.mapInArrow(_lines, f"doc_id {id_type}, _th long, line int, hash binary"))
    # band keys shared by different lines; the mark is half of a line's hash
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bands = docs.select("text").mapInArrow(_bands(gram, parts * SPREAD), "bucket int, keys binary, marks binary")
    met = cut(bands.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_candidates, "key long, mark long, other long"))
    # the lines themselves, each once
    slots = spark.sparkContext.broadcast(_slots(met))
    sets = cut(docs.select("text").mapInArrow(_line_texts(slots), "hash binary, mark long, text string").repartition(parts, "hash")
               .mapInArrow(_sets(gram), "hash binary, mark long, text string, n long, wide array<long>")
               .withColumn("node", F.monotonically_increasing_id()))  # short numbers for the rounds of linking

    def verify(pairs: DataFrame) -> DataFrame:
        asked = of_pairs(sets, pairs)
        one = asked.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
        two = asked.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
        return pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b") \
                    .mapInArrow(_similar(gram, percent), "a long, b long")

    fits = _fits(percent)
    one, two = (sets.select(F.col("mark").alias(c), F.struct("node", "n", "wide").alias(s)) for c, s in (("mark", "x"), ("other", "y")))
    tested = cut(met.where("other is not null").select("mark", "other").distinct().join(one, "mark").join(two, "other")
                 .where(fits("x", "y")).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")))
    edges = cut(verify(tested))
    keys = cut(met.where("other is null").join(sets.select("mark", "node", "n", "wide"), "mark").select("key", "node", "n", "wide"))
    uncut(met)
    _, roots = link(keys, fits, verify, tested=tested, edges=edges)
    # of a linked line the first line of its component stays, of a repeated one its own first place
    members = roots.unionByName(roots.select(F.col("root").alias("node"), "root")).distinct()  # a root is no node of its own
    hashes = sets.select("node", "hash")
    members = cut(members.join(hashes, "node").join(hashes.select(F.col("node").alias("root"), F.col("hash").alias("first")), "root")
                  .select("hash", "first"))
    uncut(sets, keys, tested, edges)
    again = lines.groupBy("hash").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("hash")
    rooted = cut(again.join(members, "hash", "full").select("hash", F.coalesce("first", "hash").alias("root")))
    rows = cut(lines.join(rooted.hint("shuffle_hash"), "hash").select("root", "doc_id", "_th", "line"))
    uncut(lines, rooted, members)
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "_th", "line")
    stays = cut(rows.groupBy("root").agg(F.min(place).alias("stay")))
    gone = rows.join(stays, "root").where(place != F.col("stay"))  # repeated rows have the same places
    per_doc = cut(gone.groupBy("doc_id", "_th").agg(F.sort_array(F.collect_set("line")).alias("gone")))
    uncut(rows, stays)
    return keyed.join(per_doc.hint("shuffle_hash"), same_doc(keyed, per_doc), "left").select(keyed["doc_id"], "text", "gone").mapInArrow(
        _kept, f"doc_id {id_type}, n_lines long, n_removed long, removed_lines array<int>, kept_text string, kept_sha256 string")
