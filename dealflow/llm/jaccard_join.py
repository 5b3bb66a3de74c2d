"""N-gram Jaccard join with rare-first prefix filtering (operator 8).

Texts become sets of hashed word n-grams; equal sets are one node (a 128-bit signature). For
a threshold t, similar sets of size n share a gram among the first n - ceil(t n) + 1 in any one
global order. The order is rare first: by level of a hashed document-frequency table that is
counted over all sets and has a fixed size, then by hash. Candidates that share a prefix gram
pass, inside the join, the length filter, the positional filter (grams still to come on both
sides). Then come a bitmap filter (each set has a bitmap of the parity of its grams per hash cell,
and bits that differ are grams of one set alone; inside the join for grams of many sets, once per
pair for the others) and the suffix filter: both sets are split into cells by hash, and the smaller
count of each cell bounds the overlap. Large sets that pass have a second bitmap compared, as large
as they are. Only pairs that pass all have their texts compared, once per pair. ``links`` keeps groups of near copies from pairing all with all.

Null texts, and texts without words, have the empty set and are linked with nothing; with fewer
words than n the whole sequence is the one gram. Null ids are allowed: a component's id is its
least non-null id. Repeated rows have equal sets and so lie in one component.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dealflow.llm.common import cut, in_buckets, is_empty, of_pairs, restrict, text_key, uncut
from dealflow.llm.links import FEW, few_pairs, link
from dealflow.llm.tokens import FIRST, LOWER, Grams, Words, mix, signed, slices

NGRAM, PERCENT = 3, 90
#: The document-frequency table: counters, and blocks in which they are summed.
DF_BITS, DF_BLOCKS = 20, 64
#: Cells of the suffix filter: grams are counted by the top bits of a mixed hash.
CELL_BITS = 5
#: Longs of a set's parity bitmap.
BITMAP = [f"bits{i}" for i in range(4)]
#: What ``_signatures`` says of a row besides its id.
SIGNED = ", ".join(["_th long, node binary, mark long, n long, cells array<int>, wide array<long>", *(f"{b} long" for b in BITMAP)])


def gram_sets(buf: np.ndarray, offsets: np.ndarray, ngram: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of the distinct n-grams of each text, sorted by text."""
    words = Words(LOWER[buf], offsets)
    n = np.diff(words.first)
    count = np.where(n >= ngram, n - ngram + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(n)), count)
    start = np.repeat(words.first[:-1], count) + _within(count)
    size = np.minimum(n, ngram)[doc]
    value = Grams(words.hashes(FIRST), FIRST)(start, size)
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[new], value[new]


def _within(count: np.ndarray) -> np.ndarray:
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count, count)


def signatures(doc: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
    """Two independent 64-bit hashes of each set."""
    n = np.bincount(doc, minlength=rows)
    ends = np.cumsum(n)
    sign = np.zeros((rows, 2), np.uint64)
    for k, salt in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(value ^ np.uint64(salt)))])
        sign[:, k] = mix(sums[ends] - sums[ends - n] + n.astype(np.uint64))
    return sign


def bitmaps(doc: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
    """Per set, the parity of its gram count in each of 64 * len(BITMAP) hash cells, as longs."""
    width = 64 * len(BITMAP)
    cell = (mix(value ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(width)).astype(np.int64)
    odd = (np.bincount(doc * width + cell, minlength=rows * width) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64).reshape(rows, len(BITMAP))


def wide_bitmaps(doc: np.ndarray, value: np.ndarray, n: np.ndarray) -> pa.Array:
    """The parity bitmaps of sets too large for the fixed one, as longs: a cell for each gram at least, their number a
    power of two, so that a bitmap folds to half its size. Smaller sets have none."""
    size = np.where(n > 64 * len(BITMAP), 1 << np.ceil(np.log2(np.maximum(n, 1) / 64)).astype(np.int64), 0)
    ends = np.cumsum(size)
    large = size[doc] > 0
    doc, value = doc[large], value[large]
    cell = (mix(value ^ np.uint64(0xE7037ED1A0B428DB)) & (64 * size[doc] - 1).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(64 * (ends - size)[doc] + cell, minlength=64 * int(size.sum())) & 1).astype(np.uint8)
    longs = np.packbits(odd, bitorder="little").view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(longs))


def _as_binary(sign: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(
        pa.binary(16), len(sign), [None, pa.py_buffer(sign.tobytes())]).cast(pa.binary())


def _signatures(ngram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, offsets in slices(batches):
            doc, value = gram_sets(buf, offsets, ngram)
            sign = signatures(doc, value, rows.num_rows)
            n, width = np.bincount(doc, minlength=rows.num_rows), 1 << CELL_BITS
            cell = doc * width + (mix(value) >> np.uint64(64 - CELL_BITS)).astype(np.int64)
            cells = np.bincount(cell, minlength=rows.num_rows * width).astype(np.int32)
            ends = pa.array(np.arange(0, len(cells) + 1, width, dtype=np.int32))
            bits = bitmaps(doc, value, rows.num_rows)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("_th"), _as_binary(sign), signed(sign[:, 0].copy()), pa.array(n),
                 pa.ListArray.from_arrays(ends, pa.array(cells)), wide_bitmaps(doc, value, n), *(pa.array(b) for b in bits.T)],
                names=["doc_id", "_th", "node", "mark", "n", "cells", "wide", *BITMAP])
    return run


def _frequencies(ngram: int):
    """Hashed document counts of a partition, one row per block of counters."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << DF_BITS, np.int64)
        for _, buf, offsets in slices(batches):
            _, value = gram_sets(buf, offsets, ngram)
            counts += np.bincount((value >> np.uint64(64 - DF_BITS)).astype(np.int64), minlength=1 << DF_BITS)
        blocks = counts.reshape(DF_BLOCKS, -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(DF_BLOCKS), pa.int32()), pa.array([b.tobytes() for b in blocks], pa.binary())],
            names=["block", "counts"])
    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            have = total.setdefault(block, np.zeros((1 << DF_BITS) // DF_BLOCKS, np.int64))
            have += np.frombuffer(counts, np.int64)
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())],
        names=["block", "counts"])


def rarity(docs: DataFrame, ngram: int = NGRAM) -> np.ndarray:
    """Level of each counter of the frequency table (one byte each, 2^DF_BITS in all): 8 log2(1 + count)."""
    schema = "block int, counts binary"
    rows = docs.select("text").mapInArrow(_frequencies(ngram), schema) \
               .repartition(DF_BLOCKS, "block").mapInArrow(_summed, schema).collect()  # DF_BLOCKS rows of fixed size
    levels = np.zeros((DF_BLOCKS, (1 << DF_BITS) // DF_BLOCKS), np.uint8)
    for r in rows:
        levels[r["block"]] = np.minimum(255, 8 * np.log2(1 + np.frombuffer(r["counts"], np.int64)))
    return levels.reshape(-1)


def _prefixes(ngram: int, percent: int, table):
    """The prefix of each set: (gram, half a signature, place in the rare-first order, size of the set)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, buf, offsets in slices(batches):
            doc, value = gram_sets(buf, offsets, ngram)
            n = np.bincount(doc, minlength=len(offsets) - 1)
            sign = signatures(doc, value, len(n))
            rare = table.value[(value >> np.uint64(64 - DF_BITS)).astype(np.int64)]
            value = value[np.lexsort((value, rare, doc))]
            at, size = _within(n), n[doc]
            head = np.flatnonzero(at < size - (size * percent + 99) // 100 + 1)
            yield pa.RecordBatch.from_arrays(
                [signed(value[head]), signed(sign[doc[head], 0]), pa.array(at[head].astype(np.int32)),
                 pa.array(size[head].astype(np.int32))], names=["key", "mark", "pos", "n"])
    return run


def needed(n1, n2, percent: int):
    """Shared grams that sets of these sizes need: ceil(percent (n1 + n2) / (100 + percent))."""
    return F.floor((percent * (n1 + n2) + 99 + percent) / (100 + percent))


def _near(percent: int):
    def near(x: str, y: str):
        n1, n2, p1, p2 = (F.col(f"{s}.{c}") for c in ("n", "pos") for s in (x, y))
        length = (100 * n1 >= percent * n2) & (100 * n2 >= percent * n1)
        # before this gram at most min(p1, p2) are shared, after it what is left of either
        return length & (F.least(p1, p2) + 1 + F.least(n1 - p1 - 1, n2 - p2 - 1) >= needed(n1, n2, percent))
    return near


def bits_allow(percent: int, x: str, y: str) -> Column:
    """A bit that differs stands for at least one gram that only one of the sets has."""
    n1, n2 = F.col(f"{x}.n"), F.col(f"{y}.n")
    apart = sum(F.bit_count(F.col(f"{x}.{b}").bitwiseXOR(F.col(f"{y}.{b}"))) for b in BITMAP)
    return apart <= n1 + n2 - 2 * needed(n1, n2, percent)


def _wide_apart(x: str, y: str):
    """Bits that differ between the wide bitmaps, the larger one folded to the other's size; 0 where a set has none
    or one fold is not enough."""
    def fold(c):
        half = (F.size(c) / 2).cast("int")
        return F.zip_with(F.slice(c, F.lit(1), half), F.slice(c, half + 1, half), lambda i, j: i.bitwiseXOR(j))
    one, two = F.col(f"{x}.wide"), F.col(f"{y}.wide")
    p = F.when(F.size(one) == 2 * F.size(two), fold(one)).otherwise(one)
    q = F.when(F.size(two) == 2 * F.size(one), fold(two)).otherwise(two)
    count = F.aggregate(F.zip_with(p, q, lambda i, j: F.bit_count(i.bitwiseXOR(j))), F.lit(0), lambda s, i: s + i)
    return F.when((F.least(F.size(one), F.size(two)) > 0) & (F.size(p) == F.size(q)), count).otherwise(F.lit(0))


def _fits(percent: int):
    near = _near(percent)
    return lambda x, y: near(x, y) & bits_allow(percent, x, y)


def _first_shared(x: str, y: str):
    """Not true where the gram before this one is shared too: the pair is met there already."""
    return ~F.coalesce(F.col(f"{x}.earlier") == F.col(f"{y}.earlier"), F.lit(False))


def _similar(ngram: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for s in _by_bytes(batch):
                sets = [[], []]
                for k, name in enumerate(("text_a", "text_b")):
                    for _, buf, offsets in slices(iter([s.select([name])]), name, 1 << 62):
                        doc, value = gram_sets(buf, offsets, ngram)
                        sets[k] = np.split(value, np.searchsorted(doc, np.arange(1, s.num_rows)))
                for a, b in zip(*sets, strict=True):
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def _by_bytes(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for rows, _, _ in slices(iter([batch]), "text_a"):
        yield rows


class Verifier:
    """Exact check of candidate pairs. Only the texts of pairs that the filters allow are shuffled, those of
    one call, and from ``keyed`` itself: no round moves a text that an earlier one has asked for."""

    def __init__(self, keyed: DataFrame, sets: DataFrame, ngram: int, percent: int):
        self.keyed, self.sets, self.ngram, self.percent = keyed, sets, ngram, percent
        self.repeated = repeated(keyed)

    def __call__(self, pairs: DataFrame) -> DataFrame:
        left = self.allowed(pairs, "node")
        out = cut(self.similar(left))
        uncut(left)
        return out

    def allowed(self, pairs: DataFrame, by: str) -> DataFrame:
        """Nodes (a, b) of the pairs, given by the column ``by`` of the sets, that bitmaps and cells allow, with
        a document of each (x, y)."""
        what = ["node", "n", "cells", *BITMAP]
        one = self.sets.select(F.col(by).alias("a"), F.struct(*what).alias("x"))
        two = self.sets.select(F.col(by).alias("b"), F.struct(*what).alias("y"))
        shared = F.aggregate(F.zip_with("x.cells", "y.cells", lambda i, j: F.least(i, j)), F.lit(0), lambda s, i: s + i)
        close = cut(pairs.join(one, "a").join(two, "b")
                    .where(bits_allow(self.percent, "x", "y") & (shared >= needed(F.col("x.n"), F.col("y.n"), self.percent)))
                    .select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")))
        # long sets fill the fixed bitmap and the cells: theirs are compared where both allow the pair
        asked = of_pairs(self.sets, close)
        x, y = (asked.select(F.col("node").alias(k), F.struct("n", "doc_id", "_th", "wide").alias(s)) for k, s in ("ax", "by"))
        far = _wide_apart("x", "y") > F.col("x.n") + F.col("y.n") - 2 * needed(F.col("x.n"), F.col("y.n"), self.percent)
        out = cut(close.join(x, "a").join(y, "b").where(~far)
                  .select("a", "b", *[F.struct(f"{k}.doc_id", f"{k}._th").alias(k) for k in "xy"]))
        uncut(close)
        return out

    def similar(self, left: DataFrame) -> DataFrame:
        """(a, b) of the pairs from ``allowed`` whose sets are similar."""
        if is_empty(left):
            return left.select("a", "b")
        near = in_buckets(self.keyed, left.select("x._th").unionByName(left.select("y._th")))
        # rows equal in id and text hold one set: its text is read once
        near = (near.dropDuplicates(["doc_id", "_th"]) if self.repeated else near).select("doc_id", "_th", "text")
        one, two = (near.select(*[F.col(c).alias(f"{c}_{s}") for c in near.columns]) for s in "ab")
        here = lambda at, s: (F.col(f"{at}._th") == F.col(f"_th_{s}")) & F.col(f"{at}.doc_id").eqNullSafe(F.col(f"doc_id_{s}"))
        return left.join(one, here("x", "a")).drop("doc_id_a", "_th_a", "x").join(two, here("y", "b")) \
                   .select("a", "b", "text_a", "text_b").mapInArrow(_similar(self.ngram, self.percent), "a binary, b binary")


def linked(docs: DataFrame, ngram: int = NGRAM, percent: int = PERCENT, every_link: bool = False) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, _th, n_shingles, node (signature of its set),
    root (signature that stands for its component), component_id (least doc_id of it).

    With ``every_link`` also n_links: how many other texts are similar to the row's, each counted
    once however many rows hold it. Every candidate pair is then verified, also inside components,
    so a group of m near copies costs up to m(m-1)/2 pairs; without it, pairs that are already in
    one component are not met, which is enough for the components only."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", text_key(F.col("text")).alias("_th"), "text")
    slim = cut(keyed.mapInArrow(_signatures(ngram), f"doc_id {id_type}, {SIGNED}"))
    # prefix grams that different sets share
    table = docs.sparkSession.sparkContext.broadcast(rarity(docs, ngram))  # 2^DF_BITS bytes, whatever the input
    keys = cut(docs.select("text").mapInArrow(_prefixes(ngram, percent, table), "key long, mark long, pos int, n int"))
    shared = cut(keys.groupBy("key").agg(F.min("mark").alias("lo"), F.max("mark").alias("hi"), F.count(F.lit(1)).alias("size"))
                 .where("lo != hi").select("key", F.least("size", F.lit(FEW + 1)).cast("int").alias("size")))
    met = cut(keys.join(shared, "key").distinct())
    uncut(keys, shared)
    # one row for each set that shares a gram, with a document to read it from
    who = slim.where("n > 0").join(met.select("mark").distinct(), "mark")
    sets = cut(who.groupBy("node", "mark", "n").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_th")).alias("r"), *(F.any_value(c).alias(c) for c in ("cells", "wide")),
        *(F.any_value(b).alias(b) for b in BITMAP))
        .select("node", "mark", "n", "cells", "wide", *BITMAP, "r.doc_id", "r._th"))
    verify = Verifier(keyed, sets, ngram, percent)
    # grams of a few sets: all their pairs, by marks; a mark stands for every set that has it
    tested = verify.allowed(few_pairs(met, "mark", _near(percent)), "mark")
    edges = cut(verify.similar(tested))
    tested = tested.select("a", "b")
    # grams of many sets
    earlier = F.lag("key").over(Window.partitionBy("mark", "node").orderBy("pos", "key"))
    chosen = cut(met.where(F.col("size") > FEW).drop("n", "size").join(sets.select("mark", "node", "n", *BITMAP), "mark")
                 .select("key", "node", "pos", "n", *BITMAP, earlier.alias("earlier")))
    uncut(met)
    rounds = {"star_rounds": 0} if every_link else {}  # without star rounds all pairs are met at once
    edges, roots = link(chosen, _fits(percent), verify, _first_shared, tested=tested, edges=edges, **rounds)
    uncut(chosen, sets)
    roots = cut(roots)
    rooted = slim.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    counted = []
    if every_link:
        rooted = rooted.join(link_counts(slim, edges), "node", "left")
        counted = [F.when(F.col("n") > 0, F.col("n_links")).otherwise(F.lit(0).cast("long")).alias("n_links")]
    least = cut(rooted.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("component_id")))
    return rooted.join(least, "root", "left").select(
        "doc_id", "_th", F.col("n").alias("n_shingles"), "node", "root",
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), *counted)


def link_counts(slim: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, n_links) of every set with grams: the texts of the sets linked with it, and the other
    texts of its own set."""
    texts = cut(slim.where("n > 0").select("node", "_th").distinct().groupBy("node").agg(F.count(F.lit(1)).alias("texts")))
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    other = texts.select(F.col("node").alias("b"), "texts")
    far = both.join(other, "b").groupBy(F.col("a").alias("node")).agg(F.sum("texts").alias("far"))
    return cut(texts.join(far, "node", "left").select(
        "node", (F.col("texts") - 1 + F.coalesce("far", F.lit(0).cast("long"))).alias("n_links")))


def repeated(slim: DataFrame) -> bool:
    """Whether some rows agree in id and text."""
    return slim.groupBy("doc_id", "_th").agg(F.count(F.lit(1)).alias("c")).where("c > 1").limit(1).count() > 0


def one_of_each(docs: DataFrame, ngram: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` with one document left of each component: that with the least id (of
    equal ids the least text hash; of rows equal in both, one). Empty documents all stay."""
    spread = cut(linked(docs, ngram, percent).select("doc_id", "_th", "root", "n_shingles"))
    best = spread.where("n_shingles > 0").groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_th")).alias("r")).select("r.doc_id", "r._th")
    best = cut(best)
    twice = repeated(spread.where("n_shingles > 0"))
    empty = spread.where("n_shingles = 0").select("doc_id", "_th").distinct()
    stay = cut(best.select("doc_id", "_th"))
    if not twice:
        return restrict(docs, stay.unionByName(empty), "left_semi")
    # rows equal in id and text: one of them stays
    filled = restrict(docs, stay, "left_semi")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    one = filled.select(row, "doc_id", text_key(F.col("text")).alias("_th")).dropDuplicates(["doc_id", "_th"]).select("_row.*")
    return one.unionByName(restrict(docs, empty, "left_semi"))
