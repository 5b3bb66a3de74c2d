"""Hilbert-curve sharding (operator 10; DataFrame functions only).

Several metadata dimensions are quantised to small integers, the rows are sorted by their
index on the Hilbert curve through that grid, and the sorted sequence is cut into runs of
equal row counts. Rows of a run lie close together in every dimension, so the files that
``write_shards`` makes per shard have narrow ranges in all of them and a filter on any dimension
skips most files. ``shard`` gives the placement alone, ``sharded`` the whole rows with it.

Null, empty and very long texts, null sources and languages are values like any other; equal
rows lie next to each other; the law is ``rows``: shard counts differ by one at most.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealflow.llm.common import cut, ranked, text_key

BITS = 8
#: What the placement says of a row besides its id.
PLACEMENT = ("_th", "size", "text_crc32", "hilbert", "law", "shard", "slot", "grown_shard")


def size_level(size: Column, bits: int = BITS) -> Column:
    """Logarithmic level of a byte size, eight levels to a doubling."""
    return F.least(F.floor(F.log2(size.cast("double")) * 8), F.lit((1 << bits) - 1)).cast("long")


def label_level(label: Column, bits: int = BITS) -> Column:
    """A label's cell: equal labels share it, null has one too."""
    return F.pmod(F.xxhash64(label), F.lit(1 << bits))


def with_hilbert(df: DataFrame, dims: list[Column], bits: int = BITS, name: str = "hilbert") -> DataFrame:
    """``df`` with each row's position on the Hilbert curve of ``len(dims)`` dimensions.

    The published transposed form: from the highest bit down, exchange or invert the low bits
    of the axes, then Gray-code, then interleave the bits. Each step is a projection of plain
    integer expressions, so the whole chain runs as generated code."""
    n, axis = len(dims), [f"_axis{i}" for i in range(len(dims))]
    bit = lambda c, b: F.col(c).bitwiseAND(F.lit(1 << b)) != 0
    df = df.withColumns({a: d.cast("long") for a, d in zip(axis, dims, strict=True)})
    for b in range(bits - 1, 0, -1):
        low = F.lit((1 << b) - 1)
        df = df.withColumn(axis[0], F.when(bit(axis[0], b), F.col(axis[0]).bitwiseXOR(low)).otherwise(F.col(axis[0])))
        for a in axis[1:]:
            swap = F.col(axis[0]).bitwiseXOR(F.col(a)).bitwiseAND(low)
            df = df.withColumns({
                axis[0]: F.when(bit(a, b), F.col(axis[0]).bitwiseXOR(low)).otherwise(F.col(axis[0]).bitwiseXOR(swap)),
                a: F.when(bit(a, b), F.col(a)).otherwise(F.col(a).bitwiseXOR(swap))})
    for a, c in zip(axis, axis[1:], strict=False):
        df = df.withColumn(c, F.col(c).bitwiseXOR(F.col(a)))
    turn = F.lit(0).cast("long")
    for b in range(bits - 1, 0, -1):
        turn = turn.bitwiseXOR(F.when(bit(axis[-1], b), F.lit((1 << b) - 1)).otherwise(F.lit(0)))
    df = df.withColumn("_turn", turn)
    df = df.withColumns({a: F.col(a).bitwiseXOR(F.col("_turn")) for a in axis})
    index = F.lit(0).cast("long")
    for b in range(bits):
        for i, a in enumerate(axis):
            index = index + F.shiftleft(F.shiftright(a, b).bitwiseAND(F.lit(1)), b * n + n - 1 - i)
    return df.withColumn(name, index).drop("_turn", *axis)


def shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Place every row of ``docs`` (doc_id, text, lang, source), without its text.

    Returns doc_id, _th (text hash), size, text_crc32, hilbert, law, shard, slot, grown_shard;
    ``slot`` numbers a shard's rows from 0 along the curve."""
    slim = cut(_on_curve(docs).drop("lang", "source"))
    return _dealt(slim, shards).select("doc_id", *PLACEMENT)


def placement_names(columns: list[str]) -> dict[str, str]:
    """The names of the placement columns beside ``columns``: their own, with ``placed_`` before them as
    often as it takes to be new."""
    taken, out = {c.lower() for c in columns}, {}
    for c in PLACEMENT:
        out[c] = c
        while out[c].lower() in taken:
            out[c] = "placed_" + out[c]
        taken.add(out[c].lower())
    return out


def sharded(docs: DataFrame, shards: int = 8) -> DataFrame:
    """The whole rows of ``docs`` with their placement: the columns of ``shard``, named by
    ``placement_names``.

    The rows themselves go through the sort by rank, so equal rows need no key to get their places back."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    names = [F.col(c).alias(name) for c, name in placement_names(docs.columns).items()]
    return _dealt(_on_curve(docs, row).drop("lang", "source"), shards).select("_row.*", *names)


def write_shards(docs: DataFrame, path: str, shards: int = 8) -> None:
    """Write ``sharded`` as Parquet, a folder per shard (``shard=0``, ...), each file a run of slots
    sorted along the curve."""
    placed, names = sharded(docs, shards), placement_names(docs.columns)
    shard_, slot = names["shard"], names["slot"]
    placed.repartitionByRange(shard_, slot).sortWithinPartitions(shard_, slot).write.partitionBy(shard_).parquet(path)


def _on_curve(docs: DataFrame, *more: Column) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", text_key(F.col("text")).alias("_th"),
                       (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"),
                       "lang", "source", *more)
    return with_hilbert(slim, [size_level(F.col("size")), label_level(F.col("source")), label_level(F.col("lang"))])


def _dealt(slim: DataFrame, shards: int) -> DataFrame:
    order = ["hilbert", "size", "_th", "doc_id"]
    placed = ranked(slim, *map(F.col, order))
    total = placed.agg(F.count(F.lit(1)).alias("n")).scalar()
    # shard k holds the ranks from ceil(k * total / shards) on, so counts differ by one at most
    at = F.expr(f"(_rank * {shards}L) div n_total")
    return (placed.withColumn("n_total", total).withColumn("_shard", at)
            .withColumn("_from", F.expr(f"(_shard * n_total + {shards - 1}L) div {shards}L"))
            .withColumns({"law": F.lit("rows"), "shard": F.col("_shard").cast("int"),
                          "slot": F.col("_rank") - F.col("_from"), "grown_shard": F.lit(None).cast("int")}))
