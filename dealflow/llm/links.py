"""Distributed linking of near-duplicates: candidate pairs from shared keys without all pairs
of a group, and union-find over the links.

Candidates come as a table (key, node): nodes under one key may be similar. Keys of a few nodes
(``FEW``) are settled first and once for all: every pair of such a key is met. The others go
through star rounds, in which every node of a key is paired with some centres of that key;
verified pairs become links. Later rounds look only at keys whose nodes are still in different
components, and the last round pairs all nodes of a key that lie in different components. Two
nodes in one component need no pair, so a group of thousands of near copies costs pairs in
proportion to its size, while no link that could join two components is missed.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealflow.llm.common import cut, is_empty, uncut

#: Star rounds before the round over all remaining pairs, and the centres of a key in each.
STAR_ROUNDS, CENTRES = 2, (1, 16)
#: A key of at most so many rows has all its pairs met at once.
FEW = 8


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b): root is the least node of its component.

    Large-star and small-star steps alternate until every component is a star around its least node; the
    number of rounds grows with the logarithm of the longest path, every step is a shuffle over the edges."""
    edges = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                .where("u != v").distinct())
    while not is_empty(_astray(edges)):
        # large star: each node's larger neighbours move to the least node around it
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = cut(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        # small star: each node's smaller neighbours and itself move to the least of them
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        uncut(edges, least, large, low)
        edges = new
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _astray(edges: DataFrame) -> DataFrame:
    """The nodes of ``edges`` (u, v), all different, v < u, that have several smaller neighbours, or smaller and larger ones."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 or down = 1 and up = 1")


def few_pairs(keys: DataFrame, node: str, fits: Callable[[str, str], Column]) -> DataFrame:
    """(a, b) of all pairs that fit under the keys of a few rows; ``keys``: (key, ``node``, size, ...), written
    already, ``size`` at least the number of nodes under the key."""
    few = keys.where(F.col("size") <= FEW)
    return few.alias("x").join(few.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col(f"x.{node}") < F.col(f"y.{node}"))
                               & fits("x", "y")).select(F.col(f"x.{node}").alias("a"), F.col(f"y.{node}").alias("b")).distinct()


def link(keys: DataFrame, fits: Callable[[str, str], Column],
         verify: Callable[[DataFrame], DataFrame], once: Callable[[str, str], Column] | None = None,
         star_rounds: int = STAR_ROUNDS, tested: DataFrame | None = None,
         edges: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Links among nodes that share a key.

    ``keys``: (key, node, ...), written already; ``fits(x, y)``: condition on two rows of a key, by
    alias, that a similar pair always meets; ``verify(pairs)``: the rows (a, b) of similar pairs;
    ``once(x, y)``: condition that holds at one common key of a similar pair at least, and spares the
    last round most repeats of a pair; ``tested`` and ``edges``: pairs (a, b) that were verified
    before, and those of them that are similar (both written already).
    Without star rounds all pairs are met, also those inside a component.
    Returns (edges (a, b), roots (node, root))."""
    roots = None if edges is None or is_empty(edges) else components(edges)
    for turn in range(star_rounds + 1):
        rows = keys.withColumn("comp", F.col("node")) if roots is None or not star_rounds else \
            keys.join(roots, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
        rows = rows.withColumns({"_c": F.xxhash64("comp"), "_p": F.xxhash64("node", F.lit(turn))})
        # keys whose nodes lie in different components
        split = cut(rows.groupBy("key").agg(F.min("_c").alias("lo"), F.max("_c").alias("hi"))
                    .where("lo != hi").select("key"))
        if is_empty(split):
            break
        open_rows = cut(rows.join(split, "key"))
        other = open_rows
        if turn < star_rounds:  # the centres of each key: the least of each of so many parts of its nodes
            slot = F.pmod(F.xxhash64("node", F.lit(-1 - turn)), F.lit(CENTRES[min(turn, len(CENTRES) - 1)]))
            least = open_rows.groupBy("key", slot.alias("_slot")).agg(F.min("_p").alias("_p")).drop("_slot")
            other = cut(open_rows.join(least, ["key", "_p"]).select(open_rows.columns))
        differ = F.col("x._c") < F.col("y._c") if turn == star_rounds else F.col("x._c") != F.col("y._c")
        if turn == star_rounds and once is not None:
            differ = differ & once("x", "y")
        pairs = open_rows.alias("x").join(other.alias("y"), (F.col("x.key") == F.col("y.key")) & differ & fits("x", "y")).select(
            F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = cut(pairs)
        found = cut(verify(pairs))
        uncut(split, open_rows, *([other] if other is not open_rows else []))
        tested = pairs if tested is None else tested.unionByName(pairs)
        edges = found if edges is None else edges.unionByName(found)
        if not is_empty(found):  # a component that is known already is as well linked by its root
            roots = components(found if roots is None else found.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    if edges is None:
        node = keys.schema["node"].dataType.simpleString()
        edges = keys.sparkSession.createDataFrame([], f"a {node}, b {node}")
    if roots is None:
        roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return edges, roots
