"""Mixing sources to target weights by capped water-filling (operator 2; DataFrame functions only).

Each source gets a share of the wanted words by weight. A source whose share would repeat its
words more than ``max_epochs`` times is clamped there and its excess goes to the others in
proportion to their weights, until no source is above its cap. A source is then taken a
whole number of times plus a seeded fraction of its documents.

Null text has size 0; null is a source of its own, last in order; a source without words has
target 0; repeated rows (equal id and text) are taken or left together.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dealflow.llm.common import cut, ranked, words

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = 17
#: A source's documents are dealt by seeded hash into so many cells; running totals go over
#: cells, and over documents only inside the one cell where the fraction ends.
CELL_BITS = 12


def draw(seed: int) -> Column:
    """Seeded 63-bit number of a document; depends on its id and text alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")), 1)


def sized(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, source, size and draw of every document (one scan of the texts, written once)."""
    return cut(docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"),
                           draw(seed).alias("_u")))


def targets(slim: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
            max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, weight, target (words) of every source."""
    totals = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = ranked(totals, F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int"))
    table = cut(order.select("source", "source_size", weight.alias("weight"),
                             (F.col("source_size") * F.lit(float(max_epochs))).alias("cap")))
    wanted = (table.agg(F.sum("source_size")).first()[0] or 0) * share
    level, clamped = 0.0, -1
    while True:  # each turn clamps at least one more source, or ends
        above = F.col("weight") * F.lit(level) >= F.col("cap")
        n, held, free = table.agg(F.count(F.when(above, 1)), F.sum(F.when(above, F.col("cap"))),
                                  F.sum(F.when(~above, F.col("weight")))).first()
        if n == clamped or not free:
            break
        clamped, level = n, max(level, (wanted - (held or 0.0)) / free)
    target = F.least(F.col("cap"), F.col("weight") * F.lit(level)) if free else F.col("cap")
    return table.select("source", "source_size", "weight", target.alias("target"))


def repetitions(slim: DataFrame, goal: DataFrame) -> DataFrame:
    """Per source: target, ``whole`` repetitions of every document, and ``_until``, the draw up
    to which documents are taken once more."""
    goal = goal.withColumn("_epochs", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size"))
                           .otherwise(F.lit(0.0))) \
               .withColumn("whole", F.floor("_epochs").cast("int"))
    goal = cut(goal.withColumn("_rest", F.col("target") - F.col("whole") * F.col("source_size")).drop("_epochs"))
    cell = F.shiftright("_u", 63 - CELL_BITS)
    per_cell = slim.groupBy("source", cell.alias("_cell")).agg(F.sum("size").alias("_words"))
    before = Window.partitionBy("source").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    per_cell = per_cell.withColumn("_before", F.coalesce(F.sum("_words").over(before), F.lit(0)))
    last = cut(per_cell.join(goal, per_cell["source"].eqNullSafe(goal["source"]))
               .where((F.col("_rest") > F.col("_before")) & (F.col("_rest") <= F.col("_before") + F.col("_words")))
               .select(goal["source"], "_cell", "_before", "_rest"))
    inside = slim.withColumn("_cell", cell)
    inside = inside.join(last, inside["source"].eqNullSafe(last["source"]) & (inside["_cell"] == last["_cell"])) \
                   .select(last["source"], last["_cell"], "_before", "_rest", "_u", "doc_id", "size")
    upto = Window.partitionBy("source", "_cell").orderBy("_u", "doc_id", "size")
    run = inside.withColumn("_sum", F.col("_before") + F.sum("size").over(
        upto.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # a document is taken while that brings the sum nearer to the target
    ends = run.groupBy("source", "_cell").agg(
        F.max(F.when(F.col("_sum") - F.col("size") / 2 <= F.col("_rest"), F.col("_u"))).alias("_hit"))
    floor = F.shiftleft(F.col("_cell"), 63 - CELL_BITS) - 1
    ends = ends.select("source", F.coalesce("_hit", floor).alias("_until"))
    return cut(goal.join(ends, goal["source"].eqNullSafe(ends["source"]), "left")
               .select(goal["source"], "source_size", "target", "whole",
                       F.coalesce("_until", F.lit(-1).cast("long")).alias("_until")))


def with_copies(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """``docs`` (source, _u, ...) with target, source_size and ``copies``, the times it is taken."""
    copies = F.col("whole") + (F.col("_u") <= F.col("_until")).cast("int")
    keep = [docs[c] for c in docs.columns]
    return docs.join(plan, docs["source"].eqNullSafe(plan["source"])) \
               .select(*keep, plan["source_size"], plan["target"], copies.alias("copies"))


def mix_plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
             max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(sizes of the documents, repetitions per source)."""
    slim = sized(docs, seed)
    return slim, repetitions(slim, targets(slim, weights, share, max_epochs))


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
          max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken."""
    _, plan = mix_plan(docs, weights, share, max_epochs, seed)
    rows = docs.withColumn("_row", F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    rows = with_copies(rows.select("_row", "source", draw(seed).alias("_u")), plan).where(F.col("copies") > 0)
    again = rows.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy"))
    return again.select("_row.*")
