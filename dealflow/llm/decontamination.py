"""Benchmark decontamination with a positional inverted index (operator 3; DataFrame functions only).

The index holds, for every term of the benchmark, its postings (document, position) in the whole
corpus; it is written once and everything else is answered from it. Benchmark items are cut into
windows of ``window`` words (a shorter item is one window). Of every window the two rarest terms,
by their postings, come first: their lists, each adjusted by the term's place in the item, meet
in (document, item, shift) where the item, laid over the document at that shift, has both. There
the item's other terms are looked up in the postings at their places; a run of ``window`` places
is an exact phrase. ``near`` finds windows most of whose terms lie close to their places.

Null texts have no words; null item ids count as one item named ''; rows of one item id are
one item with several texts; an empty benchmark leaves every document clean.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dealflow.llm.common import cut, in_buckets, restrict, same_doc, text_key, uncut

WINDOW = 13
#: Term tables of at most so many rows are broadcast; larger ones are shuffled.
BROADCAST_TERMS = 200_000
#: Share of a window's terms that a proximity match needs.
SHARE = 0.8
#: A document is contaminated when hit words are at least one in so many.
ONE_IN = 20

_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def terms(text: Column) -> Column:
    """Words of letters and digits: A-Z lower-cased, all non-ASCII characters kept as they are."""
    text = F.coalesce(text, F.lit(""))
    # lower() would also change other alphabets, so it serves plain ASCII texts only
    low = F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, _LETTERS.upper(), _LETTERS)).otherwise(F.lower(text))
    return F.filter(F.split(low, _BETWEEN), lambda w: w != "")


def small(df: DataFrame, limit: int = BROADCAST_TERMS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``limit`` rows (counted), else as it is."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def item_terms(benchmark: DataFrame) -> DataFrame:
    """Distinct (item_id, iwords) of the benchmark."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"),
                             terms(F.col("text")).alias("iwords"))
    return items.where(F.size("iwords") > 0).distinct()


def item_index(benchmark: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three written tables of the benchmark's size: vocabulary (term, _t: its number), items (item,
    item_id, n_words) and places (item, n_words, place, _t)."""
    items = cut(item_terms(benchmark).withColumn("item", F.monotonically_increasing_id()))
    vocabulary = cut(items.select(F.explode("iwords").alias("term")).distinct().withColumn("_t", F.monotonically_increasing_id()))
    places = items.select("item", F.size("iwords").alias("n_words"), F.posexplode("iwords").alias("place", "term")) \
                  .join(vocabulary, "term").drop("term")
    return vocabulary, items.select("item", "item_id", F.size("iwords").alias("n_words")), cut(places)


def postings(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The positional index, written once: doc_id, _th, _pos, _t of every word of the corpus that the
    benchmark has. The texts are read for this and not again."""
    flat = docs.select("doc_id", text_key(F.col("text")).alias("_th"), F.posexplode(terms(F.col("text"))).alias("_pos", "term"))
    return cut(flat.join(small(vocabulary), "term").drop("term"))


def seeds(index: DataFrame, places: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, first, second): places in the item of the two rarest terms of each window."""
    seen = cut(index.groupBy("_t").agg(F.count(F.lit(1)).alias("n")))
    size = F.least(F.lit(window), F.col("n_words"))
    starts = F.sequence(F.greatest(F.lit(0), F.col("place") - size + 1), F.least(F.col("place"), F.col("n_words") - size))
    each = places.join(seen, "_t").select("item", size.alias("_len"), F.explode(starts).alias("_start"), F.struct("n", "_t", "place").alias("_s"))
    # a window of at most ``window`` terms; one with a term that the corpus lacks cannot occur
    found = each.groupBy("item", "_len", "_start").agg(F.sort_array(F.collect_list("_s")).alias("_s")).where(F.size("_s") == F.col("_len"))
    return found.select("item", F.col("_s")[0]["place"].alias("first"),
                        F.coalesce(F.get("_s", 1)["place"], F.col("_s")[0]["place"]).alias("second")).distinct()


def shifts(index: DataFrame, places: DataFrame, seeded: DataFrame) -> DataFrame:
    """(doc_id, _th, item, shift) where the offset-adjusted lists of both seeds of a window meet."""
    pairs = seeded.groupBy("item").agg(F.collect_set(F.struct("first", "second")).alias("pairs"))
    wanted = seeded.select("item", F.explode(F.array("first", "second")).alias("place")).distinct().join(places, ["item", "place"])
    met = index.join(small(cut(wanted.select("item", "place", "_t"))), "_t") \
               .groupBy("doc_id", "_th", "item", (F.col("_pos") - F.col("place")).alias("shift")).agg(F.collect_set("place").alias("met"))
    both = met.join(pairs, "item").where(F.exists("pairs", lambda p: (
        F.array_contains("met", p["first"]) & F.array_contains("met", p["second"]))))
    return both.select("doc_id", "_th", "item", "shift")


def phrases(index: DataFrame, places: DataFrame, found: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, _th, item, at): the words of the documents inside an exact phrase. The item's other terms
    are looked up in the postings at their places, and runs of ``window`` places are phrases."""
    wanted = found.join(places, "item").withColumn("_pos", F.col("shift") + F.col("place"))
    held = in_buckets(index, found).distinct()  # of these documents and, by chance, a few more
    on = same_doc(wanted, held) & (wanted["_pos"] == held["_pos"]) & (wanted["_t"] == held["_t"])
    laid = wanted.join(held, on, "left_semi").groupBy("doc_id", "_th", "item", "n_words", "shift") \
                 .agg(F.sort_array(F.collect_set("place")).alias("_p")) \
                 .withColumn("_len", F.least(F.lit(window), F.col("n_words")))
    # places in ascending order: a window starts where the one _len - 1 entries on is as much greater
    starts = F.filter(F.transform("_p", lambda p, i: F.when(F.get("_p", i + F.col("_len") - 1) - p == F.col("_len") - 1, p)),
                      lambda p: p.isNotNull())
    inside = F.flatten(F.transform(starts, lambda s: F.sequence(F.col("shift") + s, F.col("shift") + s + F.col("_len") - 1)))
    return laid.select("doc_id", "_th", "item", F.explode(F.array_distinct(inside)).alias("at"))


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, _th, n_words, ``hits`` (document positions of
    words inside an exact phrase, ascending) and ``items`` (ids of the matching items, sorted)."""
    vocabulary, items, places = item_index(benchmark)
    index = postings(docs, vocabulary)
    seeded = cut(seeds(index, places, window))
    found = cut(shifts(index, places, seeded))
    words = cut(phrases(index, places, found, window))
    uncut(index, seeded, found, vocabulary)
    key = ["doc_id", "_th"]
    hits = words.select(*key, "at").distinct().groupBy(*key).agg(F.sort_array(F.collect_list("at")).alias("hits"))
    named = words.select(*key, "item").distinct().join(items, "item").groupBy(*key).agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    keyed = docs.select("doc_id", text_key(F.col("text")).alias("_th"), F.size(terms(F.col("text"))).cast("long").alias("n_words"))
    both = hits.join(named, same_doc(hits, named)).select(hits["doc_id"], hits["_th"], "hits", "items")
    none = F.array()
    return keyed.join(both, same_doc(keyed, both), "left").select(
        keyed["doc_id"], keyed["_th"], "n_words", F.coalesce("hits", none.cast("array<int>")).alias("hits"),
        F.coalesce("items", none.cast("array<string>")).alias("items"))


def judged(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, one_in: int = ONE_IN) -> DataFrame:
    """``matches`` with n_hit, n_items and contaminated."""
    df = matches(docs, benchmark, window).withColumns({
        "n_hit": F.size("hits").cast("long"), "n_items": F.size("items").cast("long")})
    return df.withColumn("contaminated", (F.col("n_hit") > 0) & (one_in * F.col("n_hit") >= F.col("n_words")))


def near(docs: DataFrame, benchmark: DataFrame, slop: int, window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """Proximity matches: (doc_id, _th, item_id, start, shift, n_terms). A window of an item (from its word
    ``start``) lies near a document's word ``shift + start`` if its two rarest terms come within ``slop``
    positions of their distance, and at least ``share`` of its terms within ``slop`` of their places
    (the rarest one exactly at its own)."""
    vocabulary, items, places = item_index(benchmark)
    index = postings(docs, vocabulary)
    size = F.least(F.lit(window), F.col("n_words"))
    seeded = seeds(index, places, window)
    starts = F.sequence(F.greatest(F.lit(0), F.greatest("first", "second") - size + 1),
                        F.least(F.least("first", "second"), F.col("n_words") - size))
    windows = cut(seeded.join(items, "item").select("item", "n_words", "first", "second", F.explode(starts).alias("start")))
    rarest = windows.join(places.select("item", F.col("place").alias("first"), "_t"), ["item", "first"])
    found = cut(index.join(small(cut(rarest)), "_t").select(
        "doc_id", "_th", "item", "n_words", "first", "second", "start", (F.col("_pos") - F.col("first")).alias("shift")).distinct())
    held = in_buckets(index, found).distinct()  # of these documents and, by chance, a few more
    around = F.explode(F.sequence(F.lit(-slop), F.lit(slop))).alias("off")
    asked = found.join(places.drop("n_words"), "item").where((F.col("place") >= F.col("start")) & (F.col("place") < F.col("start") + size)) \
                 .select("*", around).where((F.col("off") == 0) | (F.col("place") != F.col("first"))) \
                 .withColumn("_at", F.col("shift") + F.col("place") + F.col("off"))
    on = same_doc(asked, held) & (asked["_at"] == held["_pos"]) & (asked["_t"] == held["_t"])
    met = asked.join(held, on, "left_semi").groupBy("doc_id", "_th", "item", "n_words", "start", "shift", "second") \
               .agg(F.collect_set("place").alias("met"))
    return met.where(F.array_contains("met", F.col("second")) & (F.size("met") >= F.ceil(share * size))) \
              .join(items.select("item", "item_id"), "item") \
              .select("doc_id", "_th", "item_id", "start", "shift", F.size("met").alias("n_terms")).distinct()


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, one_in: int = ONE_IN) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, as they came."""
    bad = cut(judged(docs, benchmark, window, one_in).where("contaminated").select("doc_id", "_th").distinct())
    return restrict(docs, bad, "left_anti")
