"""Quality rules by distribution divergence (operator 7; DataFrame functions only).

A document's histogram of character classes and of common words is compared with the
histograms of whole languages, summed over the corpus itself, by Jensen-Shannon distance (the
square root of the divergence in bits, 0 to 1). A document far from every language is
rejected. Short documents are not judged by a histogram they cannot fill.

In the histogram over all words the other words hold most of the mass, so a text without one
common word is not far by it. The common words are therefore judged once more alone: by their
share of the words, and by the distance of their distribution among themselves. Both bounds come
from the spread over all documents (quartiles and ``FENCE``). The query op7 goes by the two
distances of its SQL only (``common=False``).

The texts are read once: counts of every document are written as a slim table, from which the
language references are summed and the verdicts taken.

Null and empty texts have no words and fail the base rule; with no document in a reference
language there is nothing to diverge from, and the base rule alone decides. Rows of equal id
and text get equal verdicts.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealflow.llm.common import cut, text_key, words

# The most frequent words of each reference language.
COMMON = {
    "de": "der die und in den von zu das",
    "en": "the of and to in a is that",
    "es": "de la que el en y a los",
    "fr": "de la le et les des en un",
}
COMMON_WORDS = sorted({w for ws in COMMON.values() for w in ws.split()})
CLASSES = ("lower", "upper", "digit", "mark", "other", "gap")

MIN_WORDS = 50
#: A histogram is judged from this many characters or words on.
MIN_CHARS, MIN_LISTED = 200, 50
#: Distances above these are rejected.
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.25, 0.65
#: Common words alone: rejected so many quartile distances below the first quartile of their share or
#: above the third of their distance. The bound of the share stays between these parts of the least
#: share of a language, that of the distance above what fifty words are apart by chance.
FENCE, LEAST_SHARE, MOST_SHARE, LEAST_DISTANCE = 3, 0.1, 0.5, 0.3

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _less(text: Column, drop: str) -> Column:
    """How many characters ``drop`` takes from ``text``."""
    return F.length(text) - F.length(F.regexp_replace(text, drop, ""))


def repeats(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words of ``_words`` inside any run of three that occurs twice or more.

    Runs are hashed. Only where some hashes are equal they are sorted, each with its place in
    the low bits of the same long, and neighbours are compared by hash, then word by word."""
    n = F.greatest(F.size("_words") - 2, F.lit(0))
    df = df.withColumn("_tri", F.transform(F.slice("_words", F.lit(1), n), lambda w, i: F.xxhash64(
        w, F.get("_words", i + 1), F.get("_words", i + 2))))
    some = F.size(F.array_distinct("_tri")) < F.size("_tri")
    df = df.withColumn("_low", F.when(some, F.expr("shiftleft(1L, length(bin(size(_tri)))) - 1")))
    df = df.withColumn("_sorted", F.when(F.col("_low").isNotNull(), F.sort_array(F.transform(
        "_tri", lambda h, i: h.bitwiseOR(F.col("_low")).bitwiseXOR(F.col("_low")).bitwiseOR(i.cast("long"))))))

    def equal(x: Column, y: Column) -> Column:
        i, j = x.bitwiseAND(F.col("_low")).cast("int"), y.bitwiseAND(F.col("_low")).cast("int")
        same = x.bitwiseOR(F.col("_low")) == y.bitwiseOR(F.col("_low"))
        for k in range(3):
            same = same & (F.get("_words", i + k) == F.get("_words", j + k))
        return F.coalesce(same, F.lit(False))

    df = df.withColumn("_twins", F.sort_array(F.transform(
        F.filter("_sorted", lambda x, j: equal(F.get("_sorted", j - 1), x) | equal(F.get("_sorted", j + 1), x)),
        lambda x: x.bitwiseAND(F.col("_low")))))
    # a window covers three words, or as many as lie before the next repeated window
    cover = F.transform("_twins", lambda p, j: F.least(F.lit(3), F.coalesce(F.get("_twins", j + 1) - p, F.lit(3))))
    count = F.aggregate(cover, F.lit(0).cast("long"), lambda a, b: a + b)
    return df.withColumn("n_repeat_words", F.coalesce(count, F.lit(0).cast("long"))) \
             .drop("_tri", "_low", "_sorted", "_twins")


def counts(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, _th, lang, the five base counts, and the counts by character class (``chars``, in
    the order of CLASSES) and by common word (``listed``, all other words last); further columns
    ``more`` are handed on."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select("doc_id", text_key(F.col("text")).alias("_th"), "lang", words(F.col("text")).alias("_words"),
                     F.split(text, "\n").alias("_lines"), F.length(text).alias("_all"), *more)
    names = df.columns[6:]
    df = df.withColumns({"_solid": F.concat_ws("", "_words"),
                         "_lines": F.filter("_lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
                         "_known": F.filter("_words", lambda w: w.isin(*COMMON_WORDS))})
    df = df.withColumns({"_rest": F.regexp_replace("_solid", r"\p{Ll}+", ""), "_len": F.length("_solid"),
                         "_known": F.transform("_known", lambda w: F.array_position(
                             F.array(*map(F.lit, COMMON_WORDS)), w).cast("int"))})
    df = df.withColumns({"_upper": _less(F.col("_rest"), r"\p{Lu}+"), "_digit": _less(F.col("_rest"), "[0-9]+"),
                         "_mark": _less(F.col("_rest"), "[.,;:!?'\"()-]+"),
                         "n_symbols": _less(F.col("_rest"), "[#*$%&|<>]+").cast("long"),
                         "_left": F.length("_rest")})
    other = F.col("_left") - F.col("_upper") - F.col("_digit") - F.col("_mark")
    known = F.size("_known")
    listed = [known - F.size(F.array_remove("_known", i + 1)) for i in range(len(COMMON_WORDS))]
    return repeats(df).select(
        "doc_id", "_th", "lang", F.size("_words").cast("long").alias("n_words"), F.col("_len").cast("long").alias("word_chars"),
        "n_symbols", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.array(F.col("_len") - F.col("_left"), "_upper", "_digit", "_mark", other,
                F.col("_all") - F.col("_len")).alias("chars"),
        F.array(*listed, F.size("_words") - known).alias("listed"), *names)


def references(table: DataFrame, languages: tuple[str, ...] = tuple(COMMON)) -> list[tuple[list[float], list[float]]]:
    """Per reference language (at most ``languages``) the histograms of all its documents."""
    sums = [F.sum(F.col(c)[i]) for c, k in (("chars", len(CLASSES)), ("listed", len(COMMON_WORDS) + 1))
            for i in range(k)]
    judged = table.where((F.col("n_words") >= MIN_WORDS) & F.col("lang").isin(*languages))
    out = []
    for r in judged.groupBy("lang").agg(*sums).orderBy("lang").collect():  # a row per listed language
        chars, listed = list(r)[1:1 + len(CLASSES)], list(r)[1 + len(CLASSES):]
        out.append(([x / sum(chars) for x in chars], [x / sum(listed) for x in listed]))
    return out


def distance(counts: Column, total: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance of a count array to a reference distribution."""

    def part(x: Column, q: Column) -> Column:
        p = x / total
        m = (p + q) / 2
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)

    bits = F.aggregate(F.zip_with(counts, F.array(*map(F.lit, reference)), part), F.lit(0.0), lambda a, b: a + b)
    return F.sqrt(F.greatest(bits / 2, F.lit(0.0)))


def quartiles(df: DataFrame, name: str) -> tuple[float, float] | None:
    """First and third quartile of a column from 0 to 1, to three places; None if it is all null."""
    rows = df.where(F.col(name).isNotNull()).groupBy(F.round(name, 3).alias("x")).agg(
        F.count(F.lit(1)).alias("n")).orderBy("x").collect()  # at most 1001 rows
    total, seen, out = sum(r["n"] for r in rows), 0, []
    for r in rows:
        seen += r["n"]
        out += [r["x"]] * (sum(4 * seen >= k * total for k in (1, 3)) - len(out))
    return (out[0], out[1]) if out else None


def common_words(df: DataFrame, refs: list[tuple[list[float], list[float]]]) -> tuple[DataFrame, Column]:
    """``df`` (counts) with common_share and common_distance (null where not judged), and the
    condition that either is out of its bound."""
    known = F.col("n_words") - F.element_at("listed", -1)
    own = [[x / sum(w[:-1]) for x in w[:-1]] for _, w in refs if sum(w[:-1]) > 0]
    ds = [distance(F.slice("listed", 1, len(COMMON_WORDS)), F.greatest(known, F.lit(1)), w) for w in own]
    far = F.least(*ds) if len(ds) > 1 else ds[0] if ds else F.lit(None).cast("double")
    share = F.round(F.when(F.col("n_words") >= MIN_LISTED, known / F.col("n_words")), 6)
    df = df.withColumns({"common_share": share, "common_distance": F.round(F.when(known >= MIN_LISTED, far), 6)})
    out = F.lit(False)
    if own and (spread := quartiles(df, "common_share")):
        least = min(sum(w[:-1]) for _, w in refs)
        low = spread[0] - FENCE * (spread[1] - spread[0])
        out = out | (F.col("common_share") < min(max(low, LEAST_SHARE * least), MOST_SHARE * least))
    if own and (spread := quartiles(df, "common_distance")):
        out = out | (F.col("common_distance") > max(spread[1] + FENCE * (spread[1] - spread[0]), LEAST_DISTANCE))
    return df, F.coalesce(out, F.lit(False))


def verdicts(docs: DataFrame, languages: tuple[str, ...] = tuple(COMMON),
             max_char_distance: float = MAX_CHAR_DISTANCE, max_word_distance: float = MAX_WORD_DISTANCE,
             common: bool = True) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, lang): doc_id, _th, the base counts, base_failed,
    char_distance and word_distance (to the nearest language; null where not judged), with
    ``common`` also common_share and common_distance, kept."""
    return judged(cut(counts(docs)), languages, max_char_distance, max_word_distance, common).drop("lang", "chars", "listed", "_total")


def judged(table: DataFrame, languages: tuple[str, ...], max_char_distance: float, max_word_distance: float, common: bool) -> DataFrame:
    """A written table of ``counts`` with base_failed, the distances and kept."""
    refs = references(table, languages)
    near = lambda ds: F.least(*ds) if len(ds) > 1 else ds[0] if ds else F.lit(None).cast("double")
    df = table.withColumn("_total", F.aggregate("chars", F.lit(0), lambda a, b: a + b))
    chars = near([distance(F.col("chars"), F.col("_total"), c) for c, _ in refs])
    listed = near([distance(F.col("listed"), F.col("n_words"), w) for _, w in refs])
    df = df.withColumns({
        "char_distance": F.round(F.when(F.col("_total") >= MIN_CHARS, chars), 6),
        "word_distance": F.round(F.when(F.col("n_words") >= MIN_LISTED, listed), 6),
        "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))})
    far = (F.coalesce(F.col("char_distance") > max_char_distance, F.lit(False))
           | F.coalesce(F.col("word_distance") > max_word_distance, F.lit(False)))
    if common:
        df, odd = common_words(df, refs)
        far = far | odd
    return df.withColumn("kept", ~F.col("base_failed") & ~far)


def passing(docs: DataFrame, languages: tuple[str, ...] = tuple(COMMON), max_char_distance: float = MAX_CHAR_DISTANCE,
            max_word_distance: float = MAX_WORD_DISTANCE, common: bool = True) -> DataFrame:
    """The rows of ``docs`` that are kept, as they came. Each row is written beside its counts once, so
    its verdict needs no join and no text is shuffled."""
    table = cut(counts(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")))
    return judged(table, languages, max_char_distance, max_word_distance, common).where("kept").select("_row.*")
