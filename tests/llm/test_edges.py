"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""
import collections

import pytest
from pyspark.sql import functions as F

from dealflow.llm import (decontamination, jaccard_join, line_dedup, mixing, pii, quality_classifier, quality_rules,
                          sharding, substring_dedup, token_counts)
from tests.llm import brute as B

PASSAGE = " ".join(f"w{i}" for i in range(60))
LONG = " ".join(f"x{i % 977}y{i % 1009}" for i in range(60_000))
TEXTS = [
    None, "", " \n\t ", "one", "One", "two words", PASSAGE, PASSAGE, PASSAGE + " tail", "head " + PASSAGE + " more",
    "a " * 80, "A  a\ta\n" * 30, LONG, LONG + " z", "é " + PASSAGE.upper() + " ÀÉ", "x" * 5000,
    PASSAGE.replace("w30", "changed"), PASSAGE.replace(" ", "\x0b"), "line one\nline one\n\nline two !!\nline one",
    "nbsp joined   em", "zero\x00byte " + PASSAGE[:40],
]
#: Further columns, some with the names that the operators use inside.
EXTRA = {"_th": "no hash", "n": 1, "size": -1, "node": "x", "start": 0.5, "key": "k", "_words": "w", "hits": 3,
         "anchor": "a", "kept": 1, "_row": 0, "_u": 2.5, "term": "t", "root": "r", "copies": 9, "whole": "w"}


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(i, t, ["en", "de", None][i % 3], ["s1", "s2", None][i % 3]) for i, t in enumerate(TEXTS)]
    rows += [rows[6], rows[6], rows[0], (None, PASSAGE, None, None), (None, None, "en", "s1"), (5, "same id, other text", "en", "s3")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")\
        .withColumns({k: F.lit(v) for k, v in EXTRA.items()}).repartition(3)


@pytest.fixture(scope="module")
def docs(frame):
    return [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def empty(frame):
    return frame.limit(0)


def bag(df, *columns):
    return collections.Counter(tuple(r) for r in df.select(*columns).collect())


def test_substring_dedup(frame, docs, empty):
    got = bag(substring_dedup.dedup(frame), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == collections.Counter(B.op1(docs))
    assert substring_dedup.dedup(empty).count() == 0


def test_substring_dedup_small_windows(spark):
    texts = ["a b c d e f g", "x b c d e y", "c d e c d e c d e", "a b c d e f g h", "q", None, "b c", "z z z z z z z"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for window, anchor in ((3, 1), (3, 2), (4, 2), (5, 3)):
        got = bag(substring_dedup.dedup(df, window, anchor), "doc_id", "n_words", "n_removed", "kept_sha256")
        assert got == collections.Counter(B.op1(list(enumerate(texts)), window)), (window, anchor)


def test_mixing(frame, empty):
    slim, plan = mixing.mix_plan(frame)
    got = mixing.with_copies(slim, plan).collect()
    total = collections.Counter()
    for r in frame.collect():
        total[r.source] += len(B.words(r.text))
    goal = B.op2_targets(total)
    assert len(got) == frame.count()
    for r in got:
        assert r.target == pytest.approx(goal[r.source]) and r.source_size == total[r.source] and 0 <= r.copies <= 2
    mixed = mixing.mixed(frame)
    assert mixed.columns == frame.columns and mixed.count() == sum(r.copies for r in got)
    slim, plan = mixing.mix_plan(empty)
    assert mixing.with_copies(slim, plan).count() == 0 and mixing.mixed(empty).count() == 0


def test_decontamination(spark, frame, docs, empty):
    items = [(1, PASSAGE), (2, "two WORDS"), (3, ""), (4, None), (None, "one"), (2, "two words"), (7, "tail"), (8, LONG[:300]),
             (9, "zero byte"), (10, "no such phrase anywhere at all"), (11, "a a a")]
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("term", F.lit(1))
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items", "contaminated")
    got = decontamination.judged(frame, table).select(
        *cols[:4], F.sha2(F.concat_ws(",", "items").cast("binary"), 256), cols[5])
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(B.op3(docs, items))
    clean = decontamination.clean(frame, table)
    assert clean.columns == frame.columns
    assert clean.count() == sum(not r[5] for r in B.op3(docs, items))
    assert decontamination.judged(empty, table).count() == 0
    none = decontamination.judged(frame, table.limit(0))
    assert none.count() == len(docs) and none.where("contaminated or n_hit > 0").count() == 0
    assert decontamination.judged(frame, table, window=5).where("n_hit > 0").count() > 0


def test_proximity_matches(spark):
    docs = spark.createDataFrame([(1, "alpha x beta"), (2, "alpha x y beta"), (3, "alpha x y z u v beta"), (4, None)],
                                 "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha beta")], "item_id long, text string")
    assert bag(decontamination.near(docs, items, 2), "doc_id") == {(1,): 1, (2,): 1}
    assert decontamination.near(docs, items, 0).count() == 0


def test_line_dedup(spark, frame, docs, empty):
    got = line_dedup.dedup(frame)
    assert got.count() == len(docs)
    for r in got.collect():
        assert r.n_removed == len(r.removed_lines or ())
    by = {r.doc_id: r for r in got.where("doc_id = 18").collect()}
    assert by[18].n_lines == 5 and by[18].kept_text == "line one\n\nline two !!"
    assert {r.kept_text for r in got.where("doc_id = 0").collect()} == {None}
    assert line_dedup.dedup(empty).count() == 0
    near = "this is a fairly long line of text that is almost the same number {} everywhere it goes"
    df = spark.createDataFrame([(i, near.format(i) + "\nown line qq" + str(i) * 9) for i in range(40)], "doc_id long, text string")
    kept = {r.doc_id: r.n_removed for r in line_dedup.dedup(df).collect()}
    assert kept[0] == 0 and all(kept[i] >= 1 for i in range(1, 40))


def test_classifier(spark, frame, docs, empty):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(12)] + [(None, 1, 0), (13, None, 0), (6, 1, 0)],
                                   "doc_id long, quality int, toxic int").withColumn("_o", F.lit("x"))
    got = quality_classifier.classify(frame, labels)
    assert got.count() == len(docs) and got.where("score is null or score < 0 or score > 1").count() == 0
    same = collections.defaultdict(set)
    for r in got.collect():
        same[r.doc_id].add(r.score)
    assert len(same[6]) == 1
    assert {r.score for r in quality_classifier.classify(frame, labels.limit(0)).collect()} == {0.5}
    assert quality_classifier.classify(empty, labels).count() == 0


def test_token_counts(frame, docs, empty):
    got = token_counts.token_counts(frame)
    size = token_counts.lengths([t for _, t in docs])
    assert bag(got, "n_tokens", "n_docs") == collections.Counter(
        (int(n), int(c)) for n, c in collections.Counter(size.tolist()).items())
    assert token_counts.token_counts(empty).count() == 0
    assert token_counts.quantile(token_counts.token_counts(empty), 0.5) is None


def test_quality_rules(frame, docs, empty):
    got = quality_rules.verdicts(frame)
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert bag(got, *cols) == collections.Counter(B.op7_base(docs))
    assert got.where("base_failed and kept").count() == 0
    kept = quality_rules.passing(frame)
    assert kept.columns == frame.columns and kept.count() == got.where("kept").count()
    assert quality_rules.verdicts(empty).count() == 0
    alone = quality_rules.verdicts(frame.where("lang is null"))  # no reference language: the base rule decides
    assert alone.where("kept = base_failed").count() == 0


def test_distance():
    assert B.distance([1, 1], [1, 1]) == 0 and B.distance([1, 0], [0, 1]) == 1


def test_divergence_matches_definition(spark):
    en = "the cat and the dog went to a house in that of is it for "
    texts = [(i, en * 6 + f"number {i}.", "en") for i in range(5)] + [(9, "&&& *** ### $$$ %%% zzz " * 3 + en.upper() * 4, "en")]
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    table = quality_rules.counts(df).collect()
    sums = [[sum(r[c][i] for r in table) for i in range(len(table[0][c]))] for c in ("chars", "listed")]
    for r in quality_rules.verdicts(df).collect():
        row = next(x for x in table if x.doc_id == r.doc_id)
        assert r.char_distance == pytest.approx(B.distance(row["chars"], sums[0]), abs=1e-6)
        assert r.word_distance == pytest.approx(B.distance(row["listed"], sums[1]), abs=1e-6)


def test_jaccard_join(frame, docs, empty):
    got = bag(jaccard_join.linked(frame), "doc_id", "n_shingles", "component_id")
    assert got == collections.Counter(B.op8(docs))
    kept = jaccard_join.one_of_each(frame)
    assert kept.columns == frame.columns
    want = collections.Counter(c for _, c in {(root, c) for _, n, c, root in B.op8_rooted(docs) if n})
    assert collections.Counter(r.doc_id for r in kept.collect() if B.words(r.text)) == want
    assert sum(not B.words(r.text) for r in kept.collect()) == sum(not B.words(t) for _, t in docs)
    assert jaccard_join.linked(empty).count() == 0 and jaccard_join.one_of_each(empty).count() == 0


def test_jaccard_join_chains_and_big_groups(spark):
    """A large group of near copies, a chain whose ends are not similar, and short texts."""
    base = [f"t{i}" for i in range(120)]
    texts = []
    for i in range(60):
        w = list(base)
        w[(i * 7) % 120] = f"edit{i}"
        texts.append(" ".join(w))
    chain = [f"c{i}" for i in range(200)]
    for step in range(8):
        texts.append(" ".join(chain[step * 4:step * 4 + 160]))
    texts += ["a b c d e f g h i j k", "a b c d e f g h i j k l", "B C d", "b c D", "b c", "b", "B"]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert bag(jaccard_join.linked(df), "doc_id", "n_shingles", "component_id") == collections.Counter(B.op8(rows))


def test_personal_data(spark, frame, docs, empty):
    assert pii.scan(frame).count() == len(docs) and pii.scan(empty).count() == 0
    texts = ["", "a@b.c d@e.f@g.h", "@@x@y.z", "1.2.3.4.5.6.7.8 256.1.1.1 0255.0.0.1", "+1 (234) 567-8901 ++12 345 678 9",
             "4111 1111 1111 1111", "4111-1111-1111-1112", "4111111111111111 4111111111111111", "é" * 5 + "x@y.zz", "9" * 5000,
             "+" + "(" * 3000, "a" * 3000 + "@", "1." * 900, "a.b-c%d+e_f@h-i.j-k.", "x@y x@y.z", "1" * 400 + ".1.1.1"]
    for t in texts:
        assert [s[:3] for s in pii.find(t) if s[0] in pii.BASE_KINDS] == B.op9_base(t), t
    assert pii.find("pay to account DE89 3704 0044 0532 0130 00 now")[0][:1] == ("iban",)
    assert not pii.find("code DE89 3704 0044 0532 0130 01")
    assert pii.find("amex card 378282246310005")[0][0] == "shortcard" and not pii.find("id 378282246310005")
    assert pii.redact("write a@b.c") == "write [email]" and pii.redact(None) is None


def test_sharding(frame, docs, empty):
    got = sharding.shard(frame).collect()
    per = collections.defaultdict(list)
    for r in got:
        per[r.shard].append(r.slot)
    assert sum(map(len, per.values())) == len(docs)
    assert all(sorted(s) == list(range(len(s))) for s in per.values())
    assert max(map(len, per.values())) - min(map(len, per.values())) <= 1
    assert sharding.shard(empty).count() == 0
    few = sharding.shard(frame.limit(3)).collect()
    assert len({r.shard for r in few}) == 3 and all(r.slot == 0 for r in few)
