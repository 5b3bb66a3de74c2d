"""Token files against the library's own encoding of whole texts, and against plain searches."""
import collections
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as E
from dealflow.llm import token_files as T
from tests.conftest import SF_SMALL
from tests.llm.test_edges import EXTRA, TEXTS

PLAIN = Tokenizer.from_file(T.default_vocabulary())


def ids_of(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids + [T.END]


def test_query_over_the_whole_table(spark):
    docs = sorted(map(tuple, spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()))
    want, start = [], 0
    for doc_id, text in docs:
        ids = ids_of(text)
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = E.queries()["op11_token_files"](spark, SF_SMALL)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.collect())) == want


def test_units_give_the_ids_of_whole_texts():
    marks = ["don't", "<|endoftext|>", "<|startoftext|>x", "<|EndOfText|>", "<|", "é", "\u0301", "ǅ", "İ", "ΣΑΣ", "a\u2003b", "\u00a0", "\x1c", "\x85",
             "\x00", "각", "\u1100", "\u1161", "12,5%", "'s", "😀\u200d😀", "\ufeff", "_", "ﬁ", "\u0327\u0301", "x" * 300, "O'REILLY'LL", "''d", "a'", "\x7f",
             "Word.Word,word!", "x1y22z", "'ſ", "K", "e\u0301a", "(\u0301)", "#$%", "Über", "STRAßE", "ÀÉÎ", "Ÿ", "¿Qué?", "«mot»", "ª", "µ", "×÷", "œuvre", "e\u0301té", "ü\u0308", "ÿŸ", "it'S", "I'Ve", "ø'Re"]
    rng = random.Random(5)
    texts = [rng.choice(["", " ", "\n"]).join(w + rng.choice(["", " ", "\t", "\n\n", "\r\n", "\x0b", " \x0c "])
                                              for w in rng.choices(marks, k=rng.randint(1, 25))) for _ in range(600)]
    encode = T.Encoder(T.default_vocabulary(), "<u4")
    assert encode.by_unit
    for part in (texts[:100], texts):
        got = encode(part)
        assert got == [np.array(PLAIN.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in part]


def test_encoder_forgets_and_stays_right(monkeypatch):
    monkeypatch.setattr(T, "REMEMBERED", 3)
    encode = T.Encoder(T.default_vocabulary(), "<u4")
    for text in ("one two three four five", "two six", "one seven " + "long" * 40, "five five"):
        assert encode([text]) == [np.array(ids_of(text)[:-1], "<u4").tobytes()]
        assert all(len(p) <= T.UNIT_CHARS for p in encode.known)


def test_other_vocabularies_are_left_to_the_library():
    import public_tokenizers
    path = public_tokenizers.path("byte_bpe_50k.json")
    encode, plain = T.Encoder(path, "<u4"), Tokenizer.from_file(path)
    texts = ["Two  words\n and 'more'", "", " é <|endoftext|>"]
    assert not encode.by_unit
    assert encode(texts) == [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


@pytest.fixture(scope="module")
def rows(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (3, "one"), (3, "one"), (3, "same id"), (None, None), (-7, "minus #")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {k: F.lit(v) for k, v in (EXTRA | {"part": 1, "seq": 2, "_mid": 3, "ids": 4}).items()}).repartition(4)


@pytest.mark.parametrize("shard_tokens", [1, 500, T.SHARD_TOKENS])
def test_files(spark, rows, tmp_path, shard_tokens):
    rows, frame = rows
    T.write(frame, f"{tmp_path}/t", shard_tokens=shard_tokens)
    shards = T.read(spark, f"{tmp_path}/t")
    files = spark.read.parquet(f"{tmp_path}/t").select(F.input_file_name()).distinct().count()
    assert files == shards.count() and (files == len(rows) or shard_tokens > 1)
    docs = sorted(T.documents(shards).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in docs] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    assert collections.Counter((r.doc_id, bytes(r.ids)) for r in docs) == collections.Counter(
        (i, np.array(ids_of(t), "<u4").tobytes()) for i, t in rows)
    all_ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in docs])
    assert [r.start for r in docs] == [0, *np.cumsum([r.n_tokens for r in docs])[:-1]]

    asked = [0, 1, 5, len(all_ids) - 1, len(all_ids) // 2, 700, 700, -1, len(all_ids)]
    got = dict(map(tuple, T.tokens_at(shards, asked).collect()))
    assert got == {p: all_ids[p] for p in asked if 0 <= p < len(all_ids)}
    common = [int(t) for t, _ in collections.Counter(all_ids.tolist()).most_common(3)] + [T.END, 49405, 1 << 20]
    assert dict(map(tuple, T.counts(shards, common).collect())) == {t: int((all_ids == t).sum()) for t in common}
    found = collections.defaultdict(list)
    for r in T.occurrences(shards, common).collect():
        found[r.token].append((r.position, r.doc_id))
    owner = [r.doc_id for r in docs for _ in range(r.n_tokens)]
    for t in common:
        assert sorted(found[t], key=lambda x: x[0]) == [(int(p), owner[p]) for p in np.flatnonzero(all_ids == t)]


def test_no_documents_and_string_ids(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    T.write(empty, f"{tmp_path}/e")
    shards = T.read(spark, f"{tmp_path}/e")
    assert T.documents(shards).count() == 0 and T.occurrences(shards, [2]).count() == 0 and T.counts(shards, [2]).count() == 0
    named = spark.createDataFrame([("b", "two words"), ("a", None)], "doc_id string, text string")
    T.write(named, f"{tmp_path}/s")
    docs = T.documents(T.read(spark, f"{tmp_path}/s", "string")).collect()
    assert [(r.doc_id, r.start) for r in sorted(docs, key=lambda r: r.start)] == [("a", 0), ("b", 1)]


def test_wider_vocabularies_take_more_planes(spark, tmp_path):
    """An end id beyond 16 bits."""
    df = spark.createDataFrame([(1, "some words, more words"), (2, "")], "doc_id long, text string")
    T.write(df, f"{tmp_path}/w", end_id=70_000)
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in T.documents(T.read(spark, f"{tmp_path}/w")).collect()}
    assert got == {1: ids_of("some words, more words")[:-1] + [70_000], 2: [70_000]}
