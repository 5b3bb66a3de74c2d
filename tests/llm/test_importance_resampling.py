"""Importance resampling against the definition; the position tables against zlib."""
import collections
import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from dealflow.llm import importance_resampling as R
from tests.conftest import SF_SMALL
from tests.llm import brute as B
from tests.llm.test_edges import EXTRA, TEXTS


def by_hand(docs, target, ngram=1, buckets=10_000, min_words=20, percent=10, seed=2024):
    def hashed(text):
        w = B.terms(text)
        return [zlib.crc32(" ".join(w[i:i + n]).encode()) % buckets for n in range(1, ngram + 1) for i in range(len(w) - n + 1)]

    feats = [hashed(t) for _, t in docs]
    s, t = collections.Counter(), collections.Counter()
    for f in feats:
        s.update(f)
    for text in target:
        t.update(hashed(text))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[k] + 1) * (all_s + buckets) / ((s[k] + 1) * (all_t + buckets)))) for k in range(buckets)]
    rows = []
    for (doc_id, text), f in zip(docs, feats, strict=True):
        weight = sum(gain[k] for k in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, text])
    able = [r for r in rows if len(B.terms(r[5])) >= min_words]
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[:percent * len(able) // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in rows]


def test_query_over_the_whole_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    items = [r[0] for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").select("text").collect()]
    got = E.queries()["op13_importance_resampling"](spark, SF_SMALL)
    assert dict(got.dtypes) == dict.fromkeys(["doc_id", "n_features", "weight", "score", "rank"], "bigint")
    assert sorted(map(tuple, got.collect())) == sorted(by_hand(docs, items))
    assert got.where("rank is not null").count() > 10


@pytest.mark.parametrize("ngram,buckets,min_words", [(1, 10_000, 20), (2, 97, 1), (3, 10_000, 0)])
def test_edges(spark, ngram, buckets, min_words):
    rows = [(i, t) for i, t in enumerate(TEXTS * 2)] + [(None, TEXTS[6]), (None, TEXTS[6]), (5, TEXTS[6]), (5, None)]
    rows += [(900 + i, "ÀÉ ünï \U0001F600 x_y-z A1b2 " * i + "w" * (61 + i)) for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {k: F.lit(v) for k, v in (EXTRA | {"weight": 1, "bucket": 2, "_mid": 3, "_rank": 4}).items()}).repartition(3)
    target = [TEXTS[6], None, "", "A1B2 x", TEXTS[12][:4000]]
    items = spark.createDataFrame([(t,) for t in target], "text string")
    wish = {"ngram": ngram, "buckets": buckets, "min_words": min_words, "percent": 30}
    got = R.scored(df, items, **wish).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(by_hand(rows, target, **wish))
    kept = R.resampled(df, items, **wish)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r["rank"]}
    none = R.scored(df, items.limit(0), **wish).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert collections.Counter(map(tuple, none)) == collections.Counter(by_hand(rows, [], **wish))
    assert R.scored(df.limit(0), items, **wish).count() == 0 and R.resampled(df.limit(0), items, **wish).count() == 0


def test_checksums_of_spans():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 40_000).astype(np.uint8)
    sizes = np.concatenate([np.arange(1, 4 * R.REACH + 3), [1000, 16 * R.REACH, 9999, 30_000]])
    starts = rng.integers(0, len(data) - sizes + 1)
    want = [zlib.crc32(data[a:a + n].tobytes()) for a, n in zip(starts, sizes, strict=True)]
    assert R.crc32_spans(data, starts, sizes).tolist() == want
    assert len(R.crc32_spans(data, starts[:0], sizes[:0])) == 0


def test_long_words_and_small_pieces(monkeypatch):
    texts = ["a " * 50 + "Bc9" * 400 + " d", "", "é" * 33, "x y"]
    want = collections.Counter((k, zlib.crc32(w.encode()) % 1000) for k, t in enumerate(texts) for w in B.terms(t))
    for size in (1, 7, 1 << 18):
        monkeypatch.setattr(R, "BATCH_FEATURES", size)
        got, words = collections.Counter(), []
        for n, owner, bucket in R.features([t.encode() for t in texts], 1, 1000):
            words += n.tolist()
            got.update(zip(owner.tolist(), bucket.tolist(), strict=True))
        assert got == want and words == [len(B.terms(t)) for t in texts]
