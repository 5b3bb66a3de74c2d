"""Long texts in the n-gram join: pairs that are not similar are told apart before their texts are shuffled."""
import random

import numpy as np
import pyarrow as pa

from dealflow.llm import jaccard_join as J
from dealflow.llm.common import cut, ship, text_key


def _texts():
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    base = [word() for _ in range(4050)]
    copy = base + [word() for _ in range(100)]  # its bitmap is twice as large
    far = [word() if i % 20 == 0 else w for i, w in enumerate(base)]  # similarity 0.74
    short = [word() for _ in range(100)]
    return [" ".join(t) for t in (base, copy, far, short, short + [word()])]


def test_only_similar_long_texts_are_compared(spark):
    from pyspark.sql import functions as F
    ship(spark)
    docs = spark.createDataFrame(list(enumerate(_texts())) + [(0, _texts()[0])], "doc_id long, text string")
    keyed = docs.select("doc_id", text_key(F.col("text")).alias("_th"), "text")
    sets = cut(keyed.dropDuplicates(["doc_id"]).mapInArrow(J._signatures(3), f"doc_id long, {J.SIGNED}"))
    nodes = sets.select("node")
    pairs = nodes.select(F.col("node").alias("a")).crossJoin(nodes.select(F.col("node").alias("b"))).where("a < b")
    verify = J.Verifier(keyed, sets, 3, 90)
    left = verify.allowed(pairs, "node")
    assert sorted(sorted((r.x.doc_id, r.y.doc_id)) for r in left.collect()) == [[0, 1], [3, 4]]
    who = {bytes(r.node): r.doc_id for r in sets.collect()}
    assert all((who[bytes(r.a)], who[bytes(r.b)]) == (r.x.doc_id, r.y.doc_id) for r in left.collect())
    assert verify.similar(left).count() == 2  # the repeated row counts once
    assert verify.similar(left.limit(0)).count() == 0


def test_wide_bitmaps_never_count_more_than_differs(spark):
    rng = np.random.default_rng(4)
    rows, want = [], []
    for n, other, both in [(300, 280, 270), (1020, 1030, 1000), (2000, 2100, 1), (5000, 2000, 100), (200, 300, 100), (0, 0, 0), (257, 257, 257)]:
        value = rng.integers(0, 2**63, n + other - both, dtype=np.uint64)
        a, b = value[:n], value[n - both:]
        x, y = (J.wide_bitmaps(np.zeros(len(v), np.int64), v, np.array([len(v)])).to_pylist()[0] for v in (a, b))
        assert all(len(w) == 0 if len(v) <= 256 else len(v) <= 64 * len(w) < 2 * len(v) + 64 for v, w in ((a, x), (b, y)))
        rows.append(({"wide": x}, {"wide": y}))
        want.append(n + other - 2 * both)
    df = spark.createDataFrame(rows, "x struct<wide: array<long>>, y struct<wide: array<long>>")
    got = [r[0] for r in df.select(J._wide_apart("x", "y")).collect()]
    assert all(g <= w for g, w in zip(got, want, strict=True))
    assert got[2] > 900 and got[0] > 0 and got[3:] == [0, 0, 0, 0]


def test_wide_bitmaps_of_several_sets():
    rng = np.random.default_rng(6)
    sizes = np.array([0, 700, 3, 1500, 257])
    doc = np.repeat(np.arange(5), sizes)
    value = rng.integers(0, 2**63, len(doc), dtype=np.uint64)
    together = J.wide_bitmaps(doc, value, sizes)
    alone = [J.wide_bitmaps(doc[doc == k] * 0, value[doc == k], sizes[k:k + 1]).to_pylist()[0] for k in range(5)]
    assert together.to_pylist() == alone and together.type == pa.list_(pa.int64())
