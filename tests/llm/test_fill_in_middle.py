"""Fill-in-middle against the definition, unit by unit."""
import collections
import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from dealflow.llm import fill_in_middle as M
from dealflow.llm.wavelet import WaveletMatrix
from tests.conftest import SF_SMALL
from tests.llm import brute as B
from tests.llm.test_edges import EXTRA, TEXTS

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def by_hand(doc_id, text, seed=1, rate=90, spm=20):
    text = text or ""
    u = UNIT.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(u) + 1) for x in h[:2])
    prefix, middle, suffix = ("".join(x) for x in (u[:a], u[a:b], u[b:]))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, len(u), "plain", None, None, text
    form, out = ("spm", f"<S>{suffix}<P>{prefix}<M>{middle}") if h[3] % 100 < spm else ("psm", f"<P>{prefix}<S>{suffix}<M>{middle}")
    return doc_id, len(u), form, len(prefix), len(middle), out


def test_query_over_the_whole_table(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    want = [(*(r := by_hand(i, t))[:5], B.sha(r[5]), B.sha(t or "")) for i, t in docs]
    got = E.queries()["op12_fill_in_middle"](spark, SF_SMALL)
    key = lambda r: r[0]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert {r[2] for r in want} == {"plain", "spm", "psm"}


def test_edges(spark):
    texts = [*TEXTS, "has <S> inside", "<P", "P><", "<<P<M", "a<", "ÀbÇd́e", "😀abc😀", "Z[`@z{", "aB1 2\n\n\tc", "\x00x\x1f", "ab" * 40_000]
    rows = [(i, t) for i, t in enumerate(texts * 3)] + [(None, "no id here"), (None, None), (4, "again"), (4, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {k: F.lit(v) for k, v in (EXTRA | {"output": "o", "form": "f"}).items()}).repartition(3)
    made = M.fill_in_middle(df)
    assert collections.Counter(map(tuple, made.collect())) == collections.Counter(by_hand(i, t) for i, t in rows)
    again = made.select("doc_id", M.restored(F.col("form"), F.col("output")).alias("t"))
    assert collections.Counter(map(tuple, again.collect())) == collections.Counter((i, t or "") for i, t in rows)
    assert M.fill_in_middle(df.limit(0)).count() == 0


def test_parameters(spark):
    rows = [(i, f"text number {i}, with [P] and more") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = M.fill_in_middle(df, seed=7, rate=50, spm=100, sentinels=("[P]", "[S]", "[M]"))
    assert {r.form for r in got.collect()} == {"plain"}
    got = M.fill_in_middle(df, seed=7, rate=50, spm=100)
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(by_hand(i, t, 7, 50, 100) for i, t in rows)
    odd = ("[p.", "(s+", "|m?")
    back = M.fill_in_middle(df, sentinels=odd).select("doc_id", M.restored(F.col("form"), F.col("output"), odd))
    assert dict(map(tuple, back.collect())) == dict(rows)
    for bad in (("a", "a", "b"), ("ab", "bc", "d"), ("", "x", "y"), ("xx<", "<", "y")):
        with pytest.raises(ValueError):
            M.fill_in_middle(df, sentinels=bad)


def test_cuts_by_rank():
    text = "ab, c\n\nDe1fg"
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    begins, ends = np.array([0, 3, 3]), np.array([3, 3, len(text)])
    w = WaveletMatrix.build(M.classes(points, begins), 2)
    assert M.units_before(w, np.arange(len(text) + 1)).tolist() == [0, 1, 1, 2, 3, 4, 5, 6, 7, 7, 8, 9, 9]
    for k, parts in ((0, (0, 3, 3)), (1, (2, 3, 4)), (2, (3, 3, 5)), (7, (3, 3, len(text)))):
        assert M.cut_at(w, begins, ends, np.full(3, k)).tolist() == list(parts)
