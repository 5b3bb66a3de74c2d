"""Lines that share a band without being similar: no pair may come out of the join."""
import random

from dealflow.llm import line_dedup as L
from dealflow.llm import links
from dealflow.llm.common import cut, of_pairs, ship


def _lines(n):
    """Lines of one pattern, similarity about 0.55: they share bands, but no two are similar."""
    rng = random.Random(9)
    word = lambda k: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=k))
    return [f"{word(16)} the very same words stand at the end of every one of these lines {word(16)}" for _ in range(n)]


def test_lines_of_one_pattern_make_few_pairs(spark, monkeypatch):
    ship(spark)
    lines = _lines(120)
    near = [x + "!" for x in lines[:20]]
    met = []

    def seen(keys, fits, verify, **kw):
        def counted(pairs):
            met.append(pairs.count())
            return verify(pairs)
        met.append(kw["tested"].count())
        return links.link(keys, fits, counted, **kw)

    monkeypatch.setattr(L, "link", seen)
    docs = spark.createDataFrame(list(enumerate(lines + near)), "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in L.dedup(docs).collect()}
    assert got == {k: int(k >= 120) for k in range(140)}
    assert sum(met) <= 60, met  # the 20 similar pairs, and a few that only the exact check tells apart


def test_of_pairs_keeps_every_node_of_a_pair(spark):
    table = cut(spark.range(1000).selectExpr("cast(cast(id as string) as binary) as node", "id"))
    pairs = cut(spark.createDataFrame([(b"3", b"700"), (b"3", b"12")], "a binary, b binary"))
    got = {r.id for r in of_pairs(table, pairs).collect()}
    assert {3, 700, 12} <= got and len(got) < 10
    assert of_pairs(table, cut(pairs.limit(0))).count() == 0
