"""Long lines of one pattern, gram sets and exact similarity of lines, and texts fetched line by line."""
import random

import pyarrow as pa

from dealflow.llm import line_dedup as L
from dealflow.llm import links
from dealflow.llm.common import ship

ODD = ["a", "ab", "abcd", "abcde", "abcdé", "ab\x00", "ab", "é", "a line of a few words", "a line of a few wordz", "x" * 700,
       "x" * 701, "\x00\x00\x00", "word " * 300, "the same line " * 40 + "end", "the same line " * 40 + "End"]


def grams(text, n=L.GRAM):
    x = text.encode()
    return {x[k:k + n] for k in range(max(1, len(x) - n + 1))}


def test_long_lines_of_one_pattern_make_few_pairs(spark, monkeypatch):
    """800 grams fill a bitmap of 256 bits; one as large as the line still tells lines of similarity 0.55 apart."""
    ship(spark)
    rng = random.Random(3)
    word = lambda k: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=k))
    base = word(650)
    lines = [f"{word(130)} {base} {word(130)}" for _ in range(80)]
    near = [x + "!" for x in lines[:10]]
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
    assert got == {k: int(k >= 80) for k in range(90)}
    assert sum(met) <= 30, met


def test_sets_and_bitmaps():
    batch = pa.RecordBatch.from_pydict({"hash": [x.encode() for x in ODD], "mark": list(range(len(ODD))), "text": ODD})
    got = [r for b in L._sets(L.GRAM)(iter([batch, batch])) for r in b.to_pylist()]
    assert [r["text"] for r in got] == list(dict.fromkeys(ODD))  # each once, whatever batch it comes in
    for r in got:
        assert r["n"] == len(grams(r["text"]))
        assert len(r["wide"]) & len(r["wide"]) - 1 == 0
        assert sum(x.bit_count() if x >= 0 else (x + 2**64).bit_count() for x in r["wide"]) <= r["n"]


def test_similar_is_exact():
    pairs = [(s, t) for s in ODD for t in ODD]
    for gram in (L.GRAM, 7):  # held as they are, and as sets of bytes
        batch = pa.RecordBatch.from_pydict({"a": list(range(len(pairs))), "b": list(range(len(pairs))),
                                            "text_a": [p[0] for p in pairs], "text_b": [p[1] for p in pairs]})
        got = {r["a"] for b in L._similar(gram, 80)(iter([batch])) for r in b.to_pylist()}
        want = {k for k, (s, t) in enumerate(pairs)
                if 100 * len(grams(s, gram) & grams(t, gram)) >= 80 * len(grams(s, gram) | grams(t, gram))}
        assert got == want


def test_few_rows_of_a_key_give_their_pairs():
    many = list(range(L.FEW + 1))
    rows = [(1, 5, 2), (1, 9, 2)] + [(2, m, 3) for m in (-4, 5, 7)] + [(3, m, L.FEW + 1) for m in many]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["key", "mark", "size"])
    got = [tuple(r.values()) for b in L._pairs(iter([batch])) for r in b.to_pylist()]
    assert sorted(r[1:] for r in got if r[0] is None) == [(-4, 5), (-4, 7), (5, 7), (5, 9)]
    assert [r for r in got if r[0] is not None] == [(3, m, None) for m in many]


def test_lines_with_gaps_and_without_words(spark):
    text = "  first line of the text\t\n\n \x0b \nfirst line of the text\r\n\tan other one here\n  \nfirst line of the text"
    got = L.dedup(spark.createDataFrame([(1, text), (1, text), (None, text), (2, None), (3, "")], "doc_id long, text string")).collect()
    removed = sorted((r.doc_id or 0, r.removed_lines) for r in got if r.removed_lines)
    assert removed == [(0, [0, 3, 4, 6]), (1, [3, 6]), (1, [3, 6])]
    assert {r.doc_id: r.n_lines for r in got}[1] == 7
