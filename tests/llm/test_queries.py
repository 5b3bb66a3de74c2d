"""Every registered query over whole tables, against brute force or DuckDB."""
import collections
import json
import zlib

import duckdb
import numpy as np
import pytest

import __spark_entry__ as E
from dealflow.llm import line_dedup, mixing, pii, quality_classifier, sharding, token_counts
from tests.conftest import SF_SMALL
from tests.llm import brute as B


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def docs(con):
    return con.execute("SELECT doc_id, text FROM documents").fetchall()


def rows(spark, name, *columns):
    df = E.queries()[name](spark, SF_SMALL)
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_substring_dedup(spark, docs):
    assert rows(spark, "op1_substring_dedup") == sorted(B.op1(docs))


def test_mixing(spark, con):
    got = E.queries()["op2_source_mixing"](spark, SF_SMALL).collect()
    full = con.execute("SELECT doc_id, source, text FROM documents").fetchall()
    size, source = {i: len(B.words(t)) for i, _, t in full}, {i: s for i, s, _ in full}
    total = collections.Counter()
    for i, s, _ in full:
        total[s] += size[i]
    goal = B.op2_targets(total)
    assert len(got) == len(full)
    taken = collections.Counter()
    for r in got:
        s = source[r.doc_id]
        assert r["size"] == size[r.doc_id] and r.source_size == total[s]
        assert r.target == pytest.approx(goal[s])
        assert 0 <= r.taken <= 2 * r["size"] and r.taken % max(1, r["size"]) == 0
        taken[s] += r.taken
    for s, words in taken.items():
        assert abs(words - goal[s]) <= max(size[i] for i in size if source[i] == s)
    again = E.queries()["op2_source_mixing"](spark, SF_SMALL).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_decontamination(spark, con, docs):
    items = con.execute("SELECT item_id, text FROM benchmark").fetchall()
    assert rows(spark, "op3_benchmark_decontamination") == sorted(B.op3(docs, items))


def lines_of(docs):
    """(doc_id, line number, bytes without gaps at the ends) of lines with a word."""
    for doc_id, text in docs:
        for i, line in enumerate((text or "").split("\n")):
            if B.words(line):
                yield doc_id, i, line.encode().strip(b" \t\n\x0b\x0c\r")


def grams(line, n=line_dedup.GRAM):
    return {line[i:i + n] for i in range(max(1, len(line) - n + 1))}


def test_line_dedup(spark, docs):
    got = {r[0]: r[1] for r in rows(spark, "op4_line_dedup", "doc_id", "removed_lines")}
    all_lines = list(lines_of(docs))
    distinct = list(dict.fromkeys(x for _, _, x in all_lines))
    sets = [grams(x) for x in distinct]
    holders = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    links = []
    for i, s in enumerate(sets):
        common = collections.Counter(j for g in s for j in holders[g] if j > i)
        links += [(i, j) for j, c in common.items() if 100 * c >= 80 * (len(s) + len(sets[j]) - c)]
    root = dict(zip(distinct, B.roots(len(distinct), links), strict=True))
    stay = {}
    for doc_id, i, x in all_lines:
        stay[root[x]] = min(stay.get(root[x], (doc_id, i)), (doc_id, i))
    wanted = {(d, i) for d, i, x in all_lines if stay[root[x]] != (d, i)}
    removed = {(d, i) for d, gone in got.items() for i in gone or ()}
    assert removed <= wanted  # nothing is removed without an exact similarity chain to a kept line
    assert len(removed) >= 0.99 * len(wanted)


def test_classifier_on_held_out_rows(spark, con):
    got = {r.doc_id: r for r in E.queries()["op5_quality_classifier"](spark, SF_SMALL).collect()}
    labels = dict(con.execute("SELECT doc_id, quality FROM labels").fetchall())
    assert len(got) == con.execute("SELECT count(*) FROM documents").fetchone()[0]
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    out = [(got[i].predicted, q) for i, q in labels.items() if got[i].held_out]
    assert np.mean([p == q for p, q in out]) >= 0.9


def test_token_counts(spark, docs):
    size = token_counts.lengths([t for _, t in docs])
    for r in E.queries()["op6_token_counts"](spark, SF_SMALL).collect():
        assert r.n_docs == (size == r.n_tokens).sum()
        assert r.docs_at_least == (size >= r.n_tokens).sum() and r.docs_up_to == (size <= r.n_tokens).sum()
        assert r.tokens_at_least == size[size >= r.n_tokens].sum()
        assert r.truncated_total == np.minimum(size, r.n_tokens).sum()
    sums = E.queries()["op6_token_counts"](spark, SF_SMALL)
    assert sums.count() == len(set(size))
    assert token_counts.truncated_total(sums, 77) == np.minimum(size, 77).sum()
    assert token_counts.quantile(sums, 0.5) == np.sort(size)[int(np.ceil(0.5 * len(size))) - 1]


def test_quality_rules_base(spark, docs):
    got = rows(spark, "op7_quality_rules", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
               "n_repeat_words", "base_failed")
    assert got == sorted(B.op7_base(docs))


def test_jaccard_join(spark, docs):
    assert rows(spark, "op8_ngram_jaccard_join") == sorted(B.op8(docs))


def test_personal_data(spark, docs):
    text = dict(docs)
    for r in E.queries()["op9_personal_data"](spark, SF_SMALL).collect():
        base = B.op9_base(text[r.doc_id])
        count = collections.Counter(k for k, _, _ in base)
        assert [count[k] for k in pii.BASE_KINDS] == [r.n_email, r.n_ip, r.n_card, r.n_phone]
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == B.sha(joined)
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))


def hilbert_2d(order, x, y):
    """Index of a point on the plane curve, the textbook way."""
    d, s = 0, 1 << (order - 1)
    while s:
        rx, ry = int(bool(x & s)), int(bool(y & s))
        d += s * s * ((3 * rx) ^ ry)
        if not ry:
            if rx:
                x, y = s - 1 - (x & (s - 1)), s - 1 - (y & (s - 1))
            x, y = y, x
        x, y, s = x & (s - 1), y & (s - 1), s >> 1
    return d


def test_hilbert_curve_visits_neighbours(spark):
    """Consecutive positions are neighbouring cells, and every cell is visited once."""
    for n, bits in ((2, 4), (3, 3)):
        cells = 1 << (n * bits)
        grid = spark.range(cells).select(*[((spark_id() / (1 << (bits * i))).cast("long") % (1 << bits)).alias(f"d{i}")
                                           for i in range(n)])
        dims = [grid[f"d{i}"] for i in range(n)]
        got = sorted((r["hilbert"], *(r[f"d{i}"] for i in range(n)))
                     for r in sharding.with_hilbert(grid, dims, bits).collect())
        assert [g[0] for g in got] == list(range(cells))
        for a, b in zip(got, got[1:], strict=False):
            assert sum(abs(p - q) for p, q in zip(a[1:], b[1:], strict=True)) == 1


def spark_id():
    from pyspark.sql import functions as F
    return F.floor(F.col("id"))


def test_sharding(spark, docs):
    got = E.queries()["op10_hilbert_sharding"](spark, SF_SMALL).collect()
    text = dict(docs)
    for r in got:
        raw = (text[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    per = collections.defaultdict(list)
    for r in got:
        per[r.shard].append(r.slot)
    assert sorted(per) == list(range(8)) and len(got) == len(docs)
    assert all(sorted(s) == list(range(len(s))) for s in per.values())
    assert max(map(len, per.values())) - min(map(len, per.values())) <= 1
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.hilbert for r in order] == sorted(r.hilbert for r in got)


def test_oracles(spark, con):
    from dealflow.llm.queries import ORACLE_SQL
    for name, sql in ORACLE_SQL.items():
        df = E.queries()[name](spark, SF_SMALL)
        cols = sorted(df.columns)
        exp = con.execute(sql)
        names = [c[0] for c in exp.description]
        assert sorted(names) == cols, name
        want = [tuple(r[names.index(c)] for c in cols) for r in exp.fetchall()]
        got = [tuple(r) for r in df.select(*cols).collect()]
        assert sorted(map(json.dumps, got)) == sorted(map(json.dumps, want)), name


def test_mixing_targets_match_round_by_round_clamping(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, None: 70, "é": 0, "z": 300}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got == pytest.approx(B.op2_targets(sizes))


def test_train_ignores_held_out_labels(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    from pyspark.sql import functions as F
    lied = labels.withColumn("quality", F.when(quality_classifier.held_out(F.col("doc_id")), 1 - F.col("quality"))
                             .otherwise(F.col("quality")))
    a, b = quality_classifier.train(docs, labels), quality_classifier.train(docs, lied)
    assert (a == b).all()
