"""n_links of the n-gram Jaccard join: every link between different texts is counted."""
import collections

from dealflow.llm import jaccard_join
from tests.conftest import SF_SMALL
from tests.llm import brute as B


def links(rows, n=3, percent=90):
    texts = {t: B.shingles(t, n) for _, t in rows}
    holders = collections.defaultdict(set)
    for t, s in texts.items():
        for g in s:
            holders[g].add(t)
    count = {}
    for t, s in texts.items():
        met = collections.Counter(u for g in s for u in holders[g] if u != t)
        count[t] = sum(100 * c >= percent * (len(s) + len(texts[u]) - c) for u, c in met.items())
    return collections.Counter((i, count[t]) for i, t in rows)


def got(df, **settings):
    return collections.Counter((r.doc_id, r.n_links) for r in jaccard_join.linked(df, every_link=True, **settings).collect())


def test_group_of_near_copies(spark):
    base = [f"t{i}" for i in range(120)]
    rows = []
    for i in range(40):
        w = list(base)
        w[i * 3] = f"edit{i}"
        rows.append((i, " ".join(w)))
    rows += [(40, rows[0][1]), (41, rows[0][1].upper()), (42, "  " + rows[1][1]), (43, None), (44, ""), (45, "one"), (46, "One"),
             (47, "quite alone here"), (None, rows[2][1])]
    chain = [f"c{i}" for i in range(200)]
    rows += [(100 + k, " ".join(chain[k * 4:k * 4 + 160])) for k in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = links(rows)
    assert max(n for _, n in want) >= 39 + 2  # a built component alone has about one link a member
    assert got(df) == want
    assert collections.Counter((r.doc_id, r.component_id) for r in jaccard_join.linked(df, every_link=True).collect()) \
        == collections.Counter((i, c) for i, _, c in B.op8(rows))


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert got(docs) == links(rows)
    assert got(docs, ngram=5, percent=80) == links(rows, 5, 80)
    assert got(docs.limit(0)) == {}
