"""Distributed union-find and linking against plain versions."""
import random

from dealflow.llm.common import cut
from dealflow.llm.links import FEW, components, few_pairs, link
from tests.llm import brute as B


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 520)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in components(df).collect()}
    want = B.roots(600, edges)
    least = {}
    for i, r in enumerate(want):
        least[r] = min(least.get(r, i), i)
    assert got == {i: least[r] for i, r in enumerate(want) if least[r] != i}
    assert components(df.limit(0)).count() == 0


def test_link_finds_every_component(spark):
    """Nodes are numbers, similar when they differ by one; all share one key."""
    from pyspark.sql import functions as F
    nodes = [n for n in range(200) if n % 17]
    keys = spark.createDataFrame([(1, n) for n in nodes] + [(2, 500), (2, 501), (3, 900)], "key long, node long")
    edges, roots = link(keys, lambda a, b: F.lit(True), lambda p: p.where(F.abs(F.col("a") - F.col("b")) == 1))
    got = {r.node: r.root for r in roots.collect()}
    want = {n: max(m for m in range(n + 1) if m == 0 or (m - 1) % 17 == 0) for n in nodes}
    want = {n: r for n, r in want.items() if n != r} | {501: 500}
    assert {n: r for n, r in got.items() if n != r} == want


def test_keys_of_a_few_nodes_are_settled_once(spark):
    """Rare keys give all their pairs at once; no later round tests one of them again."""
    from pyspark.sql import functions as F
    rng = random.Random(11)
    groups = {k: rng.sample(range(400), rng.choice([2, 3, FEW])) for k in range(150)} | {1000: list(range(0, 400, 3))}
    keys = cut(spark.createDataFrame([(k, n, len(g)) for k, g in groups.items() for n in g], "key long, node long, size int"))
    any_pair = lambda a, b: F.lit(True)
    similar = lambda p: p.where(F.abs(F.col("a") - F.col("b")) <= 3)
    tested = cut(few_pairs(keys, "node", any_pair))
    want = {(a, b) for g in groups.values() if len(g) <= FEW for a in g for b in g if a < b}
    assert sorted((r.a, r.b) for r in tested.collect()) == sorted(want)
    later = []

    def verify(pairs):
        later.extend((r.a, r.b) for r in pairs.collect())
        return similar(pairs)

    edges, roots = link(keys.where(F.col("size") > FEW), any_pair, verify, tested=tested, edges=cut(similar(tested)))
    assert later and not want & set(later)
    pairs = want | {(a, b) for a in groups[1000] for b in groups[1000] if a < b}
    root = B.roots(400, [(a, b) for a, b in pairs if b - a <= 3])
    least = {}
    for i, r in enumerate(root):
        least[r] = min(least.get(r, i), i)
    assert {r.node: r.root for r in roots.collect() if r.node != r.root} == {i: least[r] for i, r in enumerate(root) if least[r] != i}
    assert {(r.a, r.b) for r in edges.collect()} <= {(a, b) for a, b in pairs if b - a <= 3}
