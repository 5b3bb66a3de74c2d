"""The pipeline's stages, each against a plain version on its own input."""
import collections

import corpus_pipeline as P
from dealflow.llm import mixing, quality_rules
from tests.conftest import SF_SMALL
from tests.llm import brute as B


def bag(df, *columns):
    return collections.Counter(tuple(r) for r in df.select(*columns).collect())


def test_stages(spark, tmp_path):
    start = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    docs, seen = start, []
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, SF_SMALL).write.parquet(f"{tmp_path}/{k}")
        seen.append((docs, spark.read.parquet(f"{tmp_path}/{k}")))
        docs = seen[-1][1]
    assert [n for n, _ in P.STAGES] == ["quality_rules", "ngram_jaccard_join", "benchmark_decontamination",
                                        "source_mixing", "hilbert_sharding"]
    for before, after in seen[:-1]:
        assert after.columns == start.columns and after.count() > 0

    def pairs(df):
        return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]

    before, after = seen[0]
    kept = {r.doc_id for r in quality_rules.verdicts(before).where("kept").collect()}
    failed = {r[0] for r in B.op7_base(pairs(before)) if r[6]}
    assert {i for i, _ in pairs(after)} == kept and not kept & failed
    before, after = seen[1]
    assert {i for i, _ in pairs(after)} == {c for _, n, c in B.op8(pairs(before), 5, 80) if n}
    before, after = seen[2]
    assert {i for i, _ in pairs(after)} == {r[0] for r in B.op3(pairs(before), items) if not r[5]}
    before, after = seen[3]
    slim, plan = mixing.mix_plan(before)
    want = collections.Counter({r.doc_id: r.copies for r in mixing.with_copies(slim, plan).collect() if r.copies})
    assert collections.Counter(i for i, _ in pairs(after)) == want
    assert bag(P.run(spark, SF_SMALL), "doc_id", "shard") == bag(seen[4][1], "doc_id", "shard")
    assert seen[4][1].count() == seen[3][1].count()


def test_stages_on_an_empty_table(spark):
    empty = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, empty, SF_SMALL).count() == 0
