"""The pipeline's near-duplicate stage: runs of five words, similarity 0.8 or more."""
import corpus_pipeline as P
from tests.conftest import SF_SMALL
from tests.llm import brute as B


def test_near_duplicate_stage(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = {c for _, n, c in B.op8(rows, 5, 80) if n}
    assert want != {c for _, n, c in B.op8(rows) if n}  # op8's own values keep more
    after = P.near_duplicates(spark, docs, SF_SMALL)
    assert after.columns == docs.columns
    assert {r.doc_id for r in after.select("doc_id").collect()} == want


def test_copy_with_two_words_in_a_hundred_changed_goes(spark):
    words = [f"w{i}" for i in range(100)]
    near = ["x" if i in (30, 70) else w for i, w in enumerate(words)]
    far = ["y" if i % 12 == 5 else w for i, w in enumerate(words)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate((words, near, far))], "doc_id long, text string")
    assert sorted(r.doc_id for r in P.near_duplicates(spark, docs, SF_SMALL).collect()) == [0, 2]
