"""Quality rules: the common words alone decide about texts without function words."""
import random

from pyspark.sql import functions as F

from dealflow.llm import quality_rules
from tests.conftest import SF_SMALL
from tests.llm import brute as B


def made(seed, letters, n=300):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices(letters, k=rng.randint(3, 9))) for _ in range(n))


def test_texts_without_function_words_go_and_clean_ones_stay(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    keywords = "camera lens tripod battery charger sensor shutter zoom flash filter strap memory card reader light".split()
    rng = random.Random(3)
    odd = {-1: made(1, "abcdefghijklmnopqrstuvwxyz"), -2: made(2, "bcdfghjklmnpqrstvwxz"),
           -3: " ".join(rng.choices(keywords, k=400)), -4: " ".join(f"{w} that" for w in made(4, "aeioulnrst", 200).split())}
    table = docs.unionByName(spark.createDataFrame([(i, t, "en") for i, t in odd.items()], docs.schema))
    got = {r.doc_id: r for r in quality_rules.verdicts(table).collect()}
    for i in odd:
        assert not got[i].base_failed and not got[i].kept, i
    before = {r.doc_id: r.kept for r in quality_rules.verdicts(table, common=False).collect()}
    assert all(before[i] for i in odd)  # the two distances of the query op7 let them pass
    clean = docs.join(labels.where("quality = 1"), "doc_id").select("doc_id", "lang").distinct().collect()
    assert {r.lang for r in clean} == set(quality_rules.COMMON)
    assert all(got[r.doc_id].kept for r in clean if before[r.doc_id])
    kept = {r.doc_id for r in quality_rules.passing(table).collect()}
    assert kept == {i for i, r in got.items() if r.kept}


def test_common_words_match_definition(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text", "lang")
    table = {r.doc_id: r for r in quality_rules.counts(docs).collect()}
    sums = [[sum(r.listed[i] for r in table.values() if r.lang == x and r.n_words >= 50) for i in range(len(r.listed) - 1)]
            for x in quality_rules.COMMON for r in [next(iter(table.values()))]]
    judged = 0
    for r in quality_rules.verdicts(docs).collect():
        known = table[r.doc_id].listed[:-1]
        assert (r.common_share is None) == (r.n_words < 50) and (r.common_distance is None) == (sum(known) < 50)
        assert r.common_share is None or abs(r.common_share - sum(known) / r.n_words) < 1e-6
        if r.common_distance is not None:
            judged += 1
            assert abs(r.common_distance - min(B.distance(known, q) for q in sums)) < 1e-6
    assert judged > 20


def test_quartiles(spark):
    values = [0.1, 0.2, 0.2, 0.3, 0.4, 0.5, 0.9, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert quality_rules.quartiles(df, "v") == (0.2, 0.5)
    assert quality_rules.quartiles(df.where("v is null"), "v") is None
    same = df.select(F.lit(0.5).alias("v"))
    assert quality_rules.quartiles(same, "v") == (0.5, 0.5)
