"""Sharding hands the whole rows on and writes them per shard."""
import collections
import glob
import re

import pyarrow.parquet as pq

import corpus_pipeline as P
from dealflow.llm import sharding
from tests.conftest import SF_SMALL


def bag(rows):
    return collections.Counter(tuple(r) for r in rows)


def test_last_stage_returns_the_texts(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    docs = docs.unionByName(docs.limit(20))  # copies, as the mix makes them
    got = P.shards(spark, docs, SF_SMALL)
    assert got.columns[:len(docs.columns)] == docs.columns
    assert bag(got.select(*docs.columns).collect()) == bag(docs.collect())
    names = ["doc_id", *sharding.PLACEMENT]
    assert bag(got.select(*names).collect()) == bag(sharding.shard(docs).select(*names).collect())


def test_files_per_shard(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    sharding.write_shards(docs, f"{tmp_path}/out", 4)
    seen, counts = [], collections.Counter()
    for f in glob.glob(f"{tmp_path}/out/shard=*/*.parquet"):
        t = pq.ParquetFile(f).read().to_pydict()
        shard = int(re.search(r"shard=(\d+)", f)[1])
        assert t["hilbert"] == sorted(t["hilbert"]) and t["slot"] == list(range(t["slot"][0], t["slot"][-1] + 1))
        counts[shard] += len(t["slot"])
        seen += zip(t["doc_id"], t["text"], t["lang"], t["source"], strict=True)
    assert bag(seen) == bag(docs.select("doc_id", "text", "lang", "source").collect())
    assert sorted(counts) == [0, 1, 2, 3] and max(counts.values()) - min(counts.values()) <= 1


def test_columns_of_the_same_name_stay(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "en", "s", -i, None) for i in range(9)] + [(None, None, None, None, 5, 7)],
                                 "doc_id long, text string, lang string, source string, size long, Shard int")
    got = sharding.sharded(docs, 2)
    assert bag(got.select(*docs.columns).collect()) == bag(docs.collect())
    assert {r.placed_shard for r in got.collect()} == {0, 1} and all(r.placed_size > 0 for r in got.collect())
    assert sharding.sharded(docs.limit(0)).count() == 0


def test_placing_again_and_again_finds_free_names(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"text {i}" * (i % 5), "en", "s", i) for i in range(20)],
                                 "doc_id long, text string, lang string, source string, Placed_Size long")
    for k in range(3):
        columns = rows.columns
        placed = sharding.sharded(rows)
        assert placed.columns[:len(columns)] == columns and len({c.lower() for c in placed.columns}) == len(placed.columns)
        placed.write.parquet(f"{tmp_path}/{k}")
        rows = spark.read.parquet(f"{tmp_path}/{k}")
        assert rows.count() == 20
    assert {"size", "placed_placed_size", "placed_placed_placed_size"} <= {c.lower() for c in rows.columns}
    sharding.write_shards(rows, f"{tmp_path}/again")
    assert spark.read.parquet(f"{tmp_path}/again").count() == 20
