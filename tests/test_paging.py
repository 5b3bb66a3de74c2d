"""Pages of a written order: joined they are the whole, each reads one or two ranges."""
import pytest
from pyspark.sql import functions as F

from dealflow.operators import paging

def order():
    return [F.col("v").desc_nulls_last(), F.col("id")]


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pages") / "t")
    # a third of all rows share one value, some have none
    df = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 11 == 0, None).otherwise(F.col("id") * 37 % 101).alias("v"),
                                  F.lit("x").alias("_row"))
    paging.write_ordered(df.drop("_row"), path, order(), ranges=8)
    return path, [tuple(r) for r in df.drop("_row").orderBy(*order()).collect()]


@pytest.mark.parametrize("size", [1000, 137, 64, 7])
def test_pages_make_the_whole(spark, written, size):
    path, want = written
    got = []
    for k in range(-(-len(want) // size)) if size > 7 else (0, 1, 50, 142):
        page = [tuple(r) for r in paging.page(spark, path, k, size).collect()]
        assert page == want[k * size:(k + 1) * size]
        got += page
    assert size == 7 or got == want
    assert paging.page(spark, path, 5000, size).collect() == [] and paging.page(spark, path, 0, size).columns == ["id", "v"]


def test_a_page_reads_one_or_two_ranges(spark, written):
    path, want = written
    spans = [(r.first_row, r.first_row + r.n_rows) for r in paging.directory(spark, path).orderBy("range").collect()]
    assert len(spans) > 3 and spans[0][0] == 0 and spans[-1][1] == len(want) and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    size = min(b - a for a, b in spans)
    for k in range(len(want) // size):
        read = {f.split("_range=")[1].split("/")[0] for f in paging.page(spark, path, k, size).inputFiles()}
        assert len(read) <= 2


def test_an_empty_result(spark, tmp_path):
    path = str(tmp_path / "none")
    paging.write_ordered(spark.range(0).select("id", F.col("id").alias("v")), path, order())
    assert paging.page(spark, path, 0, 10).count() == 0 and paging.directory(spark, path).count() == 0
