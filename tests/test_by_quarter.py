"""Deals by touched quarter: the same quarter base, read from one folder."""
import datetime as dt
import os

import pytest

from dealflow.config import ReviewConfig
from dealflow.plans.context import Review
from dealflow.sources import by_quarter, readers
from tests.conftest import SF_SMALL

KEYS = ("create_d", "disco_d", "sal_d", "close_d")


@pytest.fixture(scope="module")
def laid(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("q") / "deals")
    deals = Review.from_test_tables(spark, SF_SMALL).deals
    by_quarter.write(deals, path)
    return deals, path


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("today", [ReviewConfig().today, dt.date(1998, 7, 1), dt.date(1996, 12, 31), dt.date(1994, 5, 9), dt.date(2030, 1, 1)])
def test_same_rows_from_one_folder(spark, laid, today):
    deals, path = laid
    cfg = ReviewConfig(today=today)
    got = by_quarter.qtd_base(spark, path, cfg)
    assert rows(got) == rows(readers.qtd_base(deals, cfg))
    plan = got._jdf.queryExecution().executedPlan()
    assert "quarter" in plan.toString().split("PartitionFilters:")[1].split("]")[0]
    # the files listed for the scan are those of one folder
    read = plan.collectLeaves().head().metrics().apply("numFiles").value()
    folder = f"{path}/quarter={today.year}Q{(today.month + 2) // 3}"
    assert read == (sum(f.endswith(".parquet") for f in os.listdir(folder)) if os.path.exists(folder) else 0)
    assert read < len(spark.read.parquet(path).inputFiles())


def test_a_deal_is_once_in_each_quarter_it_touches(spark, laid):
    deals, path = laid
    got = spark.read.parquet(path)
    assert got.groupBy("deal_id", "quarter").count().where("count > 1").count() == 0
    assert got.groupBy("deal_id").count().where("count > 4").count() == 0
    dated = deals.where(" or ".join(f"{c} is not null" for c in KEYS[:3]) + " or (is_won and close_d is not null)")
    assert got.select("deal_id").distinct().count() == dated.count()
