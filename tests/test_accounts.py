"""What a job reports of its rows equals counts made separately, and reporting changes no result."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from areaframe.operators.accounts import Accounts, NoAccounts
from areaframe.plans import area_features, health_profile, model_features
from areaframe.queries.area_sources import derived_sources


def test_counts_of_single_steps(spark):
    frame = spark.createDataFrame([(1, "a", 1.0), (2, None, float("nan")), (None, "b", None), (4, "c", 2.0)], "i int, s string, x double")
    accounts = Accounts()
    some = accounts.keep(frame, "large", F.col("i") > 1, ["i", "s", "x"])
    full = accounts.keep_complete(some, "complete")
    assert rows(full) == [(4, "c", 2.0)]
    assert accounts.counts() == {
        "large": {"rows": 4, "dropped": 2, "missing_i": 1, "missing_s": 1, "missing_x": 2},
        "complete": {"rows": 2, "dropped": 1, "missing_i": 0, "missing_s": 1, "missing_x": 1},
    }
    table = accounts.table(spark)
    assert table.columns == ["step", "measure", "value"] and table.count() == 10
    with pytest.raises(ValueError, match="two steps"):
        accounts.keep(frame, "large", F.col("i") > 1)
    assert rows(NoAccounts().keep_complete(frame, "any")) == rows(frame.na.drop())


@pytest.fixture(scope="module")
def sources(spark, tiny):
    return derived_sources(spark, tiny)


def test_the_area_job(sources):
    accounts = Accounts()
    got = area_features(sources, 1998, accounts=accounts)
    assert rows(got) == rows(area_features(sources, 1998))
    seen = accounts.counts()
    streets, energy = sources["greenstreets"], sources["energy"]
    assert seen["closed greenstreets"] == {
        "rows": streets.count(), "dropped": streets.filter("status IN ('Retired', 'Archived')").count(),
        "missing_status": streets.filter("status IS NULL").count(),
    }
    needed = ["year", "postal_code", "score", "electricity", "green_power", "natural_gas"]
    assert seen["incomplete buildings"] == {
        "rows": energy.count(), "dropped": energy.count() - energy.na.drop(subset=needed).count(),
        **{f"missing_{c}": energy.filter(F.col(c).isNull()).count() for c in needed},
    }
    assert seen["incomplete areas"]["rows"] - seen["incomplete areas"]["dropped"] == got.count()


def test_the_model_and_health_jobs(sources):
    accounts = Accounts()
    got = model_features(sources, 1998, accounts=accounts)
    assert rows(got) == rows(model_features(sources, 1998))
    seen, lots, trees = accounts.counts(), sources["parcels"], sources["trees"]
    assert seen["lots without land use"] == {
        "rows": lots.count(), "dropped": lots.filter("landuse IS NULL").count(), "missing_landuse": lots.filter("landuse IS NULL").count(),
    }
    assert seen["lots of ignored land use"]["dropped"] == lots.filter("landuse = '09'").count()
    contradictory = trees.filter("health IS NULL AND status = 'Alive'").count()
    assert seen["trees that contradict themselves"]["dropped"] == contradictory
    again = Accounts()
    health_profile(trees, accounts=again).collect()
    assert again.counts()["trees that contradict themselves"]["rows"] == trees.count()
