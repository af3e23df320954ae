"""The complete jobs over sources derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import (
    area_features,
    health_pivot,
    health_profile,
    health_summary,
    land_use_histogram,
    model_features,
    prepare_features,
    train_and_evaluate,
)
from ..plans.common import KEY as KEY_COLUMN
from ..plans.model_features import MODEL_COLUMNS
from ..plans.train_evaluate import TARGET, UNSCALED
from ..session import cut_lineage
from .area_sources import derived_sources, source_sql
from .registry import query, table
from .scoring import split_rows_sql

YEAR = 1998


# A text key in its one spelling, and what a lenient parser makes of dirty text.
KEY = (
    "CASE WHEN regexp_full_match(trim({0}), '[0-9]+([.]0*)?') THEN "
    "CASE WHEN length(regexp_extract(trim({0}), '^[0-9]+')) < 5 "
    "THEN lpad(regexp_extract(trim({0}), '^[0-9]+'), 5, '0') "
    "ELSE regexp_extract(trim({0}), '^[0-9]+') END ELSE {0} END"
)
NUMBER = (
    "CASE WHEN regexp_full_match({0}, '\\s*[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)\\s*') "
    "THEN try_cast(trim({0}) AS DOUBLE) END"
)
CODE_KEY = (
    "CASE WHEN length(cast(cast(postcode AS BIGINT) AS VARCHAR)) < 5 "
    "THEN lpad(cast(cast(postcode AS BIGINT) AS VARCHAR), 5, '0') "
    "ELSE cast(cast(postcode AS BIGINT) AS VARCHAR) END"
)


def mode_cte(name: str, source: str, value: str) -> str:
    return (
        f"{name} AS (SELECT z, first({value} ORDER BY n DESC, {value}) AS {value} FROM "
        f"(SELECT z, {value}, count(*) AS n FROM {source} WHERE {value} IS NOT NULL AND "
        f"z IS NOT NULL GROUP BY z, {value}) GROUP BY z)"
    )


SPINE_SQL = (
    f"spine AS (SELECT i.z, median_income, population, hvi FROM "
    f"(SELECT {KEY.format('zipcode')} AS z, median_income FROM income) i "
    f"JOIN (SELECT {KEY.format('zipcode')} AS z, population FROM population) p ON i.z = p.z "
    f"JOIN (SELECT {KEY.format('zipcode')} AS z, hvi FROM heat_index) h ON i.z = h.z)"
)
STREETS_SQL = (
    f"streets AS (SELECT {KEY.format('zipcode')} AS z, zipcode, acres FROM greenstreets "
    "WHERE status IS NULL OR status NOT IN ('Retired', 'Archived'))"
)

AREA_SQL = (
    "WITH "
    + source_sql(
        "income", "population", "heat_index", "greenstreets", "energy", "parcels", "gardens",
        "trees", "college", "justice", "poverty",
    )
    + f", {SPINE_SQL}, {STREETS_SQL}, "
    "acres AS (SELECT z, sum(acres) AS acres FROM streets GROUP BY z), "
    "buildings AS (SELECT nullif(regexp_extract(postal_code, '[0-9]{5}'), '') AS z, "
    f"{NUMBER.format('score')} AS score, {NUMBER.format('electricity')} AS electricity, "
    f"{NUMBER.format('green_power')} AS green_power, {NUMBER.format('natural_gas')} AS natural_gas "
    "FROM energy WHERE postal_code IS NOT NULL AND score IS NOT NULL AND electricity IS NOT NULL "
    f"AND green_power IS NOT NULL AND natural_gas IS NOT NULL AND year = {YEAR}), "
    "power AS (SELECT z, avg(score) AS score, coalesce(sum(electricity), 0) / count(*) AS e, "
    "coalesce(sum(green_power), 0) / count(*) AS g, coalesce(sum(natural_gas), 0) / count(*) AS n "
    "FROM buildings WHERE z IS NOT NULL GROUP BY z), "
    f"lots AS (SELECT {CODE_KEY} AS z, * FROM parcels WHERE postcode IS NOT NULL), "
    "sizes AS (SELECT z, sum(numbldgs) AS b, sum(unitsres) AS u, sum(bldgarea) AS a FROM lots GROUP BY z), "
    + mode_cte("boroughs", "lots", "borough")
    + ", plots AS (SELECT z, count(*) AS n FROM gardens JOIN lots ON gardens.block = lots.block GROUP BY z), "
    f"wood AS (SELECT {KEY.format('postcode')} AS z, status, nta_name FROM trees), "
    "alive AS (SELECT z, count(*) AS n FROM wood WHERE status = 'Alive' GROUP BY z), "
    + mode_cte("places", "wood", "nta_name")
    + f", degrees AS (SELECT {KEY.format('zipcode')} AS z, college_percent / 100 AS c FROM college), "
    f"shares AS (SELECT {KEY.format('zipcode')} AS z, {NUMBER.format('white_percent')} AS w, "
    f"{NUMBER.format('black_percent')} AS b, {NUMBER.format('jail_admissions_per_100k')} AS j FROM justice), "
    "poor AS (SELECT replace(name, 'ZCTA5 ', '') AS z, round_even(10000 * (cast(estimate AS BIGINT)::DOUBLE "
    "/ nullif(cast(total AS BIGINT), 0)), 0) / 10000 AS p FROM poverty "
    "WHERE regexp_full_match(name, 'ZCTA5 [0-9]+')), "
    "full_ AS (SELECT spine.z AS zipcode, borough, nta_name AS neighborhood, population, "
    "sizes.a / nullif(sizes.b, 0) AS average_building_area, "
    "sizes.u / nullif(population, 0) AS res_units_per_capita, "
    "score AS mean_energy_star_score_50k_building, "
    "e AS electricity_onsite_renew_per_50k_building, "
    "g AS green_power_onsite_per_50k_building, "
    "power.n AS nat_gas_onsite_per_50k_building, coalesce(alive.n, 0) AS num_trees, "
    "coalesce(acres, 0) AS total_acres_greenstreets, "
    "coalesce(plots.n, 0) AS num_community_gardens, w AS white_percent, shares.b AS black_percent, "
    "p AS poverty_percent, c AS college_percent, j AS jail_admissions_per_100k, "
    "CASE WHEN median_income >= 150000 THEN 3 WHEN median_income >= 100000 THEN 2 "
    "WHEN median_income >= 50000 THEN 1 ELSE 0 END AS income_group, hvi "
    "FROM spine LEFT JOIN acres ON spine.z = acres.z LEFT JOIN power ON spine.z = power.z "
    "LEFT JOIN sizes ON spine.z = sizes.z LEFT JOIN boroughs ON spine.z = boroughs.z "
    "LEFT JOIN plots ON spine.z = plots.z LEFT JOIN alive ON spine.z = alive.z "
    "LEFT JOIN places ON spine.z = places.z LEFT JOIN degrees ON spine.z = degrees.z "
    "LEFT JOIN shares ON spine.z = shares.z LEFT JOIN poor ON spine.z = poor.z) "
    "SELECT * FROM full_ WHERE borough IS NOT NULL AND neighborhood IS NOT NULL "
    "AND average_building_area IS NOT NULL AND res_units_per_capita IS NOT NULL "
    "AND mean_energy_star_score_50k_building IS NOT NULL AND white_percent IS NOT NULL "
    "AND black_percent IS NOT NULL AND poverty_percent IS NOT NULL "
    "AND college_percent IS NOT NULL AND jail_admissions_per_100k IS NOT NULL"
)


@query(AREA_SQL)
def area_feature_table(spark: SparkSession, folder: str) -> DataFrame:
    return area_features(derived_sources(spark, folder), YEAR)


KEPT_SQL = (
    "kept AS (SELECT postcode, CASE health WHEN 'Good' THEN 0 WHEN 'Fair' THEN 1 WHEN 'Poor' THEN 2 "
    "ELSE 3 END AS health FROM trees WHERE NOT (health IS NULL AND coalesce(status = 'Alive', FALSE)))"
)
GROUP_SQL = (
    "CASE {0} WHEN '01' THEN 1 WHEN '02' THEN 1 WHEN '03' THEN 1 WHEN '04' THEN 2 WHEN '05' THEN 2 "
    "WHEN '06' THEN 3 WHEN '07' THEN 3 WHEN '08' THEN 3 WHEN '10' THEN 4 WHEN '11' THEN 4 END"
)
MODEL_SQL = (
    "WITH "
    + source_sql(
        "income", "population", "heat_index", "greenstreets", "energy", "parcels", "gardens", "trees"
    )
    + f", {SPINE_SQL}, {STREETS_SQL}, {KEPT_SQL}, "
    "acres AS (SELECT z, count(*) AS n, sum(acres) AS acres FROM streets "
    "WHERE zipcode NOT LIKE '%,%' GROUP BY z), "
    "buildings AS (SELECT nullif(regexp_extract(postal_code, '[0-9]{5}'), '') AS z, "
    f"{NUMBER.format('score')} AS score, {NUMBER.format('target_score')} AS target, "
    f"{NUMBER.format('electricity')} AS electricity FROM energy WHERE year = {YEAR}), "
    "power AS (SELECT z, avg(score) AS score, avg(target - score) AS gap, sum(electricity) AS e "
    "FROM buildings WHERE z IS NOT NULL GROUP BY z), "
    f"lots AS (SELECT {CODE_KEY} AS z, * FROM parcels WHERE postcode IS NOT NULL "
    "AND landuse IS NOT NULL AND landuse <> '09'), "
    "sizes AS (SELECT z, sum(unitstotal) AS u, sum(bldgarea) AS a FROM lots GROUP BY z), "
    + mode_cte("uses", "lots", "landuse")
    + ", "
    + mode_cte("boroughs", "lots", "borough")
    + ", plots AS (SELECT z, count(*) AS n FROM gardens JOIN lots ON gardens.block = lots.block GROUP BY z), "
    f"health AS (SELECT {KEY.format('postcode')} AS z, count(*) AS n, "
    "(count(*) FILTER (WHERE health = 0))::DOUBLE / count(*) AS good FROM kept GROUP BY ALL), "
    "model AS (SELECT cast(spine.z AS INTEGER) AS zipcode, median_income AS median_income, "
    "population, hvi, coalesce(acres.n, 0) AS num_greenstreets, "
    "coalesce(acres, 0) AS total_acres_greenstreets, "
    "coalesce(score, 0) AS mean_energy_star_score_50k, "
    "coalesce(gap, 0) AS mean_gap_energy_star_score_50k, "
    "coalesce(e, 0) AS electricity_onsite_renew_50k, "
    f"{GROUP_SQL.format('landuse')} AS most_common_landuse_code, "
    "coalesce(sizes.u, 0) AS total_units, coalesce(sizes.a, 0) AS total_building_areas, "
    "CASE borough WHEN 'MN' THEN 0 WHEN 'SI' THEN 1 WHEN 'BX' THEN 2 WHEN 'QN' THEN 3 WHEN 'BK' THEN 4 END "
    "AS borough, coalesce(plots.n, 0) AS num_community_gardens, health.n AS num_trees, "
    "good AS proportion_healthy_trees "
    "FROM spine LEFT JOIN acres ON spine.z = acres.z LEFT JOIN power ON spine.z = power.z "
    "LEFT JOIN sizes ON spine.z = sizes.z LEFT JOIN uses ON spine.z = uses.z "
    "LEFT JOIN boroughs ON spine.z = boroughs.z LEFT JOIN plots ON spine.z = plots.z "
    "LEFT JOIN health ON spine.z = health.z) "
)


@query(MODEL_SQL + "SELECT * FROM model")
def model_feature_table(spark: SparkSession, folder: str) -> DataFrame:
    return model_features(derived_sources(spark, folder), YEAR)


@query(
    MODEL_SQL + "SELECT most_common_landuse_code, count(*) AS count, "
    "CASE most_common_landuse_code WHEN 1 THEN 'Residential' WHEN 2 THEN 'Commercial' "
    "WHEN 3 THEN 'Industrial' WHEN 4 THEN 'Undeveloped' ELSE 'Unknown' END AS label FROM model "
    "WHERE most_common_landuse_code IS NOT NULL GROUP BY ALL"
)
def land_use_of_areas(spark: SparkSession, folder: str) -> DataFrame:
    return land_use_histogram(model_features(derived_sources(spark, folder), YEAR))


HEALTH_SHARE = "(count(*) FILTER (WHERE health = {0}))::DOUBLE / count(*)"
HEALTH_SQL = f"WITH {source_sql('trees')}, {KEPT_SQL} "


@query(
    HEALTH_SQL + "SELECT postcode, count(*) AS treeCount, "
    + ", ".join(
        f"{HEALTH_SHARE.format(code)} AS {name}Proportion"
        for code, name in ((3, "dead"), (2, "poor"), (1, "fair"), (0, "good"))
    )
    + " FROM kept WHERE postcode IS NOT NULL GROUP BY postcode"
)
def tree_health_profile(spark: SparkSession, folder: str) -> DataFrame:
    return health_profile(derived_sources(spark, folder)["trees"])


@query(
    HEALTH_SQL + f"SELECT postcode AS zipcode, count(*) AS treeCount, {HEALTH_SHARE.format(0)} "
    "AS goodProportion FROM kept WHERE postcode IS NOT NULL GROUP BY postcode"
)
def tree_health_summary(spark: SparkSession, folder: str) -> DataFrame:
    return health_summary(derived_sources(spark, folder)["trees"])


@query(
    HEALTH_SQL + "SELECT postcode, "
    + ", ".join(f'{HEALTH_SHARE.format(code)} AS "{code}"' for code in range(4))
    + " FROM kept WHERE postcode IS NOT NULL GROUP BY postcode"
)
def tree_health_pivot(spark: SparkSession, folder: str) -> DataFrame:
    return health_pivot(derived_sources(spark, folder)["trees"])


@query(
    "WITH t AS (SELECT source, lang, quality FROM documents LEFT JOIN labels "
    "ON documents.doc_id = labels.doc_id WHERE NOT (quality IS NULL AND lang = 'en')), "
    "k AS (SELECT source, CASE quality WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE 3 END AS health FROM t) "
    "SELECT source, count(*) AS treeCount, "
    + ", ".join(
        f"{HEALTH_SHARE.format(code)} AS {name}Proportion"
        for code, name in ((3, "dead"), (2, "poor"), (1, "fair"), (0, "good"))
    )
    + " FROM k GROUP BY source",
    name="health_profile",
)
def document_health_profile(spark: SparkSession, folder: str) -> DataFrame:
    """The profile over naturally missing values: labels stand in for health."""
    documents, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    judged = documents.select("doc_id", "source", "lang").join(labels, "doc_id", "left")
    trees = judged.select(
        "source",
        F.when(F.col("lang") == "en", "Alive").otherwise("Stump").alias("status"),
        F.when(F.col("quality") == 0, "Poor").when(F.col("quality") == 1, "Good").alias("health"),
    )
    return health_profile(trees, "source")


SCALED = [c for c in MODEL_COLUMNS if c not in (KEY_COLUMN, TARGET, *UNSCALED)]
PREPARED_SQL = (
    MODEL_SQL
    + f", m AS (SELECT * REPLACE (cast({TARGET} - 1 AS INTEGER) AS {TARGET}) FROM model), "
    + split_rows_sql("m", KEY_COLUMN, TARGET)
    + f", t AS (SELECT m.*, split FROM m JOIN r ON {KEY_COLUMN} = id), s AS (SELECT "
    + ", ".join(f"avg({c}) AS {c}_mean, coalesce(nullif(stddev_pop({c}), 0), 1) AS {c}_scale" for c in SCALED)
    + f" FROM t WHERE split = 'train') SELECT {KEY_COLUMN}, {TARGET}, split, {', '.join(UNSCALED)}, "
    + ", ".join(f"round(({c} - {c}_mean) / {c}_scale, 6) AS {c}" for c in SCALED)
    + " FROM t, s"
)


@query(PREPARED_SQL)
def prepared_model_table(spark: SparkSession, folder: str) -> DataFrame:
    """Labels from 0, split and scaled, ready for the fits."""
    prepared = prepare_features(cut_lineage(model_features(derived_sources(spark, folder), YEAR)))
    return prepared.withColumns({c: F.round(c, 6) for c in SCALED})


@query()
def train_evaluate(spark: SparkSession, folder: str) -> DataFrame:
    features = model_features(derived_sources(spark, folder), YEAR)
    return train_and_evaluate(features)
