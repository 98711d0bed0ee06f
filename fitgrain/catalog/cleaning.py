"""Profiling, cleaning and imputation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fitgrain.catalog.registry import (
    mode_map_sql,
    mode_sql,
    query,
    rounded,
    scramble_sql,
    union_sql,
    with_apps,
)
from fitgrain.functions import text as tx
from fitgrain.operators import keyed_maps as km
from fitgrain.operators import numeric, profile
from fitgrain.functions.mixing import MULTIPLIERS
from fitgrain.operators.hotdeck import DONOR_SEED, VISIT_SEED, fit_hotdeck
from fitgrain.plans import cleaning as plan
from fitgrain.sources.applications import applications, test_rows, train_rows, written_applications
from fitgrain import schema

APP_COLUMNS = (
    "ID label split loan_amount applicant_income population minority_population hud_median_family_income "
    "number_of_owner_occupied_units tract_to_msamd_income census_tract_number county msamd property_type "
    "loan_type lien_status owner_occupancy preapproval applicant_ethnicity applicant_race_name_1 "
    "co_applicant_ethnicity co_applicant_race_name_1 applicant_sex co_applicant_sex agency loan_purpose "
    "A B C D county_code sparse_col"
).split()

LEGAL = "('Owner-occupied as a principal dwelling', 'Not owner-occupied as a principal dwelling', 'Not applicable')"


def missing_pct_sql(columns=APP_COLUMNS, source="apps") -> str:
    return union_sql(
        [
            f"SELECT '{c}' AS column_name, round(avg(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) * 100, 6) AS missing_pct FROM {source}"
            for c in columns
        ]
    )


@query("t1_missing_percent", with_apps(missing_pct_sql()))
def t1(spark, sf_dir):
    return rounded(profile.missing_percent(applications(spark, sf_dir)))


@query(
    "t2_drop_high_missing",
    with_apps(
        "SELECT t.*, d.dropped FROM test t CROSS JOIN (SELECT string_agg(column_name, ',' ORDER BY column_name) AS dropped "
        "FROM shares WHERE missing_pct > 50) d".replace("t.*", "t.* EXCLUDE (sparse_col)"),
        ("shares", missing_pct_sql([c for c in APP_COLUMNS if c != "split"], "train")),
    ),
)
def t2(spark, sf_dir):
    apps = applications(spark, sf_dir)
    dropped = profile.high_missing_columns(train_rows(apps))
    return test_rows(apps).drop(*dropped).withColumn("dropped", F.lit(",".join(sorted(dropped))))


@query("t3_legal_occupancy", with_apps(f"SELECT * FROM train WHERE owner_occupancy IN {LEGAL}"))
def t3(spark, sf_dir):
    return plan.legal_occupancy(train_rows(applications(spark, sf_dir)))


def _label_query(name: str, column: str, expression, sql: str) -> None:
    @query(name, with_apps(f"SELECT ID, {sql} AS {column} FROM apps"))
    def run(spark, sf_dir):
        return applications(spark, sf_dir).select("ID", expression(F.col(column)).alias(column))


PREAPPROVAL = "coalesce(lower(trim(preapproval)), 'unknown')"
_label_query(
    "t4_preapproval_flag",
    "preapproval",
    tx.request_flag,
    f"CASE WHEN {PREAPPROVAL} LIKE '%requested%' AND {PREAPPROVAL} NOT LIKE '%not requested%' THEN 1 ELSE 0 END",
)
_label_query(
    "t4_preapproval_flag_compat",
    "preapproval",
    lambda c: tx.request_flag(c, compat=True),
    f"CASE WHEN {PREAPPROVAL} LIKE '%requested%' THEN 1 ELSE 0 END",
)
_label_query("t5_normalised_label", "applicant_ethnicity", tx.normalised, "lower(trim(applicant_ethnicity))")


def codes_sql(column: str, default: int) -> str:
    return (
        f"CASE lower(trim({column})) WHEN 'hispanic or latino' THEN 1 WHEN 'not hispanic or latino' THEN 2 "
        "WHEN 'information not provided by applicant in mail, internet, or telephone application' THEN 3 "
        f"WHEN 'not applicable' THEN 4 WHEN 'no co-applicant' THEN 5 ELSE {default} END"
    )


_label_query(
    "t6_ethnicity_code",
    "applicant_ethnicity",
    lambda c: tx.coded(c, tx.ETHNICITY_CODES, tx.APPLICANT_DEFAULT_CODE),
    codes_sql("applicant_ethnicity", 3),
)
_label_query(
    "t7_co_applicant_ethnicity_code",
    "co_applicant_ethnicity",
    lambda c: tx.coded(c, tx.ETHNICITY_CODES, tx.CO_APPLICANT_DEFAULT_CODE),
    codes_sql("co_applicant_ethnicity", 5),
)


def race_sql(column: str, edge: str = "\\b") -> str:
    phrases = (
        "white|black or african american|asian|american indian or alaska native|"
        "information not provided|not applicable|no co-applicant"
    )
    return f"CASE WHEN regexp_matches(lower(trim({column})), '{edge}({phrases}){edge}') THEN trim({column}) ELSE 'Other' END"


_label_query("t8_race_consolidation", "applicant_race_name_1", tx.consolidated, race_sql("applicant_race_name_1"))
_label_query(
    "t9_co_applicant_race_consolidation",
    "co_applicant_race_name_1",
    lambda c: tx.consolidated(c, missing="No co-applicant"),
    race_sql("coalesce(co_applicant_race_name_1, 'No co-applicant')"),
)


# With a syllable before the label, phrases stand inside words: the compat form finds them, the default does not.
_label_query(
    "t8_race_consolidation_compat",
    "applicant_race_name_1",
    lambda c: tx.consolidated(F.concat(F.lit("Cauc"), F.trim(c)), compat=True),
    race_sql("'Cauc' || trim(applicant_race_name_1)", ""),
)
_label_query(
    "t9_co_applicant_race_compat",
    "co_applicant_race_name_1",
    lambda c: tx.consolidated(F.concat(F.lit("Cauc"), F.trim(c)), missing="No co-applicant", compat=True),
    race_sql("coalesce('Cauc' || trim(co_applicant_race_name_1), 'No co-applicant')", ""),
)


def sex_sql(column: str) -> str:
    v = f"lower(trim({column}))"
    return (
        f"CASE WHEN contains({v}, 'female') THEN 'Female' WHEN contains({v}, 'male') THEN 'Male' "
        f"WHEN contains({v}, 'not applicable') THEN 'Not applicable' "
        f"WHEN contains({v}, 'no co-applicant') THEN 'No co-applicant' ELSE 'Not provided' END"
    )


_label_query("t10_sex_class", "applicant_sex", tx.classified, sex_sql("applicant_sex"))
_label_query("t11_co_applicant_sex_class", "co_applicant_sex", tx.classified, sex_sql("co_applicant_sex"))


def fill_sql(source: str, key: str, value: str, learned: str, fallback: str, rest: str = "*") -> str:
    """``source`` with ``value`` filled by the map ``learned`` and then ``fallback``."""
    return (
        f"SELECT s.* EXCLUDE ({value}), coalesce(s.{value}, m.v, {fallback}) AS {value} "
        f"FROM {source} s LEFT JOIN {learned} m ON s.{key} = m.k"
    )


def _mode_fill(name: str, spec: km.MapSpec, sentinel: str | None = None) -> None:
    fallback = f"'{sentinel}'" if sentinel else mode_sql("train", spec.value)

    @query(
        name,
        with_apps(
            f"SELECT ID, {spec.value} FROM filled",
            ("learned", mode_map_sql("train", spec.key, spec.value)),
            ("filled", fill_sql("apps", spec.key, spec.value, "learned", fallback)),
        ),
    )
    def run(spark, sf_dir):
        apps = applications(spark, sf_dir)
        learned = km.fit_modes(train_rows(apps), [spec])[spec.name]
        return km.filled(apps.select("ID", spec.key, spec.value), learned, sentinel=sentinel).select("ID", spec.value)


_mode_fill("i1_occupancy_by_property", plan.OCCUPANCY)
_mode_fill("i3_tract_by_county", plan.TRACT, plan.TRACT_SENTINEL)
_mode_fill("i7_lien_by_loan_type", plan.LIEN)

NORMAL_ETHNICITY = "nullif(nullif(lower(trim(applicant_ethnicity)), 'nan'), '')"


@query(
    "i2_ethnicity_by_race",
    with_apps(
        "SELECT ID, applicant_ethnicity FROM filled",
        ("clean", f"SELECT ID, split, applicant_race_name_1, {NORMAL_ETHNICITY} AS applicant_ethnicity FROM apps"),
        ("seen", "SELECT * FROM clean WHERE split = 'train'"),
        ("learned", mode_map_sql("seen", "applicant_race_name_1", "applicant_ethnicity")),
        ("filled", fill_sql("clean", "applicant_race_name_1", "applicant_ethnicity", "learned", mode_sql("seen", "applicant_ethnicity"))),
    ),
)
def i2(spark, sf_dir):
    clean = plan.normalised_ethnicity(applications(spark, sf_dir))
    learned = km.fit_modes(train_rows(clean), [plan.ETHNICITY])[plan.ETHNICITY.name]
    rows = clean.select("ID", "applicant_race_name_1", "applicant_ethnicity")
    return km.filled(rows, learned).select("ID", "applicant_ethnicity")


GEO_STEPS = (
    ("tract_map", mode_map_sql("train", "county", "census_tract_number")),
    ("g1", fill_sql("apps", "county", "census_tract_number", "tract_map", "'-1'")),
    ("g1_train", "SELECT * FROM g1 WHERE split = 'train'"),
    ("county_map", mode_map_sql("g1_train", "census_tract_number", "county")),
    ("g2", fill_sql("g1", "census_tract_number", "county", "county_map", mode_sql("g1_train", "county"))),
    ("g2_train", "SELECT * FROM g2 WHERE split = 'train'"),
    ("msamd_map", mode_map_sql("g2_train", "county", "msamd")),
    ("g3", fill_sql("g2", "county", "msamd", "msamd_map", mode_sql("g2_train", "msamd"))),
)


def _filled_tract(spark, sf_dir):
    apps = applications(spark, sf_dir).select("ID", "split", "census_tract_number", "county", "msamd")
    learned = km.fit_modes(train_rows(apps), [plan.TRACT])[plan.TRACT.name]
    return km.filled(apps, learned, sentinel=plan.TRACT_SENTINEL)


def _filled_county(spark, sf_dir):
    rows = _filled_tract(spark, sf_dir)
    learned = km.fit_modes(train_rows(rows), [plan.COUNTY])[plan.COUNTY.name]
    return km.filled(rows, learned)


@query("i4_county_by_tract", with_apps("SELECT ID, census_tract_number, county FROM g2", *GEO_STEPS[:5]))
def i4(spark, sf_dir):
    return _filled_county(spark, sf_dir).select("ID", "census_tract_number", "county")


@query("i5_msamd_by_county", with_apps("SELECT ID, county, msamd FROM g3", *GEO_STEPS))
def i5(spark, sf_dir):
    rows = _filled_county(spark, sf_dir)
    learned = km.fit_modes(train_rows(rows), [plan.MSAMD])[plan.MSAMD.name]
    return km.filled(rows, learned).select("ID", "county", "msamd")


def income_steps(source: str, seen: str, into: str) -> tuple:
    col = "tract_to_msamd_income"
    return (
        ("tract_mean", f"SELECT census_tract_number AS k, avg({col}) AS v FROM {seen} WHERE census_tract_number IS NOT NULL GROUP BY 1"),
        ("county_mean", f"SELECT county AS k, avg({col}) AS v FROM {seen} WHERE county IS NOT NULL GROUP BY 1"),
        (
            into,
            f"SELECT s.* EXCLUDE ({col}), coalesce(s.{col}, t.v, c.v, (SELECT avg({col}) FROM {seen})) AS {col} "
            f"FROM {source} s LEFT JOIN tract_mean t ON s.census_tract_number = t.k LEFT JOIN county_mean c ON s.county = c.k",
        ),
    )


@query(
    "i6_income_by_geography",
    with_apps(
        "SELECT ID, round(tract_to_msamd_income, 6) AS tract_to_msamd_income FROM filled",
        *income_steps("apps", "train", "filled"),
    ),
)
def i6(spark, sf_dir):
    apps = applications(spark, sf_dir).select("ID", "split", "census_tract_number", "county", "tract_to_msamd_income")
    learned = km.fit_means(train_rows(apps), [plan.INCOME_BY_TRACT, plan.INCOME_BY_COUNTY])
    filled = km.filled(apps, *(learned[s.name] for s in (plan.INCOME_BY_TRACT, plan.INCOME_BY_COUNTY)))
    return rounded(filled.select("ID", "tract_to_msamd_income"))


def hotdeck_steps(source: str, seen: str, into: str) -> tuple:
    """Draws from buckets of donors, in plain integer arithmetic."""
    donors = scramble_sql("ID", DONOR_SEED)
    lists = ", ".join(f"list({c} ORDER BY o) FILTER (WHERE {c} IS NOT NULL) AS d{c}" for c in "ABC")
    picks = ", ".join(
        f"coalesce({c}, d{c}[(mix // n_buckets % 2147483647 * {MULTIPLIERS[i] + i} % 2147483647 % len(d{c})) + 1], "
        f"(SELECT median({c}) FROM {seen})) AS {c}"
        for i, c in enumerate("ABC")
    )
    return (
        ("deck_size", f"SELECT greatest(1, count(*) // 1000) AS n_buckets FROM {seen}"),
        ("deck_rows", f"SELECT A, B, C, {donors} AS o FROM {seen}"),
        ("deck", f"SELECT o % n_buckets AS bucket, {lists} FROM deck_rows, deck_size GROUP BY 1"),
        ("visits", f"SELECT *, {scramble_sql('ID', VISIT_SEED)} AS mix FROM {source}"),
        (
            into,
            f"SELECT v.* EXCLUDE (A, B, C, mix), {picks} FROM visits v CROSS JOIN deck_size "
            "LEFT JOIN deck ON mix % n_buckets = bucket",
        ),
    )


@query("i8_random_fill", with_apps("SELECT ID, A, B, C FROM filled", *hotdeck_steps("apps", "train", "filled")))
def i8(spark, sf_dir):
    apps = applications(spark, sf_dir).select("ID", "split", "A", "B", "C")
    return fit_hotdeck(train_rows(apps)).transform(apps).select("ID", "A", "B", "C")


def _listed(columns, f) -> str:
    return ", ".join(f(c) for c in columns)


@query(
    "i9_median_fill",
    with_apps(
        "SELECT ID, "
        + _listed(schema.MEDIAN_FILLED, lambda c: f"round(coalesce({c}, (SELECT median({c}) FROM train)), 6) AS {c}")
        + " FROM apps"
    ),
)
def i9(spark, sf_dir):
    apps = applications(spark, sf_dir)
    medians = numeric.fit_medians(train_rows(apps), schema.MEDIAN_FILLED)
    return rounded(numeric.constant_fill(apps.select("ID", *schema.MEDIAN_FILLED), medians))


@query("i10_mode_fill", with_apps(f"SELECT ID, coalesce(agency, {mode_sql('train', 'agency')}) AS agency FROM apps"))
def i10(spark, sf_dir):
    apps = applications(spark, sf_dir)
    modal = km.fit_modes(train_rows(apps), [km.MapSpec("modal", None, "agency")])["modal"]
    return km.filled(apps.select("ID", "agency"), modal)


@query(
    "i11_mean_fill",
    with_apps(
        "SELECT ID, "
        + _listed(schema.NUMERIC, lambda c: f"round(coalesce({c}, (SELECT avg({c}) FROM train)), 6) AS {c}")
        + " FROM apps"
    ),
)
def i11(spark, sf_dir):
    apps = applications(spark, sf_dir)
    means = numeric.fit_column_means(train_rows(apps), schema.NUMERIC)
    return rounded(numeric.constant_fill(apps.select("ID", *schema.NUMERIC), means))


def cleaning_steps() -> tuple:
    """The whole cleaning plan as steps; the last one is ``cleaned`` with its ``split``."""
    legal = f"(split = 'test' OR owner_occupancy IN {LEGAL})"
    labels = {
        "preapproval": f"CASE WHEN {PREAPPROVAL} LIKE '%requested%' AND {PREAPPROVAL} NOT LIKE '%not requested%' THEN 1 ELSE 0 END",
        "applicant_ethnicity": codes_sql("applicant_ethnicity", 3),
        "applicant_race_name_1": race_sql("applicant_race_name_1"),
        "co_applicant_ethnicity": codes_sql("co_applicant_ethnicity", 5),
        "co_applicant_race_name_1": race_sql("coalesce(co_applicant_race_name_1, 'No co-applicant')"),
        "applicant_sex": sex_sql("applicant_sex"),
        "co_applicant_sex": sex_sql("co_applicant_sex"),
    }
    relabelled = ", ".join(f"{sql} AS {c}" for c, sql in labels.items())
    seen = lambda name, source: (name, f"SELECT * FROM {source} WHERE split = 'train'")
    return (
        ("occ_map", mode_map_sql("train", "property_type", "owner_occupancy")),
        ("c1", fill_sql("(SELECT * EXCLUDE (sparse_col) FROM apps)", "property_type", "owner_occupancy", "occ_map", mode_sql("train", "owner_occupancy"))),
        ("c2", f"SELECT * EXCLUDE (applicant_ethnicity), {NORMAL_ETHNICITY} AS applicant_ethnicity FROM c1 WHERE {legal}"),
        seen("c2_train", "c2"),
        ("eth_map", mode_map_sql("c2_train", "applicant_race_name_1", "applicant_ethnicity")),
        ("c3", fill_sql("c2", "applicant_race_name_1", "applicant_ethnicity", "eth_map", mode_sql("c2_train", "applicant_ethnicity"))),
        ("c4", f"SELECT * EXCLUDE ({', '.join(labels)}), {relabelled} FROM c3"),
        ("tract_map", mode_map_sql("c2_train", "county", "census_tract_number")),
        ("c5", fill_sql("c4", "county", "census_tract_number", "tract_map", "'-1'")),
        seen("c5_train", "c5"),
        ("county_map", mode_map_sql("c5_train", "census_tract_number", "county")),
        ("c6", fill_sql("c5", "census_tract_number", "county", "county_map", mode_sql("c5_train", "county"))),
        seen("c6_train", "c6"),
        ("msamd_map", mode_map_sql("c6_train", "county", "msamd")),
        ("c7", fill_sql("c6", "county", "msamd", "msamd_map", mode_sql("c6_train", "msamd"))),
        *income_steps("c7", "c6_train", "c8"),
        ("lien_map", mode_map_sql("c2_train", "loan_type", "lien_status")),
        ("c9", fill_sql("c8", "loan_type", "lien_status", "lien_map", mode_sql("c2_train", "lien_status"))),
        *hotdeck_steps("c9", "c2_train", "cleaned"),
    )


CLEAN_COLUMNS = [c for c in APP_COLUMNS if c not in ("split", "sparse_col")]


@query(
    "i12_cleaning_plan",
    with_apps(
        "SELECT split, "
        + _listed(CLEAN_COLUMNS, lambda c: f"round({c}, 6) AS {c}" if c in schema.NUMERIC else c)
        + " FROM cleaned",
        *cleaning_steps(),
    ),
)
def i12(spark, sf_dir):
    # The derived table is read once per level, so it is written once.
    apps = written_applications(spark, sf_dir)
    train, test = train_rows(apps), test_rows(apps)
    model = plan.fit_cleaning(train)
    clean = model.transform(train, training=True).withColumn("split", F.lit("train"))
    return rounded(clean.unionByName(model.transform(test).withColumn("split", F.lit("test"))))
