"""Feature engineering queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fitgrain import schema
from fitgrain.catalog.cleaning import CLEAN_COLUMNS, cleaning_steps
from fitgrain.catalog.registry import mode_sql, query, rounded, table, union_sql, with_apps
from fitgrain.operators import keyed_maps as km
from fitgrain.operators import numeric
from fitgrain.plans import cleaning as cleaning_plan
from fitgrain.plans import features as plan
from fitgrain.session import written
from fitgrain.sources.applications import applications, test_rows, train_rows, written_applications


def capped_sql(column: str, source: str = "train") -> str:
    return (
        f"CASE WHEN {column} IS NOT NULL THEN "
        f"ln(1 + least({column}, (SELECT quantile_cont({column}, 0.99) FROM {source}))) END"
    )


def filled_log_sql(column: str, source: str = "train") -> str:
    return f"ln(1 + coalesce({column}, (SELECT median({column}) FROM {source})))"


def _capped_log(name: str, column: str) -> None:
    @query(name, with_apps(f"SELECT ID, round({capped_sql(column)}, 6) AS {column} FROM apps"))
    def run(spark, sf_dir):
        apps = applications(spark, sf_dir)
        caps = numeric.fit_caps(train_rows(apps), [column])
        return rounded(numeric.capped_log(apps.select("ID", column), caps))


def _filled_log(name: str, column: str) -> None:
    @query(name, with_apps(f"SELECT ID, round({filled_log_sql(column)}, 6) AS {column} FROM apps"))
    def run(spark, sf_dir):
        apps = applications(spark, sf_dir)
        medians = numeric.fit_medians(train_rows(apps), [column])
        return rounded(numeric.filled_log(apps.select("ID", column), medians))


_capped_log("f1_loan_amount_log", "loan_amount")
_capped_log("f2_income_log", "applicant_income")
_filled_log("f3_population_log", "population")
_filled_log("f4_minority_population_log", "minority_population")
_filled_log("f5_family_income_log", "hud_median_family_income")
_filled_log("f6_owner_units_log", "number_of_owner_occupied_units")


def encoding_step(column: str, source: str, seen: str) -> str:
    return (
        f"SELECT s.* EXCLUDE ({column}), coalesce(m.v, (SELECT avg(label) FROM {seen})) AS {column} FROM {source} s "
        f"LEFT JOIN (SELECT {column} AS k, avg(label) AS v FROM {seen} WHERE {column} IS NOT NULL GROUP BY 1) m "
        f"ON s.{column} = m.k"
    )


def _encode(name: str, column: str, modal: bool = False) -> None:
    source = f"SELECT ID, label, split, {column} FROM apps"
    if modal:
        source = f"SELECT ID, label, split, coalesce({column}, {mode_sql('train', column)}) AS {column} FROM apps"

    @query(
        name,
        with_apps(
            f"SELECT ID, round({column}, 6) AS {column} FROM coded",
            ("source", source),
            ("seen", "SELECT * FROM source WHERE split = 'train'"),
            ("coded", encoding_step(column, "source", "seen")),
        ),
    )
    def run(spark, sf_dir):
        rows = applications(spark, sf_dir).select("ID", "label", "split", column)
        if modal:
            rows = km.filled(rows, km.fit_modes(train_rows(rows), [plan.MODAL_AGENCY])[plan.MODAL_AGENCY.name])
        learned = km.fit_means(train_rows(rows), [km.MapSpec(column, None, column)], of="label")
        return rounded(km.encoded(rows.select("ID", column), list(learned.values())))


_encode("f8_race_encoding", "applicant_race_name_1")
_encode("f9_agency_encoding", "agency", modal=True)
_encode("f10_tract_encoding", "census_tract_number")
_encode("f11_county_encoding", "county")
_encode("f12_msamd_encoding", "msamd")
_encode("f13_d_encoding", "D")


@query(
    "f7_target_mean_encoding",
    """
    WITH rows AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label FROM orders),
    seen AS (SELECT o_custkey AS k, avg(label) AS v FROM rows WHERE o_orderkey % 5 <> 0 GROUP BY 1)
    SELECT o_orderkey, round(coalesce(v, (SELECT avg(label) FROM rows WHERE o_orderkey % 5 <> 0)), 6) AS o_custkey
    FROM rows LEFT JOIN seen ON o_custkey = k
    """,
)
def f7(spark, sf_dir):
    """Many keys: each customer's mean, learned on train orders, unseen by the overall mean."""
    label = F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", label.alias("label"))
    learned = km.fit_means(rows.filter("o_orderkey % 5 <> 0"), [km.MapSpec("customer", None, "o_custkey")], of="label")
    return rounded(km.encoded(rows.select("o_orderkey", "o_custkey"), list(learned.values())))


@query(
    "f7_target_mean_encoding_large_map",
    """
    WITH rows AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label FROM orders),
    seen AS (SELECT o_custkey AS k, avg(label) AS v FROM rows WHERE o_orderkey % 5 <> 0 GROUP BY 1)
    SELECT o_orderkey, round(coalesce(v, (SELECT avg(label) FROM rows WHERE o_orderkey % 5 <> 0)), 6) AS o_custkey
    FROM rows LEFT JOIN seen ON o_custkey = k
    """,
)
def f7_large(spark, sf_dir):
    """The same with the map held as a table, as for maps that outgrow the driver."""
    label = F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", label.alias("label"))
    spec = [km.MapSpec("customer", None, "o_custkey")]
    learned = km.fit_means(rows.filter("o_orderkey % 5 <> 0"), spec, limit=0, of="label")
    return rounded(km.encoded(rows.select("o_orderkey", "o_custkey"), list(learned.values())))


TEXT_COLUMNS = (
    "census_tract_number county msamd property_type owner_occupancy preapproval applicant_ethnicity "
    "applicant_race_name_1 co_applicant_ethnicity co_applicant_race_name_1 applicant_sex co_applicant_sex "
    "agency loan_purpose"
).split()


@query(
    "f14_bulk_encoding",
    with_apps(
        "SELECT ID, "
        + ", ".join(f"round({c}, 6) AS {c}" for c in TEXT_COLUMNS)
        + f" FROM b{len(TEXT_COLUMNS)}",
        ("b0", "SELECT * FROM apps"),
        *[(f"b{i}", encoding_step(c, f"b{i - 1}", "train")) for i, c in enumerate(TEXT_COLUMNS, start=1)],
    ),
)
def f14(spark, sf_dir):
    """Every text column in one pass."""
    apps = applications(spark, sf_dir)
    specs = [km.MapSpec(c, None, c) for c in plan.text_columns(apps)]
    learned = km.fit_means(train_rows(apps), specs, of="label")
    return rounded(km.encoded(apps.select("ID", *[s.value for s in specs]), list(learned.values())))


def feature_steps() -> tuple:
    """The feature plan over ``cleaned``; the last step is ``featured``."""
    caps = ", ".join(f"{capped_sql(c, 'clean_train')} AS {c}" for c in schema.CAPPED)
    logs = ", ".join(f"{filled_log_sql(c, 'clean_train')} AS {c}" for c in schema.MEDIAN_FILLED)
    changed = ", ".join((*schema.CAPPED, *schema.MEDIAN_FILLED, "agency"))
    coded = [*schema.ENCODED, "property_type", "owner_occupancy", "co_applicant_race_name_1", "applicant_sex", "co_applicant_sex", "loan_purpose"]
    steps = [
        ("clean_train", "SELECT * FROM cleaned WHERE split = 'train'"),
        ("f0", f"SELECT * EXCLUDE ({changed}), {caps}, {logs}, coalesce(agency, {mode_sql('clean_train', 'agency')}) AS agency FROM cleaned"),
        ("f0_train", "SELECT * FROM f0 WHERE split = 'train'"),
    ]
    steps += [(f"f{i}", encoding_step(c, f"f{i - 1}", "f0_train")) for i, c in enumerate(coded, start=1)]
    return (*steps, ("featured", f"SELECT * FROM f{len(coded)}"))


WHOLE = ("ID", "label", "loan_type", "lien_status", "preapproval", "applicant_ethnicity", "co_applicant_ethnicity", "county_code")


@query(
    "f16_feature_plan",
    with_apps(
        "SELECT split, " + ", ".join(c if c in WHOLE else f"round({c}, 6) AS {c}" for c in CLEAN_COLUMNS) + " FROM featured",
        *cleaning_steps(),
        *feature_steps(),
    ),
)
def f16(spark, sf_dir):
    apps = written_applications(spark, sf_dir)
    train, test = train_rows(apps), test_rows(apps)
    cleaner = cleaning_plan.fit_cleaning(train)
    # The features are learned in several passes, so the cleaned rows are written once.
    clean = written(cleaner.transform(train, training=True), "clean")
    model = plan.fit_features(clean)
    rows = clean.withColumn("split", F.lit("train")).unionByName(cleaner.transform(test).withColumn("split", F.lit("test")))
    return rounded(model.transform(rows))


FEATURES = [
    c
    for c in CLEAN_COLUMNS
    if c not in ("ID", "label", "county_code") and c not in schema.PROTECTED and c not in TEXT_COLUMNS
]


@query(
    "f15_feature_selection",
    with_apps(
        union_sql(
            [f"SELECT {i} AS position, '{c}' AS feature, count({c}) AS n_present FROM apps" for i, c in enumerate([*FEATURES, "sparse_col"])]
        )
    ),
)
def f15(spark, sf_dir):
    """The numeric, unprotected columns in table order, with their filled row counts."""
    apps = applications(spark, sf_dir)
    names = plan.feature_columns(apps)
    counted = apps.agg(*[F.count(c).alias(c) for c in names])
    rows = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("feature"), F.col(c).alias("n_present")) for i, c in enumerate(names)]
    return counted.select(F.inline(F.array(*rows)))


@query(
    "f17_standard_scale",
    with_apps(
        "SELECT ID, "
        + ", ".join(
            f"round(({c} - (SELECT avg({c}) FROM train)) / (SELECT stddev_pop({c}) FROM train), 6) AS {c}" for c in schema.NUMERIC
        )
        + " FROM apps"
    ),
)
def f17(spark, sf_dir):
    apps = applications(spark, sf_dir)
    scales = numeric.fit_scales(train_rows(apps), schema.NUMERIC)
    return rounded(numeric.scaled(apps.select("ID", *schema.NUMERIC), scales))
