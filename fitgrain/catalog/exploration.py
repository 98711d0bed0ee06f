"""Exploratory aggregate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fitgrain import schema
from fitgrain.catalog.cleaning import APP_COLUMNS, missing_pct_sql
from fitgrain.catalog.registry import query, rounded, scramble_sql, table, union_sql, with_apps
from fitgrain.functions import sketches as sk
from fitgrain.operators import profile
from fitgrain.session import scratch_path
from fitgrain.sources.applications import applications

LINE_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
CATEGORIES = ("agency", "loan_purpose", "applicant_race_name_1", "applicant_ethnicity", "applicant_sex", "property_type")

TYPES = {
    **dict.fromkeys(APP_COLUMNS, "string"),
    **dict.fromkeys((*schema.NUMERIC, "sparse_col"), "double"),
    **dict.fromkeys(("label", "loan_type", "lien_status", "D", "county_code"), "int"),
    "ID": "bigint",
}


@query(
    "e1_overview",
    with_apps(
        union_sql(
            [
                f"SELECT {i} AS position, '{c}' AS column_name, '{TYPES[c]}' AS data_type, count(*) AS n_rows, "
                f"{len(APP_COLUMNS)} AS n_columns FROM apps"
                for i, c in enumerate(APP_COLUMNS)
            ]
        )
    ),
)
def e1(spark, sf_dir):
    return profile.overview(applications(spark, sf_dir))


@query("e1_head", with_apps("SELECT * FROM apps ORDER BY ID LIMIT 3"))
def e1_head(spark, sf_dir):
    return applications(spark, sf_dir).orderBy("ID").limit(3)


@query(
    "e2_value_counts",
    with_apps("SELECT label, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS pct FROM apps GROUP BY label"),
)
def e2(spark, sf_dir):
    return profile.value_counts(applications(spark, sf_dir), "label")


@query(
    "e3_imbalance",
    with_apps(
        "SELECT round(max(n) / min(n)::DOUBLE, 6) AS ratio, max(n) / min(n)::DOUBLE > 3 AS weighting_advised "
        "FROM (SELECT count(*) AS n FROM apps GROUP BY label)"
    ),
)
def e3(spark, sf_dir):
    return rounded(profile.imbalance(applications(spark, sf_dir)))


@query(
    "e4_missing_report",
    with_apps(
        "SELECT *, missing_pct > 50 AS drop_candidate FROM shares WHERE missing_pct > 0 ORDER BY missing_pct DESC, column_name",
        ("shares", missing_pct_sql()),
    ),
)
def e4(spark, sf_dir):
    return rounded(profile.missing_report(applications(spark, sf_dir)))


SAMPLE = f"(SELECT * FROM apps ORDER BY {scramble_sql('ID', 42)} LIMIT {{n}})"


@query("e5_row_sample", with_apps(f"SELECT * FROM {SAMPLE.format(n=500)}"))
def e5(spark, sf_dir):
    return profile.row_sample(applications(spark, sf_dir), 500)


@query(
    "e6_null_mask",
    with_apps("SELECT " + ", ".join(f"{c} IS NULL AS {c}" for c in APP_COLUMNS) + f" FROM {SAMPLE.format(n=500)}"),
)
def e6(spark, sf_dir):
    return profile.null_mask(profile.row_sample(applications(spark, sf_dir), 500))


def histogram_sql(source: str, columns) -> str:
    parts = []
    for c in columns:
        parts.append(
            f"SELECT '{c}' AS column_name, bin, round(lo + (bin - 1) * (hi - lo) / 50, 6) AS bin_low, "
            f"round(lo + bin * (hi - lo) / 50, 6) AS bin_high, count(*) AS n FROM "
            f"(SELECT CAST(least(floor(({c} - lo) * 50.0 / (hi - lo)), 49) + 1 AS INT) AS bin, lo, hi FROM {source}, "
            f"(SELECT CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi FROM {source}) WHERE {c} IS NOT NULL) "
            f"GROUP BY bin, lo, hi"
        )
    return union_sql(parts)


@query("e7_histogram", with_apps(histogram_sql("apps", schema.NUMERIC)))
def e7(spark, sf_dir):
    return rounded(profile.histogram(applications(spark, sf_dir), schema.NUMERIC))


@query("e7_histogram_lineitem", histogram_sql("lineitem", LINE_NUMBERS))
def e7_lines(spark, sf_dir):
    return rounded(profile.histogram(table(spark, sf_dir, "lineitem"), LINE_NUMBERS))


def describe_sql(source: str, columns) -> str:
    return union_sql(
        [
            f"SELECT '{c}' AS column_name, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, "
            f"round(skewness({c}), 6) AS skew, max({c}) AS max, round(quantile_cont({c}, 0.99), 6) AS q99, "
            f"abs(skewness({c})) > 1 AS log_recommended FROM {source}"
            for c in columns
        ]
    )


@query("e8_describe", with_apps(describe_sql("apps", schema.NUMERIC)))
def e8(spark, sf_dir):
    return rounded(profile.describe(applications(spark, sf_dir)))


@query("e8_describe_lineitem", describe_sql("lineitem", LINE_NUMBERS))
def e8_lines(spark, sf_dir):
    return rounded(profile.describe(table(spark, sf_dir, "lineitem"), LINE_NUMBERS))


@query(
    "e9_rate_by_category",
    with_apps(
        "SELECT column_name, CAST(place AS INT) AS place, category, rate, n, overall_rate FROM ("
        + union_sql(
            [
                f"SELECT '{c}' AS column_name, row_number() OVER (ORDER BY avg(label) DESC, {c}) AS place, {c} AS category, "
                f"round(avg(label), 6) AS rate, count(*) AS n, (SELECT round(avg(label), 6) FROM apps) AS overall_rate "
                f"FROM apps WHERE {c} IS NOT NULL GROUP BY {c}"
                for c in CATEGORIES
            ]
        )
        + ") WHERE place <= 15"
    ),
)
def e9(spark, sf_dir):
    return rounded(profile.rate_by_category(applications(spark, sf_dir), CATEGORIES))


@query(
    "e10_bin_by_label",
    with_apps(
        "SELECT property_type, count(*) FILTER (WHERE label = 0) AS rejected, count(*) FILTER (WHERE label = 1) AS approved "
        "FROM apps GROUP BY property_type"
    ),
)
def e10(spark, sf_dir):
    return profile.bin_by_target(applications(spark, sf_dir), "property_type")


def quantile_bin_sql(source: str, column: str, q: int) -> str:
    """Bins by counting the inner edges below the value; equal edges count once."""
    shares = ", ".join(f"{i / q!r}" for i in range(q + 1))
    return (
        f"SELECT t.*, CASE WHEN t.{column} IS NULL THEN NULL ELSE greatest(1, CAST(len(list_filter(e, lambda x: x < t.{column})) AS INT)) END AS bin "
        f"FROM {source} t, (SELECT list_distinct(quantile_cont({column}, [{shares}])) AS e FROM {source})"
    )


@query(
    "e11_decile_by_label",
    with_apps(
        "SELECT bin, count(*) FILTER (WHERE label = 0) AS rejected, count(*) FILTER (WHERE label = 1) AS approved "
        "FROM binned WHERE bin IS NOT NULL GROUP BY bin",
        ("binned", quantile_bin_sql("apps", "loan_amount", 10)),
    ),
)
def e11(spark, sf_dir):
    binned = profile.with_quantile_bin(applications(spark, sf_dir), "loan_amount", 10, "bin")
    return profile.bin_by_target(binned, "bin")


@query(
    "e11_decile_lineitem",
    "WITH binned AS ("
    + quantile_bin_sql("lineitem", "l_quantity", 10)
    + ") SELECT bin, count(*) AS n, min(l_quantity) AS low, max(l_quantity) AS high FROM binned GROUP BY bin",
)
def e11_lines(spark, sf_dir):
    binned = profile.with_quantile_bin(table(spark, sf_dir, "lineitem"), "l_quantity", 10, "bin")
    return binned.groupBy("bin").agg(
        F.count("*").alias("n"), F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high")
    )


@query(
    "e8_sketched_quantiles",
    union_sql([f"SELECT '{c}' AS column_name, {q!r}E0 AS share, count({c}) AS n, true AS within FROM lineitem" for c in LINE_NUMBERS for q in (0.5, 0.99)]),
)
def e8_sketched(spark, sf_dir):
    """Quantiles of sketches, stored for each return flag and merged: is each one's rank within the stated error?"""
    lines = table(spark, sf_dir, "lineitem")
    path = scratch_path(spark, "sketches")
    for flag in ("l_returnflag <> 'R'", "l_returnflag = 'R'"):  # what came later adds its own sketches
        sk.add_sketches(sk.sketches(lines.filter(flag), LINE_NUMBERS, ("l_returnflag",)), path)
    shares = (0.5, 0.99)
    found = sk.approx_quantiles(sk.stored_sketches(spark, path), {c: shares for c in LINE_NUMBERS})
    error = sk.rank_error()
    tests = []
    for c in LINE_NUMBERS:
        for q, value in zip(shares, found[c]):
            low, high = F.count_if(F.col(c) < value) / F.count(c) - error, F.count_if(F.col(c) <= value) / F.count(c) + error
            tests.append(F.struct(F.lit(c).alias("column_name"), F.lit(q).alias("share"), F.count(c).alias("n"), F.lit(q).between(low, high).alias("within")))
    return lines.agg(F.array(*tests).alias("t")).select(F.explode("t").alias("t")).select("t.*")


@query(
    "e12_income_quartile_rate",
    with_apps(
        "SELECT 'Q' || bin AS quartile, round(avg(label), 6) AS rate, count(*) AS n FROM binned WHERE bin IS NOT NULL GROUP BY bin",
        ("binned", quantile_bin_sql("apps", "applicant_income", 4)),
    ),
)
def e12(spark, sf_dir):
    return rounded(profile.quartile_rates(applications(spark, sf_dir), "applicant_income"))


def _top_rates(name: str, column: str, least: int) -> None:
    @query(
        name,
        with_apps(
            f"SELECT {column}, round(avg(label), 6) AS rate, count(*) AS n FROM apps WHERE {column} IS NOT NULL "
            f"GROUP BY {column} HAVING count(*) >= {least} ORDER BY avg(label) DESC, {column} LIMIT 20"
        ),
    )
    def run(spark, sf_dir):
        return rounded(profile.top_rates(applications(spark, sf_dir), column, least))


_top_rates("e13_msamd_rates", "msamd", 100)
_top_rates("e14_county_rates", "county", 50)


def correlation_sql(source: str, columns) -> str:
    return union_sql(
        [
            f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 6) AS r FROM {source}"
            for a in columns
            for b in columns
        ]
    )


@query("e15_correlation", with_apps(correlation_sql("apps", (*schema.NUMERIC, "label"))))
def e15(spark, sf_dir):
    return rounded(profile.correlation(applications(spark, sf_dir), (*schema.NUMERIC, "label")))


@query("e15_correlation_lineitem", correlation_sql("lineitem", LINE_NUMBERS))
def e15_lines(spark, sf_dir):
    return rounded(profile.correlation(table(spark, sf_dir, "lineitem"), LINE_NUMBERS))


@query("e16_scatter", with_apps(f"SELECT tract_to_msamd_income, label FROM {SAMPLE.format(n=5000)}"))
def e16(spark, sf_dir):
    return profile.row_sample(applications(spark, sf_dir), 5000).select("tract_to_msamd_income", "label")
