"""The application table derived from orders, customers, nations and regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fitgrain.session import spread, written

# One statement for Spark and for the check in DuckDB; the table names are
# filled in by either side. Its CASE patterns are made up and mean nothing.
STATEMENT = """
SELECT o_orderkey AS ID,
  CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label,
  CASE WHEN o_orderkey % 5 = 0 THEN 'test' ELSE 'train' END AS split,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_totalprice END AS loan_amount,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE abs(c_acctbal) END AS applicant_income,
  CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE 1.0E3 + (o_custkey * 37) % 9001 END AS population,
  CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE 1.0E1 + (o_custkey * 53) % 4001 END AS minority_population,
  CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE 3.0E4 + (o_custkey * 71) % 60013 END AS hud_median_family_income,
  CASE WHEN o_orderkey % 37 = 0 THEN NULL ELSE 1.0E2 + (o_custkey * 17) % 3001 END AS number_of_owner_occupied_units,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE 5.0E1 + (o_custkey * 13) % 101 END AS tract_to_msamd_income,
  CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE n_name || '-' || CAST(o_custkey % 8 AS VARCHAR(10)) END AS census_tract_number,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE n_name END AS county,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE r_name END AS msamd,
  c_mktsegment AS property_type,
  CAST(1 + o_custkey % 4 AS INT) AS loan_type,
  CASE WHEN o_orderkey % 12 = 0 THEN NULL ELSE CAST(1 + (o_custkey + o_orderkey) % 3 AS INT) END AS lien_status,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL WHEN o_custkey % 3 = 0 THEN 'Not applicable'
       WHEN o_custkey % 3 = 1 THEN 'Owner-occupied as a principal dwelling'
       WHEN o_custkey % 21 = 2 THEN 'Unrecognised'
       ELSE 'Not owner-occupied as a principal dwelling' END AS owner_occupancy,
  CASE WHEN o_custkey % 4 = 0 THEN ' Preapproval was requested' WHEN o_custkey % 4 = 1 THEN 'Preapproval was NOT requested'
       WHEN o_custkey % 4 = 2 THEN 'Not applicable' ELSE NULL END AS preapproval,
  CASE WHEN o_orderkey % 8 = 0 THEN NULL WHEN o_custkey % 5 = 0 THEN 'Hispanic or Latino ' WHEN o_custkey % 5 = 1 THEN 'Not applicable'
       ELSE 'NOT Hispanic or Latino' END AS applicant_ethnicity,
  CASE WHEN o_orderkey % 14 = 0 THEN NULL WHEN o_custkey % 6 = 0 THEN 'White' WHEN o_custkey % 6 = 1 THEN ' Asian'
       WHEN o_custkey % 6 = 2 THEN 'Black or African American' WHEN o_custkey % 6 = 3 THEN 'Native Hawaiian or Other Pacific Islander'
       ELSE 'Information not provided by applicant' END AS applicant_race_name_1,
  CASE WHEN o_orderkey % 2 = 0 THEN NULL WHEN o_custkey % 2 = 0 THEN 'No co-applicant' ELSE 'Hispanic or Latino' END AS co_applicant_ethnicity,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_custkey % 2 = 0 THEN 'No co-applicant' ELSE 'Some other race' END AS co_applicant_race_name_1,
  CASE WHEN o_orderkey % 16 = 0 THEN NULL WHEN o_custkey % 3 = 0 THEN ' FEMALE' WHEN o_custkey % 3 = 1 THEN 'Male' ELSE 'Not applicable' END AS applicant_sex,
  CASE WHEN o_custkey % 3 = 0 THEN 'No co-applicant' WHEN o_custkey % 3 = 1 THEN 'female' ELSE 'n/a' END AS co_applicant_sex,
  CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderpriority END AS agency,
  CASE WHEN o_custkey % 3 = 0 THEN 'Home purchase' WHEN o_custkey % 3 = 1 THEN 'Refinancing' ELSE 'Home improvement' END AS loan_purpose,
  CASE WHEN o_orderkey % 3 = 0 THEN CAST(NULL AS DOUBLE) ELSE (o_orderkey * 31 % 1009) / 7.0E0 END AS A,
  CASE WHEN o_orderkey % 4 = 1 THEN CAST(NULL AS DOUBLE) ELSE (o_orderkey * 47 % 2003) / 3.0E0 END AS B,
  CASE WHEN o_orderkey % 5 = 2 THEN CAST(NULL AS DOUBLE) ELSE (o_orderkey * 59 % 503) / 2.0E0 END AS C,
  CASE WHEN o_orderkey % 15 = 0 THEN NULL ELSE CAST(o_custkey % 9 AS INT) END AS D,
  c_nationkey AS county_code,
  CASE WHEN o_orderkey % 3 <> 0 THEN CAST(NULL AS DOUBLE) ELSE 1.0E0 END AS sparse_col
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
"""

TABLES = ("orders", "customer", "nation", "region")


def applications(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """The whole application table. Catalyst prunes what a query does not use.

    ``dealt`` gives small tables to all cores, for work that is heavy per row.
    """
    sides = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    if dealt:
        sides["orders"] = spread(sides["orders"])
    return spark.sql(STATEMENT, **sides)


def written_applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The application table written once, for plans that read it in several passes."""
    return written(applications(spark, sf_dir, dealt=True), "applications")


def applications_sql() -> str:
    """The same statement over the table names themselves."""
    return STATEMENT.format(**{t: t for t in TABLES})


def train_rows(apps: DataFrame) -> DataFrame:
    return apps.filter("split = 'train'").drop("split")


def test_rows(apps: DataFrame) -> DataFrame:
    return apps.filter("split = 'test'").drop("split")
