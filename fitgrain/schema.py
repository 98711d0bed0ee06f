"""Column roles and the record layout of the application table."""

from __future__ import annotations

from pyspark.sql import types as T

TARGET = "label"
ID = "ID"
SPLIT = "split"

# Columns kept out of the feature vector, protected attributes,
# legal occupancy labels, numeric columns of the exploratory report.
EXCLUDED = ("county_code", "loan_amount_bin")

PROTECTED = (
    "applicant_ethnicity",
    "applicant_race_name_1",
    "applicant_sex",
    "co_applicant_ethnicity",
    "co_applicant_race_name_1",
    "co_applicant_sex",
)

OCCUPANCY_LABELS = (
    "Owner-occupied as a principal dwelling",
    "Not owner-occupied as a principal dwelling",
    "Not applicable",
)

NUMERIC = (
    "loan_amount",
    "applicant_income",
    "population",
    "minority_population",
    "hud_median_family_income",
    "tract_to_msamd_income",
    "number_of_owner_occupied_units",
    "A",
    "B",
    "C",
)

CAPPED = ("loan_amount", "applicant_income")
MEDIAN_FILLED = (
    "population",
    "minority_population",
    "hud_median_family_income",
    "number_of_owner_occupied_units",
)
RANDOM_FILLED = ("A", "B", "C")
ENCODED = ("agency", "applicant_race_name_1", "census_tract_number", "county", "msamd", "D")

# The text and whole-number columns of a record, in its order.
_TEXT = (
    "census_tract_number",
    "county",
    "msamd",
    "property_type",
    "owner_occupancy",
    "preapproval",
    "applicant_ethnicity",
    "applicant_race_name_1",
    "co_applicant_ethnicity",
    "co_applicant_race_name_1",
    "applicant_sex",
    "co_applicant_sex",
    "agency",
    "loan_purpose",
)
_INTS = ("loan_type", "lien_status", "D")

APPLICATION_SCHEMA = T.StructType(
    [T.StructField(ID, T.LongType()), T.StructField(TARGET, T.IntegerType())]
    + [T.StructField(c, T.DoubleType()) for c in NUMERIC]
    + [T.StructField(c, T.StringType()) for c in _TEXT]
    + [T.StructField(c, T.IntegerType()) for c in _INTS]
    + [T.StructField("county_code", T.IntegerType()), T.StructField("loan_amount_bin", T.StringType())]
)
