import pytest
from pyspark.sql import functions as F

from fitgrain.functions import text as tx
from fitgrain.operators import keyed_maps as km
from fitgrain.operators.hotdeck import fit_hotdeck
from fitgrain.plans.cleaning import CleaningModel, fit_cleaning
from fitgrain.plans.features import FeatureModel, fit_features, require_features
from fitgrain.session import scratch_path
from fitgrain.sources.applications import test_rows as rows_of_test
from fitgrain.sources.applications import train_rows


def values(df, expression):
    return [r[0] for r in df.select(expression).collect()]


@pytest.fixture(scope="module")
def fitted(apps):
    cleaner = fit_cleaning(train_rows(apps))
    clean = cleaner.transform(train_rows(apps), training=True)
    return cleaner, clean, fit_features(clean)


def test_label_expressions(spark):
    df = spark.createDataFrame([(" Preapproval was requested ",), ("was NOT requested",), (None,), ("x",)], "c string")
    assert values(df, tx.request_flag(F.col("c"))) == [1, 0, 0, 0]
    assert values(df, tx.request_flag(F.col("c"), compat=True)) == [1, 1, 0, 0]
    df = spark.createDataFrame([(" FEMALE",), ("male ",), ("Not Applicable",), ("no co-applicant",), (None,), ("?",)], "c string")
    expected = ["Female", "Male", "Not applicable", "No co-applicant", "Not provided", "Not provided"]
    assert values(df, tx.classified(F.col("c"))) == expected
    df = spark.createDataFrame([(" Asian",), ("Caucasian",), (None,), ("WHITE",)], "c string")
    assert values(df, tx.consolidated(F.col("c"))) == ["Asian", "Other", "Other", "WHITE"]
    assert values(df, tx.consolidated(F.col("c"), compat=True)) == ["Asian", "Caucasian", "Other", "WHITE"]
    assert values(df, tx.consolidated(F.col("c"), missing="No co-applicant"))[2] == "No co-applicant"


def test_mode_ties_take_the_smallest_and_numbers_compare_as_numbers(spark):
    df = spark.createDataFrame([("a", 10), ("a", 9), ("b", None), ("b", None), (None, 10)], "k string, v int")
    learned = km.fit_modes(df, [km.MapSpec("m", "k", "v")])["m"]
    assert learned.rows == [("a", "9", 2)]
    assert learned.fallback == "10"
    filled = km.filled(spark.createDataFrame([("a", None), ("b", None), ("z", None), (None, 4)], "k string, v int"), learned)
    assert [r["v"] for r in filled.collect()] == [9, 10, 10, 4]


def test_missing_companion_column_leaves_the_global_mode(spark):
    df = spark.createDataFrame([(1,), (1,), (None,)], "v int")
    learned = km.fit_modes(df, [km.MapSpec("m", "absent", "v")])["m"]
    assert [r["v"] for r in km.filled(df, learned).collect()] == [1, 1, 1]


def test_a_large_map_leaves_the_small_one_beside_it_small(spark):
    rows = spark.range(400).select(F.col("id").alias("ID"), F.col("id").cast("string").alias("wide"), (F.col("id") % 3).cast("string").alias("few"), (F.col("id") % 2).alias("label"))
    learned = km.fit_means(rows, [km.MapSpec(c, None, c) for c in ("wide", "few")], limit=100, of="label")
    assert learned["wide"].table is not None and len(learned["few"].rows) == 3
    again = km.restored(km.stored(learned, spark), [km.MapSpec(c, None, c) for c in ("wide", "few")], limit=100)
    assert again["wide"].table is not None and sorted(again["few"].rows) == sorted(learned["few"].rows)
    assert sorted(km.encoded(rows, list(learned.values())).collect()) == sorted(km.encoded(rows, list(again.values())).collect())


@pytest.mark.parametrize("limit", [0, 1000])
def test_a_hot_key_without_values_takes_the_fallback(spark, limit):
    """Half of the rows share a key whose value is always missing; such rows are dealt out, too."""
    key = F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string"))
    rows = spark.range(4000).select(F.col("id").alias("ID"), key.alias("k"), F.when(F.col("id") % 2 == 1, F.col("id") % 5).alias("v"))
    learned = km.fit_modes(rows, [km.MapSpec("m", "k", "v")], limit=limit)["m"]
    if limit == 0:
        assert learned.table.filter("n > 1").first()["n"] == 2000
    got = {r["ID"]: r["v"] for r in km.filled(rows, learned).collect()}
    assert len(got) == 4000 and got[1] == 1 and got[4] == int(learned.fallback)


@pytest.mark.parametrize("limit", [0, 1000])
def test_small_and_large_maps_agree_under_a_hot_key(spark, limit):
    """One key holds a third of the rows, many keys are missing or unseen."""
    rows = spark.range(3000).select(
        F.col("id").alias("ID"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.col("id").cast("string")).alias("k"),
        (F.col("id") % 2).cast("int").alias("label"),
    )
    learned = km.fit_means(rows.filter("ID < 2000"), [km.MapSpec("k", None, "k")], limit=limit, of="label")
    assert (learned["k"].table is None) == (limit > 0) or limit == 1000
    got = {r["ID"]: r["k"] for r in km.encoded(rows, list(learned.values())).collect()}
    assert len(got) == 3000
    hot = [i % 2 for i in range(0, 2000, 3)]
    assert got[0] == got[2997] == pytest.approx(sum(hot) / len(hot))
    assert got[7] == got[2999] == pytest.approx(0.5)
    assert got[5] == 1.0


def test_maps_are_learned_from_train_only(apps, fitted):
    """Other test labels and values must not change what is learned."""
    changed = apps.withColumn("label", F.when(F.col("split") == "test", 1 - F.col("label")).otherwise(F.col("label")))
    changed = changed.withColumn("county", F.when(F.col("split") == "test", "elsewhere").otherwise(F.col("county")))
    again = fit_cleaning(train_rows(changed))
    order = lambda m: {k: (sorted(v.rows), v.fallback) for k, v in m.maps.items()}
    assert order(again) == order(fitted[0])


def test_cleaning_leaves_no_gaps_and_keeps_test_rows(apps, fitted):
    cleaner, clean, _ = fitted
    test = rows_of_test(apps)
    out = cleaner.transform(test)
    assert out.count() == test.count()
    filled = "owner_occupancy applicant_ethnicity census_tract_number county msamd tract_to_msamd_income lien_status A B C".split()
    for side in (out, clean):
        gaps = side.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in filled]).first().asDict()
        assert set(gaps.values()) == {0}
    assert "sparse_col" not in out.columns


def test_encodings_are_rates_and_unseen_keys_get_the_mean(apps, fitted):
    cleaner, clean, features = fitted
    mean = clean.agg(F.avg("label")).first()[0]
    strange = rows_of_test(apps).withColumn("county", F.lit("nowhere"))
    out = features.transform(cleaner.transform(strange))
    assert values(out.select("county").distinct(), "county") == pytest.approx([mean])
    low, high = out.agg(F.min("census_tract_number"), F.max("census_tract_number")).first()
    assert 0 <= low <= high <= 1


def test_feature_list_is_frozen_and_unprotected(fitted):
    features = fitted[2].features
    assert "applicant_race_name_1" not in features and "county_code" not in features
    assert fit_features(fitted[1], exclude_protected=False).features != features
    with pytest.raises(ValueError, match="loan_amount"):
        require_features(features, fitted[1].drop("loan_amount"))


def test_plans_survive_saving(spark, apps, fitted):
    cleaner, _, features = fitted
    path = scratch_path(spark, "plan")
    cleaner.save(spark, f"{path}/c")
    features.save(spark, f"{path}/f")
    test = rows_of_test(apps)
    before = features.transform(cleaner.transform(test))
    after = FeatureModel.load(spark, f"{path}/f").transform(CleaningModel.load(spark, f"{path}/c").transform(test))
    assert sorted(map(str, before.collect())) == sorted(map(str, after.collect()))


def test_columns_may_be_absent(apps):
    few = train_rows(apps).select("ID", "label", "loan_amount", "county")
    cleaner = fit_cleaning(few)
    clean = cleaner.transform(few, training=True)
    out = fit_features(clean).transform(clean)
    assert out.columns == ["ID", "label", "loan_amount", "county"]
    assert out.count() == few.count()


@pytest.mark.parametrize("small", [0, 10**6])
def test_random_fill_draws_seen_values_evenly(spark, small):
    rows = spark.range(40000).select(
        F.col("id").alias("ID"), F.when(F.col("id") % 2 == 0, (F.col("id") % 200).cast("double")).alias("A")
    )
    deck = fit_hotdeck(rows, ["A"], small_rows=small)
    out = deck.transform(rows)
    assert out.count() == 40000
    drawn = out.filter("ID % 2 = 1")
    assert drawn.filter("A is null or A % 2 = 1").count() == 0
    mean, n = drawn.agg(F.avg("A"), F.countDistinct("A")).first()
    assert mean == pytest.approx(99.0, abs=1.5) and n == 100
    assert sorted(out.collect()) == sorted(deck.transform(rows.repartition(7)).collect())


def test_random_fill_without_donors_stays_missing(spark):
    rows = spark.createDataFrame([(1, None), (2, None)], "ID long, A double")
    assert [r["A"] for r in fit_hotdeck(rows, ["A"]).transform(rows).collect()] == [None, None]
