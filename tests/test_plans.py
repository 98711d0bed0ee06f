"""Plans must prune, and must not rank or move the whole table."""

from pyspark.sql import functions as F

from fitgrain.catalog import QUERIES
from fitgrain.operators import profile
from fitgrain.operators.split import stratified_split

def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_what_a_query_uses(spark, sf_dir):
    text = plan(QUERIES["e13_msamd_rates"](spark, sf_dir))
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderstatus:string>" in text
    assert "o_totalprice" not in text


def test_a_split_does_not_shuffle(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("label", F.lit(1))
    assert "Exchange" not in plan(stratified_split(orders, id_col="o_orderkey"))


def test_top_rates_sort_only_the_top(spark, apps):
    assert "TakeOrderedAndProject" in plan(profile.top_rates(apps, "county", 1))
