"""Source and sink queries: what is written is read back whole."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fitgrain import schema
from fitgrain.catalog.registry import query, rounded, table, with_apps
from fitgrain.catalog.cleaning import APP_COLUMNS
from fitgrain.catalog.evaluation import CELLS, SCORED, scored
from fitgrain.catalog.retrieval import CHUNKS_SQL, document_chunks
from fitgrain.operators import evaluate as ev
from fitgrain.operators import retrieve as rt
from fitgrain.operators.split import stratified_split
from fitgrain.plans.scoring import predicted, with_rule_score
from fitgrain.plans.training import TrainedModel, train_model
from fitgrain.session import scratch_path
from fitgrain.sources import tables as io
from fitgrain.sources.applications import applications, train_rows, written_applications
from fitgrain.streaming.upsert import upsert_stream


def application_layout() -> T.StructType:
    """The record layout with the columns the derived table adds or lacks."""
    known = {f.name: f for f in schema.APPLICATION_SCHEMA.fields}
    extra = {"split": T.StringType(), "sparse_col": T.DoubleType()}
    return T.StructType([known.get(c) or T.StructField(c, extra[c]) for c in APP_COLUMNS])


@query("s1_csv_scan", with_apps("SELECT * FROM apps"))
def s1(spark, sf_dir):
    path = scratch_path(spark, "applications-csv")
    plain = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    applications(spark, sf_dir).write.option("header", True).options(**plain).csv(path)
    return io.scan(spark, path, application_layout())


@query("s1_parquet_scan", "SELECT * FROM customer")
def s1_parquet(spark, sf_dir):
    return io.scan(spark, f"{sf_dir}/customer.parquet", fmt="parquet")


@query("s2_optional_scan", "SELECT count(*) AS n_orders, true AS absent_is_none FROM orders")
def s2(spark, sf_dir):
    absent = io.optional_scan(spark, f"{sf_dir}/no-such-table.parquet", fmt="parquet")
    orders = io.optional_scan(spark, f"{sf_dir}/orders.parquet", fmt="parquet")
    return orders.agg(F.count("*").alias("n_orders"), F.lit(absent is None).alias("absent_is_none"))


@query("s3_document_pages", "SELECT doc_id, text FROM documents")
def s3(spark, sf_dir):
    """Documents taken apart at line breaks into pages, in any order, and joined again."""
    docs = table(spark, sf_dir, "documents")
    pages = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("page_no", "page"))
    return io.read_pages_as_text(pages.select("doc_id", "page_no", F.nullif("page", F.lit("")).alias("page")), "doc_id", "page_no", "page")


@query("s4_prediction_sink", with_apps("SELECT ID, CASE WHEN applicant_income > loan_amount * 0.2E0 THEN 1 ELSE 0 END AS Prediction FROM apps"))
def s4(spark, sf_dir):
    rows = with_rule_score(applications(spark, sf_dir)).withColumn("Prediction", predicted(F.col("probability")))
    path = scratch_path(spark, "predictions")
    io.write_predictions(rows, path)
    return spark.read.schema("ID long, Prediction int").option("header", True).csv(path)


@query("s5_chunk_upsert", f"SELECT doc_id || '_' || chunk_index AS chunk_id, chunk FROM ({CHUNKS_SQL})")
def s5(spark, sf_dir):
    """Half of the documents arrive first, then all of them: every chunk is stored once."""
    path = scratch_path(spark, "chunk-table")
    chunks = rt.with_chunk_id(document_chunks(spark, sf_dir), F.col("doc_id")).select("chunk_id", "chunk", "doc_id")
    io.upsert_chunks(chunks.filter("doc_id % 2 = 0").drop("doc_id"), path)
    io.upsert_chunks(chunks.drop("doc_id"), path)
    return io.read_chunks(spark, path)


@query("s5_stream_upsert", f"SELECT doc_id || '_' || chunk_index AS chunk_id, chunk FROM ({CHUNKS_SQL})")
def s5_stream(spark, sf_dir):
    """The chunks of a stream of documents, upserted batch by batch; half of them were stored before."""
    path = scratch_path(spark, "chunk-stream")
    docs = table(spark, sf_dir, "documents")
    known = rt.with_chunk_id(document_chunks(spark, sf_dir), F.col("doc_id")).filter("doc_id % 2 = 0")
    io.upsert_chunks(known.select("chunk_id", "chunk"), f"{path}/table")
    stream = spark.readStream.schema(docs.schema).parquet(f"{sf_dir}/documents.parque[t]")
    chunks = rt.with_chunk_id(rt.chunked(stream, "doc_id", "text"), F.col("doc_id")).select("chunk_id", "chunk")
    upsert_stream(chunks, f"{path}/table", f"{path}/state").awaitTermination()
    return io.read_chunks(spark, f"{path}/table")


@query("s3_document_files", "SELECT doc_id || '.txt' AS name, CASE WHEN doc_id % 50 = 0 THEN 'empty' ELSE 'read' END AS status, CASE WHEN doc_id % 50 = 0 THEN 2 ELSE length(text) + 1 END AS n_chars FROM documents")
def s3_files(spark, sf_dir):
    """Each document as a file, some of them blank, read whole with what became of it."""
    path = scratch_path(spark, "document-files")
    text = F.when(F.col("doc_id") % 50 == 0, " ").otherwise(F.col("text"))
    docs = table(spark, sf_dir, "documents").select(F.concat("doc_id", F.lit(".txt")).alias("name"), text.alias("text"))
    io.write_text_files(docs, path)
    found = io.scan_documents(spark, path, "*.txt")
    return found.select(F.col("folder").alias("name"), "status", F.char_length("text").cast("long").alias("n_chars"))


@query(
    "s6_experiment_log",
    with_apps(
        "SELECT '20260101_000000' AS timestamp, (SELECT CAST(count(*) - sum(v) AS BIGINT) FROM sizes) AS train_rows, "
        "(SELECT CAST(sum(v) AS BIGINT) FROM sizes) AS val_rows, 2 AS n_features, 'loan_amount,applicant_income' AS feature_cols, "
        "round((tp + tn) / (tp + tn + fp + fn)::DOUBLE, 6) AS accuracy, 'models/a' AS model_path FROM cells",
        SCORED,
        CELLS,
        (
            "sizes",
            "SELECT CASE WHEN row_number() OVER (PARTITION BY label ORDER BY ID) <= floor(0.2E0 * count(*) OVER (PARTITION BY label) + 0.5) THEN 1 ELSE 0 END AS v FROM apps",
        ),
    ),
)
def s6(spark, sf_dir):
    path = scratch_path(spark, "log")
    sizes = {r[0]: r[1] for r in stratified_split(applications(spark, sf_dir)).groupBy("is_validation").count().collect()}
    figures = ev.metrics(scored(spark, sf_dir)).first().asDict()
    io.append_log(spark, path, sizes[False], sizes[True], ["loan_amount", "applicant_income"], figures, "models/a", "20260101_000000")
    log = io.read_log(spark, path)
    return rounded(
        log.select(
            "timestamp",
            "train_rows",
            "val_rows",
            "n_features",
            F.array_join("feature_cols", ",").alias("feature_cols"),
            F.col("metrics")["accuracy"].alias("accuracy"),
            "model_path",
        )
    )


@query("s7_model_round_trip", with_apps("SELECT ID, true AS same_score FROM apps"))
def s7(spark, sf_dir):
    """A model scores every row alike before it is saved and after it is loaded."""
    apps = written_applications(spark, sf_dir)
    logistic = lambda inputs: LogisticRegression(featuresCol="features", labelCol="y", maxIter=1000)
    model = train_model(train_rows(apps), logistic)
    path = scratch_path(spark, "model")
    model.save(spark, path)
    loaded = TrainedModel.load(spark, path)
    rows = apps.drop("split")
    both = loaded.probabilities(model.probabilities(rows).withColumnRenamed("probability", "first"))
    return both.select("ID", (F.abs(F.col("probability") - F.col("first")) < 1e-12).alias("same_score"))
