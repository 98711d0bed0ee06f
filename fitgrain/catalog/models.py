"""Split, training, sweep and scoring queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fitgrain import schema
from fitgrain.catalog.registry import query, rounded, scramble_sql, table, union_sql, with_apps
from fitgrain.catalog.retrieval import chunk_store
from fitgrain.operators import evaluate as ev
from fitgrain.operators import retrieve as rt
from fitgrain.operators.fold_maps import fit_fold_means
from fitgrain.operators.keyed_maps import MapSpec, encoded
from fitgrain.operators.split import SEED, stratified_folds, stratified_split
from fitgrain.plans import scoring as sc
from fitgrain.plans import training as tr
from fitgrain.plans.cleaning import fit_cleaning
from fitgrain.plans.features import encoding_specs, feature_columns, fit_features, missing_features
from fitgrain.session import scratch_dir, scratch_path, written
from fitgrain.sources.applications import applications, STATEMENT, test_rows, train_rows, written_applications
from fitgrain.sources.tables import path_exists, read_log, write_json_document
from fitgrain.streaming.scoring import stream_decisions


@query(
    "m1_stratified_split",
    with_apps(
        f"SELECT ID, label, row_number() OVER (PARTITION BY label ORDER BY {scramble_sql('ID', SEED)}) <= "
        "floor(0.2E0 * count(*) OVER (PARTITION BY label) + 0.5) AS is_validation FROM apps"
    ),
)
def m1(spark, sf_dir):
    return stratified_split(applications(spark, sf_dir)).select("ID", "label", "is_validation")


@query(
    "m2_stratified_folds",
    with_apps(
        f"SELECT ID, label, CAST((row_number() OVER (PARTITION BY label ORDER BY {scramble_sql('ID', SEED)}) - 1) * 5 "
        "// count(*) OVER (PARTITION BY label) AS INT) AS fold FROM apps"
    ),
)
def m2(spark, sf_dir):
    return stratified_folds(applications(spark, sf_dir)).select("ID", "label", "fold")


def content_key(df: DataFrame) -> str:
    """A digest of all rows, whatever their order: the number of rows and a sum of their hashes."""
    n, total = df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()
    return f"{n}-{total or 0}".replace("--", "-m")


def trained(spark, sf_dir) -> tuple[DataFrame, tr.TrainedModel]:
    """The applications and the production model, loaded if one learned from the same rows is saved."""
    apps = written_applications(spark, sf_dir)
    path = f"{scratch_dir(spark)}/fitgrain/models/{content_key(train_rows(apps))}"
    if not path_exists(spark, f"{path}/complete"):
        tr.train_model(train_rows(apps)).save(spark, path)
        write_json_document(spark, f"{path}/complete", "{}")
    return apps, tr.TrainedModel.load(spark, path)


@query("m3_network_training")
def m3(spark, sf_dir):
    """Learn on train, evaluate on test."""
    apps, model = trained(spark, sf_dir)
    scored = written(sc.with_decision(model.probabilities(test_rows(apps))), "scored")
    rows = scored.withColumn("Prediction", sc.predicted(F.col("probability")))
    return ev.metrics(rows).withColumn("roc_auc", ev.auc(rows, score="probability").scalar())


@query("m3_training_run", with_apps(
    "SELECT count(*) AS train_rows, (SELECT count(*) FROM train) - count(*) AS val_rows, 0 <= min(rank) AS has_metrics FROM ("
    "SELECT label, row_number() OVER (PARTITION BY label ORDER BY ID) AS rank, floor(0.2E0 * count(*) OVER (PARTITION BY label) + 0.5) AS held FROM train) WHERE rank > held"
))
def m3_run(spark, sf_dir):
    """The whole training run: stratified split, fit, held-out metrics, saved model and log, whose sizes are returned."""
    path = scratch_path(spark, "training-run")
    sc.training_run(train_rows(written_applications(spark, sf_dir)), tr.network, f"{path}/model", f"{path}/log")
    log = read_log(spark, f"{path}/log")
    return log.select(F.col("train_rows").cast("long"), F.col("val_rows").cast("long"), F.col("metrics")["roc_auc"].between(0, 1).alias("has_metrics"))


@query("m3_loss_curve")
def m3_curve(spark, sf_dir):
    """The held-out loss after each round of the network over the vectors; the least one's weights are the model."""
    rows, names = vectors(spark, sf_dir)
    network = tr.network(len(names))
    tr.fit_classifier(rows, names, network)
    curve = spark.createDataFrame(network.curve, "iterations long, held_out_loss double, is_best boolean")
    return curve.withColumn("kept", F.col("held_out_loss") == F.min("held_out_loss").over(Window.partitionBy()))


def vectors(spark, sf_dir):
    """The embeddings as a labelled feature table."""
    rows = table(spark, sf_dir, "embeddings")
    width = rows.agg(F.max(F.size("embedding"))).first()[0]
    names = [f"x{i}" for i in range(width)]
    label = (F.col("label") < 5).cast("int").alias("label")
    columns = [F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(names)]
    return rows.select(F.col("vec_id").alias("ID"), label, *columns), names


def sweep_scores(spark, sf_dir, *wanted: str) -> DataFrame:
    """Scores of candidates, all unless some are named, on the same five folds."""
    rows, names = vectors(spark, sf_dir)
    rows = written(stratified_folds(rows), "folds")
    models = tr.candidates(len(names)) | ({"LinearSVC": tr.linear_margin()} if "LinearSVC" in wanted else {})
    return tr.cross_validate(rows, names, {m: models[m] for m in wanted or models})


def _candidate(name: str, model: str) -> None:
    @query(name)
    def run(spark, sf_dir):
        """Five-fold scores of one classifier, as AUC per fold."""
        return ev.auc(sweep_scores(spark, sf_dir, model), by=["model", "fold"])


_candidate("m4_logistic", "LogisticRegression")
_candidate("m6_linear_svc", "LinearSVC")
_candidate("m6_kernel_svc", "SVC")
_candidate("m7_random_forest", "RandomForest")
_candidate("m8_network", "MLP")


@query(
    "m5_nearest_neighbour_votes",
    f"""
    WITH rows AS (SELECT vec_id, CASE WHEN label < 5 THEN 1 ELSE 0 END AS label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    folds AS (SELECT *, (row_number() OVER (PARTITION BY label ORDER BY {scramble_sql('vec_id', SEED)}) - 1) * 5 // count(*) OVER (PARTITION BY label) AS fold FROM rows)
    SELECT vec_id, round(avg(label), 6) AS score FROM (
      SELECT q.vec_id, s.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_distance(q.v, s.v), 9), s.vec_id) AS place
      FROM folds q JOIN folds s ON q.fold <> s.fold) WHERE place <= 5 GROUP BY vec_id
    """,
)
def m5(spark, sf_dir):
    """The share of class 1 among the five nearest vectors of the other folds, for every vector."""
    label = (F.col("label") < 5).cast("int")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), "embedding")
    folds = written(stratified_folds(rows, id_col="vec_id"), "folds")
    out = None
    for fold in range(5):
        store = folds.filter(F.col("fold") != fold).withColumnRenamed("vec_id", "near")
        asked = folds.filter(F.col("fold") == fold)
        hits = rt.top_k(asked, store, tr.NEIGHBOURS, "l2", "vec_id", store_id="near")
        votes = rt.neighbour_votes(hits, store, "label", "vec_id", "near")
        out = votes if out is None else out.unionByName(votes)
    return rounded(out)


@query("m9_cross_validation_sweep")
def m9(spark, sf_dir):
    """All five classifiers on the same folds, ranked by mean AUC."""
    scores = sweep_scores(spark, sf_dir)
    return ev.model_ranking(ev.auc(scores, by=["model", "fold"]))


def fold_features(spark, sf_dir) -> tuple[DataFrame, list, list[str]]:
    """Cleaned training rows with folds, the encodings of all folds, and the feature names.

    What no label enters (modes, caps, medians) is learned from all rows; the
    encodings by label are learned without the fold they are used on.
    """
    train = train_rows(written_applications(spark, sf_dir))
    clean = written(fit_cleaning(train).transform(train, training=True), "clean")
    features = fit_features(clean, encode=False)
    rows = written(stratified_folds(features.transform(clean)), "folds")
    specs = encoding_specs(rows)
    names = dict.fromkeys(feature_columns(rows.drop("fold")) + [s.value for s in specs if s.value not in schema.PROTECTED])
    return rows, fit_fold_means(rows, specs, of=schema.TARGET), list(names)


@query("m9_application_sweep")
def m9_applications(spark, sf_dir):
    """All five classifiers over the application features, encodings learned without the fold they score, ranked by mean AUC."""
    rows, maps, names = fold_features(spark, sf_dir)
    scores = tr.cross_validate(rows, names, tr.candidates(len(names)), by_fold=lambda df, fold: encoded(df, list(maps[fold].values())))
    return ev.model_ranking(ev.auc(scores, by=["model", "fold"]))


def _without_fold_sql(column: str) -> str:
    return (
        f"SELECT f.ID, f.fold, '{column}' AS encoded, round(coalesce("
        f"(sum(f.label) OVER (PARTITION BY f.{column}) - sum(f.label) OVER (PARTITION BY f.{column}, f.fold)) / "
        f"nullif(CAST(CASE WHEN f.{column} IS NULL THEN NULL ELSE count(*) OVER (PARTITION BY f.{column}) - count(*) OVER (PARTITION BY f.{column}, f.fold) END AS DOUBLE), 0), "
        f"(sum(f.label) OVER () - sum(f.label) OVER (PARTITION BY f.fold)) / CAST(count(*) OVER () - count(*) OVER (PARTITION BY f.fold) AS DOUBLE)), 6) AS value FROM folds f"
    )


@query(
    "m9_fold_encodings",
    with_apps(
        union_sql([_without_fold_sql(c) for c in ("county", "msamd", "agency")]),
        ("folds", f"SELECT ID, label, county, msamd, agency, (row_number() OVER (PARTITION BY label ORDER BY {scramble_sql('ID', SEED)}) - 1) * 5 // count(*) OVER (PARTITION BY label) AS fold FROM train"),
    ),
)
def m9_encodings(spark, sf_dir):
    """Target means of each row's fold, learned from the other folds, all in one scan."""
    columns = ("county", "msamd", "agency")
    rows = stratified_folds(train_rows(applications(spark, sf_dir)).select("ID", "label", *columns))
    rows = written(rows.withColumn("fold", F.col("fold").cast("long")), "folds")
    maps = fit_fold_means(rows, [MapSpec(c, None, c) for c in columns], of="label")
    out = None
    for fold in range(5):
        known = encoded(rows.filter(F.col("fold") == fold), list(maps[fold].values()))
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("encoded"), F.col(c).alias("value")) for c in columns])).alias("e")
        part = known.select("ID", "fold", pairs).select("ID", "fold", "e.*")
        out = part if out is None else out.unionByName(part)
    return rounded(out)


@query("m10_batch_score")
def m10(spark, sf_dir):
    apps, model = trained(spark, sf_dir)
    return sc.predictions(model, test_rows(apps))


@query("m11_missing_features", with_apps("SELECT count(*) AS n_rows, 'loan_type' AS missing FROM apps"))
def m11(spark, sf_dir):
    """The learned features that a table lacks, found from its schema."""
    rows = applications(spark, sf_dir).drop("loan_type")
    absent = missing_features(["loan_amount", "loan_type", "population"], rows)
    return rows.agg(F.count("*").alias("n_rows"), F.lit(",".join(absent)).alias("missing"))


@query("m12_approval_rate")
def m12(spark, sf_dir):
    apps, model = trained(spark, sf_dir)
    return sc.approval_rate(sc.predictions(model, test_rows(apps)))


@query(
    "m12_rule_approval_rate",
    with_apps("SELECT round(avg(CASE WHEN applicant_income > loan_amount * 0.2E0 THEN 1 ELSE 0 END), 6) AS approval_rate FROM apps"),
)
def m12_rule(spark, sf_dir):
    rows = sc.with_rule_score(applications(spark, sf_dir)).withColumn("Prediction", sc.predicted(F.col("probability")))
    return rounded(sc.approval_rate(rows))


RULE = "CASE WHEN applicant_income > loan_amount * 0.2E0 THEN 0.82E0 ELSE 0.45E0 END"
DECISIONS = with_apps(
    f"SELECT ID, CASE WHEN {RULE} >= 0.5 THEN 'approved' ELSE 'denied' END AS decision, round({RULE}, 3) AS confidence FROM apps"
)


@query("m13_decision", DECISIONS)
def m13(spark, sf_dir):
    scored = sc.with_decision(sc.with_rule_score(applications(spark, sf_dir)))
    return scored.select("ID", "decision", "confidence")


def application_stream(spark, sf_dir):
    """Orders as a stream, looked up in the static tables."""
    orders = table(spark, sf_dir, "orders").schema
    # As a pattern the path may be a file or a folder of files; a stream takes a plain path for a folder only.
    sides = {t: table(spark, sf_dir, t) for t in ("customer", "nation", "region")}
    stream = spark.readStream.schema(orders).parquet(f"{sf_dir}/orders.parque[t]")
    return spark.sql(STATEMENT, orders=stream, **sides)


@query("m13_stream_decision", DECISIONS)
def m13_stream(spark, sf_dir):
    """The same decisions from a stream, written exactly once and read back."""
    return stream_decisions(spark, application_stream(spark, sf_dir), scratch_path(spark, "stream"))


@query("m13_stream_model_decision")
def m13_model(spark, sf_dir):
    """Decisions of the trained model over the same stream."""
    _, model = trained(spark, sf_dir)
    return stream_decisions(spark, application_stream(spark, sf_dir).drop("split"), scratch_path(spark, "stream"), model)


@query("m14_rule_score", with_apps(f"SELECT ID, {RULE} AS probability FROM apps"))
def m14(spark, sf_dir):
    return sc.with_rule_score(applications(spark, sf_dir)).select("ID", "probability")


@query("m10_scored_rows", with_apps("SELECT count(*) AS n_rows, count(DISTINCT ID) AS n_ids, true AS zero_or_one FROM test"))
def m10_rows(spark, sf_dir):
    """Every test row is scored once, with a class."""
    apps, model = trained(spark, sf_dir)
    scored = sc.predictions(model, test_rows(apps))
    return scored.agg(F.count("*").alias("n_rows"), F.countDistinct("ID").alias("n_ids"), F.bool_and(F.col("Prediction").isin(0, 1)).alias("zero_or_one"))


@query("m12_model_rate_is_mean", with_apps("SELECT count(*) AS n_rows, true AS is_mean FROM test"))
def m12_mean(spark, sf_dir):
    """The approval rate is the share of rows scored as approved, each from its probability."""
    apps, model = trained(spark, sf_dir)
    rate = m12(spark, sf_dir).first()[0]
    scored = model.probabilities(test_rows(apps))
    share = F.count_if(F.col("probability") >= 0.5) / F.count("*")
    return scored.agg(F.count("*").alias("n_rows"), (F.abs(share - rate) < 1e-12).alias("is_mean"))


@query("m13_stream_equals_batch", with_apps("SELECT ID, true AS same FROM apps"))
def m13_same(spark, sf_dir):
    """The model decides each application of the stream as it does in a batch."""
    apps, model = trained(spark, sf_dir)
    batch = sc.with_decision(model.probabilities(apps.drop("split"))).select("ID", F.struct("decision", "confidence").alias("batch"))
    stream = m13_model(spark, sf_dir).select("ID", F.struct("decision", "confidence").alias("stream"))
    return batch.join(stream, "ID", "full").select("ID", F.col("batch").eqNullSafe(F.col("stream")).alias("same"))


@query(
    "m9_sweep_sizes",
    "WITH folds AS (SELECT (row_number() OVER (PARTITION BY label < 5 ORDER BY " + scramble_sql("vec_id", SEED) + ") - 1) * 5 // count(*) OVER (PARTITION BY label < 5) AS fold FROM embeddings) "
    "SELECT model, CAST(fold AS INT) AS fold, count(*) AS n, true AS in_range FROM folds, (SELECT unnest(['LogisticRegression', 'KNeighbors', 'SVC', 'RandomForest', 'MLP']) AS model) GROUP BY model, fold",
)
def m9_sizes(spark, sf_dir):
    """Every classifier scores every row of every fold once; probabilities lie between 0 and 1."""
    scores = sweep_scores(spark, sf_dir)
    return scores.groupBy("model", "fold").agg(F.count("*").alias("n"), F.bool_and(F.col("score").between(0, 1)).alias("in_range"))


@query("r9_explained_model")
def r9_model(spark, sf_dir):
    """The model's decisions on the test rows, explained: search text, nearest chunks and prompt."""
    apps, model = trained(spark, sf_dir)
    scored = sc.with_decision(model.probabilities(test_rows(apps)))
    amounts = [F.round(c).cast("long").alias(c) for c in ("applicant_income", "loan_amount")]
    store, encoder = chunk_store(spark, sf_dir)
    return rt.explained(scored.select("ID", "decision", "confidence", "loan_type", *amounts), store, encoder).select("ID", "decision", "confidence", "query", F.size("chunks").alias("n_chunks"), "prompt")
