import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from fitgrain.catalog.models import application_stream, vectors
from fitgrain.operators import evaluate as ev
from fitgrain.operators.split import stratified_folds
from fitgrain.plans import scoring as sc
from fitgrain.plans import training as tr
from fitgrain.plans.cleaning import fit_cleaning
from fitgrain.plans.features import fit_features
from fitgrain.session import scratch_path, written
from fitgrain.sources import tables as io
from fitgrain.sources.applications import test_rows as rows_of_test
from fitgrain.sources.applications import train_rows
from fitgrain.streaming.scoring import stream_decisions


def logistic(inputs):
    return LogisticRegression(featuresCol="features", labelCol="y", maxIter=15)


@pytest.fixture(scope="module")
def run(spark, apps):
    path = scratch_path(spark, "run")
    model, figures = sc.training_run(train_rows(apps), logistic, f"{path}/model", f"{path}/log")
    return path, model, figures


def test_missing_data_is_named(spark):
    with pytest.raises(FileNotFoundError, match="/no/such/train.csv"):
        io.scan(spark, "/no/such/train.csv")
    assert io.optional_scan(spark, "/no/such/test.csv") is None
    with pytest.raises(FileNotFoundError, match="no saved model"):
        tr.TrainedModel.load(spark, "/no/such/model")


def test_pages_are_joined_in_order(spark):
    pages = spark.createDataFrame([("d", 2, "c"), ("d", 0, "a"), ("d", 1, None), ("e", 0, None)], "doc string, page int, t string")
    got = {r["doc"]: r["text"] for r in io.read_pages_as_text(pages, "doc", "page", "t").collect()}
    assert got == {"d": "a\n\nc", "e": ""}


def test_text_files_are_whole_rows(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    (tmp_path / "b.txt").write_text("three")
    got = {r["name"]: r["text"] for r in io.scan_text_files(spark, f"{tmp_path}/*.txt").collect()}
    assert got == {"a.txt": "one\ntwo", "b.txt": "three"}


def test_upsert_adds_each_chunk_once(spark):
    path = scratch_path(spark, "upsert")
    rows = spark.createDataFrame([("a", "1"), ("b", "2"), ("a", "1")], "chunk_id string, chunk string")
    for _ in range(3):
        io.upsert_chunks(rows, path)
    assert spark.read.parquet(path).count() == 2


def test_training_run_logs_and_saves(spark, apps, run):
    path, model, figures = run
    log = io.read_log(spark, f"{path}/log").first()
    n = train_rows(apps).count()
    assert log["train_rows"] + log["val_rows"] == n
    assert log["feature_cols"] == model.features.features and log["n_features"] == len(log["feature_cols"])
    assert log["metrics"].keys() == {"accuracy", "precision", "recall", "f1", "roc_auc"}
    assert 0 <= figures["roc_auc"] <= 1
    loaded = tr.TrainedModel.load(spark, f"{path}/model")
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(sc.predictions(loaded, rows_of_test(apps))) == key(sc.predictions(model, rows_of_test(apps)))


def test_predictions_follow_the_threshold(apps, run):
    test = rows_of_test(apps).drop("label")  # a test table has no label
    scored = {r["ID"]: r["probability"] for r in run[1].probabilities(test).collect()}
    got = {r["ID"]: r["Prediction"] for r in sc.predictions(run[1], test).collect()}
    assert got == {i: int(p >= 0.5) for i, p in scored.items()}
    rate = sc.approval_rate(sc.predictions(run[1], test)).first()[0]
    assert rate == pytest.approx(sum(got.values()) / len(got))


def test_stream_of_a_trained_model_equals_batch(spark, apps, sf_dir, run):
    streamed = stream_decisions(spark, application_stream(spark, sf_dir).drop("split"), scratch_path(spark, "s"), run[1])
    batch = sc.with_decision(run[1].probabilities(apps.drop("split"))).select("ID", "decision", "confidence")
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))


def test_features_missing_from_the_table_are_an_error(apps, run):
    with pytest.raises(ValueError, match="loan_type"):
        run[1].probabilities(rows_of_test(apps).drop("loan_type"))


def test_sweep_scores_every_row_once_per_model(spark, sf_dir):
    rows, names = vectors(spark, sf_dir)
    rows = written(stratified_folds(rows.select("ID", "label", *names[:6])), "folds")
    models = {"KNeighbors": 5, "LogisticRegression": logistic(6)}
    scores = tr.cross_validate(rows, names[:6], models)
    n = rows.count()
    assert {r["model"]: r["count"] for r in scores.groupBy("model").count().collect()} == dict.fromkeys(models, n)
    assert scores.select("model", "id").distinct().count() == 2 * n
    ranking = ev.model_ranking(ev.auc(scores, by=["model", "fold"])).collect()
    assert sorted(r["place"] for r in ranking) == [1, 2]
    assert [r["winner"] for r in sorted(ranking, key=lambda r: r["place"])] == [True, False]


def test_preprocessing_is_refitted_inside_each_fold(apps):
    """The maps of a fold must come from its training rows alone."""
    rows = written(stratified_folds(train_rows(apps)), "folds")
    seen = []

    def prepare(train):
        cleaner = fit_cleaning(train)
        clean = cleaner.transform(train, training=True)
        features = fit_features(clean)
        seen.append(features.encodings["county"].fallback)
        return lambda df, training: features.transform(cleaner.transform(df, training))

    scores = tr.cross_validate(rows, ["loan_amount", "county"], {"LogisticRegression": logistic(2)}, folds=2, prepare=prepare, parallelism=1)
    assert len(set(seen)) == 2
    assert scores.count() > 0


def test_decision_of_a_missing_probability_is_denied(spark):
    df = spark.createDataFrame([(0.5,), (0.4999,), (None,)], "probability double")
    got = [(r["decision"], r["confidence"]) for r in sc.with_decision(df).collect()]
    assert got == [("approved", 0.5), ("denied", 0.5), ("denied", None)]


def test_rule_needs_more_than_a_fifth(spark):
    df = spark.createDataFrame([(21.0, 100.0), (20.0, 100.0), (None, 1.0)], "applicant_income double, loan_amount double")
    assert [r["probability"] for r in sc.with_rule_score(df).collect()] == [0.82, 0.45, 0.45]


def test_compat_run_learns_its_maps_from_all_rows(spark, apps):
    path = scratch_path(spark, "compat")
    train = train_rows(apps)
    model, figures = sc.training_run(train, logistic, f"{path}/model", f"{path}/log", compat=True)
    everything = fit_cleaning(train, compat=True)
    assert sorted(model.cleaning.maps["county"].rows) == sorted(everything.maps["county"].rows)
    assert model.cleaning.compat and 0 <= figures["accuracy"] <= 1


def test_stream_of_a_table_in_many_files(spark, sf_dir, tmp_path):
    from fitgrain.catalog.models import application_stream
    from fitgrain.streaming.scoring import stream_decisions

    for name in ("customer", "nation", "region", "orders"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    found = stream_decisions(spark, application_stream(spark, str(tmp_path)), f"{tmp_path}/out")
    assert found.count() == spark.read.parquet(f"{sf_dir}/orders.parquet").count()


def test_one_chunk_id_for_two_chunks(spark, tmp_path):
    import pytest

    from fitgrain.sources.tables import upsert_chunks

    same = spark.createDataFrame([("x_0", 0, "a"), ("x_0", 0, "a")], "chunk_id string, chunk_index int, chunk string")
    upsert_chunks(same, f"{tmp_path}/ok")
    assert spark.read.parquet(f"{tmp_path}/ok").count() == 1
    with pytest.raises(ValueError):
        upsert_chunks(same.union(same.selectExpr("chunk_id", "chunk_index", "'b'")), f"{tmp_path}/bad")


def test_scored_rows_keep_their_columns_and_repeated_ids(apps, run):
    test = rows_of_test(apps).drop("label").limit(20)
    rows = written(test.unionByName(test).withColumn("probability", F.lit("old")), "repeated")
    scored = run[1].probabilities(rows)
    assert scored.columns == rows.columns and scored.schema["probability"].dataType.simpleString() == "double"
    came = rows.drop("probability")
    assert scored.drop("probability").exceptAll(came).count() == came.exceptAll(scored.drop("probability")).count() == 0


def test_document_files_are_written_by_all_cores(spark, tmp_path):
    """One scan partition of many documents is written by several tasks; rows of one id still share a file."""
    from fitgrain.catalog import QUERIES

    rows = [(i, f"text {i}") for i in range(1, 60)] + [(7, "again")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["s3_document_files"](spark, str(tmp_path))
    assert found.count() == 59 and {r["n_chars"] for r in found.where("name = '7.txt'").collect()} == {len("text 7\nagain\n")}
    tasks = {str(p).split("part-")[1][:5] for f in found.inputFiles() for p in [f]}
    assert len(tasks) > 1


def test_text_files_are_laid_out_as_by_spark_and_none_is_left_out(spark, tmp_path):
    rows = [("a.txt", "x\ny"), ("b.txt", None), ("a.txt", "é"), (None, "z"), ("c-1.txt", "")]
    df = spark.createDataFrame(rows, "name string, text string")
    here, theirs = str(tmp_path / "here"), str(tmp_path / "theirs")
    io.write_text_files(df, here)
    df.repartition(3, "name").write.partitionBy("name").text(theirs)
    read = lambda path, *files: sorted((r["folder"], "\n".join(sorted(r["text"].split("\n"))), r["status"]) for r in io.scan_documents(spark, path, *files).collect())
    assert read(here, "*.txt") == read(f"{theirs}/name=*/*.txt") == read(here + "/name=*/*.txt")
    names = [p.name for p in (tmp_path / "here").rglob("*") if p.is_file()]
    assert len(names) == 4 and all(n.startswith("part-") for n in names)  # no second file of checksums or rights
    (tmp_path / "here" / "name=d.txt").mkdir()
    (tmp_path / "here" / "name=d.txt" / "part.txt").touch()
    (tmp_path / "here" / "name=d.txt" / "other.log").touch()
    assert read(here, "*.txt") == read(here + "/name=*/*.txt")
    odd = spark.createDataFrame([("a/b", "x"), ("", "y")], "name string, text string")
    io.write_text_files(odd, str(tmp_path / "odd"))
    assert len(read(str(tmp_path / "odd"), "*.txt")) == 2
