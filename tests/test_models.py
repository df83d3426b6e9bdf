import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tabloom.operators import evaluate, isolation, models, score, split, stages, target_stats
from tabloom.session import shared_folder, written_table


@pytest.fixture(scope="module")
def flowers(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(120):
        k = i % 3
        rows.append((i, *[float(v) for v in rng.normal(2 + 3 * k, 0.6, 3)], ["setosa", "versicolor", "virginica"][k]))
    return spark.createDataFrame(rows, "id int, a double, b double, c double, species string")


@pytest.mark.parametrize("algorithm, config", [
    ("random_forest_trainer", {"n_estimators": 10, "max_depth": 4}),
    ("linear_trainer", {}),
    ("lightgbm_trainer", {"n_estimators": 3, "num_leaves": 7}),
])
def test_classifiers_decode_their_classes(flowers, algorithm, config):
    train, test = split.parts(split.train_test_split(flowers, ["id"], 0.3, stratify_by="species"))
    trained = models.train_model(train.drop("id"), "species", algorithm, config)
    assert trained.classes == ["setosa", "versicolor", "virginica"]
    scored = score.score_batch(test, trained)
    assert scored.columns == [*test.columns, "Predicted_Class", "Confidence_Pct"]
    rows = scored.collect()
    assert sum(r.species == r.Predicted_Class for r in rows) / len(rows) > 0.9
    assert all(33.0 <= r.Confidence_Pct <= 100.0 for r in rows)
    assert set(trained.importances) == {"a", "b", "c"}


def test_ridge_equals_closed_form(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 2))
    y = x @ [2.0, -1.0] + 5 + rng.normal(scale=0.3, size=80)
    df = spark.createDataFrame([(float(a), float(b), float(t)) for (a, b), t in zip(x, y)], "a double, b double, y double")
    trained = models.train_model(df, "y", "linear_trainer", {"task_type": "regression", "C": 0.2})
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + 5.0 * np.eye(2), xc.T @ yc)
    assert trained.pipeline.stages[-1].coefficients.toArray() == pytest.approx(want, abs=1e-6)


def test_native_categories_and_unseen_levels(spark):
    rows = [(float(20 + i % 40), ["Oslo", "Rome", None][i % 3], int(i % 3 == 1)) for i in range(100)]
    df = spark.createDataFrame(rows, "Age double, City string, Default int")
    trained = models.train_model(df, "Default", "catboost_trainer", {"iterations": 5, "depth": 3})
    assert "City" in trained.importances
    new = spark.createDataFrame([(None, "Paris"), (30.0, "Rome")], "Age double, City string")
    rows = score.score_batch(new, trained).collect()
    assert rows[1].Predicted_Class == "1" and len(rows) == 2


def test_many_levels_become_target_statistics(spark):
    df = spark.createDataFrame([(f"u{i % 300}", float(i % 300 > 150), float(i)) for i in range(900)], "u string, y double, x double")
    trained = models.train_model(df, "y", "catboost_trainer", {"task_type": "regression", "iterations": 5, "depth": 2})
    # The first row of a level has seen no target yet, so a third of the rows only know the overall mean.
    assert trained.importances["u"] > 2 * trained.importances["x"]
    assert score.score_batch(spark.createDataFrame([("new", 1.0)], "u string, x double"), trained).count() == 1


def test_ignored_options_are_stated(flowers):
    trained = models.train_model(flowers.drop("id").filter("species <> 'setosa'"), "species", "xgboost_trainer",
                                 {"n_estimators": 2, "max_depth": 2, "reg_alpha": 0.5, "scale_pos_weight": 2.0})
    assert trained.ignored == {"reg_alpha": 0.5}


def test_unseen_test_label_is_class_zero(spark, flowers):
    trained = models.train_model(flowers.drop("id").filter("species <> 'setosa'"), "species", "linear_trainer", {})
    labels = {r.species for r in trained.label_rows(flowers).select("species").distinct().collect()}
    assert labels == {0, 1}


def test_preparation_survives_saving(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, "b"), (3.0, "a"), (9.0, None)], "x double, c string")
    fitted = [stages.Imputer(config={"strategy": "median"}).fit(df)]
    fitted.append(stages.Encoder(config={"method": "one_hot"}).fit(fitted[0].transform(df)))
    fitted.append(stages.Scaler(config={"columns": ["x"]}).fit(fitted[1].transform(fitted[0].transform(df))))
    pipeline = PipelineModel(fitted)
    path = shared_folder(spark, "prep")
    pipeline.write().save(path)
    again = PipelineModel.load(path)
    new = spark.createDataFrame([(None, "b"), (5.0, "z")], "x double, c string")
    assert again.transform(new).collect() == pipeline.transform(new).collect()


def test_trained_pipeline_survives_saving(spark, flowers):
    trained = models.train_model(flowers.drop("id"), "species", "random_forest_trainer", {"n_estimators": 3, "max_depth": 3})
    path = shared_folder(spark, "model")
    trained.pipeline.write().save(path)
    again = PipelineModel.load(path)
    pick = lambda m: [r.prediction for r in m.transform(flowers).orderBy("id").collect()]
    assert pick(again) == pick(trained.pipeline)


def test_isolation_forest_flags_planted_rows(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(rng.normal(50, 5)), float(rng.normal(100, 10)), "ab"[i % 2]) for i in range(100)]
    rows += [(100 + i, v, -v, "a") for i, v in enumerate([500.0, 600.0, -200.0, 700.0, 800.0])]
    df = spark.createDataFrame(rows, "id int, feature1 double, feature2 double, category string")
    fitted = isolation.fit_isolation_forest(df, ["feature1", "feature2", "category"], 0.05, 60)
    flagged = isolation.flag_anomalies(df, fitted)
    assert flagged.columns == [*df.columns, "is_anomaly", "anomaly_score"]
    hits = {r.id for r in flagged.filter("is_anomaly = 1").collect()}
    assert len(hits & {100, 101, 102, 103, 104}) >= 4 and len(hits) <= 6
    new = spark.createDataFrame([(1, 900.0, -900.0, "a"), (2, 50.0, 100.0, "b")],
                                "id int, feature1 double, feature2 double, category string")
    scored = {r.id: r for r in isolation.score_new_rows(new, fitted).collect()}
    assert scored[1].is_anomaly == 1 and scored[1].verdict == "ANOMALOUS_OUTLIER" and scored[2].is_anomaly == 0
    assert scored[1].anomaly_score > scored[2].anomaly_score


def test_isolation_forest_with_missing_values(spark):
    df = spark.createDataFrame([(1.0, 10.0, "x"), (None, 11.0, "y"), (1.2, None, None), (0.9, 9.5, "x"), (1.1, 10.2, "y"),
                                (1000.0, 9999.0, "x")], "num1 double, num2 double, dept string")
    flagged = isolation.flag_anomalies(df, isolation.fit_isolation_forest(df, contamination=0.2, n_estimators=50))
    assert flagged.filter("num1 = 1000").first().is_anomaly == 1


def test_text_classifier(spark):
    df = spark.createDataFrame([(f"good great fine {i}", "pos") if i % 2 else (f"bad awful poor {i}", "neg") for i in range(40)],
                               "t string, y string")
    model, target = score.train_text_classifier(df, "t", "y")
    rows = score.classify_text(spark.createDataFrame([("great fine",), ("awful",)], "t string"), model, target["classes"]).collect()
    assert [r.prediction for r in rows] == ["pos", "neg"]
    assert all(sum(r.probabilities.values()) == pytest.approx(1, abs=1e-3) for r in rows)


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (1, 0, 0.4), (0, 0, 0.4), (0, 1, 0.7), (0, 0, 0.1)], "label int, prediction int, p double")
    m = evaluate.classification_metrics(df, average="macro").first()
    assert (m.accuracy, m.balanced_accuracy, m.f1_score) == (0.6, 0.5833, 0.5833)
    assert evaluate.roc_auc(df, F.col("label") == 1, F.col("p")).first().roc_auc == 0.75
    assert evaluate.roc_auc(df, F.col("label") == 1, F.col("p"), max_task_rows=1).first().roc_auc == 0.75
    cost = evaluate.business_cost(df, cost_false_positive=2.5, cost_false_negative=10).first()
    assert cost.total_estimated_business_loss == 12.5
    only = evaluate.confusion(df.filter("label = 0 and prediction = 1"))
    assert {(r.label, r.prediction, r.n) for r in only.collect()} == {(0, 0, 0), (0, 1, 1), (1, 0, 0), (1, 1, 0)}


def test_constant_regression_target(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "label double, prediction double")
    assert evaluate.regression_metrics(df).first().r2_score == 1.0


def test_options_beyond_the_limits_are_listed(spark):
    assert models._forest("classification", {"label": "y", "max_depth": 40})[1] == {"max_depth": 40}
    assert models._xgboost("regression", {"label": "y", "max_depth": 31, "min_child_weight": 60}, 0, 100)[1] == {"max_depth": 31, "min_child_weight": 60}
    assert models._lightgbm("regression", {"label": "y", "max_depth": 9}, 0, 100)[1] == {}


def test_ordered_statistics_equal_a_loop(spark):
    rng = np.random.default_rng(4)
    rows = [(f"c{rng.integers(5)}" if i % 6 else "hot", float(i % 13), int(rng.integers(3))) for i in range(400)]
    df = spark.createDataFrame(rows, "c string, x double, y int")
    state = target_stats.fit_target_stats(df, "y", ["c"], 3)
    whole = target_stats.training_stats(df.withColumn("id", F.monotonically_increasing_id()), "y", state, 3).collect()
    cut = target_stats.training_stats(df.withColumn("id", F.monotonically_increasing_id()), "y", state, 3, max_task_rows=15).collect()
    key = lambda r: (r.c, r.x, r.id, r.y)
    assert [[round(v, 9) for v in r[-2:]] for r in sorted(whole, key=key)] == [[round(v, 9) for v in r[-2:]] for r in sorted(cut, key=key)]
    draw = {r.id: r.h for r in df.withColumn("id", F.monotonically_increasing_id()).select("id", F.xxhash64(F.lit(42), "c", "x", "id").alias("h")).collect()}
    seen: dict = {}
    prior = [np.mean([r[2] == k for r in rows]) for k in (1, 2)]
    for r in sorted(whole, key=lambda r: draw[r.id]):
        n, totals = seen.get(r.c, (0, [0, 0]))
        assert [r["_stat_c_0"], r["_stat_c_1"]] == pytest.approx([(t + p) / (n + 1) for t, p in zip(totals, prior)])
        seen[r.c] = (n + 1, [totals[0] + (r.y == 1), totals[1] + (r.y == 2)])


def test_native_categories_of_any_number_of_levels(spark):
    """One rule from three levels to 100,000; a category that says nothing about the label leaks nothing."""
    df = spark.range(100_000).select(
        F.concat(F.lit("u"), "id").alias("unique_id"), F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("id") % 3 + 1).cast("int")).alias("kind"),
        (F.when(F.rand(3) < 0.9, F.col("id") % 3).otherwise(F.floor(F.rand(5) * 3))).cast("int").alias("y"))
    df = written_table(df, "levels")
    trained = models.train_model(df, "y", "catboost_trainer", {"iterations": 3, "depth": 2})
    assert trained.importances["kind"] > 0.9 and trained.importances["unique_id"] < 0.1
    stats = trained.pipeline.stages[1].getOrDefault("state")
    assert stats["columns"]["unique_id"]["rows"] == 100_000 and len(stats["prior"]) == 2
    new = score.score_batch(spark.createDataFrame([("new", "b")], "unique_id string, kind string"), trained).first()
    assert new.Predicted_Class == "1"


def test_saved_model_carries_its_tables(spark):
    """Maps of thousands of levels live in scratch folders: the saved model must not need them."""
    df = spark.range(12_000).select(F.concat(F.lit("k"), F.col("id") % 6000).alias("c"), (F.col("id") % 7).cast("double").alias("x"),
                                    (F.col("id") % 2).cast("double").alias("y"))
    encoder = stages.Encoder(config={"method": "label"}).fit(df.select("c"))
    trained = models.train_model(df, "y", "catboost_trainer", {"task_type": "regression", "iterations": 2, "depth": 2})
    scratch = [encoder.getOrDefault("state")["steps"]["c"], trained.pipeline.stages[1].getOrDefault("state")["columns"]["c"]]
    new = df.limit(50)
    want = [encoder.transform(new.select("c")).collect(), score.score_batch(new, trained).collect()]
    prep, model = shared_folder(spark, "saved"), shared_folder(spark, "saved")
    PipelineModel([encoder]).write().save(prep)
    trained.save(model)
    again = models.TrainedModel.load(model)
    loaded = [PipelineModel.load(prep).stages[0].getOrDefault("state")["steps"]["c"], again.pipeline.stages[1].getOrDefault("state")["columns"]["c"]]
    for was, now, folder in zip(scratch, loaded, (prep, model)):
        assert not was["table"].startswith(folder) and now["table"].startswith(folder)
    assert again.importances == trained.importances
    assert [PipelineModel.load(prep).transform(new.select("c")).collect(), score.score_batch(new, again).collect()] == want


@pytest.mark.parametrize("n", [90, 3000])
def test_forest_does_not_depend_on_partitions(spark, n):
    rows = [(f"u{i % 70}", "ab"[i % 2], float(i % 101) if i % 9 else None) for i in range(n)] + [("hot", "a", 1.0)] * n
    df = spark.createDataFrame(rows, "many string, few string, x double")
    fits = [isolation.fit_isolation_forest(df.repartition(p), n_estimators=10, sample_size=64) for p in (2, 7)]
    assert fits[0]["forest"] == fits[1]["forest"] and fits[0]["offset"] == fits[1]["offset"]
    assert fits[0]["sample_size"] == 64 and fits[0]["inputs"]["hashed"] == ["many"]
    other = isolation.fit_isolation_forest(df, n_estimators=10, sample_size=64, random_state=1)
    assert other["forest"] != fits[0]["forest"]


def test_copies_are_drawn_in_proportion():
    key, n = np.arange(200, dtype=np.int64) * 7919, np.r_[np.ones(199, dtype=np.int64), 1801]
    row, tree, draw = isolation._drawn(key, n, 300, 42, 0.1)
    assert len(row) == pytest.approx(300 * 200, rel=0.05) and (row == 199).mean() == pytest.approx(0.9, abs=0.02)
    assert draw.min() > 0 and draw.max() < 0.1 and np.bincount(tree, minlength=300).min() > 120


def test_training_rows_are_spread_by_their_number(spark):
    """One split with many rows is dealt over tasks; few rows stay as they are."""
    df = spark.range(0, 1000, numPartitions=1)
    dealt = models.spread_rows(df, 1000, max_task_rows=20)
    assert dealt.rdd.getNumPartitions() >= 50 and max(dealt.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()) <= 21
    assert sorted(r.id for r in dealt.collect()) == list(range(1000))
    assert models.spread_rows(df, 1000).rdd.getNumPartitions() == 1
