"""Models, scoring, forecasts and whole pipelines. Not expressible as plain SQL: checked by
invariants in the tests."""

from pyspark.sql import functions as F

from tabloom.operators import evaluate, forecast, isolation, models, score, split
from tabloom.plans import blueprints
from tabloom.session import shared_folder
from tabloom.streaming import jobs

from .base import daily_events, daily_revenue, events_nulls, query, table, text_table


def doc_features(spark, sf):
    d, lab = table(spark, sf, "documents"), table(spark, sf, "labels")
    text = F.col("text")
    return d.join(lab, "doc_id").select(
        "doc_id", "lang", "source", "n_chars", F.size(F.split(text, " ")).alias("n_words"),
        (F.length(F.regexp_replace(text, "[^a-z]", "")) / F.length(text)).alias("letters"), "quality",
    )


def _embeddings(spark, sf):
    e = table(spark, sf, "embeddings")
    width = e.agg(F.max(F.size("embedding"))).first()[0]
    return e.select("vec_id", *[F.col("embedding")[i].alias(f"e{i}") for i in range(width)], "label")


def _parts(df, keys, target):
    train, test = split.parts(split.train_test_split(df, keys, stratify_by=target))
    return train.drop(*keys), test


def _class_scores(spark, sf, algorithm, **config):
    train, test = _parts(doc_features(spark, sf), ["doc_id"], "quality")
    trained = models.train_model(train, "quality", algorithm, config)
    return score.score_batch(test, trained)


def _price_scores(spark, sf, algorithm, **config):
    p = table(spark, sf, "part")
    train, test = split.parts(split.train_test_split(p, ["p_partkey"]))
    trained = models.train_model(train.drop("p_partkey"), "p_retailprice", algorithm, {"task_type": "regression", **config})
    return score.score_batch(test, trained)


@query("rf_cls")
def rf_cls(spark, sf):
    return _class_scores(spark, sf, "random_forest_trainer", n_estimators=30, max_depth=6, class_weight="balanced")


@query("rf_reg")
def rf_reg(spark, sf):
    return _price_scores(spark, sf, "random_forest_trainer", n_estimators=20, max_depth=6)


@query("gbt_cls")
def gbt_cls(spark, sf):
    return _class_scores(spark, sf, "xgboost_trainer", n_estimators=15, max_depth=4, scale_pos_weight=2.0)


@query("gbt_reg")
def gbt_reg(spark, sf):
    return _price_scores(spark, sf, "lightgbm_trainer", n_estimators=15, num_leaves=15)


@query("cat_gbt")
def cat_gbt(spark, sf):
    return _class_scores(spark, sf, "catboost_trainer", iterations=15, depth=4)


@query("gbt_multiclass")
def gbt_multiclass(spark, sf):
    wide = _embeddings(spark, sf).withColumn("label", F.concat(F.lit("c"), F.col("label") % 3))
    train, test = _parts(wide, ["vec_id"], "label")
    return score.score_batch(test, models.train_model(train, "label", "xgboost_trainer", {"n_estimators": 5, "max_depth": 3}))


@query("logreg")
def logreg(spark, sf):
    train, test = _parts(_embeddings(spark, sf), ["vec_id"], "label")
    return score.score_batch(test, models.train_model(train, "label", "linear_trainer", {"max_iter": 100}))


@query("ridge")
def ridge(spark, sf):
    return _price_scores(spark, sf, "linear_trainer", C=0.5)


@query("feature_importances")
def feature_importances(spark, sf):
    train, _ = _parts(doc_features(spark, sf), ["doc_id"], "quality")
    trained = models.train_model(train, "quality", "random_forest_trainer", {"n_estimators": 20, "max_depth": 5})
    return models.importance_table(spark, trained)


@query("iforest")
def iforest(spark, sf):
    e = events_nulls(spark, sf).drop("ts")
    fitted = isolation.fit_isolation_forest(e, ["event_type", "value"], 0.05, 50)
    return isolation.flag_anomalies(e, fitted)


@query("iforest_new_rows")
def iforest_new_rows(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts", "event_type", "value")
    fitted = isolation.fit_isolation_forest(e.filter("ts < timestamp_ntz'2024-01-20'"), ["event_type", "value"], 0.05, 50)
    return isolation.score_new_rows(e, fitted)


@query("batch_score_map")
def batch_score_map(spark, sf):
    train, test = _parts(doc_features(spark, sf), ["doc_id"], "quality")
    trained = models.train_model(train, "quality", "linear_trainer", {})
    scored = score.probability_map(trained.predict(test), ["0", "1"])
    return scored.select("doc_id", F.explode("probabilities").alias("class", "probability"))


@query("text_classifier")
def text_classifier(spark, sf):
    d = text_table(spark, sf, "documents", "doc_id", "text", "lang")
    train, test = _parts(d, ["doc_id"], "lang")
    model, target = score.train_text_classifier(train, "text", "lang", 100, max_iter=30)
    return score.classify_text(test.select("doc_id", "text"), model, target["classes"]).select("doc_id", "prediction", "confidence")


@query("stream_score")
def stream_score(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    trained = models.train_model(e.drop("event_id"), "event_type", "random_forest_trainer", {"n_estimators": 5, "max_depth": 4})
    stream = jobs.read_events(spark, sf, table(spark, sf, "events").schema, "parquet", "events.parquet")
    scored = jobs.scored_events(stream.select("event_id", "user_id", "value"), trained)
    return jobs.run_available(scored, shared_folder(spark, "sink"), shared_folder(spark, "state"))


@query("forecast_additive")
def forecast_additive(spark, sf):
    return forecast.additive_forecast(daily_revenue(spark, sf), "day", "revenue", 30)


@query("forecast_many_series")
def forecast_many_series(spark, sf):
    return forecast.additive_forecast(daily_events(spark, sf), "day", "total", 7, "D", "multiplicative", ["event_type"])


@query("forecast_replay")
def forecast_replay(spark, sf):
    # Coefficients are a table: stored, read back and applied to later dates.
    series = forecast.prepare_series(daily_events(spark, sf), "day", "total", ["event_type"])
    path = shared_folder(spark, "fit")
    forecast.fit_additive(series, ["event_type"]).write.parquet(path)
    fit = spark.read.parquet(path)
    dates = forecast.spine_after(fit, 30, "D", ["event_type"])
    return forecast.forecast_table(forecast.predict_additive(dates, fit, ["event_type"]), ["event_type"])


@query("arima")
def arima(spark, sf):
    return forecast.arima_forecast(daily_revenue(spark, sf), "day", "revenue", 2, 1, 1, 14)


@query("arima_many_series")
def arima_many_series(spark, sf):
    return forecast.arima_forecast(daily_events(spark, sf), "day", "total", 1, 1, 0, 7, keys=["event_type"])


@query("supervised_blueprint")
def supervised_blueprint(spark, sf):
    _, predicted = blueprints.supervised(doc_features(spark, sf), "quality", ["doc_id"], config={"n_estimators": 10, "max_depth": 4})
    return evaluate.classification_metrics(predicted)


@query("forecast_blueprint")
def forecast_blueprint(spark, sf):
    d = daily_revenue(spark, sf)
    return blueprints.forecasting(d.withColumn("revenue", F.when(F.dayofmonth("day") != 13, F.col("revenue"))), "day", "revenue")


@query("anomaly_blueprint")
def anomaly_blueprint(spark, sf):
    return isolation.anomaly_summary(blueprints.anomaly(events_nulls(spark, sf), ["value"], n_estimators=30))


@query("governed_blueprint")
def governed_blueprint(spark, sf):
    _, metrics = blueprints.governed(doc_features(spark, sf), "quality", ["doc_id"], shared_folder(spark, "runs"),
                                     {"iterations": 10, "depth": 3})
    return metrics
