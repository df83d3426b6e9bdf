"""Supervised models on Spark ML, configured by the usual option names.

A trained model is one `PipelineModel`: preparation fitted on the training rows,
assembly, learner. Options without a counterpart in Spark ML are kept in
`TrainedModel.ignored`, never dropped silently.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder, written_table
from . import features as feature_prep
from .split import apply_target, fit_target, with_class_weight
from .stages import FeatureModel, NativeCategoryModel, TargetStatsModel, load_state, save_state
from .target_stats import fit_target_stats, stat_names, training_stats

FEATURES, WEIGHT = "_features", "_weight"
DEEPEST = 30  # fixed value: the deepest tree of Spark ML
NATIVE_BINS = 254  # split candidates of a column of the trees with native categories
MAX_TASK_ROWS = 100_000  # training rows that one task holds and reads again in every pass


@dataclass
class TrainedModel:
    pipeline: PipelineModel
    task: str
    label: str
    target: dict
    feature_names: list[str]
    importances: dict[str, float] = field(default_factory=dict)
    ignored: dict[str, object] = field(default_factory=dict)

    @property
    def classes(self) -> list[str] | None:
        return self.target.get("classes")

    def save(self, path: str) -> None:
        """The whole model below `path`: stages, learned tables, and how the target becomes a number."""
        self.pipeline.write().save(f"{path}/pipeline")
        plain = {k: getattr(self, k) for k in ("task", "label", "target", "feature_names", "importances", "ignored")}
        save_state(SparkSession.active(), plain, f"{path}/model")

    @classmethod
    def load(cls, path: str) -> TrainedModel:
        return cls(PipelineModel.load(f"{path}/pipeline"), **load_state(SparkSession.active(), f"{path}/model"))

    def predict(self, df: DataFrame) -> DataFrame:
        """`df` with prediction columns added; every original column is kept."""
        return self.pipeline.transform(df)

    def label_rows(self, df: DataFrame) -> DataFrame:
        """The target as the model sees it; a class unseen in training counts as class 0."""
        out = apply_target(df, self.target)
        if self.target.get("encoder"):
            out = out.withColumn(self.label, F.greatest(F.col(f"`{self.label}`"), F.lit(0)))
        return out


def _deeper(depth: int) -> dict:
    """A wanted depth beyond the one Spark ML allows, to be listed as ignored."""
    return {"max_depth": depth} if depth > DEEPEST else {}


def _forest(task: str, c: dict, **_):
    common = dict(
        featuresCol=FEATURES, labelCol=c["label"], numTrees=int(c.get("n_estimators", 100)),
        maxDepth=min(DEEPEST, int(c.get("max_depth", 10))), minInstancesPerNode=int(c.get("min_samples_leaf", 1)),
        featureSubsetStrategy=c.get("max_features", "sqrt"), seed=int(c.get("random_state", 42)),
    )
    ignored = {"min_samples_split": c["min_samples_split"]} if int(c.get("min_samples_split", 2)) != 2 else {}
    ignored |= _deeper(int(c.get("max_depth", 10)))
    return (RandomForestClassifier if task == "classification" else RandomForestRegressor)(**common), ignored


def _boosted(task: str, c: dict, classes: int, iterations: int, depth: int, **extra):
    common = dict(
        featuresCol=FEATURES, labelCol=c["label"], maxIter=iterations, maxDepth=min(DEEPEST, depth),
        stepSize=float(c.get("learning_rate", 0.1)), subsamplingRate=float(c.get("subsample", 1.0)),
        seed=int(c.get("random_state", c.get("random_seed", 42))), **extra,
    )
    columns = float(c.get("colsample_bytree", 1.0))
    if columns < 1.0:
        common["featureSubsetStrategy"] = str(columns)
    if task != "classification":
        return GBTRegressor(**common)
    binary = GBTClassifier(**common)
    # The boosted trees of Spark ML know two classes; more are one model per class.
    return binary if classes <= 2 else OneVsRest(
        classifier=binary, featuresCol=FEATURES, labelCol=c["label"], rawPredictionCol="rawPrediction"
    )


def _xgboost(task: str, c: dict, classes: int, rows: int):
    model = _boosted(task, c, classes, int(c.get("n_estimators", 100)), int(c.get("max_depth", 6)),
                     minWeightFractionPerNode=min(0.49, float(c.get("min_child_weight", 1.0)) / max(rows, 1)))
    ignored = {k: c[k] for k in ("reg_alpha", "reg_lambda") if k in c} | _deeper(int(c.get("max_depth", 6)))
    if float(c.get("min_child_weight", 1.0)) > 0.49 * max(rows, 1):
        ignored["min_child_weight"] = c.get("min_child_weight", 1.0)
    return model, ignored


def _lightgbm(task: str, c: dict, classes: int, rows: int):
    leaves = max(2, int(c.get("num_leaves", 31)))
    depth = int(c.get("max_depth", -1))
    depth = math.ceil(math.log2(leaves)) if depth <= 0 else depth
    model = _boosted(task, c, classes, int(c.get("n_estimators", 100)), depth,
                     minInstancesPerNode=int(c.get("min_child_samples", 20)))
    return model, {k: c[k] for k in ("reg_alpha", "reg_lambda", "num_leaves") if k in c} | _deeper(depth)


def _linear(task: str, c: dict, classes: int, rows: int, label_spread: float = 1.0):
    strength = float(c.get("C", 1.0))
    if task != "classification":
        # Spark scales the penalty by the spread of the label and averages the loss.
        alpha = 1.0 / max(strength, 1e-5)
        return LinearRegression(
            featuresCol=FEATURES, labelCol=c["label"], regParam=alpha * label_spread / max(rows, 1),
            elasticNetParam=0.0, standardization=False, solver="normal",
        ), {}
    penalty = c.get("penalty", "l2")
    return LogisticRegression(
        featuresCol=FEATURES, labelCol=c["label"], maxIter=int(c.get("max_iter", 200)),
        regParam=0.0 if penalty in ("none", None) else 1.0 / (max(rows, 1) * strength),
        elasticNetParam=1.0 if penalty == "l1" else 0.0, standardization=False,
    ), ({"solver": c["solver"]} if c.get("solver", "auto") != "auto" else {})


ALGORITHMS = ("random_forest_trainer", "xgboost_trainer", "lightgbm_trainer", "catboost_trainer", "linear_trainer")


def _importances(model, names: list[str]) -> dict[str, float]:
    if hasattr(model, "models"):
        parts = [_importances(m, names) for m in model.models]
        return {n: round(sum(p[n] for p in parts) / len(parts), 4) for n in names}
    if hasattr(model, "featureImportances"):
        values = model.featureImportances.toArray()
    elif hasattr(model, "coefficientMatrix"):
        values = abs(model.coefficientMatrix.toArray()[0])
    else:
        values = abs(model.coefficients.toArray())
    return {n: round(float(v), 4) for n, v in zip(names, values)}


def without_summary(pipeline: PipelineModel, spark) -> PipelineModel:
    """The pipeline with a learner that is free of its training summary.

    The summary of a two-class learner refers to the session, and goes with the model
    into every scoring task; a session with observed metrics cannot be sent. The
    stored form of the learner has no summary.
    """
    learner = pipeline.stages[-1]
    if not getattr(learner, "hasSummary", False):
        return pipeline
    path = shared_folder(spark, "learner")
    learner.write().save(path)
    return PipelineModel([*pipeline.stages[:-1], type(learner).load(path)])


def spread_rows(df: DataFrame, rows: int, max_task_rows: int = MAX_TASK_ROWS) -> DataFrame:
    """`df`, dealt over more tasks if its `rows` are too many for one.

    A small file comes in few splits however many rows it holds, and learners keep the splits.
    """
    if rows <= max_task_rows:
        return df
    return df.repartition(max(math.ceil(rows / max_task_rows), df.sparkSession.sparkContext.defaultParallelism))


def _native_rows(train: DataFrame, label: str, classes: int, seed: int) -> tuple[list, list[str], list[str], DataFrame]:
    """Stages, inputs, the feature each input stands for, and the written training rows: categories as ordered target statistics."""
    state = feature_prep.fit_native_categories(train, [label])
    prepared = NativeCategoryModel(state=state)
    filled = prepared.transform(train)
    stats = fit_target_stats(filled, label, state["categories"], classes)
    rows = written_table(training_stats(filled, label, stats, classes, seed), "training")
    inputs = [(n, n) for n in state["numeric"]] + [(s, c) for c in state["categories"] for s in stat_names(c, stats)]
    return [prepared, TargetStatsModel(state=stats)], [i for i, _ in inputs], [f for _, f in inputs], rows


def train_model(train: DataFrame, label: str, algorithm: str, config: dict | None = None) -> TrainedModel:
    """Fit preparation and learner on the training rows."""
    if algorithm not in ALGORITHMS:
        raise ValueError(f"unknown trainer: {algorithm}")
    c = {**(config or {}), "label": label}
    task = "classification" if str(c.get("task_type", "classification")).lower() == "classification" else "regression"
    target = fit_target(train, label) if task == "classification" else {
        "target": label, "encoder": None, "classes": None, "to_int": False}
    rows = apply_target(train, target).filter(F.col(f"`{label}`").isNotNull())
    if task == "classification" and target["classes"] is None:
        rows = rows.withColumn(label, F.col(f"`{label}`").cast("int"))
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.max(label).alias("top"),
                    F.stddev_pop(F.col(f"`{label}`").cast("double")).alias("spread")).first()
    classes = int(seen["top"]) + 1 if task == "classification" and seen["top"] is not None else 0

    fitted_stages: list = []
    if algorithm == "catboost_trainer":
        seed = int(c.get("random_state", c.get("random_seed", 42)))
        fitted_stages, names, readable, rows = _native_rows(rows, label, classes, seed)
        stages: list = []
    else:
        state = feature_prep.fit_features(rows, [label])
        # A missing number has no path in Spark's trees: it is read as 0.
        stages, names = [FeatureModel(state={**state, "fill": 0.0})], state["columns"]
        readable = names
    stages.append(VectorAssembler(inputCols=names, outputCol=FEATURES, handleInvalid="error"))

    if algorithm == "random_forest_trainer":
        learner, ignored = _forest(task, c)
    elif algorithm == "xgboost_trainer":
        learner, ignored = _xgboost(task, c, classes, seen["n"])
    elif algorithm == "lightgbm_trainer":
        learner, ignored = _lightgbm(task, c, classes, seen["n"])
    elif algorithm == "catboost_trainer":
        learner = _boosted(task, c, classes, int(c.get("iterations", 100)), int(c.get("depth", 6)),
                           maxBins=NATIVE_BINS)
        ignored = {}
    else:
        learner, ignored = _linear(task, c, classes, seen["n"], seen["spread"] or 1.0)

    if task == "classification":
        if c.get("class_weight") == "balanced":
            rows = with_class_weight(rows, label, WEIGHT)
            learner.setWeightCol(WEIGHT)
        elif classes == 2 and float(c.get("scale_pos_weight", 1.0)) != 1.0:
            rows = rows.withColumn(WEIGHT, F.when(F.col(f"`{label}`") == 1, float(c["scale_pos_weight"])).otherwise(1.0))
            learner.setWeightCol(WEIGHT)
    fitted = without_summary(Pipeline(stages=[*stages, learner]).fit(spread_rows(rows, seen["n"])), train.sparkSession)
    importances: dict[str, float] = {}
    for value, feature in zip(_importances(fitted.stages[-1], names).values(), readable):
        importances[feature] = round(importances.get(feature, 0.0) + value, 4)
    fitted = PipelineModel([*fitted_stages, *fitted.stages])
    return TrainedModel(fitted, task, label, target, list(importances), importances, ignored)


def importance_table(spark, trained: TrainedModel) -> DataFrame:
    """`(feature, importance)`, the largest first."""
    rows = sorted(trained.importances.items(), key=lambda kv: (-kv[1], kv[0]))
    return spark.createDataFrame(rows, "feature string, importance double")
