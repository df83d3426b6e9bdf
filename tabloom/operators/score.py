"""Scoring of batches and streams with a trained model."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .models import TrainedModel, without_summary
from .split import apply_target, class_name, fit_target
from .stages import Vectorizer


def probabilities(predicted: DataFrame) -> Column:
    """Array of class probabilities.

    One-versus-rest models only give a margin per class: those are squashed and
    scaled to sum to one.
    """
    if "probability" in predicted.columns:
        return vector_to_array("probability")
    margins = F.transform(vector_to_array("rawPrediction"), lambda m: 1.0 / (1.0 + F.exp(-2.0 * m)))
    total = F.aggregate(margins, F.lit(0.0), lambda a, b: a + b)
    return F.transform(margins, lambda m: m / total)


def _decode(prediction: Column, classes: list[str] | None) -> Column:
    if not classes:
        return prediction.cast("int").cast("string")
    return F.get(F.array(*[F.lit(c) for c in classes]), prediction.cast("int"))


def score_batch(df: DataFrame, trained: TrainedModel) -> DataFrame:
    """The rows as they came, with `Predicted_Class` and `Confidence_Pct`, or `Predicted_Value`.

    Works on streams as well: nothing but row-wise expressions.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")
    predicted = trained.predict(df.select("*", row))
    if trained.task != "classification":
        return predicted.select("_row.*", F.bround("prediction", 4).alias("Predicted_Value"))
    named = class_name(predicted, F.col("prediction"), trained.target, "Predicted_Class")
    return named.select(
        "_row.*", "Predicted_Class",
        F.bround(F.array_max(probabilities(predicted)) * 100.0, 2).alias("Confidence_Pct"),
    )


def probability_map(predicted: DataFrame, classes: list[str]) -> DataFrame:
    """Add `probabilities`: class name to probability (4 digits)."""
    names = F.array(*[F.lit(c) for c in classes])
    rounded = F.transform(probabilities(predicted), lambda p: F.bround(p, 4))
    return predicted.withColumn("probabilities", F.map_from_arrays(names, F.slice(rounded, 1, len(classes))))


def train_text_classifier(df: DataFrame, text: str, label: str, max_features: int = 50, method: str = "tfidf",
                          max_iter: int = 200) -> tuple[PipelineModel, dict]:
    """Vectorizer and logistic regression on one raw text column."""
    target = fit_target(df, label)
    rows = apply_target(df, target).withColumn(label, F.col(label).cast("int"))
    n = rows.count()
    stages = [
        Vectorizer(config={"method": method, "column": text, "max_features": max_features, "vector_column": "_features"}),
        LogisticRegression(featuresCol="_features", labelCol=label, maxIter=max_iter, regParam=1.0 / max(n, 1),
                           standardization=False),
    ]
    return without_summary(Pipeline(stages=stages).fit(rows), df.sparkSession), target


def classify_text(df: DataFrame, model: PipelineModel, classes: list[str] | None = None) -> DataFrame:
    """Add prediction, confidence in percent and the probability of every class."""
    predicted = model.transform(df)
    known = classes or [f"Class {i}" for i in range(model.stages[-1].numClasses)]
    scored = probability_map(predicted, known)
    return scored.select(
        *[F.col(f"`{c}`") for c in df.columns],
        _decode(F.col("prediction"), classes).alias("prediction"),
        F.bround(F.array_max(probabilities(scored)) * 100.0, 2).alias("confidence"),
        "probabilities",
    )
