"""Metrics as aggregates over a table of labels, predictions and probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import MAX_TASK_ROWS, running_sums

AVERAGES = ("weighted", "macro", "micro")
EPSILON = 2.220446049250313e-16  # fixed value: smallest probability and smallest MAPE denominator


def _counts(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """`(label, prediction, n)` for every pair of classes seen on either side.

    The grid is built from the one-row list of classes, so only counts are shuffled.
    """
    counts = _counts(df, label, prediction)
    classes = counts.select(F.explode(F.array("label", "prediction")).alias("c")).agg(
        F.array_sort(F.collect_set("c")).alias("cs")
    )
    grid = classes.select(F.explode("cs").alias("label"), "cs").select(
        "label", F.explode("cs").alias("prediction"), F.lit(0).cast("long").alias("n")
    )
    return grid.unionByName(counts).groupBy("label", "prediction").agg(F.sum("n").alias("n"))


def _div(a: Column, b: Column) -> Column:
    return F.coalesce(a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))


def per_class(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """`(class, tp, support, predicted, precision, recall, f1)`, unrounded."""
    sides = _counts(df, label, prediction).select(F.explode(F.array(
        F.struct(F.col("label").alias("class"), F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("tp"),
                 F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted")),
        F.struct(F.col("prediction").alias("class"), F.lit(0).cast("long").alias("tp"),
                 F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted")),
    )).alias("s"))
    sums = sides.groupBy("s.class").agg(
        F.sum("s.tp").alias("tp"), F.sum("s.support").alias("support"), F.sum("s.predicted").alias("predicted")
    )
    tp = F.col("tp")
    return sums.withColumns({
        "precision": _div(tp, F.col("predicted")),
        "recall": _div(tp, F.col("support")),
        "f1": _div(2 * tp, F.col("support") + F.col("predicted")),
    })


def _averages(kind: str) -> dict[str, Column]:
    if kind == "micro":
        hit = _div(F.sum("tp"), F.sum("support"))
        return {"precision": hit, "recall": hit, "f1": hit}
    weight = F.col("support") if kind == "weighted" else F.lit(1)
    return {m: _div(F.sum(F.col(m) * weight), F.sum(weight)) for m in ("precision", "recall", "f1")}


def classification_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction",
                           average: str = "weighted") -> DataFrame:
    """One row: accuracy, balanced accuracy, precision, recall and F1 (4 digits)."""
    mean = _averages(average)
    present = F.when(F.col("support") > 0, F.col("recall"))
    return per_class(df, label, prediction).agg(
        F.bround(_div(F.sum("tp"), F.sum("support")), 4).alias("accuracy"),
        F.bround(F.coalesce(F.avg(present), F.lit(0.0)), 4).alias("balanced_accuracy"),
        F.bround(mean["precision"], 4).alias("precision"),
        F.bround(mean["recall"], 4).alias("recall"),
        F.bround(mean["f1"], 4).alias("f1_score"),
    )


def classification_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """`(class, precision, recall, f1, support)` per class, then the macro and weighted averages."""
    classes = per_class(df, label, prediction)
    # Read three times below; the class table itself is a handful of rows.
    lines = classes.select(F.col("class").cast("string").alias("class"), "precision", "recall", "f1", "support")
    for kind in ("macro", "weighted"):
        mean = _averages(kind)
        lines = lines.unionByName(classes.agg(
            F.lit(f"{kind} avg").alias("class"), mean["precision"].alias("precision"),
            mean["recall"].alias("recall"), mean["f1"].alias("f1"), F.sum("support").alias("support"),
        ))
    return lines


def _auc_from_counts(counts: DataFrame, keys: list[str], max_task_rows: int) -> DataFrame:
    """Area under the ROC curve from `(keys, score, pos, neg)`: the share of positive and
    negative pairs in the right order, ties counting half. Ranges of scores, no global sort."""
    ranked = running_sums(counts, {"_below": F.col("neg")}, ["score"], keys, max_task_rows=max_task_rows)
    right = F.sum(F.col("pos") * (F.col("_below") + F.col("neg") / 2.0))
    return ranked.groupBy(*keys).agg(
        (right / F.nullif(F.sum("pos").cast("double") * F.sum("neg"), F.lit(0.0))).alias("roc_auc"),
        F.sum("pos").alias("positives"),
    )


def roc_auc(df: DataFrame, positive: Column, score: Column, max_task_rows: int = MAX_TASK_ROWS) -> DataFrame:
    """One row `roc_auc` (4 digits). Rows are first counted per distinct score."""
    counts = df.groupBy(score.alias("score")).agg(
        F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg")
    )
    return _auc_from_counts(counts, [], max_task_rows).select(F.bround("roc_auc", 4).alias("roc_auc"))


def roc_auc_one_vs_rest(df: DataFrame, label: str, scores: dict[object, Column], average: str = "weighted",
                        max_task_rows: int = MAX_TASK_ROWS) -> DataFrame:
    """One row `roc_auc_ovr`: per class against the rest, averaged by support or plainly."""
    per_row = F.explode(F.array(*[
        F.struct(F.lit(str(c)).alias("class"), s.cast("double").alias("score"),
                 (F.col(label).cast("string") == F.lit(str(c))).alias("hit"))
        for c, s in scores.items()
    ])).alias("p")
    counts = df.select(per_row).groupBy("p.class", "p.score").agg(
        F.count_if("p.hit").alias("pos"), F.count_if(~F.col("p.hit")).alias("neg")
    )
    areas = _auc_from_counts(counts, ["class"], max_task_rows)
    weight = F.col("positives") if average == "weighted" else F.lit(1)
    return areas.agg(F.bround(F.sum(F.col("roc_auc") * weight) / F.sum(weight), 4).alias("roc_auc_ovr"))


def log_loss(df: DataFrame, true_probability: Column) -> DataFrame:
    """One row `log_loss` (4 digits) from the probability given to the true class."""
    p = F.least(F.greatest(true_probability, F.lit(EPSILON)), F.lit(1.0 - EPSILON))
    return df.agg(F.bround(F.avg(-F.ln(p)), 4).alias("log_loss"))


def apply_threshold(df: DataFrame, probability: Column, threshold: float = 0.5, name: str = "prediction") -> DataFrame:
    return df.withColumn(name, (probability >= threshold).cast("int"))


def business_cost(df: DataFrame, label: str = "label", prediction: str = "prediction",
                  cost_false_positive: float = 0.0, cost_false_negative: float = 0.0) -> DataFrame:
    """One row: false positives and negatives of a 0/1 problem and what they cost (2 digits)."""
    y, p = F.col(label), F.col(prediction)
    counted = df.agg(
        F.count_if((y == 0) & (p == 1)).alias("false_positive_count"),
        F.count_if((y == 1) & (p == 0)).alias("false_negative_count"),
    )
    return counted.withColumn("total_estimated_business_loss", F.bround(
        F.col("false_positive_count") * cost_false_positive + F.col("false_negative_count") * cost_false_negative, 2))


def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: mae, mse, rmse (root of the rounded mse), r2_score, mape as a fraction (4 digits)."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    err = y - p
    s = df.agg(
        F.avg(F.abs(err)).alias("mae"),
        F.avg(err * err).alias("mse"),
        F.sum(err * err).alias("sse"),
        (F.var_pop(y) * F.count(y)).alias("sst"),
        F.avg(F.abs(err) / F.greatest(F.abs(y), F.lit(EPSILON))).alias("mape"),
    )
    r2 = F.when(F.col("sst") > 0, 1 - F.col("sse") / F.col("sst")).when(F.col("sse") == 0, 1.0).otherwise(0.0)
    return s.select(
        F.bround("mae", 4).alias("mae"),
        F.bround("mse", 4).alias("mse"),
        F.bround(F.sqrt(F.bround("mse", 4)), 4).alias("rmse"),
        F.bround(r2, 4).alias("r2_score"),
        F.bround("mape", 4).alias("mape"),
    )


def error_columns(actual: str, fitted: str) -> list[Column]:
    """Aggregates mae, rmse (4 digits) and mape in percent over non-zero actuals (2 digits)."""
    y, p = F.col(actual).cast("double"), F.col(fitted).cast("double")
    err = F.abs(y - p)
    mape = F.coalesce(F.avg(F.when(y != 0, err / F.abs(y))) * 100, F.lit(0.0))
    return [F.bround(F.avg(err), 4).alias("mae"), F.bround(F.sqrt(F.avg(err * err)), 4).alias("rmse"),
            F.bround(mape, 2).alias("mape")]


def forecast_metrics(df: DataFrame, actual: str, fitted: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """mae, rmse (4 digits) and mape in percent over non-zero actuals (2 digits), per series."""
    exprs = error_columns(actual, fitted)
    return df.groupBy(*keys).agg(*exprs) if keys else df.agg(*exprs)


def prediction_sample(df: DataFrame, order_by: list[str], limit: int = 15) -> DataFrame:
    return df.orderBy(*order_by).limit(limit)


def score_histogram(df: DataFrame, score: str, flag: str, bins: int = 30, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """`(bin, flag, n)`; a score equal to the upper end belongs to the last bin."""
    at = F.least(F.width_bucket(F.col(score), F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins).cast("long"))
    return df.groupBy(at.alias("bin"), F.col(flag).alias(flag)).agg(F.count(F.lit(1)).alias("n"))
