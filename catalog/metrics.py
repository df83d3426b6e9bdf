"""Evaluation metrics and reports on scores."""

from pyspark.sql import functions as F

from tabloom.functions.numeric import risk_band, sigmoid_risk, verdict
from tabloom.operators import evaluate, forecast, guard

from .base import DAILY_REVENUE, PREDICTED_LANG, SCORED_DOCS, daily_revenue, predicted_lang, query, scored_docs, table

_GRID = f"""(SELECT a.c AS label, b.c AS prediction FROM (SELECT label AS c FROM {PREDICTED_LANG} UNION SELECT prediction FROM {PREDICTED_LANG}) a
    CROSS JOIN (SELECT label AS c FROM {PREDICTED_LANG} UNION SELECT prediction FROM {PREDICTED_LANG}) b)"""


@query("confusion", f"""SELECT g.label, g.prediction, count(p.doc_id) AS n FROM {_GRID} g LEFT JOIN {PREDICTED_LANG} p
    ON p.label = g.label AND p.prediction = g.prediction GROUP BY 1, 2""")
def confusion(spark, sf):
    return evaluate.confusion(predicted_lang(spark, sf))


_CLASSES = f"""k AS (SELECT label AS class FROM {PREDICTED_LANG} UNION SELECT prediction FROM {PREDICTED_LANG}),
    s AS (SELECT class, (SELECT count(*) FROM {PREDICTED_LANG} WHERE label = class AND prediction = class)::DOUBLE AS tp,
      (SELECT count(*) FROM {PREDICTED_LANG} WHERE label = class) AS support,
      (SELECT count(*) FROM {PREDICTED_LANG} WHERE prediction = class) AS predicted FROM k),
    m AS (SELECT class, tp, support, coalesce(tp / nullif(predicted, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall,
      coalesce(2 * tp / nullif(support + predicted, 0), 0) AS f1 FROM s)"""


def _metrics(average):
    weight = {"weighted": "support", "macro": "1", "micro": None}[average]
    shares = {m: f"sum({m} * {weight}) / sum({weight})" if weight else "sum(tp) / sum(support)"
              for m in ("precision", "recall", "f1")}
    return f"""WITH {_CLASSES} SELECT round_even(sum(tp) / sum(support), 4) AS accuracy,
      round_even(avg(recall) FILTER (WHERE support > 0), 4) AS balanced_accuracy, round_even({shares['precision']}, 4) AS precision,
      round_even({shares['recall']}, 4) AS recall, round_even({shares['f1']}, 4) AS f1_score FROM m"""


def _register_metrics(average):
    @query(f"class_metrics_{average}", _metrics(average))
    def run(spark, sf):
        return evaluate.classification_metrics(predicted_lang(spark, sf), average=average)


for _average in evaluate.AVERAGES:
    _register_metrics(_average)


@query("class_report", f"""WITH {_CLASSES}, r AS (
    SELECT class, precision, recall, f1, support FROM m
    UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM m
    UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
      sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM m)
    SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM r""")
def class_report(spark, sf):
    report = evaluate.classification_report(predicted_lang(spark, sf))
    return report.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


_AUC = """(sum(CASE WHEN hit THEN r END) - sum(hit::INT) * (sum(hit::INT) + 1) / 2.0::DOUBLE)
    / (sum(hit::INT)::DOUBLE * sum((NOT hit)::INT))"""


@query("roc_auc", f"""SELECT round_even({_AUC}, 4) AS roc_auc FROM (SELECT label = 1 AS hit,
    rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS r FROM {SCORED_DOCS})""")
def roc_auc(spark, sf):
    return evaluate.roc_auc(scored_docs(spark, sf), F.col("label") == 1, F.col("p"), max_task_rows=50)


_LANGS = ("de", "en", "es", "fr")


@query("roc_auc_ovr", f"""WITH p AS ({' UNION ALL '.join(
    f"SELECT '{c}' AS class, lang = '{c}' AS hit, (doc_id * {i + 3} + n_chars * 7) % 997 / 997.0::DOUBLE AS p FROM documents"
    for i, c in enumerate(_LANGS))}),
    a AS (SELECT class, {_AUC} AS auc, sum(hit::INT) AS n FROM (SELECT class, hit,
      rank() OVER (PARTITION BY class ORDER BY p) + (count(*) OVER (PARTITION BY class, p) - 1) / 2.0::DOUBLE AS r FROM p) GROUP BY class)
    SELECT round_even(sum(auc * n) / sum(n), 4) AS roc_auc_ovr FROM a""")
def roc_auc_ovr(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("label"), "n_chars")
    scores = {c: (F.col("doc_id") * (i + 3) + F.col("n_chars") * 7) % 997 / F.lit(997.0) for i, c in enumerate(_LANGS)}
    return evaluate.roc_auc_one_vs_rest(d, "label", scores)


@query("log_loss", f"""SELECT round_even(avg(-ln(least(greatest(CASE WHEN label = 1 THEN p ELSE 1 - p END,
    2.220446049250313e-16::DOUBLE), 1 - 2.220446049250313e-16::DOUBLE))), 4) AS log_loss FROM {SCORED_DOCS}""")
def log_loss(spark, sf):
    return evaluate.log_loss(scored_docs(spark, sf), F.when(F.col("label") == 1, F.col("p")).otherwise(1 - F.col("p")))


@query("threshold_cost", f"""SELECT fp AS false_positive_count, fn AS false_negative_count,
    round_even(fp * 12.5::DOUBLE + fn * 40.0::DOUBLE, 2) AS total_estimated_business_loss FROM (SELECT
    count(*) FILTER (WHERE label = 0 AND p >= 0.35) AS fp, count(*) FILTER (WHERE label = 1 AND p < 0.35) AS fn FROM {SCORED_DOCS})""")
def threshold_cost(spark, sf):
    predicted = evaluate.apply_threshold(scored_docs(spark, sf), F.col("p"), 0.35)
    return evaluate.business_cost(predicted, cost_false_positive=12.5, cost_false_negative=40.0)


_GUESS = "(SELECT l_extendedprice AS y, l_quantity * 1500.0::DOUBLE AS p FROM lineitem)"


@query("regression_metrics", f"""SELECT round_even(avg(abs(y - p)), 4) AS mae, round_even(avg((y - p) ** 2), 4) AS mse,
    round_even(sqrt(round_even(avg((y - p) ** 2), 4)), 4) AS rmse,
    round_even(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 4) AS r2_score,
    round_even(avg(abs(y - p) / greatest(abs(y), 2.220446049250313e-16)), 4) AS mape FROM {_GUESS}""")
def regression_metrics(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 1500.0).alias("prediction"))
    return evaluate.regression_metrics(lines)


@query("forecast_metrics", """WITH t AS (SELECT event_type, value AS y, CASE WHEN event_id % 50 = 0 THEN 0.0 ELSE value END AS a,
      value * 0.9 + 3.0 AS f FROM events)
    SELECT event_type, round_even(avg(abs(a - f)), 4) AS mae, round_even(sqrt(avg((a - f) ** 2)), 4) AS rmse,
      round_even(coalesce(avg(CASE WHEN a <> 0 THEN abs(a - f) / abs(a) END) * 100, 0), 2) AS mape FROM t GROUP BY event_type""")
def forecast_metrics(spark, sf):
    e = table(spark, sf, "events").select(
        "event_type", F.when(F.col("event_id") % 50 == 0, 0.0).otherwise(F.col("value")).alias("a"),
        (F.col("value") * 0.9 + 3.0).alias("f"))
    return evaluate.forecast_metrics(e, "a", "f", ("event_type",))


@query("forecast_trend", f"""WITH s AS (SELECT CAST(year(day) AS INTEGER) AS yr, arg_min(revenue, day) AS a, arg_max(revenue, day) AS b FROM {DAILY_REVENUE} GROUP BY 1)
    SELECT yr, a AS start_value, b AS projected_end_value, CASE WHEN b >= a THEN 'Upward' ELSE 'Downward' END AS trend,
      round_even((b - a) / (a + 1e-9::DOUBLE) * 100.0::DOUBLE, 2) AS projected_change_pct FROM s""")
def forecast_trend(spark, sf):
    d = daily_revenue(spark, sf).withColumn("yr", F.year("day"))
    return forecast.forecast_trend(d, "revenue", "day", ["yr"])


@query("prediction_sample", f"SELECT * FROM {SCORED_DOCS} ORDER BY doc_id LIMIT 15")
def prediction_sample(spark, sf):
    return evaluate.prediction_sample(scored_docs(spark, sf), ["doc_id"])


_SCORED = """(SELECT event_id, round(least(value / 250.0::DOUBLE, 1.0::DOUBLE), 4) AS anomaly_score,
    CAST(value > 150 AS INTEGER) AS is_anomaly FROM events)"""


def _scored_events(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select(
        "event_id", F.round(F.least(v / 250.0, F.lit(1.0)), 4).alias("anomaly_score"), (v > 150).cast("int").alias("is_anomaly"))


@query("score_histogram", f"""SELECT least(CAST(floor(anomaly_score * 30) AS BIGINT) + 1, 30) AS bin, is_anomaly, count(*) AS n
    FROM {_SCORED} GROUP BY 1, 2""")
def score_histogram(spark, sf):
    return evaluate.score_histogram(_scored_events(spark, sf), "anomaly_score", "is_anomaly")


@query("top_anomalies", f"SELECT * FROM {_SCORED} ORDER BY anomaly_score DESC, event_id LIMIT 10")
def top_anomalies(spark, sf):
    return guard.top_anomalies(_scored_events(spark, sf), key="event_id")


@query("risk_bands", """WITH s AS (SELECT event_id, (100.0::DOUBLE - value) / 100.0::DOUBLE AS d FROM events),
    r AS (SELECT event_id, CAST(d < 0 AS INTEGER) AS is_anomaly, round_even(1.0::DOUBLE / (1.0::DOUBLE + exp(d * 4.0::DOUBLE)), 4) AS anomaly_score FROM s)
    SELECT *, CASE WHEN is_anomaly = 1 THEN 'ANOMALOUS_OUTLIER' ELSE 'NORMAL_RECORD' END AS verdict,
      CASE WHEN anomaly_score > 0.8 THEN 'CRITICAL' WHEN anomaly_score > 0.6 THEN 'HIGH' WHEN anomaly_score > 0.4 THEN 'MEDIUM'
      ELSE 'LOW' END AS risk_level FROM r""")
def risk_bands(spark, sf):
    decision = (F.lit(100.0) - F.col("value")) / 100.0
    e = table(spark, sf, "events").select(
        "event_id", (decision < 0).cast("int").alias("is_anomaly"), sigmoid_risk(decision).alias("anomaly_score"))
    return e.withColumns({"verdict": verdict(F.col("is_anomaly")), "risk_level": risk_band(F.col("anomaly_score"))})
