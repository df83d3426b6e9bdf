"""Cleaning queries: imputation, duplicates, labels, redundant columns, outliers."""

from pyspark.sql import functions as F

from tabloom.functions.numeric import clean_non_finite
from tabloom.functions.text import OUTER_SPACES_PATTERN, PUNCTUATION_PATTERN
from tabloom.operators import dedup, features, guard, impute, redundancy, sanitize

from .base import EVENTS_NULLS, events_nulls, query, table


def _mode(column):
    return f"""(SELECT {column} FROM {EVENTS_NULLS} WHERE {column} IS NOT NULL
        GROUP BY {column} ORDER BY count(*) DESC, {column} LIMIT 1)"""


def _filled(value, kind):
    return f"""SELECT event_id, ts, user_id, coalesce(event_type, {kind}) AS event_type,
        round(coalesce(value, {value}), 6) AS value FROM {EVENTS_NULLS}"""


def _rounded(df):
    return df.withColumn("value", F.round("value", 6))


@query("impute_mean", _filled(f"(SELECT avg(value) FROM {EVENTS_NULLS})", _mode("event_type")))
def impute_mean(spark, sf):
    return _rounded(impute.impute(events_nulls(spark, sf), "mean", ["event_type", "value"]))


@query("impute_median", _filled(f"(SELECT quantile_cont(value, 0.5) FROM {EVENTS_NULLS})", _mode("event_type")))
def impute_median(spark, sf):
    return _rounded(impute.impute(events_nulls(spark, sf), "median", "event_type, value"))


@query("impute_mode", _filled(_mode("value"), _mode("event_type")))
def impute_mode(spark, sf):
    return _rounded(impute.impute(events_nulls(spark, sf), "mode"))


@query("impute_constant", _filled("0", "'0'"))
def impute_constant(spark, sf):
    return _rounded(impute.impute(events_nulls(spark, sf), "constant"))


@query("impute_drop_rows", f"SELECT * FROM {EVENTS_NULLS} WHERE value IS NOT NULL AND event_type IS NOT NULL")
def impute_drop_rows(spark, sf):
    return impute.impute(events_nulls(spark, sf), "drop_rows")


def _series_fill(function, frame, partition):
    w = f"OVER ({partition} ORDER BY ts, event_id ROWS BETWEEN {frame})"
    return f"""SELECT event_id, ts, user_id, {function}(event_type IGNORE NULLS) {w} AS event_type,
        {function}(value IGNORE NULLS) {w} AS value FROM {EVENTS_NULLS}"""


@query("impute_ffill", _series_fill("last_value", "UNBOUNDED PRECEDING AND CURRENT ROW", "PARTITION BY user_id"))
def impute_ffill(spark, sf):
    return impute.impute(events_nulls(spark, sf), "ffill", ["event_type", "value"], order_by=["ts", "event_id"],
                         partition_by=["user_id"])


@query("impute_bfill", _series_fill("first_value", "CURRENT ROW AND UNBOUNDED FOLLOWING", "PARTITION BY user_id"))
def impute_bfill(spark, sf):
    return impute.impute(events_nulls(spark, sf), "bfill", ["event_type", "value"], order_by=["ts", "event_id"],
                         partition_by=["user_id"])


@query("impute_ffill_global", _series_fill("last_value", "UNBOUNDED PRECEDING AND CURRENT ROW", ""))
def impute_ffill_global(spark, sf):
    # A low limit, so that the table is filled range by range even at test size.
    return impute.impute(events_nulls(spark, sf), "ffill", ["event_type", "value"], order_by=["ts", "event_id"],
                         max_task_rows=1000)


@query("impute_replay", f"""
    WITH e AS {EVENTS_NULLS}, past AS (SELECT * FROM e WHERE ts < TIMESTAMP '2024-01-15')
    SELECT event_id, coalesce(event_type, (SELECT event_type FROM past WHERE event_type IS NOT NULL
        GROUP BY event_type ORDER BY count(*) DESC, event_type LIMIT 1)) AS event_type,
        round(coalesce(value, (SELECT quantile_cont(value, 0.5) FROM past)), 6) AS value
    FROM e""")
def impute_replay(spark, sf):
    e = events_nulls(spark, sf).select("event_id", "ts", "event_type", "value")
    fills = impute.fit_fills(e.filter("ts < timestamp_ntz'2024-01-15'"), "median", ["event_type", "value"])
    return _rounded(impute.apply_fills(e, fills).drop("ts"))


def _docs(spark, sf):
    return table(spark, sf, "documents")


@query("dedup_first", """SELECT doc_id, text, lang, source, n_chars FROM (SELECT *,
    row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1""")
def dedup_first(spark, sf):
    return dedup.remove_duplicates(_docs(spark, sf), "drop_first", ["text"], ["doc_id"])


@query("dedup_last", """SELECT doc_id, text, lang, source, n_chars FROM (SELECT *,
    row_number() OVER (PARTITION BY text ORDER BY doc_id DESC) AS rn FROM documents) WHERE rn = 1""")
def dedup_last(spark, sf):
    return dedup.remove_duplicates(_docs(spark, sf), "drop_last", "text", ["doc_id"])


@query("dedup_drop_all", """SELECT doc_id, text, lang, source, n_chars FROM (SELECT *,
    count(*) OVER (PARTITION BY text) AS n FROM documents) WHERE n = 1""")
def dedup_drop_all(spark, sf):
    return dedup.remove_duplicates(_docs(spark, sf), "drop_all", ["text"])


@query("dedup_flag", """SELECT *, CAST(count(*) OVER (PARTITION BY text) > 1 AS INTEGER) AS is_duplicate FROM documents""")
def dedup_flag(spark, sf):
    return dedup.remove_duplicates(_docs(spark, sf), "flag_only", ["text"])


@query("dedup_report", """SELECT count(*) AS original_rows, count(DISTINCT text) AS final_rows,
    count(*) - count(DISTINCT text) AS rows_removed, 'drop_first' AS strategy FROM documents""")
def dedup_report(spark, sf):
    return dedup.duplicate_report(_docs(spark, sf), "drop_first", ["text"])


@query("clean_nan_inf", """SELECT event_id, CASE WHEN event_id % 13 = 0 OR event_id % 17 = 0 THEN NULL
    ELSE value END AS value FROM events""")
def clean_nan_inf(spark, sf):
    e = table(spark, sf, "events").select(
        "event_id",
        F.when(F.col("event_id") % 13 == 0, float("nan")).when(F.col("event_id") % 17 == 0, float("-inf"))
        .otherwise(F.col("value")).alias("value"),
    )
    return clean_non_finite(e)


@query("sanitize_labels", f"""
    SELECT p_partkey, lower(regexp_replace(p_name, '{OUTER_SPACES_PATTERN}', '', 'g')) AS p_name,
      regexp_replace(lower(regexp_replace(CASE p_partkey % 3 WHEN 0 THEN '  ' || p_type || '!' WHEN 1 THEN
        lower(p_type) || chr(9) ELSE p_type || '-é ' END, '{OUTER_SPACES_PATTERN}', '', 'g')),
        '{PUNCTUATION_PATTERN}', '', 'g') AS p_type FROM part""")
def sanitize_labels(spark, sf):
    third = F.col("p_partkey") % 3
    dirty = table(spark, sf, "part").select(
        "p_partkey", "p_name",
        F.when(third == 0, F.concat(F.lit("  "), "p_type", F.lit("!")))
        .when(third == 1, F.concat(F.lower("p_type"), F.lit("\t")))
        .otherwise(F.concat("p_type", F.lit("-é "))).alias("p_type"),
    )
    out = sanitize.sanitize_categories(dirty, ["p_name"])
    return sanitize.sanitize_categories(out, ["p_type"], remove_punctuation=True)


PART_COPY = "(SELECT *, p_retailprice * 2 + (p_partkey % 5) * 0.01::DOUBLE AS p_retailprice2 FROM part)"


def _part_copy(spark, sf):
    return table(spark, sf, "part").withColumn(
        "p_retailprice2", F.col("p_retailprice") * 2 + (F.col("p_partkey") % 5) * F.lit(0.01))


def _pair_rows(spark, pairs):
    rows = [(a, b, None if r is None else round(r, 6)) for a, b, r in pairs]
    return spark.createDataFrame(rows, "earlier string, later string, r double")


_PART_NUMBERS = ["p_partkey", "p_size", "p_retailprice", "p_retailprice2"]


def _pairs(names):
    return [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]


@query("correlation_pairs_pearson", " UNION ALL ".join(
    f"SELECT '{a}' AS earlier, '{b}' AS later, round(corr({a}, {b}), 6) AS r FROM {PART_COPY}"
    for a, b in _pairs(_PART_NUMBERS)))
def correlation_pairs_pearson(spark, sf):
    return _pair_rows(spark, redundancy.correlation_pairs(_part_copy(spark, sf)))


@query("corr_filter_pearson", f"SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM {PART_COPY}")
def corr_filter_pearson(spark, sf):
    return redundancy.correlation_filter(_part_copy(spark, sf))


_LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_RANKS = "(SELECT " + ", ".join(
    f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE AS {c}" for c in _LINE_NUMBERS
) + " FROM lineitem)"


@query("corr_filter_spearman", " UNION ALL ".join(
    f"SELECT '{a}' AS earlier, '{b}' AS later, round(corr({a}, {b}), 6) AS r FROM {_RANKS}"
    for a, b in _pairs(_LINE_NUMBERS)))
def corr_filter_spearman(spark, sf):
    lines = table(spark, sf, "lineitem").select(*_LINE_NUMBERS)
    return _pair_rows(spark, redundancy.correlation_pairs(lines, "spearman"))


# Ranks among the rows where both columns of the pair are known; the columns miss values in different rows.
_LINE_GAPS = """(SELECT l_orderkey, l_linenumber, l_tax,
    CASE WHEN l_orderkey % 3 <> 0 THEN l_quantity END AS l_quantity,
    CASE WHEN l_partkey % 4 <> 0 THEN l_extendedprice END AS l_extendedprice,
    CASE WHEN l_orderkey % 3 <> 0 THEN l_quantity * l_quantity END AS squared FROM lineitem)"""
_GAP_NUMBERS = ["l_orderkey", "l_linenumber", "l_tax", "l_quantity", "l_extendedprice", "squared"]


def _line_gaps(spark, sf):
    known = F.col("l_orderkey") % 3 != 0
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_tax", F.when(known, F.col("l_quantity")).alias("l_quantity"),
        F.when(F.col("l_partkey") % 4 != 0, F.col("l_extendedprice")).alias("l_extendedprice"),
        F.when(known, F.col("l_quantity") * F.col("l_quantity")).alias("squared"))


@query("correlation_pairs_spearman_gaps", " UNION ALL ".join(
    f"""SELECT '{a}' AS earlier, '{b}' AS later, round(corr(x, y), 6) AS r FROM (SELECT
        rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0::DOUBLE AS x,
        rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0::DOUBLE AS y
        FROM {_LINE_GAPS} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"""
    for a, b in _pairs(_GAP_NUMBERS)))
def correlation_pairs_spearman_gaps(spark, sf):
    return _pair_rows(spark, redundancy.correlation_pairs(_line_gaps(spark, sf), "spearman"))


@query("spearman_filter", f"SELECT l_orderkey, l_linenumber, l_tax, l_quantity, l_extendedprice FROM {_LINE_GAPS}")
def spearman_filter(spark, sf):
    return redundancy.correlation_filter(_line_gaps(spark, sf), 0.95, "spearman")


def _lineitem_const(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_returnflag", "l_linestatus", "l_tax",
        F.when(F.col("l_orderkey") % 500 != 0, F.lit("X")).alias("flag"),
    )


_CONST = """(SELECT l_orderkey, l_returnflag, l_linestatus, l_tax,
    CASE WHEN l_orderkey % 500 = 0 THEN NULL ELSE 'X' END AS flag FROM lineitem)"""


@query("variance_filter", f"SELECT l_orderkey, l_returnflag, l_linestatus, l_tax FROM {_CONST}")
def variance_filter(spark, sf):
    return redundancy.variance_filter(_lineitem_const(spark, sf))


@query("variance_report", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", round(max(n) / sum(n), 6) AS dominant_share FROM
        (SELECT count(*)::DOUBLE AS n FROM {_CONST} GROUP BY {c})"""
    for c in ("l_orderkey", "l_returnflag", "l_linestatus", "l_tax", "flag")))
def variance_report(spark, sf):
    shares = redundancy.dominant_shares(_lineitem_const(spark, sf))
    return shares.withColumn("dominant_share", F.round("dominant_share", 6))


_Z = "coalesce(abs(value - m) / s > 3.0, FALSE)"
_ZSTATS = f"(SELECT avg(value) AS m, stddev_samp(value) AS s FROM {EVENTS_NULLS})"
_IQR = "coalesce(value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1), FALSE)"
_QSTATS = f"(SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM {EVENTS_NULLS})"


@query("guard_zscore_flag", f"SELECT e.*, CAST({_Z} AS INTEGER) AS is_outlier FROM {EVENTS_NULLS} e, {_ZSTATS}")
def guard_zscore_flag(spark, sf):
    return guard.guard(events_nulls(spark, sf), columns=["value"])


@query("guard_zscore_filter", f"SELECT e.* FROM {EVENTS_NULLS} e, {_ZSTATS} WHERE NOT {_Z}")
def guard_zscore_filter(spark, sf):
    return guard.guard(events_nulls(spark, sf), action="filter", columns="value")


@query("guard_iqr_flag", f"SELECT e.*, CAST({_IQR} AS INTEGER) AS is_outlier FROM {EVENTS_NULLS} e, {_QSTATS}")
def guard_iqr_flag(spark, sf):
    return guard.guard(events_nulls(spark, sf), "iqr", columns=["value"])


@query("guard_iqr_filter", f"SELECT e.* FROM {EVENTS_NULLS} e, {_QSTATS} WHERE NOT {_IQR}")
def guard_iqr_filter(spark, sf):
    return guard.guard(events_nulls(spark, sf), "iqr", action="filter", columns=["value"])


_WIDE = ["l_quantity", "l_extendedprice", "l_tax"]


def _line_bound(c):
    return f"({c} < {c}_q[1] - 0.2 * ({c}_q[2] - {c}_q[1]) OR {c} > {c}_q[2] + 0.2 * ({c}_q[2] - {c}_q[1]))"


@query("guard_report", "WITH q AS (SELECT " + ", ".join(
    f"quantile_cont({c}, [0.25, 0.75]) AS {c}_q" for c in _WIDE) + " FROM lineitem), m AS (SELECT " + ", ".join(
    f"{_line_bound(c)} AS {c}" for c in _WIDE) + " FROM lineitem, q) " + " UNION ALL ".join(
    f"""SELECT '{name}' AS "column", count(*) FILTER (WHERE {test}) AS outliers, count(*) AS total_records,
        round_even(count(*) FILTER (WHERE {test}) / count(*)::DOUBLE * 100.0::DOUBLE, 2) AS outlier_percentage FROM m"""
    for name, test in [("*", " OR ".join(_WIDE)), *[(c, c) for c in _WIDE]]))
def guard_report(spark, sf):
    lines = table(spark, sf, "lineitem").select(*_WIDE)
    return guard.guard_report(lines, guard.fit_bounds(lines, "iqr", 0.2))


@query("guard_sample", f"""SELECT e.*, 1::INTEGER AS is_outlier FROM {EVENTS_NULLS} e, {_QSTATS}
    WHERE {_IQR} ORDER BY event_id LIMIT 50""")
def guard_sample(spark, sf):
    return guard.flagged_sample(guard.guard(events_nulls(spark, sf), "iqr", columns=["value"]), ["event_id"])


@query("align_columns", "SELECT p_partkey, p_size, 0.0::DOUBLE AS not_there, p_retailprice FROM part")
def align_columns(spark, sf):
    return features.align_columns(table(spark, sf, "part"), ["p_size", "not_there", "p_retailprice"], ["p_partkey"])
