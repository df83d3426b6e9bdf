"""Profiles, feature schema, recommendations, workflow audit."""

from functools import reduce

from pyspark.sql import functions as F

from tabloom.operators import orderstats, profile, recommend
from tabloom.plans.audit import audit_workflows

from .base import EVENTS_NULLS, events_nulls, query, table

_DOCS = """(SELECT CASE WHEN doc_id % 9 = 0 THEN NULL ELSE text END AS text, lang,
    CASE WHEN doc_id % 5 = 0 THEN NULL ELSE source END AS source FROM documents)"""


@query("profile_table", f"""
    WITH d AS {_DOCS},
      s AS (SELECT count(*) AS row_count,
          CAST(sum(coalesce(strlen(text), 0) + coalesce(strlen(lang), 0) + coalesce(strlen(source), 0)) AS BIGINT) AS memory_bytes,
          count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM d)) AS duplicate_rows,
          CAST(sum((text IS NULL)::INT + (lang IS NULL)::INT + (source IS NULL)::INT) AS BIGINT) AS total_missing_cells FROM d),
      p AS (SELECT *, 3::INTEGER AS column_count,
          round_even(duplicate_rows / row_count::DOUBLE * 100.0::DOUBLE, 2) AS duplicate_percentage,
          round_even(total_missing_cells / (row_count * 3)::DOUBLE * 100.0::DOUBLE, 2) AS missing_cells_percentage FROM s)
    SELECT *, greatest(round_even(100.0::DOUBLE - (least(missing_cells_percentage * 1.5::DOUBLE, 50.0::DOUBLE)
        + least(duplicate_percentage, 30.0::DOUBLE)), 1), 0.0::DOUBLE) AS quality_score FROM p""")
def profile_table(spark, sf):
    d = table(spark, sf, "documents").select(
        F.when(F.col("doc_id") % 9 != 0, F.col("text")).alias("text"), "lang",
        F.when(F.col("doc_id") % 5 != 0, F.col("source")).alias("source"))
    return profile.table_profile(d)


_LINE = {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
         "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double"}


@query("profile_numeric", " UNION ALL ".join(f"""
    SELECT '{c}' AS name, 'numeric' AS inferred_type, '{t}' AS raw_dtype, 0::BIGINT AS null_count,
      count(DISTINCT {c}) AS unique_count, round_even(count(DISTINCT {c}) / count(*)::DOUBLE, 4) AS cardinality_ratio,
      round_even(avg({c}), 4) AS mean, round_even(stddev_samp({c}), 4) AS std, min({c})::DOUBLE AS min,
      round_even(quantile_cont({c}::DOUBLE, 0.25), 4) AS p25, round_even(quantile_cont({c}::DOUBLE, 0.5), 4) AS median,
      round_even(quantile_cont({c}::DOUBLE, 0.75), 4) AS p75, max({c})::DOUBLE AS max,
      count(*) FILTER (WHERE {c} = 0) AS zeros_count, count(*) FILTER (WHERE {c} < 0) AS negative_count FROM lineitem"""
    for c, t in _LINE.items()))
def profile_numeric(spark, sf):
    return profile.column_profile(table(spark, sf, "lineitem").select(*_LINE)).select(
        "name", "inferred_type", "raw_dtype", "null_count", "unique_count", "cardinality_ratio", "mean", "std", "min",
        "p25", "median", "p75", "max", "zeros_count", "negative_count")


@query("order_statistics", " UNION ALL ".join(f"""
    SELECT '{c}' AS name, count({c}) AS known, count(DISTINCT {c}) AS "distinct", quantile_cont({c}::DOUBLE, 0.01) AS p01,
      quantile_cont({c}::DOUBLE, 0.5) AS p50, quantile_cont({c}::DOUBLE, 0.999) AS p999, mode_row.mode, mode_row.mode_count
    FROM lineitem, (SELECT {c}::DOUBLE AS mode, count(*) AS mode_count FROM lineitem WHERE {c} IS NOT NULL GROUP BY {c}
      ORDER BY count(*) DESC, {c} LIMIT 1) mode_row GROUP BY ALL""" for c in _LINE))
def order_statistics(spark, sf):
    found = orderstats.order_statistics(table(spark, sf, "lineitem"), list(_LINE), [0.01, 0.5, 0.999])
    q = F.col("quantiles")
    return found.select("name", "known", "distinct", q[0].alias("p01"), q[1].alias("p50"), q[2].alias("p999"), "mode", "mode_count")


def _top(column, tbl):
    return f"""SELECT '{column}' AS "column", CAST(rank AS INTEGER) AS rank, value, n, round_even(n / total::DOUBLE * 100.0::DOUBLE, 2) AS percentage
      FROM (SELECT {column} AS value, count(*) AS n, (SELECT count(*) FROM {tbl}) AS total,
        row_number() OVER (ORDER BY count(*) DESC, {column}) AS rank FROM {tbl} WHERE {column} IS NOT NULL GROUP BY {column})
      WHERE rank <= 5"""


@query("profile_top_values", " UNION ALL ".join(
    [_top("o_orderstatus", "orders"), _top("o_orderpriority", "orders"), _top("c_mktsegment", "customer"),
     _top("c_name", "customer"), _top("event_type", EVENTS_NULLS)]))
def profile_top_values(spark, sf):
    orders = profile.top_value_report(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"])
    customer = profile.top_value_report(table(spark, sf, "customer"), ["c_mktsegment", "c_name"])
    events = profile.top_value_report(events_nulls(spark, sf), ["event_type"])
    return orders.unionByName(customer).unionByName(events)


def _kind(c):
    return f"""CASE WHEN count({c}) = 0 THEN 'empty' WHEN count(DISTINCT {c}) <= 20 OR
        count(DISTINCT {c}) / count({c})::DOUBLE < 0.05 THEN 'categorical' ELSE 'text' END"""


_TYPED = {
    "part": {"p_partkey": "numeric", "p_name": None, "p_brand": None, "p_type": None, "p_size": "numeric", "p_retailprice": "numeric"},
    "customer": {"c_custkey": "numeric", "c_name": None, "c_nationkey": "numeric", "c_acctbal": "numeric", "c_mktsegment": None},
    "orders": {"o_orderkey": "numeric", "o_custkey": "numeric", "o_orderstatus": None, "o_totalprice": "numeric",
               "o_orderdate": "datetime", "o_orderpriority": None},
}


def _type_lines(tables):
    lines = []
    for t in tables:
        for c, kind in _TYPED[t].items():
            shown = f"'{kind}'" if kind else _kind(c)
            mode = "NULL" if kind else f"(SELECT {c} FROM {t} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"
            lines.append(f"""SELECT '{t}' AS table_name, '{c}' AS name, {shown} AS inferred_type,
                count(DISTINCT {c}) AS unique_count, CAST({mode} AS VARCHAR) AS mode FROM {t}""")
    return " UNION ALL ".join(lines)


@query("profile_types", _type_lines(["part", "customer", "orders"]))
def profile_types(spark, sf):
    parts = [
        profile.column_profile(table(spark, sf, t)).select(F.lit(t).alias("table_name"), "name", "inferred_type", "unique_count", "mode")
        for t in _TYPED
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("column_report", """
    SELECT 'c_acctbal' AS "Column", 'numeric' AS "Type", 0::BIGINT AS "Null Count", 0.0::DOUBLE AS "Null %",
      count(DISTINCT c_acctbal) AS "Unique Count" FROM customer
    UNION ALL SELECT 'c_mktsegment', 'categorical', 0, 0.0, count(DISTINCT c_mktsegment) FROM customer""")
def column_report(spark, sf):
    return profile.column_report(profile.column_profile(table(spark, sf, "customer").select("c_acctbal", "c_mktsegment"))).drop("Stats")


def _number_schema(i, c):
    return f"""SELECT {i}::INTEGER AS position, '{c}' AS name, 'numeric' AS data_type, round(min({c})::DOUBLE, 2) AS min_value,
      round(max({c})::DOUBLE, 2) AS max_value, round(quantile_cont({c}::DOUBLE, 0.5), 2) AS median_value,
      round(avg({c}), 2) AS mean_value, NULL AS levels FROM part"""


def _level_schema(i, c):
    return f"""SELECT {i}, '{c}', 'categorical', NULL, NULL, NULL, NULL,
      (SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT {c} AS v FROM part ORDER BY v LIMIT 30))"""


@query("feature_schema", " UNION ALL ".join([
    _number_schema(0, "p_size"), _number_schema(1, "p_retailprice"), _level_schema(2, "p_name"), _level_schema(3, "p_type")]))
def feature_schema(spark, sf):
    s = profile.feature_schema(table(spark, sf, "part"), ["p_size", "p_retailprice", "p_name", "p_type"])
    return s.select("position", "name", "data_type", "min_value", "max_value", "median_value", "mean_value",
                    F.array_join("allowed_categories", "|").alias("levels"))


def _recommended(t, target, kind, numeric, texts, dates):
    cats = " + ".join(f"(({_kind(c)}) = 'categorical')::BIGINT" for c in texts) or "0"
    if kind == "date":
        task = "'time_series_forecasting'"
    elif kind == "text":
        task = "'classification'"
    else:
        task = f"""CASE WHEN count(DISTINCT {target}) = 2 THEN 'classification'
            WHEN bool_or({target}::DOUBLE % 1 <> 0) OR count(DISTINCT {target}) > 20 THEN 'regression'
            WHEN count(DISTINCT {target}) <= 10 AND count(DISTINCT {target}) < count(*) * 0.1 THEN 'classification'
            ELSE 'regression' END"""
    return f"""SELECT '{t}' AS table_name, '{target}' AS target_column, {task} AS task_type, count(*) AS "rows",
        {numeric + len(texts) + dates}::BIGINT AS "columns", 0::BIGINT AS missing_cells, {cats} AS categorical_columns,
        {numeric}::BIGINT AS numeric_columns, {dates}::BIGINT AS date_columns FROM {t}"""


@query("recommend_task", " UNION ALL ".join([
    _recommended("part", "p_retailprice", "number", 3, ["p_name", "p_brand", "p_type"], 0),
    _recommended("customer", "c_mktsegment", "text", 3, ["c_name", "c_mktsegment"], 0),
    _recommended("orders", "o_totalprice", "date", 3, ["o_orderstatus", "o_orderpriority"], 1),
    _recommended("labels", "toxic", "number", 3, [], 0),
    _recommended("supplier", "s_acctbal", "number", 3, ["s_name"], 0)]))
def recommend_task(spark, sf):
    rows = [recommend.recommendation_row(table(spark, sf, t), t) for t in ("part", "customer", "orders", "labels", "supplier")]
    return reduce(lambda a, b: a.unionByName(b), rows)


@query("recommend_steps", f"""
    WITH e AS {EVENTS_NULLS}
    SELECT 'events' AS table_name, 0::INTEGER AS step, 'missing_value_imputer' AS recipe_id, 'strategy' AS setting, 'median' AS value
      FROM e HAVING count(*) > count(value) OR count(*) > count(event_type)
    UNION ALL SELECT 'events', 1, 'categorical_encoder', 'method', 'one_hot' FROM e HAVING count(DISTINCT event_type) <= 20
    UNION ALL SELECT 'events', 2, 'feature_scaler', 'method', 'standard' FROM e HAVING count(*) > 0""")
def recommend_steps(spark, sf):
    return recommend.recommendation_steps(events_nulls(spark, sf), "events", target_column="value")


# Every conversation as a saved workflow: a turn is a node, each turn leads to the next;
# some get a closing edge, an edge to nowhere, a repeated id or a node left alone.
_WORKFLOWS = """
    t AS (SELECT DISTINCT conv_id, turn FROM conversations),
    nodes AS (SELECT conv_id, CASE WHEN conv_id % 11 = 0 AND turn = 1 THEN 'n0' ELSE 'n' || turn END AS id,
        CASE (conv_id + turn) % 5 WHEN 0 THEN 'train_test_split' WHEN 1 THEN 'random_forest_trainer'
          WHEN 2 THEN 'feature_scaler' WHEN 3 THEN 'missing_value_imputer' ELSE
          CASE WHEN conv_id % 2 = 0 THEN 'categorical_encoder' ELSE 'feature_scaler' END END AS recipe_id FROM t),
    size AS (SELECT conv_id, max(turn) AS last, count(*) AS k FROM t GROUP BY 1),
    edges AS (SELECT a.conv_id, 'n' || a.turn AS source, 'n' || b.turn AS target FROM t a JOIN t b
          ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE NOT (a.conv_id % 6 = 0 AND b.turn = 1)
        UNION ALL SELECT conv_id, 'n' || last, 'n0' FROM size WHERE conv_id % 7 = 0
        UNION ALL SELECT conv_id, 'n' || last, 'x' FROM size WHERE conv_id % 13 = 0)"""


def _workflows(spark, sf):
    conv, turn = F.col("conv_id"), F.col("turn")
    t = table(spark, sf, "conversations").select("conv_id", "turn").distinct()
    kind = (conv + turn) % 5
    node = F.struct(
        F.when((conv % 11 == 0) & (turn == 1), F.lit("n0")).otherwise(F.concat(F.lit("n"), turn.cast("string"))).alias("id"),
        F.when(kind == 0, "train_test_split").when(kind == 1, "random_forest_trainer").when(kind == 2, "feature_scaler")
        .when(kind == 3, "missing_value_imputer").when(conv % 2 == 0, "categorical_encoder").otherwise("feature_scaler")
        .alias("recipe_id"))
    flows = t.groupBy("conv_id").agg(F.collect_list(node).alias("n"), F.array_sort(F.collect_list("turn")).alias("turns"))
    name = lambda c: F.concat(F.lit("n"), c.cast("string"))
    follows = F.filter(F.col("turns"), lambda x: F.array_contains(F.col("turns"), x + 1) & ~((conv % 6 == 0) & (x == 0)))
    steps = F.transform(follows, lambda x: F.struct(name(x).alias("source"), name(x + 1).alias("target")))
    last = name(F.array_max("turns"))

    def extra(condition, target):
        return F.when(condition, F.array(F.struct(last.alias("source"), F.lit(target).alias("target")))).otherwise(
            F.array().cast("array<struct<source:string,target:string>>"))

    return flows.select("conv_id", F.to_json("n").alias("nodes"),
                        F.to_json(F.concat(steps, extra(conv % 7 == 0, "n0"), extra(conv % 13 == 0, "x"))).alias("edges"))


@query("workflow_audit", f"""
    WITH RECURSIVE {_WORKFLOWS},
    counts AS (SELECT s.conv_id, s.k AS n_nodes, (SELECT count(*) FROM edges e WHERE e.conv_id = s.conv_id) AS n_edges,
        s.k - (SELECT count(DISTINCT id) FROM nodes n WHERE n.conv_id = s.conv_id) AS duplicate_ids,
        (SELECT count(*) FROM edges e WHERE e.conv_id = s.conv_id AND (
            NOT EXISTS (SELECT 1 FROM nodes n WHERE n.conv_id = e.conv_id AND n.id = e.source)
            OR NOT EXISTS (SELECT 1 FROM nodes n WHERE n.conv_id = e.conv_id AND n.id = e.target))) AS dangling_edges FROM size s),
    walk(conv_id, origin, here) AS (SELECT conv_id, source, target FROM edges
        UNION SELECT w.conv_id, w.origin, e.target FROM walk w JOIN edges e ON e.conv_id = w.conv_id AND e.source = w.here),
    checks AS (SELECT c.*, CASE WHEN n_nodes > 1 THEN (SELECT count(*) FROM nodes n WHERE n.conv_id = c.conv_id AND NOT EXISTS
            (SELECT 1 FROM edges e WHERE e.conv_id = n.conv_id AND (e.source = n.id OR e.target = n.id))) ELSE 0 END AS orphans,
        (SELECT count(*) FROM nodes n WHERE n.conv_id = c.conv_id AND recipe_id = 'random_forest_trainer'
            AND EXISTS (SELECT 1 FROM edges e WHERE e.conv_id = n.conv_id AND e.target = n.id)
            AND NOT EXISTS (SELECT 1 FROM edges e JOIN nodes p ON p.conv_id = e.conv_id AND p.id = e.source
                WHERE e.conv_id = n.conv_id AND e.target = n.id AND p.recipe_id = 'train_test_split')) AS unsplit,
        CASE WHEN EXISTS (SELECT 1 FROM nodes n WHERE n.conv_id = c.conv_id AND recipe_id = 'random_forest_trainer')
            AND NOT EXISTS (SELECT 1 FROM nodes n WHERE n.conv_id = c.conv_id AND recipe_id = 'categorical_encoder')
            THEN 1 ELSE 0 END AS unencoded,
        CASE WHEN EXISTS (SELECT 1 FROM walk w WHERE w.conv_id = c.conv_id AND origin = here) THEN 1 ELSE 0 END AS cyclic,
        duplicate_ids > 0 OR dangling_edges > 0 AS broken FROM counts c)
    SELECT conv_id, CAST(n_nodes AS INTEGER) AS n_nodes, CAST(n_edges AS INTEGER) AS n_edges,
      CAST(duplicate_ids AS INTEGER) AS duplicate_ids, CAST(dangling_edges AS INTEGER) AS dangling_edges,
      CAST(CASE WHEN broken THEN 0 ELSE orphans END AS INTEGER) AS orphan_nodes,
      CAST(CASE WHEN broken THEN 0 ELSE unsplit END AS INTEGER) AS trainers_without_split,
      CAST(CASE WHEN broken THEN 0 ELSE unencoded END AS INTEGER) AS missing_encoder,
      CAST(CASE WHEN broken THEN 0 ELSE cyclic END AS INTEGER) AS is_cyclic,
      CAST(NOT (broken OR orphans > 0 OR unsplit > 0 OR cyclic > 0) AS INTEGER) AS is_valid FROM checks""")
def workflow_audit(spark, sf):
    return audit_workflows(_workflows(spark, sf), "conv_id")
