"""Reading and writing, nested records, streams, pipeline specs, run tables."""

import io
import zipfile
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import functions as F

from tabloom.operators import dedup, evaluate, guard, impute, recommend
from tabloom.plans import pipeline, runs
from tabloom.session import shared_folder
from tabloom.sources import tables
from tabloom.sources.excel import parse_workbooks
from tabloom.streaming import jobs

from .base import EVENTS_NULLS, SCORED_DOCS, events_nulls, query, scored_docs, table


@query("read_csv_roundtrip", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def read_csv_roundtrip(spark, sf):
    c = table(spark, sf, "customer")
    path = shared_folder(spark, "csv")
    c.write.option("header", True).option("sep", ";").csv(path)
    return tables.read_table(spark, path, "csv", c.schema, ";")


# Values with quotes, separators and line breaks; the format is told by the file names' extension.
@query("read_csv_line_breaks", """SELECT doc_id, text, chr(34) || lang || chr(34) || ';' || chr(10) || chr(10) || source || chr(10) AS note
    FROM documents WHERE text IS NOT NULL AND text <> ''""")
def read_csv_line_breaks(spark, sf):
    d = table(spark, sf, "documents").filter("text IS NOT NULL AND text <> ''")
    note = F.concat(F.lit('"'), "lang", F.lit('";\n\n'), "source", F.lit("\n"))
    path = shared_folder(spark, "csv") + ".csv"
    # Three files at least, and as many as the table has splits: no task writes a fixed share of it.
    d.select("doc_id", "text", note.alias("note")).repartition(max(3, d.rdd.getNumPartitions())).write.csv(
        path, header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return tables.read_table(spark, path, schema="doc_id long, text string, note string")


def _workbook(customers: pa.Table) -> pa.Table:
    """One workbook of some customers: numbers, shared texts, numbers as text, dates, booleans, formula texts."""
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    links = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    rows, shared = customers.to_pylist(), []
    body = ['<row>' + "".join(f'<c t="inlineStr"><is><t>{n}</t></is></c>' for n in ("key", "name", "code", "balance", "since", "rich", "segment")) + "</row>"]
    for r in rows:
        shared.append(r["c_name"])
        body.append(f'<row><c><v>{r["c_custkey"]}</v></c><c t="s"><v>{len(shared) - 1}</v></c><c t="inlineStr"><is><r><t>00</t></r><r><t>{r["c_custkey"]}</t></r></is></c>'
                    f'<c><v>{r["c_acctbal"]!r}</v></c><c s="1"><v>{43831 + r["c_custkey"] % 1000 + 0.25}</v></c>'
                    f'<c t="b"><v>{int(r["c_acctbal"] > 0)}</v></c>'
                    + (f'<c t="str"><v>{escape(r["c_mktsegment"])}</v></c>' if r["c_custkey"] % 3 else '<c t="e"><v>#N/A</v></c>') + "</row>")
    parts = {
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{links}"><sheets><sheet name="a" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="x"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet xmlns="{main}"><numFmts><numFmt numFmtId="164" formatCode="[Red]yyyy\\-mm\\-dd hh:mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/></cellXfs></styleSheet>',
        "xl/sharedStrings.xml": f'<sst xmlns="{main}">' + "".join(f"<si><t>{escape(t)}</t></si>" for t in shared) + "</sst>",
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{"".join(body)}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in parts.items():
            book.writestr(name, text)
    return pa.table({"path": [f"{rows[0]['part']}.xlsx"], "content": [out.getvalue()]})


@query("read_excel_cells", """SELECT CAST(c_custkey AS DOUBLE) AS key, c_name AS name, '00' || c_custkey AS code, c_acctbal AS balance,
    TIMESTAMP '2020-01-01 06:00:00' + to_days(CAST(c_custkey % 1000 AS INTEGER)) AS since, c_acctbal > 0 AS rich,
    CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS segment FROM customer""")
def read_excel_cells(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment", F.floor(F.col("c_custkey") / 500).alias("part"))
    return parse_workbooks(c.groupBy("part").applyInArrow(_workbook, "path string, content binary"))


@query("read_json_roundtrip", "SELECT * FROM orders")
def read_json_roundtrip(spark, sf):
    o = table(spark, sf, "orders")
    path = shared_folder(spark, "json")
    o.write.json(path)
    return tables.read_table(spark, path, "jsonl", o.schema)


@query("write_parquet_roundtrip", "SELECT * FROM supplier")
def write_parquet_roundtrip(spark, sf):
    path = tables.write_table(table(spark, sf, "supplier"), shared_folder(spark, "out"), partition_by=["s_nationkey"])
    s = tables.read_table(spark, path, "parquet")
    return s.select("s_suppkey", "s_name", F.col("s_nationkey").cast("int").alias("s_nationkey"), "s_acctbal")


@query("json_flatten", """SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS "props.k" FROM events""")
def json_flatten(spark, sf):
    return tables.expand_json(table(spark, sf, "events").select("event_id", "event_type", "props"), "props")


@query("preview", """SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS value
    FROM events ORDER BY event_id LIMIT 10""")
def preview(spark, sf):
    e = table(spark, sf, "events").select(
        "event_id", "user_id", F.when(F.col("event_id") % 3 == 0, float("inf")).otherwise(F.col("value")).alias("value"))
    return tables.preview(e, ["event_id"])


_EVENT = "event_id long, user_id long, event_type string, value double, props struct<k: long>"


@query("stream_flatten", """SELECT event_id, user_id, event_type, value, CAST(json_extract(props, '$.k') AS BIGINT) AS "props.k" FROM events""")
def stream_flatten(spark, sf):
    landing = shared_folder(spark, "landing")
    e = table(spark, sf, "events").drop("ts")
    e.withColumn("props", F.from_json("props", "k long")).write.json(landing)
    stream = jobs.read_events(spark, landing, _EVENT, "jsonl")
    return jobs.run_available(jobs.flattened_events(stream), shared_folder(spark, "sink"), shared_folder(spark, "state"))


def _event_stream(spark, sf):
    return jobs.read_events(spark, sf, table(spark, sf, "events").schema, "parquet", "events.parquet")


@query("stream_guard", """SELECT event_id, value, CAST(abs(value - m) / s > 3.0 AS INTEGER) AS is_outlier FROM events,
    (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events)""")
def stream_guard(spark, sf):
    fitted = guard.fit_bounds(table(spark, sf, "events"), columns=["value"])
    stream = jobs.guarded_events(_event_stream(spark, sf).select("event_id", "value"), fitted)
    return jobs.run_available(stream, shared_folder(spark, "sink"), shared_folder(spark, "state"))


@query("stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, sf):
    stream = jobs.deduplicated_events(_event_stream(spark, sf), ["user_id", "event_type"], "ts", "60 days")
    kept = stream.select("user_id", "event_type")
    return jobs.run_available(kept, shared_folder(spark, "sink"), shared_folder(spark, "state"))


_CLEAN = f"""(SELECT event_id, coalesce(event_type, (SELECT event_type FROM {EVENTS_NULLS} WHERE event_type IS NOT NULL
      GROUP BY 1 ORDER BY count(*) DESC, event_type LIMIT 1)) AS event_type,
      coalesce(value, (SELECT quantile_cont(value, 0.5) FROM {EVENTS_NULLS})) AS value FROM {EVENTS_NULLS})"""


@query("config_steps", f"""
    WITH c AS {_CLEAN}, q AS (SELECT quantile_cont(value, [0.25, 0.75]) AS q FROM c),
      k AS (SELECT c.* FROM c, q WHERE NOT (value < q[1] - 1.5 * (q[2] - q[1]) OR value > q[2] + 1.5 * (q[2] - q[1]))),
      s AS (SELECT avg(value) AS m, stddev_pop(value) AS d FROM k)
    SELECT event_id, round((value - m) / d, 6) AS value, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INTEGER) AS event_type
    FROM k, s""")
def config_steps(spark, sf):
    spec = {
        "nodes": [
            {"id": "source", "recipe_id": "csv_loader", "config": {}},
            {"id": "fill", "recipe_id": "missing_value_imputer", "config": {"strategy": "median", "columns": "value, event_type"}},
            {"id": "guard", "recipe_id": "statistical_guardrail", "config": {"method": "iqr", "action": "filter", "columns": ["value"]}},
            {"id": "codes", "recipe_id": "categorical_encoder", "config": {"method": "label", "columns": ["event_type"]}},
            {"id": "scale", "recipe_id": "feature_scaler", "config": {"columns": ["value"]}},
        ],
        "edges": [{"source": "source", "target": "fill"}, {"source": "fill", "target": "guard"},
                  {"source": "guard", "target": "codes"}, {"source": "codes", "target": "scale"}],
    }
    e = events_nulls(spark, sf).select("event_id", "event_type", "value")
    out = pipeline.run_pipeline(spec, e)["scale"]["dataframe"]
    return out.withColumn("value", F.round("value", 6))


_THRESHOLDS = (0.25, 0.5, 0.75)


def _f1(threshold):
    return f"""(SELECT round_even(sum(f1 * s) / sum(s), 4) FROM (SELECT c, s, coalesce(2.0::DOUBLE * tp / nullif(s + k, 0), 0) AS f1 FROM
      (SELECT c, count(*) FILTER (WHERE label = c AND y = c) AS tp, count(*) FILTER (WHERE label = c) AS s,
        count(*) FILTER (WHERE y = c) AS k FROM (SELECT label, CAST(p >= {threshold} AS INT) AS y FROM {SCORED_DOCS}), (VALUES (0), (1)) v(c) GROUP BY c)))"""


@query("run_ranking", "WITH r AS (" + " UNION ALL ".join(
    f"SELECT 'model_{t}' AS model, 'classification' AS task_type, {_f1(t)} AS f1_score" for t in _THRESHOLDS) + """)
    SELECT *, CAST(row_number() OVER (ORDER BY f1_score DESC, model) AS INTEGER) AS rank,
      row_number() OVER (ORDER BY f1_score DESC, model) = 1 AS is_champion FROM r""")
def run_ranking(spark, sf):
    uri = shared_folder(spark, "runs")
    docs = scored_docs(spark, sf)
    for t in _THRESHOLDS:
        measured = evaluate.classification_metrics(evaluate.apply_threshold(docs, F.col("p"), t)).first().asDict()
        runs.log_run(spark, uri, {**measured, "task_type": "classification"}, registered_model_name=f"model_{t}")
    history = runs.run_history(spark, uri).select("run_id", F.col("registered_model_name").alias("model"))
    scores = runs.run_metrics(spark, uri).filter("name = 'f1_score'").select("run_id", F.col("value").alias("f1_score"))
    params = spark.read.parquet(f"{uri}/run_params").filter("name = 'task_type'").select("run_id", F.col("value").alias("task_type"))
    table_ = history.join(scores, "run_id").join(params, "run_id").drop("run_id")
    return recommend.rank_models(table_, "f1_score")


@query("step_telemetry", f"""
    SELECT 'missing_value_imputer' AS recipe_id, 1::BIGINT AS n_steps, count(*) AS output_rows, 5::INTEGER AS n_features FROM events
    UNION ALL SELECT 'duplicate_remover', 1, count(DISTINCT (user_id, event_type)), 5 FROM {_CLEAN} c JOIN events USING (event_id)
    """.replace("(user_id, event_type)", "(events.user_id, c.event_type)"))
def step_telemetry(spark, sf):
    uri = shared_folder(spark, "runs")
    filled, first = runs.observed(impute.impute(events_nulls(spark, sf), "median"), "missing_value_imputer")
    unique, second = runs.observed(
        dedup.remove_duplicates(filled, "drop_first", ["user_id", "event_type"], ["event_id"]), "duplicate_remover")
    unique.write.parquet(f"{uri}/result")
    steps = [{"step": str(i), "recipe_id": name, "duration_ms": 0.0, "output_rows": watch.get["rows"], "n_features": 5}
             for i, (name, watch) in enumerate([("missing_value_imputer", first), ("duplicate_remover", second)])]
    runs.log_steps(spark, uri, "run", steps)
    return runs.step_telemetry(spark, uri).drop("avg_ms", "max_ms")
