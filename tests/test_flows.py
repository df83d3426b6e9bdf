import csv
import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from catalog import flows
from tabloom.operators import guard, stages
from tabloom.plans import audit, pipeline, registry, runs
from tabloom.session import shared_folder, written_table
from tabloom.sources import csv_records, excel, tables
from tabloom.streaming import jobs

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _workbook(rows):
    def cell(r, c, v):
        ref = f"{chr(65 + c)}{r + 1}"
        if v is None:
            return ""
        if isinstance(v, str):
            return f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'
        return f'<c r="{ref}"><v>{v}</v></c>'

    sheet = "".join(f'<row r="{r + 1}">' + "".join(cell(r, c, v) for c, v in enumerate(row)) + "</row>" for r, row in enumerate(rows))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets><sheet name="a" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{MAIN}"><sheetData>{sheet}</sheetData></worksheet>')
    return out.getvalue()


def test_workbooks(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(_workbook([["name", "x"], ["p", 1], ["q", 2.5]]))
    (tmp_path / "b.xlsx").write_bytes(_workbook([["x", "name"], [None, "r"]]))
    df = tables.read_table(spark, str(tmp_path), "excel", "name string, x double")
    assert sorted((r.name, r.x) for r in df.collect()) == [("p", 1.0), ("q", 2.5), ("r", None)]
    typed = tables.read_table(spark, str(tmp_path / "a.xlsx"))
    assert dict(typed.dtypes) == {"name": "string", "x": "double"}
    (tmp_path / "c.xlsx").write_bytes(_workbook([["name", "extra"], ["s", 7]]))
    every = tables.read_table(spark, str(tmp_path), "excel")
    assert every.columns == ["name", "x", "extra"] and {r.name: r.extra for r in every.collect()} == {"p": None, "q": None, "r": None, "s": 7.0}


def test_workbook_kinds(spark):
    assert excel.is_date_format("yyyy-mm-dd") and excel.is_date_format("[h]:mm") and excel.is_date_format("m/d/yy;@")
    assert not any(map(excel.is_date_format, ("General", "0.00", '0 "days"', "[Red]0", "0\\d", "#,##0_);[Red](#,##0)")))
    assert excel.serial_date(1) == "1900-01-01 00:00:00.000" and excel.serial_date(61) == "1900-03-01 00:00:00.000"
    assert excel.serial_date(43831.5) == "2020-01-01 12:00:00.000" and excel.serial_date(0, True) == "1904-01-01 00:00:00.000"
    assert excel.serial_date(1e12) is None
    books = [("1.xlsx", _workbook([["n", "t", "n", "mixed", None], [1, "00123", 7, "x", 5], [None, "4", None, 2.5]])), ("2.xlsx", _workbook([["t", "void"], ["z"]])),
             ("3.xlsx", _workbook([]))]
    files = spark.createDataFrame(books, "path string, content binary")
    df = excel.parse_workbooks(files)
    assert dict(df.dtypes) == {"n": "double", "t": "string", "n.1": "double", "mixed": "string", "void": "double"}
    assert sorted((r["t"], r["n"], r["n.1"], r["mixed"], r["void"]) for r in df.collect()) == [
        ("00123", 1.0, 7.0, "x", None), ("4", None, None, "2.5", None), ("z", None, None, None, None)]
    given = excel.parse_workbooks(files, "t int, n long").orderBy("t").collect()
    assert [(r.t, r.n) for r in given] == [(None, None), (4, None), (123, 1)]
    with pytest.raises(ValueError, match="header"):
        excel.parse_workbooks(files.filter("path = '3.xlsx'"))


def test_formats_and_errors(spark, tmp_path):
    assert tables.format_of("a/b.CSV") == "csv"
    for bad in ("a.xls", "a.pdf", "noext"):
        with pytest.raises(ValueError):
            tables.format_of(bad)
    (tmp_path / "t.csv").write_text("custom_col_x;custom_col_y;custom_target\n1.5;2.0;0\n3.0;4.0;1\n")
    df = tables.read_table(spark, str(tmp_path / "t.csv"), delimiter=";")
    assert df.count() == 2 and dict(df.dtypes)["custom_col_x"] == "double"
    (tmp_path / "q.csv").write_text('id,note\n1,"two\nlines"\n2,one\n')
    quoted = tables.read_table(spark, str(tmp_path / "q.csv"), multi_line=True)
    assert [(r.id, r.note) for r in quoted.orderBy("id").collect()] == [(1, "two\nlines"), (2, "one")]
    with pytest.raises(ValueError):
        tables.read_table(spark, str(tmp_path / "t.csv"), delimiter="#")
    (tmp_path / "t.json").write_text(json.dumps([{"a": 1, "n": {"b": 2}}, {"a": 3, "n": {"b": None}}]))
    flat = tables.flatten(tables.read_table(spark, str(tmp_path / "t.json")))
    assert flat.columns == ["a", "n.b"] and flat.count() == 2
    with pytest.raises(ValueError):
        tables.reject_empty(df.filter("false"))


def test_records_payload_and_demo(spark):
    df = tables.from_records(spark, [{"user_id": 1, "amount": 2.5}, {"user_id": 2}])
    assert df.columns == ["user_id", "amount"] and df.count() == 2
    texts = spark.createDataFrame([('[{"a": 1, "o": {"k": 2}}, {"a": 3}]',), ('{"a": 9}',)], "p string")
    schema = tables.T.StructType.fromDDL("a long, o struct<k: long>")
    flat = tables.explode_payload(texts, "p", schema)
    assert flat.columns == ["a", "o.k"] and sorted(r.a for r in flat.collect()) == [1, 3, 9]
    demo = tables.demo_table(spark)
    assert demo.count() == 300 and demo.collect() == tables.demo_table(spark).collect()
    doc = tables.preview_document(demo, ["Salary"], 500)
    assert doc["total_rows"] == 300 and len(doc["rows"]) == 100


def test_shared_folder_is_the_configured_one(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    assert shared_folder(spark, "x").startswith(base)
    assert written_table(spark.range(5), "t").count() == 5


def test_registry_covers_every_operator():
    assert len(registry.names()) == 25
    assert set(registry.names("training")) >= {"xgboost_trainer", "linear_trainer"}
    assert "preprocessing" in registry.categories()
    with pytest.raises(KeyError):
        registry.get("nope")


def test_own_operator(spark):
    @registry.register("double_it", "own")
    def run(inputs, config):
        return {"dataframe": inputs["dataframe"].withColumn("id", F.col("id") * 2)}

    try:
        assert pipeline.apply_operators(spark.range(3), [("double_it", {}), ("double_it", {})]).agg(F.sum("id")).first()[0] == 12
    finally:
        registry._entries.pop("double_it")


def test_custom_stage_validation(spark):
    class Half(stages.OperatorStep):
        def validate(self):
            return [] if "column" in self.getOrDefault(self.config) else ["column is missing"]

        def apply(self, df, column):
            return df.withColumn(column, F.col(column) / 2)

    assert Half().validate() == ["column is missing"]
    assert Half(config={"column": "id"}).transform(spark.range(3)).agg(F.sum("id")).first()[0] == 1.5


def _spec(trainer, config, evaluator=None):
    nodes = [("load", "csv_loader", {}), ("fill", "missing_value_imputer", {}), ("codes", "categorical_encoder", {}),
             ("cut", "train_test_split", {"target_column": "y", "test_size": 0.25, "key_columns": ["id"]}),
             ("fit", trainer, config), ("judge", "model_evaluator", evaluator or {})]
    ids = [n[0] for n in nodes]
    return {"nodes": [{"id": i, "recipe_id": r, "config": c} for i, r, c in nodes],
            "edges": [{"source": a, "target": b} for a, b in zip(ids, ids[1:])]}


def test_whole_spec_with_evaluation(spark):
    df = spark.range(80).select("id", (F.col("id") % 7).cast("double").alias("x"),
                                F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("c"), (F.col("id") % 2).cast("int").alias("y"))
    out = pipeline.run_pipeline(_spec("random_forest_trainer", {"n_estimators": 5, "max_depth": 4},
                                      {"decision_threshold": 0.4, "cost_false_positive": 2.0}), df)
    assert out["judge"]["metrics"].first().accuracy == 1.0
    assert out["judge"]["roc_auc"].first().roc_auc == 1.0
    assert out["judge"]["business_cost"].first().total_estimated_business_loss == 0.0
    snapshot = pipeline.step_snapshot(out["fill"])
    assert snapshot["row_count"] == 80 and len(snapshot["preview_rows"]) == 5
    regression = pipeline.run_pipeline(_spec("linear_trainer", {"task_type": "regression"}), df)
    assert regression["judge"]["metrics"].first().r2_score > 0.9


def test_forecast_spec_with_evaluation(spark):
    df = spark.range(60).select(F.expr("timestampadd(DAY, CAST(id DIV 2 AS INT), timestamp_ntz'2026-01-01')").alias("day"),
                                F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("k"), (F.col("id") + F.col("id") % 5).cast("double").alias("y"))
    uri = shared_folder(spark, "runs")
    for recipe in ("prophet_forecaster", "arima_forecaster"):
        nodes = [("f", recipe, {"horizon_periods": 3, "partition_by": ["k"], "date_column": "day", "target_column": "y", "backtest_origins": 2}),
                 ("judge", "model_evaluator", {}), ("log", "mlflow_tracker", {"tracking_uri": uri})]
        spec = {"nodes": [{"id": i, "recipe_id": r, "config": c} for i, r, c in nodes],
                "edges": [{"source": "f", "target": "judge"}, {"source": "judge", "target": "log"}]}
        out = pipeline.run_pipeline(spec, df)
        rows = out["judge"]["metrics"].collect()
        assert sorted(r.k for r in rows) == ["a", "b"] and all(r.status == "fitted" and r.mae >= 0 for r in rows)
        assert {(r.k, r.tested) for r in out["f"]["backtest_metrics"].collect()} == {("a", 6), ("b", 6)}
        logged = {r["name"]: r["value"] for r in runs.run_metrics(spark, uri).collect() if r["run_id"] == out["log"]["governance_record"]["run_id"]}
        assert logged["rows"] == 2 and logged["mae"] == pytest.approx(sum(r.mae for r in rows) / 2)
    with pytest.raises(ValueError, match="lacks"):
        pipeline.run_pipeline({"nodes": [{"id": "j", "recipe_id": "model_evaluator"}], "edges": []}, df)


def test_spec_errors(spark):
    loop = {"nodes": [{"id": i, "recipe_id": "cron_trigger"} for i in "ab"],
            "edges": [{"source": "a", "target": "b"}, {"source": "b", "target": "a"}]}
    with pytest.raises(ValueError, match="cycle"):
        pipeline.run_pipeline(loop, spark.range(1))
    with pytest.raises(ValueError, match="lacks"):
        pipeline.run_pipeline({"nodes": [{"id": "m", "recipe_id": "xgboost_trainer"}], "edges": []}, spark.range(1))


def test_audit(spark):
    def flow(key, nodes, edges):
        return (key, json.dumps([{"id": i, "recipe_id": r} for i, r in nodes]),
                json.dumps([{"source": a, "target": b} for a, b in edges]))

    rows = [
        flow("cycle", [("1", "a"), ("2", "a"), ("3", "a")], [("1", "2"), ("2", "3"), ("3", "1")]),
        flow("line", [("3", "a"), ("1", "a"), ("2", "a")], [("1", "2"), ("2", "3")]),
        flow("unsplit", [("1", "csv_loader"), ("2", "xgboost_trainer")], [("1", "2")]),
        flow("dangling", [("1", "a")], [("1", "9")]),
        flow("alone", [("1", "a"), ("2", "a"), ("3", "a")], [("1", "2")]),
    ]
    got = {r.k: r for r in audit.audit_workflows(spark.createDataFrame(rows, "k string, nodes string, edges string"), "k").collect()}
    assert got["cycle"].is_cyclic == 1 and got["line"].is_valid == 1
    assert got["unsplit"].trainers_without_split == 1 and got["unsplit"].missing_encoder == 1
    assert got["dangling"].dangling_edges == 1 and got["alone"].orphan_nodes == 1
    assert [k for k, r in got.items() if r.is_valid] == ["line"]


def test_run_tables(spark):
    uri = shared_folder(spark, "runs")
    record = runs.log_run(spark, uri, {"accuracy": 0.95, "f1_score": 0.94, "loss": 0.05}, stage="Production")
    assert record["metrics_logged"] == 3
    runs.log_run(spark, uri, {"accuracy": 0.5, "note": "second"}, registered_model_name="later")
    assert [r.registered_model_name for r in runs.run_history(spark, uri).collect()] == ["later", "champion_model"]
    assert runs.run_metrics(spark, uri).count() == 4
    with pytest.raises(ValueError):
        runs.log_run(spark, uri, {}, stage="Gone")


def test_stream_receipts_and_restart(spark, tmp_path):
    landing, sink, receipts, state = (str(tmp_path / n) for n in ("in", "out", "receipts", "state"))
    (tmp_path / "in").mkdir()
    schema = "user_id long, amount double, o struct<k: long>"

    def run():
        stream = jobs.flattened_events(jobs.read_events(spark, landing, schema))
        jobs.start_with_receipts(stream, sink, receipts, state).awaitTermination()

    (tmp_path / "in" / "one.json").write_text(json.dumps([{"user_id": 1, "amount": 9.5, "o": {"k": 4}}, {"user_id": 2, "amount": 1.0}]))
    run()
    (tmp_path / "in" / "two.json").write_text(json.dumps({"user_id": 3, "amount": 7.0}))
    run()
    assert sorted(r.user_id for r in spark.read.parquet(sink).collect()) == [1, 2, 3]
    got = spark.read.parquet(receipts).orderBy("batch_id").collect()
    assert [r.rows for r in got] == [2, 1] and got[0].columns == ["user_id", "amount", "o.k"]


def test_stream_guard_equals_batch(spark, tiny):
    events = spark.read.parquet(f"{tiny}/events.parquet")
    fitted = guard.fit_bounds(events, columns=["value"])
    stream = jobs.read_events(spark, tiny, events.schema, "parquet", "events.parquet")
    got = jobs.run_available(jobs.guarded_events(stream, fitted, "filter"), shared_folder(spark, "s"), shared_folder(spark, "c"))
    assert got.exceptAll(guard.apply_bounds(events, fitted, "filter")).count() == 0
    assert got.count() == guard.apply_bounds(events, fitted, "filter").count()


def test_presets():
    assert jobs.PRESETS["Hourly"] == "1 hour"


def test_optimiser_prunes_and_pushes_down(spark, tiny):
    lines = spark.read.parquet(f"{tiny}/lineitem.parquet")
    fitted = guard.fit_bounds(lines, "iqr", columns=["l_quantity"])
    plan = guard.apply_bounds(lines.select("l_orderkey", "l_quantity"), fitted, "filter").filter("l_orderkey > 5")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in text
    assert "GreaterThan(l_orderkey,5)" in text and "Exchange" not in text


def test_json_keys_that_look_like_types(spark):
    rows = spark.createDataFrame([(1, '{"AVOIDED": 3, "VOID": null, "a OBJECT<b": {"x": [1, null]}}'), (2, None)], "id long, p string")
    got = tables.expand_json(rows, "p").orderBy("id")
    assert [r["p.AVOIDED"] for r in got.collect()] == [3, None]
    assert "p.VOID" in got.columns and dict(got.dtypes)["p.VOID"] == "string"
    assert got.first()["p.a OBJECT<b.x"] == [1, None]


@pytest.mark.parametrize("split", ["64", "134217728"])
def test_line_breaks_in_quotes_are_read_in_many_tasks(spark, tmp_path, split):
    """Records cut anywhere by the splits equal those of the csv module; a quote left open is an error."""
    rng, folder = random.Random(2), tmp_path / "in.csv"
    folder.mkdir()
    rows = [(i, "".join(rng.choice(['a', '"', ',', '\n', 'é', ' x', '\n\n']) for _ in range(rng.randrange(1, 30))) + "z", i / 2) for i in range(300)]
    for part in range(2):
        with open(folder / f"part{part}.csv", "w", newline="") as f:
            out = csv.writer(f, lineterminator="\n", quoting=csv.QUOTE_ALL)
            out.writerow(["id", "note", "half"])
            out.writerows(rows[part::2])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = tables.read_table(spark, str(folder))
        assert [f.dataType.simpleString() for f in got.schema.fields] == ["int", "string", "double"]
        assert sorted(map(tuple, got.collect())) == rows
        assert csv_records.text_lines(spark, str(folder)).rdd.getNumPartitions() >= (50 if split == "64" else 1)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    bad = tmp_path / "bad.csv"
    bad.write_text('id,note\n1,"open\n2,never closed\n')
    with pytest.raises(Exception, match="left open"):
        tables.read_table(spark, str(bad)).collect()


def test_top_anomalies_without_key_agree(spark):
    df = spark.range(200).select("id", (F.col("id") % 2).cast("double").alias("anomaly_score"))
    first = [r.id for r in guard.top_anomalies(df.repartition(7), limit=5).collect()]
    assert first == [r.id for r in guard.top_anomalies(df.repartition(2), limit=5).collect()] and all(i % 2 for i in first)
    assert [r.id for r in guard.top_anomalies(df, key="id", limit=2).collect()] == [1, 3]


def test_preview_bounds(spark):
    df = spark.range(300)
    assert [tables.preview(df, ["id"], n).count() for n in (0, 7, 250)] == [1, 7, 100]
    assert tables.preview(df, ["id"], 250, most=250).count() == 250


def test_csv_with_line_breaks_is_written_by_as_many_tasks_as_the_table_has_splits(spark, tmp_path, monkeypatch):
    rows = [(i, f'text "{i}"\n;', "en", "web") for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(8).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(flows, "shared_folder", lambda *_: f"{tmp_path}/made")
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")  # a split for each file
    try:
        got = flows.read_csv_line_breaks(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted((r.doc_id, r.text, r.note) for r in got) == [(i, t, f'"{a}";\n\n{b}\n') for i, t, a, b in rows]
    assert len([f for f in (tmp_path / "made.csv").iterdir() if f.name.startswith("part-")]) == 8
