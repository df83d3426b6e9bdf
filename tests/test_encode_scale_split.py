import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabloom.operators import encode, features, scale, split


def test_scalers_against_formulas(spark):
    df = spark.createDataFrame([(float(i), 10.0 * i, 7.0) for i in range(1, 6)], "a double, b double, k double")
    a = np.arange(1, 6, dtype=float)
    for method, want in (("standard", (a - 3) / a.std()), ("minmax", (a - 1) / 4), ("robust", (a - 3) / 2)):
        got = scale.scale(df, method, ["a", "k"]).orderBy("b").toPandas()
        assert got["a"].tolist() == pytest.approx(want.tolist())
        assert got["k"].tolist() == [0.0] * 5


def test_scaler_skips_targets(spark):
    df = spark.createDataFrame([(1.0, 0, 5), (2.0, 1, 6), (3.0, 0, 7)], "x double, flag int, label int")
    assert scale.scalable_columns(df) == ["x"]
    assert scale.scalable_columns(df, exclude_target=False) == ["x", "flag", "label"]


def test_one_hot_null_is_all_zero(spark):
    df = spark.createDataFrame([(1, "A"), (2, "B"), (3, None)], "id int, category string")
    out = encode.encode(df, "one_hot", ["category"]).orderBy("id").collect()
    assert [(r.category_A, r.category_B) for r in out] == [(1, 0), (0, 1), (0, 0)]


def test_label_unseen_and_null(spark):
    train = spark.createDataFrame([("b",), ("a",), (None,)], "c string")
    new = spark.createDataFrame([("a",), ("z",), (None,), ("b",)], "c string")
    fitted = encode.fit_encoder(train, "label", ["c"])
    assert [r.c for r in encode.apply_encoder(new, fitted).collect()] == [0, -1, 2, 1]


@pytest.mark.parametrize("method", ["label", "frequency", "target", "woe", "binary"])
def test_written_maps_equal_plain_maps(spark, method):
    df = spark.createDataFrame([(i, f"c{i * i % 90}", float(i % 11)) for i in range(300)], "id int, c string, y double")
    plain = encode.fit_encoder(df, method, ["c"], target_column="y")
    written = encode.fit_encoder(df, method, ["c"], target_column="y", driver_levels=0)
    assert "table" in written["steps"]["c"] and "table" not in plain["steps"]["c"]
    a = encode.apply_encoder(df, plain).toPandas().sort_values("id").reset_index(drop=True)
    b = encode.apply_encoder(df, written).toPandas().sort_values("id").reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b[a.columns])


def test_target_defaults_to_last_numeric(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 4.0), ("b", 1.0, 9.0)], "c string, x double, y double")
    assert encode.fit_encoder(df, "target", ["c"])["steps"]["c"]["map"] == {"a": 3.0, "b": 9.0}


def test_woe_formula(spark):
    df = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0), ("b", 0), ("b", 0)], "c string, y int")
    got = encode.fit_encoder(df, "woe", ["c"], target_column="y")["steps"]["c"]["map"]
    assert got["a"] == pytest.approx(math.log((1.5 / 1) / (1.5 / 4)))
    assert got["b"] == pytest.approx(math.log((0.5 / 1) / (3.5 / 4)))


def test_high_cardinality_gets_codes(spark):
    df = spark.createDataFrame([(f"v{i:03d}",) for i in range(60)], "c string")
    assert sorted(r.c for r in encode.encode(df, "one_hot", ["c"]).collect()) == list(range(60))


def test_split_sizes_and_repeatability(spark):
    df = spark.range(1003)
    first = split.train_test_split(df, ["id"], 0.3)
    assert first.filter("_split = 'test'").count() == math.ceil(1003 * 0.3)
    again = split.train_test_split(df.repartition(5), ["id"], 0.3)
    assert first.exceptAll(again).count() == 0
    other = split.train_test_split(df, ["id"], 0.3, random_state=1)
    assert first.exceptAll(other).count() > 0


def test_stratified_split(spark):
    df = spark.range(200).withColumn("y", F.when(F.col("id") % 10 == 0, "rare").otherwise("usual"))
    got = {(r.y, r._split): r["count"] for r in
           split.train_test_split(df, ["id"], 0.25, stratify_by="y").groupBy("y", "_split").count().collect()}
    assert got == {("rare", "test"): 5, ("rare", "train"): 15, ("usual", "test"): 45, ("usual", "train"): 135}
    lonely = spark.createDataFrame([(i, "a" if i else "b") for i in range(10)], "id int, y string")
    assert split.train_test_split(lonely, ["id"], 0.2, stratify_by="y").filter("_split = 'test'").count() == 2


def test_target_preparation(spark):
    df = spark.createDataFrame([("x", 0.0, 0.02), ("y", 1.0, 0.08)], "s string, whole double, part double")
    assert split.fit_target(df, "s")["classes"] == ["x", "y"]
    assert split.fit_target(df, "whole")["to_int"] and not split.fit_target(df, "part")["to_int"]
    assert split.fit_target(df, "missing")["target"] == "part"


def test_feature_preparation(spark):
    train = spark.createDataFrame(
        [(f"2024-01-{i % 28 + 1:02d}", "ab"[i % 2], f"name{i}", float(i)) for i in range(60)], "d string, few string, many string, x double")
    new = spark.createDataFrame([("2024-03-05", "c", "unknown", None)], "d string, few string, many string, x double")
    state = features.fit_features(train)
    row = features.apply_features(new, {**state, "fill": 0.0}).first()
    assert (row.d_year, row.d_month, row.d_day, row.few_a, row.few_b, row.many, row.x) == (2024, 3, 5, 0, 0, -1, 0.0)
    assert set(state["columns"]) == {"d_year", "d_month", "d_day", "few_a", "few_b", "many", "x"}


@pytest.mark.parametrize("limit", [10**6, 25])
def test_repeated_rows_are_split_in_proportion(spark, limit):
    df = spark.createDataFrame([("same", 1)] * 95 + [(f"r{i}", i) for i in range(5)], "a string, b int")
    got = split.train_test_split(df, df.columns, 0.2, max_task_rows=limit)
    assert {r["_split"]: r["count"] for r in got.groupBy("_split").count().collect()} == {"test": 20, "train": 80}
    assert got.filter("a = 'same' AND _split = 'test'").count() >= 15 and got.columns == ["a", "b", "_split"]


def test_split_of_thousands_of_classes(spark):
    df = spark.range(18_000).select("id", (F.col("id") % 6000).cast("string").alias("y"))
    got = split.train_test_split(df, ["id"], 1 / 3, stratify_by="y").filter("_split = 'test'").groupBy("y").count()
    assert got.agg(F.count("*"), F.min("count"), F.max("count")).first()[:] == (6000, 1, 1)
    fitted = split.fit_target(df, "y")
    coded = split.apply_target(df, fitted)
    assert fitted["classes"] is None and coded.select("y").distinct().count() == 6000
    back = split.class_name(coded.join(df.withColumnRenamed("y", "was"), "id"), F.col("y"), fitted, "name")
    assert back.filter("name <> was OR name IS NULL").count() == 0
    weighted = split.with_class_weight(coded, "y")
    assert weighted.select("_weight").distinct().collect() == [(1.0,)]
