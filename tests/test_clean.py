import math
import os
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabloom import session
from tabloom.columns import resolve_columns
from tabloom.operators import dedup, guard, impute, ordered, quantiles, rank_correlation, redundancy, sanitize


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(
        [(25.0, 100.0, "Oslo", 0), (None, 200.0, "Rome", 1), (35.0, None, None, 0), (45.0, 400.0, "Oslo", 1)],
        "Age double, Salary double, City string, Churn int")


def test_column_forms(people):
    assert resolve_columns(people, "Age, Salary ,Nope") == ["Age", "Salary"]
    assert resolve_columns(people, ["City"]) == ["City"]
    assert resolve_columns(people, "", "numeric") == ["Age", "Salary", "Churn"]


@pytest.mark.parametrize("columns", ["Age", ["Age"]])
def test_impute_only_named_column(people, columns):
    rows = impute.impute(people, "median", columns).collect()
    assert [r.Age for r in rows] == [25.0, 35.0, 35.0, 45.0]
    assert rows[2].Salary is None


def test_impute_mode_and_empty_column(spark, people):
    assert impute.fit_fills(people, "median", ["City"]) == {"City": "Oslo"}
    empty = spark.createDataFrame([(None, None)], "a double, b string")
    assert impute.fit_fills(empty, "mean") == {"a": 0, "b": "Missing"}
    ties = spark.createDataFrame([("b",), ("a",), ("b",), ("a",)], "v string")
    assert impute.fit_fills(ties, "mode") == {"v": "a"}


def test_median_of_whole_numbers_is_not_cut(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "v int")
    assert sorted(r.v for r in impute.impute(df, "median").collect()) == [1.0, 1.5, 2.0]


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (float("nan"),)], "v double")
    assert sorted(r.v for r in impute.impute(df, "mean").collect()) == [1.0, 2.0, 3.0]


def _series(spark, rows=500):
    pdf = pd.DataFrame({
        "k": ["hot" if i % 3 else f"k{i % 7}" for i in range(rows)], "t": range(rows),
        "v": [float(i) if i % 5 == 0 and i > 40 else None for i in range(rows)],
    })
    return pdf, spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).values.tolist(), "k string, t long, v double")


@pytest.mark.parametrize("limit", [10**6, 20])
@pytest.mark.parametrize("keys", [[], ["k"]])
@pytest.mark.parametrize("direction", ["ffill", "bfill"])
def test_ordered_fill_equals_pandas(spark, limit, keys, direction):
    pdf, df = _series(spark)
    got = impute.impute(df, direction, ["v"], order_by=["t"], partition_by=keys, max_task_rows=limit).toPandas()
    got = got.sort_values("t")["v"].to_numpy(dtype=float)
    want = getattr(pdf.groupby("k")["v"] if keys else pdf["v"], direction)().to_numpy(dtype=float)
    assert all((math.isnan(a) and math.isnan(b)) or a == b for a, b in zip(got, want))


@pytest.mark.parametrize("limit", [10**6, 20])
def test_positions_are_exact(spark, limit):
    pdf, df = _series(spark)
    got = ordered.row_position(df, ["t"], ["k"], max_task_rows=limit).toPandas().sort_values("t")
    assert got["_position"].tolist() == pdf.groupby("k").cumcount().tolist()


def test_nulls_order_last_in_every_path(spark):
    df = spark.createDataFrame([(i if i % 4 else None, i) for i in range(100)], "o int, id int")
    plain = ordered.row_position(df, ["o", "id"]).collect()
    ranged = ordered.row_position(df, ["o", "id"], max_task_rows=5).collect()
    assert {(r.id, r._position) for r in plain} == {(r.id, r._position) for r in ranged}
    assert min(r._position for r in plain if r.o is None) == 75


def test_no_range_takes_a_hot_key_whole(spark):
    df = spark.range(4000).select(F.lit("hot").alias("k"), F.col("id").alias("t"))
    sizes = ordered.range_chunks(df, ["k", "t"], 8).groupBy("_chunk").count().collect()
    assert len(sizes) == 8 and max(r["count"] for r in sizes) < 1200


@pytest.mark.parametrize("max_distinct", [10**6, 50])
def test_quantiles_equal_pandas(spark, max_distinct):
    values = [((i * 7919) % 10007) / 7 for i in range(3000)] + [5.0] * 1500 + [None, float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    qs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = quantiles.exact_quantiles(df, {"v": qs}, max_distinct)["v"]
    assert got == pytest.approx(pd.Series(values).quantile(qs).tolist(), abs=1e-9)


def test_quantiles_of_empty_column(spark):
    assert quantiles.exact_quantiles(spark.createDataFrame([(None,)], "v double"), {"v": [0.5]}) == {"v": [None]}


@pytest.fixture(scope="module")
def copies(spark):
    return spark.createDataFrame([(1, "a", 1.0), (2, "a", 1.0), (3, None, 2.0), (4, None, 2.0), (5, "b", 1.0)],
                                 "id int, s string, x double")


@pytest.mark.parametrize("strategy, kept", [("drop_first", [1, 3, 5]), ("drop_last", [2, 4, 5]), ("drop_all", [5])])
def test_dedup(copies, strategy, kept):
    out = dedup.remove_duplicates(copies, strategy, ["s", "x"], ["id"])
    assert out.columns == copies.columns
    assert sorted(r.id for r in out.collect()) == kept
    assert dedup.duplicate_report(copies, strategy, ["s", "x"]).first().final_rows == len(kept)


def test_dedup_flag_and_whole_rows(copies):
    flags = {r.id: r.is_duplicate for r in dedup.flag_duplicates(copies, "s, x").collect()}
    assert flags == {1: 1, 2: 1, 3: 1, 4: 1, 5: 0}
    assert dedup.remove_duplicates(copies.union(copies)).count() == 5
    assert dedup.remove_duplicates(copies.union(copies.filter("id = 1")), "drop_all").count() == 4


def test_sanitize(spark):
    df = spark.createDataFrame([("  USA!\t", 1), (None, 2)], "c string, n int")
    assert [r.c for r in sanitize.sanitize_categories(df, remove_punctuation=True).orderBy("n").collect()] == ["usa", None]
    odd = spark.createDataFrame([(1, 2)], ["Feature [A]", "Category: B"])
    assert sanitize.safe_names(odd).columns == ["Feature__A_", "Category__B"]


def test_correlation_with_missing_pairs(spark):
    pdf = pd.DataFrame({"a": [1, 2, 3, 4, 5, 6], "b": [2, 4, 6, None, 10, 12], "c": [5, 3, 9, 1, 1, 2], "d": [1.0] * 6}).astype(float)
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).values.tolist(), "a double, b double, c double, d double")
    for method in ("pearson", "spearman"):
        want = pdf.corr(method)
        for a, b, r in redundancy.correlation_pairs(df, method):
            assert (r is None and math.isnan(want.loc[a, b])) or r == pytest.approx(want.loc[a, b])
    assert redundancy.correlation_filter(df).columns == ["a", "c", "d"]


def test_spearman_in_ranges(spark):
    df = spark.createDataFrame([(float(i % 50), float((i * i) % 37)) for i in range(400)], "a double, b double")
    want = df.toPandas().corr("spearman").loc["a", "b"]
    assert redundancy.correlation_pairs(df, "spearman", max_task_rows=10)[0][2] == pytest.approx(want)


def test_spearman_with_gaps_in_every_column(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({c: rng.integers(0, 12, 300).astype(float) for c in "abcd"})
    for i, c in enumerate("abd"):
        pdf.loc[rng.random(300) < 0.1 * (i + 1), c] = None
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).values.tolist(), "a double, b double, c double, d double")
    want = pdf.corr("spearman")
    for ranges, broadcast in ((20, 0), (1000, 0), (20, 1000)):
        found = rank_correlation.spearman_pairs(df, df.columns, ranges, broadcast)
        assert [(a, b) for a, b, _ in found] == [("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("b", "d"), ("c", "d")]
        for a, b, r in found:
            assert r == pytest.approx(want.loc[a, b])


def test_spearman_of_large_whole_numbers_and_decimals(spark):
    # The doubles of neighbouring values are equal, their ranks are not.
    top = 2**63 - 8
    rows = [(top + i, (7 - i), f"{10**20 + i}.{i:02d}") for i in range(8)]
    df = spark.createDataFrame(rows, "a long, b int, c string").select("a", "b", F.col("c").cast("decimal(30,2)").alias("c"))
    assert [r for _, _, r in redundancy.correlation_pairs(df, "spearman")] == pytest.approx([-1.0, 1.0, -1.0])


def test_spearman_edge_cases(spark):
    pairs = lambda df: redundancy.correlation_pairs(df, "spearman")
    empty = spark.createDataFrame([], "a double, b int")
    assert pairs(empty) == [("a", "b", None)]
    assert pairs(spark.createDataFrame([(1.0, None), (None, 2)], "a double, b int")) == [("a", "b", None)]
    assert pairs(spark.createDataFrame([(1.0, 3), (1.0, 4)], "a double, b int")) == [("a", "b", None)]
    assert pairs(spark.createDataFrame([(1.0,)], "a double")) == []
    nan = spark.createDataFrame([(float("nan"), 9, 1), (1.0, 1, 1), (2.0, 2, 1), (3.0, 3, 1)], "a double, b int, ranking int")
    assert pairs(nan) == [("a", "b", pytest.approx(1.0)), ("a", "ranking", None), ("b", "ranking", None)]
    assert redundancy.correlation_filter(nan, 0.9, "spearman").columns == ["a", "ranking"]


def test_variance_filter(spark):
    df = spark.createDataFrame([(i, "x" if i else "y", None if i > 3 else 1) for i in range(100)], "id int, c string, n int")
    assert redundancy.variance_filter(df).columns == ["id", "n"]
    assert redundancy.variance_filter(df, 0.95).columns == ["id"]
    assert redundancy.dominated_columns(df, 0.5) == ["c", "n"]


def test_guard(spark):
    rows = [(50.0 + (i % 5),) for i in range(50)] + [(500.0,), (None,), (float("nan"),)]
    df = spark.createDataFrame(rows, "amount double")
    flagged = guard.guard(df).filter("is_outlier = 1").collect()
    assert [r.amount for r in flagged] == [500.0]
    assert guard.guard(df, "iqr", action="filter").count() == 52
    constant = spark.createDataFrame([(1.0,), (1.0,)], "v double")
    assert guard.guard(constant).agg(F.sum("is_outlier")).first()[0] == 0
    report = {r["column"]: r for r in guard.guard_report(df, guard.fit_bounds(df)).collect()}
    assert report["*"].outliers == report["amount"].outliers == 1 and report["*"].outlier_percentage == 1.89


def test_equal_orders_and_repeated_rows_are_split(spark):
    """A date, and a row, that fill most of the table are cut into ranges; sizes follow max_task_rows, not the shuffle setting."""
    rows = [(1, 7, i % 5) for i in range(3000)] + [(1, 7, 99)] * 2000 + [(None, i, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "k int, t int, x int")
    cut = ordered.arrange(df, ["t"], ["k"], 15)
    sizes = [r["count"] for r in cut.df.groupBy("_chunk").count().collect()]
    assert cut.ranges == 400 and len(sizes) > 350 and max(sizes) < 60 and sum(sizes) == 6000
    got = ordered.row_position(df, ["t"], ["k"], max_task_rows=15).groupBy("k").agg(
        F.count_distinct("_position").alias("n"), F.max("_position").alias("top"), F.count("x").alias("rows"))
    assert {r["k"]: (r["n"], r["top"], r["rows"]) for r in got.collect()} == {1: (5000, 4999, 5000), None: (1000, 999, 1000)}


def test_ties_do_not_depend_on_layout(spark):
    rows = [(i % 3, (i * 7) % 4, None if i % 3 else i) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, t int, v int").withColumn("id", F.col("v") * 2)
    def filled(parts, limit):
        got = impute.impute(df.repartition(parts), "ffill", ["v"], order_by=["t"], max_task_rows=limit)
        return sorted((r.k, r.t, str(r.v), str(r.id)) for r in got.collect())
    assert filled(2, 10**6) == filled(7, 10**6) == filled(5, 20)


def test_borders_in_groups_equal_one_array(spark):
    df = spark.createDataFrame([(None if i % 17 == 0 else (i * 37) % 501, i) for i in range(2000)], "a int, b int")
    one = ordered.range_chunks(df, ["a", "b"], 60).toPandas()
    two = ordered.range_chunks(df, ["a", "b"], 60, max_array=8).toPandas()
    both = one.merge(two, on="b")
    assert both.groupby("_chunk_x")["_chunk_y"].nunique().max() == 1 and both.groupby("_chunk_y")["_chunk_x"].nunique().max() == 1
    assert both.sort_values("_chunk_x")["_chunk_y"].is_monotonic_increasing and both["_chunk_x"].nunique() > 50


def test_thousands_of_ranges_are_joined_by_a_small_plan(spark):
    """The key of the join with the carried rows must not grow with each step of the search for the range."""
    df = spark.range(6000).select("id", F.when(F.col("id") % 7 == 0, F.col("id")).alias("v"))
    got = impute.impute(df, "ffill", ["v"], order_by=["id"], max_task_rows=1).orderBy("id").collect()
    assert [r.v for r in got] == [i - i % 7 for i in range(6000)]
    plan = ordered.row_position(df, ["id"], max_task_rows=1)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 50_000


def test_columns_that_miss_the_same_rows_share_rankings(spark, monkeypatch):
    """Few and many different values in one table, nulls alike in `a` and `b`: equal to pandas by every path."""
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"a": rng.normal(size=300), "b": rng.integers(0, 4, 300) * 1.0, "c": rng.normal(size=300), "d": rng.integers(0, 3, 300) * 1.0})
    pdf.loc[::3, ["a", "b"]] = np.nan
    pdf.loc[1::4, "c"] = np.nan
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).values.tolist(), "a double, b double, c double, d double")
    want = pdf.corr("spearman")
    broadcasts, broadcast = [], F.broadcast
    monkeypatch.setattr(rank_correlation.F, "broadcast", lambda d: broadcasts.append(1) or broadcast(d))
    for most, joins in ((0, 0), (60, 1), (10_000, 1)):
        broadcasts.clear()
        got = rank_correlation.spearman_pairs(df, list("abcd"), max_broadcast_rows=most)
        assert [(x, y) for x, y, _ in got] == [(x, y) for i, x in enumerate("abcd") for y in "abcd"[i + 1:]]
        assert all(r == pytest.approx(want.loc[x, y]) for x, y, r in got)
        assert len(broadcasts) >= joins
    alike = rank_correlation._missing_alike(df, list("abcd"), {"a": 100, "b": 100, "c": 75, "d": 0})
    assert alike == {"a": "a", "b": "a", "c": "c", "d": None}
    assert rank_correlation._rankings(list("abcd"), alike)["a", "b"] == ("a", None)


def test_written_table_drops_its_shuffles(spark):
    """The files of a shuffle go when the table is written, and the table's own when it is dropped."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles
    kept = lambda: {name for name in files().mkString("\n").split("\n") if "/shuffle_" in name}
    before, setting = kept(), spark.conf.get(session.SHUFFLE_CLEANUP)
    table = session.written_table(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    ends = time.time() + 10
    while kept() - before and time.time() < ends:
        time.sleep(0.1)
    assert not kept() - before
    assert table.count() == 7 and spark.conf.get(session.SHUFFLE_CLEANUP) == setting
    session.drop_written(table)
    assert not os.path.exists(table._written_at)
