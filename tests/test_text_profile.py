import math
from decimal import Decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabloom.functions import text as T
from tabloom.operators import profile, recommend, vectorize
from tabloom.operators.orderstats import OrderStatistics


def _one(spark, value, expression):
    return spark.createDataFrame([(value,)], "t string").select(expression(F.col("t")).alias("r")).first().r


@pytest.mark.parametrize("ties", [1000, 1])
@pytest.mark.parametrize("size", [1, 4, 9, 500])
def test_vocabulary_with_ngrams(spark, monkeypatch, size, ties):
    monkeypatch.setattr(vectorize, "MOST_TIES", ties)
    texts = ["one two one two three", "two one two", None, "", "one", "four five six seven", "one two three one one one", "é é é z z"]
    counts = {}
    for t in texts:
        w = [x for x in (t or "").split() if len(x) > 1]
        for n in (1, 2, 3):
            for i in range(len(w) - n + 1):
                term = " ".join(w[i:i + n])
                counts[term] = counts.get(term, 0) + 1
    want = sorted(sorted(counts, key=lambda x: (-counts[x], x))[:size])
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert vectorize.fit_vectorizer(df, "count", "t", size, "trigram")["vocabulary"] == want


def test_clean_text(spark):
    dirty = "See https://a.b/c?d <b>The</b> children's 3 geese were RUNNING quickly!"
    assert _one(spark, dirty, T.clean_text) == "see child s 3 goose run quick"
    assert _one(spark, dirty, lambda c: T.clean_text(c, remove_numbers=True, normalization="none")) == \
        "see children s geese running quickly"
    assert _one(spark, None, T.clean_text) == ""
    assert _one(spark, "Éa naïve über", lambda c: T.clean_text(c, normalization="none")) == "éa naïve über"


@pytest.mark.parametrize("word, stem", [
    ("glasses", "glass"), ("ponies", "poni"), ("grass", "grass"), ("cats", "cat"), ("virus", "virus"), ("basis", "basis"),
    ("agreed", "agree"), ("need", "need"), ("walked", "walk"), ("bed", "bed"), ("sings", "sing"), ("sing", "sing"),
    ("walking", "walk"), ("sadly", "sad"), ("rational", "rati"), ("as", "as")])
def test_stem(spark, word, stem):
    assert _one(spark, word, T.stem_word) == stem


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, "red red Blue"), (2, "blue a green"), (3, None)], "id int, t string")


def test_count_vectors(docs):
    fitted = vectorize.fit_vectorizer(docs, "count", "t")
    wide = vectorize.vectorize(docs, fitted).orderBy("id").collect()
    assert fitted["vocabulary"] == ["blue", "green", "red"]
    assert [tuple(r)[1:] for r in wide] == [(1, 0, 2), (1, 1, 0), (0, 0, 0)]


def test_tfidf_formula(docs):
    fitted = vectorize.fit_vectorizer(docs, "tfidf", "t")
    row = vectorize.vectorize(docs, fitted).filter("id = 1").first()
    blue, red = math.log(4 / 3) + 1, 2 * (math.log(4 / 2) + 1)
    assert row.tfidf_red == pytest.approx(red / math.hypot(blue, red))


def test_ngrams_keep_order(docs):
    fitted = vectorize.fit_vectorizer(docs, "count", "t", 50, "unigram + bigram + trigram (1,3)")
    assert {"red red", "red blue", "red red blue", "blue green"} <= set(fitted["vocabulary"])


def test_latent_vectors_keep_inner_products(spark):
    docs = spark.createDataFrame([(i, f"w{i % 3}x w{i % 5}y common") for i in range(30)], "id int, t string")
    fitted = vectorize.fit_vectorizer(docs, "lsa", "t", 7)
    rows = vectorize.vectorize(docs, fitted).orderBy("id").collect()
    # Documents with equal text have equal vectors; every vector is at most of length one.
    assert rows[0][1:] == pytest.approx(rows[15][1:])
    assert all(sum(x * x for x in r[1:]) <= 1 + 1e-9 for r in rows)


def test_no_text_column(spark):
    assert vectorize.fit_vectorizer(spark.range(3), "tfidf") is None


def test_profile_small_table(spark):
    df = spark.createDataFrame([(20.0, "A", True), (30.0, "B", False), (None, "A", True), (40.0, "B", False)],
                               "age double, category string, is_active boolean")
    rows = {r.name: r for r in profile.column_profile(df).collect()}
    assert [rows[c].inferred_type for c in df.columns] == ["numeric", "categorical", "boolean"]
    assert rows["age"].null_count == 1 and rows["age"].null_percentage == 25.0 and rows["age"].median == 30.0
    assert [(t.value, t["count"]) for t in rows["category"].top_values] == [("A", 2), ("B", 2)]
    table = profile.table_profile(df).first()
    assert (table.row_count, table.duplicate_rows, table.total_missing_cells) == (4, 0, 1)
    # 8.33 % missing cells.
    assert table.quality_score == round(100 - 8.33 * 1.5, 1)
    # Half of the rows are copies: the penalty for copies ends at 30.
    assert profile.table_profile(df.union(df)).first().quality_score == round(100 - 8.33 * 1.5 - 30, 1)


def test_profile_empty_table(spark):
    empty = spark.createDataFrame([], "a int, b string")
    assert profile.table_profile(empty).first().quality_score == 100.0
    assert profile.column_profile(empty).count() == 0


def test_duplicates_tell_null_positions_apart(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None), ("a", None)], "x string, y string")
    assert profile.duplicate_count(df).first().duplicate_rows == 1
    assert profile.duplicate_count(df, exact=True).first().duplicate_rows == 1


def test_approximate_profile(spark, tiny):
    df = spark.read.parquet(f"{tiny}/lineitem.parquet")
    exact = {r.name: r for r in profile.column_profile(df).collect()}
    rough = {r.name: r for r in profile.column_profile(df, approximate=True).collect()}
    for n, r in exact.items():
        assert r.inferred_type == rough[n].inferred_type
        assert rough[n].unique_count == pytest.approx(r.unique_count, rel=0.15)


def test_recommendations(spark):
    people = spark.createDataFrame(
        [(25.0, "HR", 0), (None, "IT", 1), (35.0, "HR", 0), (45.0, "IT", 1), (50.0, "HR", 0)], "Age double, Dept string, Target int")
    r = recommend.recommend(people)
    assert r["task_type"] == "classification" and r["target_column"] == "Target"
    assert [s["recipe_id"] for s in r["steps"]] == ["missing_value_imputer", "categorical_encoder", "feature_scaler"]
    series = spark.range(30).select(F.expr("timestampadd(DAY, CAST(id AS INT), timestamp_ntz'2026-01-01')").alias("Date"),
                                    (F.col("id") * 1.5).alias("Sales"))
    assert recommend.recommend(series)["task_type"] == "time_series_forecasting"
    assert recommend.recommend(series, task_type="regression")["task_type"] == "regression"


def test_feature_schema(spark):
    df = spark.createDataFrame([(1.234, "b"), (5.0, "a"), (None, None)], "x double, c string")
    rows = {r.name: r for r in profile.feature_schema(df).collect()}
    assert (rows["x"].min_value, rows["x"].median_value, rows["x"].default_value) == (1.23, 3.12, "3.12")
    assert rows["c"].allowed_categories == ["a", "b"] and rows["c"].default_value == "a"


@pytest.mark.parametrize("parts", ["1", "9"])
def test_order_statistics_equal_pandas(spark, parts):
    n = 4000
    rows = [(i % 7 if i % 5 else None, 2**60 + (i % 900) // 3, float("nan") if i % 11 == 0 else ((i * 7919) % 1013) / 7, f"v{i % 40}" if i % 3 else "hot",
             Decimal(i % 50) / 8) for i in range(n)]
    df = spark.createDataFrame(rows, "a int, b long, c double, d string, e decimal(20,3)").repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        stats = OrderStatistics(df, df.columns)
        qs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
        pdf = pd.DataFrame(rows, columns=list("abcde"))
        for c in "ace":
            want = pdf[c].astype(float).dropna()
            assert stats.quantiles({c: qs})[c] == pytest.approx(want.quantile(qs).tolist(), abs=1e-9)
            assert (stats.known[c], stats.distinct[c]) == (len(want), want.nunique())
        assert stats.distinct["b"] == 300 and stats.distinct["d"] == 41
        top = stats.top(2)
        assert top["d"][0] == ((n + 2) // 3, "hot") and top["b"][0] == (15, str(2**60)) and top["a"][0][1] in "0123456"
        assert sorted(top["a"], key=lambda t: (-t[0], t[1])) == top["a"]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_profile_has_no_expand_and_nulls_are_no_values(spark):
    df = spark.createDataFrame([(None, None), (None, None)], "x double, s string")
    got = {r.name: r for r in profile.column_profile(df).collect()}
    assert got["x"].unique_count == 0 and got["x"].median is None and got["s"].inferred_type == "empty"
    stats = OrderStatistics(spark.range(100).selectExpr("id AS a", "id % 3 AS b"), ["a", "b"])
    assert stats.top(1)["b"] == [(34, "0")] and stats.quantiles({"a": [0.5]}) == {"a": [49.5]}
