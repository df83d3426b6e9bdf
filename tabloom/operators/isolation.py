"""Isolation forest (Liu, Ting, Zhou 2008) grown and scored in parallel.

Each tree sees at most `sample_size` rows, whatever the size of the table, so a tree is a
small task and the whole forest a table of a few tens of thousands of nodes. Trees
grow in parallel, one per group; rows are scored in Arrow batches without a shuffle.
Samples are the smallest draws of a hash per row and tree, so a forest does not depend on
the order or partitions of the table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..columns import is_numeric
from ..functions.numeric import nan_to_null, percent, risk_band, sigmoid_risk, verdict
from ..session import written_table
from .encode import ONE_HOT_LEVELS, apply_encoder, fit_encoder
from .impute import fit_fills
from .orderstats import OrderStatistics
from .quantiles import exact_quantiles

SAMPLE_SIZE = 256  # rows per tree of the published method
HASH_BUCKETS = 64  # 0/1 columns of a text with many levels
EULER = 0.5772156649015329
NODE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, depth_value double"


def average_path(n):
    """Mean depth of an unsuccessful search in a tree of `n` rows."""
    n = np.asarray(n, dtype=float)
    out = np.where(n == 2, 1.0, 0.0)
    big = n > 2
    m = np.where(big, n, 3.0)
    return np.where(big, 2.0 * (np.log(m - 1.0) + EULER) - 2.0 * (m - 1.0) / m, out)


def _grow(tree: int, x: np.ndarray, seed: int) -> pd.DataFrame:
    """Random splits down to single rows or the height limit; a leaf holds its expected depth."""
    rng = np.random.default_rng([seed, tree])
    limit = math.ceil(math.log2(max(len(x), 2)))
    rows, todo = [], [(0, np.arange(len(x)), 0)]
    count = 1
    while todo:
        node, members, depth = todo.pop()
        part = x[members]
        low, high = part.min(axis=0), part.max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(members) <= 1 or not len(usable):
            rows.append((tree, node, -1, 0.0, -1, -1, depth + float(average_path(len(members)))))
            continue
        feature = int(rng.choice(usable))
        threshold = float(rng.uniform(low[feature], high[feature]))
        goes_left = part[:, feature] <= threshold
        left, right = count, count + 1
        count += 2
        rows.append((tree, node, feature, threshold, left, right, 0.0))
        todo += [(left, members[goes_left], depth + 1), (right, members[~goes_left], depth + 1)]
    return pd.DataFrame(rows, columns=[c.split()[0] for c in NODE_SCHEMA.split(", ")])


def _uniform(key: np.ndarray, tree: np.ndarray, copy: int, seed: int) -> np.ndarray:
    """Numbers in [0, 1) from a 64-bit mix of row, tree, copy and seed."""
    z = key.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * (tree.astype(np.uint64) + np.uint64(1))
    for extra in (copy, seed):
        z = z + np.uint64((extra * 0xD1342543DE82EF95 + 0x9E3779B97F4A7C15) % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
    return (z >> np.uint64(11)) * 2.0**-53


def _drawn(key: np.ndarray, n: np.ndarray, trees: int, seed: int, cut: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, tree, draw) of every copy whose draw is below `cut`; a row with `n` copies has the n smallest-first
    order statistics of as many draws, made one after another, so its copies are never listed."""
    row, tree = np.repeat(np.arange(len(key)), trees), np.tile(np.arange(trees), len(key))
    draw, found, copy = np.zeros(len(row)), [], 0
    while len(row):
        u = _uniform(key[row], tree, copy, seed)
        draw = 1.0 - (1.0 - draw) * np.exp(np.log1p(-u) / (n[row] - copy)) if copy else -np.expm1(np.log1p(-u) / n[row])
        low = draw < cut
        row, tree, draw = row[low], tree[low], draw[low]
        found.append((row, tree, draw))
        copy += 1
        more = n[row] > copy
        row, tree, draw = row[more], tree[more], draw[more]
    return tuple(np.concatenate([f[i] for f in found]) for i in range(3)) if found else (row, tree, draw)


def _samples(features: DataFrame, trees: int, seed: int, size: int) -> DataFrame:
    """Written table (tree, draw, x) that holds the `size` smallest draws of every tree.

    Every row draws a number for every tree from a hash of its features, so the sample
    does not depend on how the table is laid out and is the same rule at every size. Equal
    rows are counted first and draw for all their copies. Only draws below a bound that
    leaves some more than `size` rows a tree are kept; should a tree get too few, the
    bound is doubled.
    """
    counted = features.groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    rows_of = written_table(counted.select(F.xxhash64("x").alias("key"), "n", "x"), "rows")
    rows = rows_of.agg(F.sum("n").alias("n")).first()["n"] or 0
    wanted = min(size, rows)
    cut = min(1.0, (size + 6.0 * math.sqrt(size) + 10.0) / max(rows, 1))
    while True:
        bound = cut if cut < 1.0 else 2.0

        def pick(batches, bound=bound):
            for batch in batches:
                key, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                row, tree, draw = _drawn(key, n, trees, seed, bound)
                yield pa.RecordBatch.from_arrays([pa.array(tree, pa.int32()), pa.array(draw), batch.column(2).take(pa.array(row))],
                                                 names=["tree", "draw", "x"])

        drawn = written_table(rows_of.mapInArrow(pick, "tree int, draw double, x array<double>"), "draws")
        if not rows or bound == 2.0:
            return drawn
        least = drawn.groupBy("tree").count().agg(F.min("count").alias("n"), F.count("*").alias("trees")).first()
        if least["trees"] == trees and least["n"] >= wanted:
            return drawn
        cut = min(1.0, 2 * cut)


def fit_inputs(df: DataFrame, columns: Sequence[str] | None = None, hash_buckets: int = HASH_BUCKETS) -> dict:
    """0/1 columns for text (first level dropped), medians for missing numbers.

    Text with more levels than the one-hot encoder takes becomes `hash_buckets` 0/1
    columns, one for each part of the hash of its level.
    """
    names = list(columns or df.columns)
    source = df.select(*[F.col(f"`{c}`") for c in names])
    other = [n for n in names if not is_numeric(df.schema[n].dataType)]
    levels = OrderStatistics(source, other, in_order=False).distinct
    hashed = [n for n in other if levels[n] > ONE_HOT_LEVELS]
    few = [n for n in other if n not in hashed]
    encoder = fit_encoder(source, "one_hot", few, drop_first=True) if few else {"method": "one_hot", "steps": {}}
    wide = apply_encoder(source, encoder)
    numeric = [f.name for f in wide.schema.fields if is_numeric(f.dataType)]
    plain = [n for n in names if n in numeric]
    fills = fit_fills(source, "median", plain) if plain else {}
    return {"encoder": encoder, "fills": fills, "features": numeric, "hashed": hashed, "hash_buckets": hash_buckets}


def _features(df: DataFrame, inputs: dict) -> DataFrame:
    """Add the feature array `x`; the original columns stay untouched."""
    # Encoded copies under other names would hide the row itself: encode inside a struct-free copy.
    keep = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")
    wide = apply_encoder(df.select("*", keep), inputs["encoder"])
    wide = nan_to_null(wide, [n for n in inputs["features"] if n in wide.columns])
    have = set(wide.columns)
    x = F.array(*[
        F.coalesce(F.col(f"`{n}`").cast("double"), F.lit(float(inputs["fills"].get(n, 0.0)))) if n in have
        else F.lit(float(inputs["fills"].get(n, 0.0)))
        for n in inputs["features"]
    ]).cast("array<double>")
    buckets = inputs.get("hash_buckets", HASH_BUCKETS)
    for n in inputs.get("hashed", []):
        level = F.col(f"`{n}`").cast("string") if n in have else F.lit(None).cast("string")
        at = F.when(level.isNotNull(), F.pmod(F.xxhash64(level), F.lit(buckets)))
        x = F.concat(x, F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda b, at=at: F.when(at == b, 1.0).otherwise(0.0)))
    return wide.select("_row", x.alias("x"))


def fit_forest(df: DataFrame, columns: Sequence[str] | None = None, n_estimators: int = 100, random_state: int = 42,
               sample_size: int = SAMPLE_SIZE, hash_buckets: int = HASH_BUCKETS) -> dict:
    """The forest as a JSON-ready dict (at most 2 * sample_size - 1 nodes per tree)."""
    inputs = fit_inputs(df, columns, hash_buckets)
    sampled = _samples(_features(df, inputs).select("x"), n_estimators, random_state, sample_size)

    def build(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("draw", kind="stable")[:sample_size]
        return _grow(key[0], np.vstack(pdf["x"].to_numpy()), random_state).assign(size=len(pdf))

    nodes = sampled.groupBy("tree").applyInPandas(build, NODE_SCHEMA + ", size int").toPandas()
    nodes = nodes.sort_values(["tree", "node"])
    sample = int(nodes["size"].max()) if len(nodes) else 2
    forest = [
        {c: part[c].tolist() for c in ("feature", "threshold", "left", "right", "depth_value")}
        for _, part in nodes.groupby("tree")
    ]
    return {"inputs": inputs, "sample_size": sample, "forest": forest}


def _score_function(state: dict):
    forest = [{k: np.asarray(v) for k, v in t.items()} for t in state["forest"]]
    scale = max(float(average_path(state["sample_size"])), 1.0)

    @F.pandas_udf(T.DoubleType())
    def score(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=float)
        m = np.vstack(x.to_numpy())
        depth = np.zeros(len(m))
        every = np.arange(len(m))
        for t in forest:
            at = np.zeros(len(m), dtype=np.int64)
            while True:
                feature = t["feature"][at]
                inner = feature >= 0
                if not inner.any():
                    break
                left = m[every, np.where(inner, feature, 0)] <= t["threshold"][at]
                at = np.where(inner, np.where(left, t["left"][at], t["right"][at]), at)
            depth += t["depth_value"][at]
        # The anomaly score 2^(-depth / c) as a negative number: lower is more anomalous.
        return pd.Series(-np.power(2.0, -(depth / len(forest)) / scale))

    return score


def raw_scores(df: DataFrame, state: dict, name: str = "_raw") -> DataFrame:
    rows = _features(df, state["inputs"]).withColumn(name, _score_function(state)("x"))
    return rows.select("_row.*", name)


def fit_isolation_forest(df: DataFrame, columns: Sequence[str] | None = None, contamination: float = 0.05,
                         n_estimators: int = 100, random_state: int = 42, sample_size: int = SAMPLE_SIZE) -> dict:
    """Forest plus the score offset below which the wanted share of the rows lies, and the score range."""
    state = fit_forest(df, columns, n_estimators, random_state, sample_size)
    scored = raw_scores(df, state).select("_raw").persist()
    try:
        offset = exact_quantiles(scored, {"_raw": [contamination]})["_raw"][0]
        ends = scored.agg(F.min("_raw").alias("lo"), F.max("_raw").alias("hi")).first()
    finally:
        scored.unpersist()
    return {**state, "contamination": contamination, "offset": offset, "low": ends["lo"], "high": ends["hi"]}


def flag_anomalies(df: DataFrame, state: dict) -> DataFrame:
    """Add `is_anomaly` and `anomaly_score` (1 = most anomalous of the fitted table, 4 digits)."""
    width = (state["high"] or 0.0) - (state["low"] or 0.0)
    scored = raw_scores(df, state)
    score = F.lit(1.0) - (F.col("_raw") - F.lit(state["low"])) / F.lit(width) if width > 0 else F.lit(0.0)
    return scored.withColumns({
        "is_anomaly": (F.col("_raw") < F.lit(state["offset"])).cast("int"),
        "anomaly_score": F.bround(score, 4),
    }).drop("_raw")


def score_new_rows(df: DataFrame, state: dict) -> DataFrame:
    """Flag, squashed score, verdict and risk band for rows that the forest has not seen."""
    decision = F.col("_raw") - F.lit(state["offset"])
    scored = raw_scores(df, state).withColumns({
        "is_anomaly": (decision < 0).cast("int"), "anomaly_score": sigmoid_risk(decision),
    })
    return scored.withColumns({
        "verdict": verdict(F.col("is_anomaly")), "risk_level": risk_band(F.col("anomaly_score")),
    }).drop("_raw")


def anomaly_summary(flagged: DataFrame) -> DataFrame:
    """One row: total, anomalies, normal rows, percentage (2 digits)."""
    s = flagged.agg(F.count(F.lit(1)).alias("total_records"), F.count_if(F.col("is_anomaly") == 1).alias("anomaly_count"))
    return s.withColumns({
        "normal_count": F.col("total_records") - F.col("anomaly_count"),
        "anomaly_percentage": F.coalesce(
            percent(F.col("anomaly_count"), F.nullif(F.col("total_records"), F.lit(0))), F.lit(0.0)),
    })
