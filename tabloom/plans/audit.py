"""Checks over a table of saved workflows, one row per workflow with JSON nodes and edges.

Every check is an expression on the row's own arrays, so any number of workflows is
audited in one pass without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import registry

NODES_SCHEMA = "array<struct<id:string,recipe_id:string>>"
EDGES_SCHEMA = "array<struct<source:string,target:string>>"


def _ids(nodes: Column) -> Column:
    return F.transform(nodes, lambda n: n["id"])


def has_cycle(ids: Column, edges: Column) -> Column:
    """Nodes without a predecessor are taken away, once per node; what is left lies on or behind a cycle."""
    left = F.aggregate(
        ids, ids,
        lambda rest, _: F.filter(
            rest, lambda n: F.exists(edges, lambda e: (e["target"] == n) & F.array_contains(rest, e["source"]))
        ),
    )
    return F.size(left) > 0


def audit_workflows(df: DataFrame, key: str, nodes: str = "nodes", edges: str = "edges") -> DataFrame:
    """`(key, n_nodes, n_edges, duplicate_ids, dangling_edges, orphan_nodes, trainers_without_split,
    missing_encoder, is_cyclic, is_valid)`; the graph checks are 0 while ids or edges are broken."""
    parsed = df.select(
        key, F.from_json(nodes, NODES_SCHEMA).alias("n"), F.from_json(edges, EDGES_SCHEMA).alias("e")
    ).withColumn("i", _ids(F.col("n")))
    n, e, i = F.col("n"), F.col("e"), F.col("i")
    trainers = registry.names("training")
    split_ids = F.transform(F.filter(n, lambda x: x["recipe_id"] == "train_test_split"), lambda x: x["id"])
    unsplit = F.filter(n, lambda x: x["recipe_id"].isin(*trainers)
                       & F.exists(e, lambda y: y["target"] == x["id"])
                       & ~F.exists(e, lambda y: (y["target"] == x["id"]) & F.array_contains(split_ids, y["source"])))
    recipes = F.transform(n, lambda x: x["recipe_id"])
    orphans = F.filter(i, lambda x: ~F.exists(e, lambda y: (y["source"] == x) | (y["target"] == x)))
    checked = parsed.select(
        key,
        F.size(i).alias("n_nodes"),
        F.size(e).alias("n_edges"),
        (F.size(i) - F.size(F.array_distinct(i))).alias("duplicate_ids"),
        F.size(F.filter(e, lambda y: ~F.array_contains(i, y["source"]) | ~F.array_contains(i, y["target"]))).alias("dangling_edges"),
        F.when(F.size(i) > 1, F.size(orphans)).otherwise(0).alias("orphan_nodes"),
        F.size(unsplit).alias("trainers_without_split"),
        F.when(F.exists(recipes, lambda r: r.isin(*trainers)) & ~F.array_contains(recipes, "categorical_encoder"), 1)
        .otherwise(0).alias("missing_encoder"),
        has_cycle(i, e).cast("int").alias("is_cyclic"),
    )
    broken = (F.col("duplicate_ids") > 0) | (F.col("dangling_edges") > 0)
    later = ("orphan_nodes", "trainers_without_split", "missing_encoder", "is_cyclic")
    out = checked.withColumns({c: F.when(broken, 0).otherwise(F.col(c)) for c in later})
    bad = broken | (F.col("orphan_nodes") > 0) | (F.col("trainers_without_split") > 0) | (F.col("is_cyclic") > 0)
    return out.withColumn("is_valid", (~bad).cast("int"))
