"""A pipeline from a spec of nodes and edges.

A spec is `{"nodes": [{"id", "recipe_id", "config"}], "edges": [{"source", "target"}]}`.
Tables stay lazy from node to node, so Spark optimises the whole chain; work starts
only where a node has to learn something, and at the sink.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.numeric import clean_non_finite
from . import registry


def run_pipeline(spec: dict, df: DataFrame | None = None) -> dict[str, dict]:
    """Outputs per node id. A node gets the outputs of all its parents; the last parent wins."""
    nodes = {n["id"]: n for n in spec["nodes"]}
    parents: dict[str, list[str]] = {i: [] for i in nodes}
    for edge in spec.get("edges", []):
        parents[edge["target"]].append(edge["source"])
    done: dict[str, dict] = {}
    running: set[str] = set()

    def outputs(node_id: str) -> dict:
        if node_id in done:
            return done[node_id]
        if node_id in running:
            raise ValueError(f"the pipeline has a cycle through {node_id}")
        running.add(node_id)
        inputs: dict = {"dataframe": df} if df is not None and not parents[node_id] else {}
        for parent in parents[node_id]:
            inputs.update(outputs(parent))
        node = nodes[node_id]
        entry = registry.get(node["recipe_id"])
        missing = [k for k in entry.needs if k not in inputs]
        if missing:
            raise ValueError(f"{node_id} ({entry.name}) lacks {', '.join(missing)}")
        running.discard(node_id)
        # What a step does not produce passes through to its children.
        done[node_id] = {**inputs, **entry.run(inputs, node.get("config", {}))}
        return done[node_id]

    return {i: outputs(i) for i in nodes}


def apply_operators(df: DataFrame, steps: list[tuple[str, dict]]) -> DataFrame:
    """A straight chain of table operators by name."""
    for name, config in steps:
        df = registry.get(name).run({"dataframe": df}, config)["dataframe"]
    return df


def step_snapshot(outputs: dict, rows: int = 5) -> dict:
    """Row count, columns and a few rows of one step; only on request, since it runs the step."""
    df = outputs["dataframe"]
    return {
        "row_count": df.count(),
        "columns": df.columns,
        "preview_rows": [r.asDict() for r in clean_non_finite(df.limit(rows)).collect()],
    }
