"""Model producers: fit on DataFrames and write the result as a scoring document."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def k_means(df: DataFrame, columns: list[str], k: int, iterations: int = 20, seed: int = 1, tolerance: float = 1e-6) -> list[list[float]]:
    """Lloyd's iterations; each is one aggregation whose result has k rows, so only centres reach the driver."""
    points = df.select(*(F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate(columns)))
    centres = [list(r) for r in points.distinct().orderBy(F.xxhash64(*points.columns, F.lit(seed))).limit(k).collect()]
    for _ in range(iterations):
        distances = [sum((F.col(f"x{j}") - v) * (F.col(f"x{j}") - v) for j, v in enumerate(c)) for c in centres]
        nearest = F.array_position(F.array(*distances), F.least(*distances) if len(distances) > 1 else distances[0]) - 1
        rows = points.groupBy(nearest.cast("int").alias("c")).agg(*(F.avg(f"x{j}").alias(f"x{j}") for j in range(len(columns)))).collect()
        new = list(centres)
        for r in rows:
            new[r.c] = [r[f"x{j}"] for j in range(len(columns))]
        moved = max(abs(a - b) for x, y in zip(centres, new, strict=True) for a, b in zip(x, y, strict=True))
        centres = new
        if moved < tolerance:
            break
    return centres


def record_of(columns: list[str], name: str = "Datum", kind: str = "double") -> dict:
    return {"type": "record", "name": name, "fields": [{"name": c, "type": kind} for c in columns]}


def vector_of(columns: list[str]) -> dict:
    return {"new": [f"input.{c}" for c in columns], "type": {"type": "array", "items": "double"}}


def k_means_document(centres: list[list[float]], columns: list[str]) -> dict[str, Any]:
    fields = [{"name": "center", "type": {"type": "array", "items": "double"}}, {"name": "id", "type": "string"}]
    clusters = {"type": {"type": "array", "items": {"type": "record", "name": "Cluster", "fields": fields}}, "init": [{"center": c, "id": str(k)} for k, c in enumerate(centres)]}
    return {"input": record_of(columns), "output": "string", "cells": {"clusters": clusters}, "action": {"attr": {"model.cluster.closest": [vector_of(columns), {"cell": "clusters"}]}, "path": [["id"]]}}


def linear_document(coefficients: list[float], constant: float, columns: list[str], link: str | None = None) -> dict[str, Any]:
    """A linear model of pyspark.ml (its coefficients and intercept), with a link function if wanted."""
    fields = [{"name": "coeff", "type": {"type": "array", "items": "double"}}, {"name": "const", "type": "double"}]
    cell = {"type": {"type": "record", "name": "Regression", "fields": fields}, "init": {"coeff": [float(c) for c in coefficients], "const": float(constant)}}
    score: Any = {"model.reg.linear": [vector_of(columns), {"cell": "model"}]}
    return {"input": record_of(columns), "output": "double", "cells": {"model": cell}, "action": {link: [score]} if link else score}


def tree_document(model: Any, columns: list[str]) -> dict[str, Any]:
    """A fitted decision tree of pyspark.ml, read through its nodes."""

    def node(n: Any) -> dict:
        if n.numDescendants() == 0:
            return {"double": float(n.prediction())}
        split = n.split()
        inner = {"field": columns[split.featureIndex()], "operator": "<=", "value": float(split.threshold()), "pass": node(n.leftChild()), "fail": node(n.rightChild())}
        return {"TreeNode": inner}

    root = node(model._java_obj.rootNode())
    kind = {"type": "record", "name": "TreeNode", "fields": [{"name": "field", "type": "string"}, {"name": "operator", "type": "string"}, {"name": "value", "type": "double"}, {"name": "pass", "type": ["TreeNode", "double"]}, {"name": "fail", "type": ["TreeNode", "double"]}]}
    if "double" in root:
        return {"input": record_of(columns), "output": "double", "action": {"double": root["double"]}}
    return {"input": record_of(columns), "output": "double", "cells": {"tree": {"type": kind, "init": root["TreeNode"]}}, "action": {"model.tree.simpleTree": ["input", {"cell": "tree"}]}}
