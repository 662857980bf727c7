"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Up to so many edges (16 MB) one executor task finds the components; beyond, contraction does.
LOCAL_EDGES = 1 << 20


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(b.column(0).to_numpy(False), b.column(1).to_numpy(False)) for b in batches if b.num_rows]
    if not parts:
        return
    a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
    names, where = np.unique(np.concatenate((a, b)), return_inverse=True)
    root = np.arange(len(names))
    u, v = where[: len(a)], where[len(a) :]
    while len(u):  # hook larger roots to smaller ones, then shorten all paths
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while (root[root] != root).any():
            root = root[root]
        u, v = root[u], root[v]
        u, v = u[u != v], v[u != v]
    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[root])], ["node", "label"])


def connected_components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, label) for every node of ``edges`` (two long columns a, b); label is the component's smallest node.

    Rows with a null end are ignored, loops give a component of one. No edges: no rows.
    """
    edges = materialise(edges.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b"), "edges")
    if edges.count() <= local_edges:
        return materialise(edges.repartition(1).mapInArrow(_union_find, "node long, label long"), "labels")
    labels = edges.selectExpr("a AS node").union(edges.selectExpr("b AS node")).distinct().selectExpr("node", "node AS label")
    edges = edges.where("a <> b")
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = materialise(both.groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("v"), F.least("a", "p").alias("p")), "parents")
        jump = parent.selectExpr("v AS jv", "p AS jp")
        parent = materialise(parent.join(jump, F.col("p") == F.col("jv"), "left").select("v", F.coalesce("jp", "p").alias("p")), "parents")
        labels = materialise(labels.join(parent, F.col("label") == F.col("v"), "left").select("node", F.coalesce("p", "label").alias("label")), "labels")
        pa_, pb = parent.selectExpr("v AS va", "p AS ra"), parent.selectExpr("v AS vb", "p AS rb")
        edges = materialise(
            edges.join(pa_, F.col("a") == F.col("va")).join(pb, F.col("b") == F.col("vb")).where("ra <> rb").selectExpr("ra AS a", "rb AS b").distinct(), "edges"
        )
    return labels
