"""Distributed connected components: alternating large and small stars.

Edges shrink to a star around the least node of each component in a number of
rounds that grows with the logarithm of its size. Node lists never meet in one
task or on the driver: a node's least neighbour comes from a partial aggregate,
written as a table, and the join that hands it out is a shuffle join of two tables,
whose partitions adaptive execution splits when a hub (a node with a large part of
all edges) makes one large. (It splits no join that reads an aggregate directly.)

Cases: edges with a null end and from a node to itself are ignored; repeated edges
count once; no edges give no rows; nodes may be numbers or strings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow


def _contract(edges: DataFrame) -> DataFrame:
    """A spanning star per component of each partition's own edges (union-find within the task)."""
    schema = edges.schema

    def run(batches):
        import pyarrow as pa

        parent: dict = {}

        def find(x):
            root = x
            while parent.setdefault(root, root) != root:
                root = parent[root]
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        kinds = None
        for batch in batches:
            kinds = batch.schema
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                u, v = find(u), find(v)
                if u != v:
                    parent[max(u, v)] = min(u, v)
        if kinds is not None:
            pairs = [(x, r) for x in parent if (r := find(x)) != x]
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], kinds.field(i).type) for i in (0, 1)], ["u", "v"])

    return map_arrow(edges, run, schema)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(u, v) pairs -> (node, component): component is the least node; nodes without an edge are absent."""
    edges = edges.toDF("u", "v").filter("u is not null and v is not null and u <> v")
    edges = cut(_contract(edges).distinct(), "edges")  # u > v, here and below
    for _ in range(rounds):
        down = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
        least = edges.unionByName(down).groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("node")).alias("m"))
        large = down.join(cut(least, "least"), F.col("u") == F.col("node")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.distinct(), "large")
        least = cut(large.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")), "least")
        small = large.join(least, F.col("u") == F.col("node")).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.unionByName(least.toDF("u", "v")).distinct(), "edges")
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up")))
        ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("least"))
        if ends.filter("up > 1 or up = 1 and least = 0").isEmpty():  # stars: each other node has one centre and is none
            centres = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(centres)
    raise RuntimeError("components did not settle")
