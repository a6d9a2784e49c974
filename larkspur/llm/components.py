"""Connected components of an edge table by alternating large and small stars, without collecting it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import cut, discard

_EDGES = "a bigint, b bigint"


def _forest(edges: DataFrame) -> DataFrame:
    """Each partition's edges contracted to stars: at most one edge for each of its nodes is shuffled on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parent.setdefault(a, a)
                parent.setdefault(b, b)
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        nodes = [(x, root(x)) for x in parent]
        stars = [(x, r) for x, r in nodes if x != r]
        for i in range(0, len(stars), 50_000):
            part = stars[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in part], pa.int64()), pa.array([r for _, r in part], pa.int64())], names=["a", "b"])

    return edges.mapInArrow(run, _EDGES)


def _with_least(rows: DataFrame, made: list[DataFrame]) -> DataFrame:
    """Rows (u, v) with ``least``, the smallest v of u.

    The minima, combined map-side, are written first: then both sides of the join are read from
    shuffles of their own, which is where adaptive execution can split the rows of a hot u.
    """
    made.append(cut(rows.groupBy("u").agg(F.min("v").alias("least"))))
    return rows.join(made[-1], "u")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b), both long: root is the smallest node of the component.

    Nodes without edges do not appear. Each round is written before the next one and the one before
    is deleted; rounds go on until nothing changes, their number grows with the logarithm of the
    largest component.
    """
    now, before = cut(_forest(edges.select("a", "b").where("a <> b"))), None
    while True:
        made = [now]
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = cut(_with_least(both, made).select("v", "u", F.least("least", "u").alias("m")).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        made.append(large)
        small = _with_least(large, made)
        linked = small.select(F.col("v").alias("a"), F.col("least").alias("b")).where("a <> b").union(small.select(F.col("u").alias("a"), F.col("least").alias("b")))
        now = cut(_forest(linked.distinct()).distinct())
        discard(*made)
        state = now.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum((F.xxhash64("a", "b") % 1_000_003)), F.lit(0)).alias("h"), F.count_distinct("a").alias("k")).first()
        # Done when every node has one parent and a round changes nothing.
        if before == tuple(state) and state["n"] == state["k"]:
            out = cut(now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()))
            discard(now)
            return out
        before = tuple(state)
