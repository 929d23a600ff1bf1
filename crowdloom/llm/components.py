"""Connected components of an edge table by union-find in tasks and star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def _forest(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Union-find over the edges of one task: each vertex once, with its root. When more
    than `most` vertices are held, what is known goes out and the forest starts anew."""
    up: dict[int, int] = {}

    def root(v: int) -> int:
        while up[v] != v:
            up[v] = v = up[up[v]]
        return v

    def rows() -> pa.RecordBatch:
        pairs = [(v, r) for v in up if (r := root(v)) != v]
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["hi", "lo"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(up.setdefault(a, a) if a not in up else a), root(up.setdefault(b, b) if b not in up else b)
            if a != b:
                up[max(a, b)] = min(a, b)
        if len(up) > most:
            yield rows()
            up.clear()
    yield rows()


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(vertex, root) for every vertex that has an edge and isn't a root itself; root is
    the least vertex of its component. Large-star and small-star steps alternate until
    nothing changes; each step is a minimum by vertex and a join, so a vertex with very
    many edges is pre-aggregated and its rows can be split."""
    ends = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    held = settle(ends.mapInArrow(_forest, "hi long, lo long").distinct(), "forest")
    before = None
    while True:
        state = held.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            return held.select(F.col("hi").alias("vertex"), F.col("lo").alias("root"))
        before = state
        both = held.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(held.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        lowest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(lowest, "hi").select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e")).select("e.*")
        held = settle(small.where("hi <> lo").distinct(), "stars")
