"""Connected components of links between ids, by alternating star rounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import stored


def _find(parent: dict[int, int], x: int) -> int:
    root = x
    while (up := parent.get(root, root)) != root:
        root = up
    while parent.get(x, x) != root:
        parent[x], x = root, parent[x]
    return root


def _forest(max_nodes: int):
    """Links of a partition replaced by links of each id to its least partner there."""

    def run(it):
        parent: dict[int, int] = {}

        def flush():
            u = np.fromiter(parent, np.int64, len(parent))
            v = np.fromiter((_find(parent, x) for x in list(parent)), np.int64, len(parent))
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for batch in it:
            for a, b in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
                a, b = _find(parent, a), _find(parent, b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if len(parent) > max_nodes:
                yield flush()
                parent = {}
        if parent:
            yield flush()

    return run


def connected_components(links: DataFrame, max_nodes: int = 1_000_000) -> DataFrame:
    """(node, root) for each id that has a link in ``links`` (u, v), but for the roots; a root is the least id reachable.

    Links of a partition are thinned to a forest first. Then large-star and small-star rounds go on
    until nothing changes; a hub's links are spread by a minimum that is partly taken before the
    shuffle and by joins whose large partitions can be split. Each round is stored.
    """
    columns = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    links = links.where("u <> v").select(*columns)
    links = stored(links.mapInArrow(_forest(max_nodes), "u long, v long").where("u > v").distinct(), "links")
    state = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.greatest("e.v", "e.m").alias("u"), F.least("e.v", "e.m").alias("v"))
        links = stored(small.where("u > v").distinct(), "links")
        now = links.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if now == state:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now
