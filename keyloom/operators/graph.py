"""Graphs are edge tables (src, dst). Frontiers move by joins; lineage is cut at each hop."""

from __future__ import annotations

import itertools
import os
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint, in the session's shared folder; a local master without one gets a folder of its own."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(os.path.join(tempfile.gettempdir(), f"keyloom-graph-{os.getpid()}"))
    return df.checkpoint()


def reach(edges: DataFrame, seeds: DataFrame, hops: int | None = None) -> DataFrame:
    """(seed, node, depth) for nodes within so many hops of each seed, itself at 0, depth the fewest hops. seeds: a column seed."""
    edges = edges.select("src", "dst").distinct()
    visited = front = _cut(seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth")).distinct())
    k = 0
    while hops is None or k < hops:
        k += 1
        nxt = front.join(edges, front["node"] == edges["src"]).select("seed", F.col("dst").alias("node")).distinct()
        front = _cut(nxt.join(visited, ["seed", "node"], "left_anti").withColumn("depth", F.lit(k)))
        if front.isEmpty():
            break
        visited = _cut(visited.union(front))
    return visited


def shortest_path_length(edges: DataFrame, src: object, dst: object, limit: int | None = None) -> int | None:
    """The fewest hops between two nodes, from both ends at once; None if there is no path, or none of up to limit hops if that is given."""
    if src == dst:
        return 0
    spark = edges.sparkSession
    kind = edges.schema["src"].dataType.simpleString()
    one = lambda v: spark.range(1).select(F.lit(v).cast(kind).alias("node"))
    ways = [edges.select("src", "dst").distinct(), edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct()]
    seen, front = [one(src), one(dst)], [one(src), one(dst)]
    for k in itertools.count(1) if limit is None else range(1, limit + 1):  # ends when one side has no new node
        s = (k + 1) % 2
        nxt = front[s].join(ways[s], front[s]["node"] == ways[s]["src"]).select(F.col("dst").alias("node")).distinct().join(seen[s], "node", "left_anti")
        front[s] = _cut(nxt)
        if front[s].isEmpty():
            return None
        if not front[s].join(seen[1 - s], "node", "left_semi").isEmpty():
            return k
        seen[s] = seen[s].union(front[s])
    return None
