"""Connected components by alternating large-star and small-star rounds, in DataFrame joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import Scratch, few_files


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 30)), F.bit_xor(F.xxhash64("a", "b"))).first())


def connected_components(edges: DataFrame, scratch: Scratch, label: str = "cc") -> DataFrame:
    """For every node of edges (a, b) the smallest node that it reaches: node, component.

    Each round is written, so lineage stays short; rounds end when the stars no
    longer change, after about log(longest path) rounds.  Each node's least
    neighbour is written too: both sides of that join are then plain tables, and
    Spark may split the rows of a node with very many neighbours over tasks.
    """
    files = few_files(edges)
    now = scratch.write(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), f"{label}-0", files=files)
    state, k = _state(now), 0
    while state[0]:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = scratch.write(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), f"{label}-{k}-least", files=files)
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))  # a is the larger end here, so no node has very many
        small = large.join(small_least, "a")
        now = scratch.write(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(small_least.select("a", F.col("m").alias("b"))).distinct(), f"{label}-{k + 1}", files=files)
        scratch.drop(f"{label}-{k}", f"{label}-{k}-least")
        before, state, k = state, _state(now), k + 1
        if state == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
