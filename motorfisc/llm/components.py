"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motorfisc.llm.common import settle


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def _stars(edges: DataFrame, both_ways: bool) -> DataFrame:
    """One contraction: hangs neighbours on the smallest id around each node.

    Minima are aggregated (with a partial step before the shuffle) and joined back, so that a node with very many
    links is never gathered in one task.
    """
    around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both_ways else edges
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = around.join(least, "u")
    if both_ways:
        hung = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        hung = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return hung.where("u > v").distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``links`` (u, v) of longs -> (node, component), component being the smallest node reachable.

    Self links and repeats may occur; rows with a null end are ignored; nodes without links don't appear. Each round
    is written to the checkpoint folder, so a lost executor costs one round at most.
    """
    edges = settle(links.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _mark(edges)
    for _ in range(max_rounds):
        edges = settle(_stars(_stars(edges, True), False))
        now = _mark(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
