"""What both vector searches share: usable rows, bounded samples, and blocks of queries against blocks of rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motorfisc.llm.common import bounded_sample

#: Queries, and rows, of one block at most on average: what one call of a search function sees.
BLOCK = 4096
#: Entries of the largest table of points by centres that is held at once.
_CELLS = 1 << 21
FOUND = "query_id long, vec_id long, score {kind}"


def usable(table: DataFrame, vector: Column, zero: bool = True) -> DataFrame:
    """(vec_id, v): rows with an id and a vector of the usual length whose components are finite numbers.

    The usual length is that of most vectors (of several, the longest). With ``zero`` false, vectors without a
    component other than 0 are left out too. Names of other columns don't matter, as they are not kept.
    """
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("v"), F.col("embedding").cast("array<double>").alias("raw"))
    finite = F.forall("raw", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("raw").isNotNull() & (F.size("raw") > 0) & F.coalesce(finite, F.lit(False)))
    if not zero:
        rows = rows.where(F.exists("raw", lambda x: x != 0))
    usual = rows.groupBy(F.size("raw").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("raw") == (usual["n"] if usual else 0)).select("vec_id", "v")


def queries_of(rows: DataFrame) -> DataFrame:
    """The stated query set: rows whose id is divisible by 100, one for each id."""
    return rows.where("vec_id % 100 = 0").groupBy("vec_id").agg(F.min("v").alias("v"))


def sample_with_ids(rows: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of ``most`` rows at most, of different ids, by the hash of their ids: the same in every run."""
    found = bounded_sample(rows.select("vec_id", "v"), most, "sample", "vec_id").toPandas()
    return found["vec_id"].to_numpy(), np.stack(found["v"].to_list()).astype(float) if len(found) else np.zeros((0, 0))


def sample(rows: DataFrame, most: int) -> np.ndarray:
    """The vectors of ``sample_with_ids``."""
    return sample_with_ids(rows, most)[1]


def nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each point and the squared distance to it."""
    at, squared, lengths = np.zeros(len(points), dtype=np.int64), np.zeros(len(points)), (centres**2).sum(1)
    step = max(1, _CELLS // max(1, len(centres)))
    for i in range(0, len(points), step):
        part = points[i : i + step]
        table = np.maximum((part**2).sum(1)[:, None] - 2 * part @ centres.T + lengths, 0)
        at[i : i + step] = table.argmin(1)
        squared[i : i + step] = table.min(1)
    return at, squared


def k_means(points: np.ndarray, n: int, rounds: int = 12) -> np.ndarray:
    """Centres from a bounded sample; starts from evenly spaced rows, and an empty centre stays where it was."""
    centres = points[np.linspace(0, len(points) - 1, n).astype(int)]
    for _ in range(rounds):
        at, _ = nearest(points, centres)
        counts = np.bincount(at, minlength=n)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, points)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def search_blocks(queries: DataFrame, rows: DataFrame, key: str, search: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], kind: str, keys: int) -> DataFrame:
    """Calls ``search`` on each block of queries with each block of rows of the same key: (query_id, vec_id, score).

    A key with many rows or queries is cut into blocks by a hash of the id and vector, so that one very common
    vector, or id, spreads over as many tasks as its rows need. ``keys`` is the number of keys that there can be: the table of blocks by key,
    which is broadcast, has no more rows than that.
    """
    by = lambda df, name: df.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))
    parts = by(queries, "query_parts").join(by(rows, "row_parts"), key)
    parts = F.broadcast(parts.limit(keys))
    block = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = queries.join(parts, key).select("*", block("query_parts").alias("query_block"), every("row_parts").alias("row_block"))
    right = rows.join(parts, key).select("*", block("row_parts").alias("row_block"), every("query_parts").alias("query_block"))
    names = [key, "query_block", "row_block"]
    # columns of their own for each side, as both may come from one table
    left, right = (df.select(*[F.col(c).alias(c) for c in df.columns if not c.endswith("_parts")]) for df in (left, right))
    return left.groupBy(*names).cogroup(right.groupBy(*names)).applyInPandas(search, FOUND.format(kind=kind))


def best(found: DataFrame, order: Column, k: int) -> DataFrame:
    """The first ``k`` of each query: (query_id, rank, vec_id, score). Blocks have cut theirs to ``k`` before."""
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(order, "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
