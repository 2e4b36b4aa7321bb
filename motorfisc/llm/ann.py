"""Approximate nearest neighbours: inverted lists, scanned by blocks of rotated dimensions with early rejection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motorfisc.llm.common import settle, table
from motorfisc.llm.vectors import best, k_means, nearest, sample, search_blocks, usable

K = 10
#: Vectors that lists are fitted on at most. Lists: LISTS times the square root of the rows.
#: A list has LEAST_FIT of the fitted vectors on average at least.
FIT_ROWS, LISTS, LEAST_FIT = 1 << 15, 1.0, 8
#: Share of the lists that a query probes, its nearest ones first; at least so many. The share is that large as vectors
#: spread evenly over all directions lie about as near in one list as in the next; clustered ones need far less.
PROBED, LEAST_PROBED = 0.85, 16
#: Rotated dimensions that a step adds, and the width of the test: larger rejects less and later.
STEP, EPSILON = 16, 2.1
#: Pairs of a query and a row whose partial distances are held at once.
_PAIRS = 1 << 20
SEED = 42


def rotation(dimensions: int) -> np.ndarray:
    """A random orthogonal matrix, the same one for the same number of dimensions."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dimensions, dimensions)))
    return q * np.sign(np.diag(r))


def scan(queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, turned: tuple[np.ndarray, np.ndarray], known: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query position, row position, distance) of the rows that come into question as the k nearest of a query.

    ``turned`` are the rotated queries and rows, ``known`` the distances that the queries' k-th nearest rows have at
    most by what was searched before (infinite: nothing was). A first step over STEP rotated dimensions gives every
    pair a partial distance. Where nothing is known, the k rows that look nearest are measured in full, and the
    farthest of them is the query's bound. A pair goes as soon as its partial distance, scaled up to all dimensions,
    exceeds the bound by more than the test allows for the dimensions seen. What is left after the last step is
    measured on the original vectors in double precision.
    """
    q, c = turned
    n = q.shape[1]
    seen = min(STEP, n)
    partial = np.maximum((q[:, :seen] ** 2).sum(1)[:, None] - 2 * q[:, :seen] @ c[:, :seen].T + (c[:, :seen] ** 2).sum(1), 0)
    partial[ids[:, None] == row_ids] = np.inf
    bound = known**2
    new = np.flatnonzero(np.isinf(bound))
    if len(new) and len(rows) >= k:
        near = np.argpartition(partial[new], k - 1, axis=1)[:, :k]
        full = ((q[new, None, :] - c[near]) ** 2).sum(2)
        full[np.isinf(np.take_along_axis(partial[new], near, 1))] = np.inf
        bound[new] = full.max(1)
    # the first step's products round in the last digits of the squared lengths, which counts where vectors repeat
    bound = bound + 1e-11 * ((q**2).sum(1) + (c**2).sum(1).max(initial=0))

    def passes(squared: np.ndarray, at: np.ndarray) -> np.ndarray:
        return squared * (n / seen) <= (1 + EPSILON / np.sqrt(seen)) ** 2 * bound[at] * (1 + 1e-9)

    a, b = np.nonzero((partial * (n / seen) <= ((1 + EPSILON / np.sqrt(seen)) ** 2 * bound * (1 + 1e-9))[:, None]) & np.isfinite(partial))
    squared = partial[a, b]
    while seen < n:
        more = slice(seen, min(seen + STEP, n))
        block_q, block_c = np.ascontiguousarray(q[:, more]), np.ascontiguousarray(c[:, more])
        squared = squared + ((block_q[a] - block_c[b]) ** 2).sum(1)
        seen = more.stop
        # with all dimensions seen the distance is no guess any more
        keep = passes(squared, a) if seen < n else squared <= bound[a] * (1 + 1e-6)
        a, b, squared = a[keep], b[keep], squared[keep]
    distance = np.sqrt(((queries[a] - rows[b]) ** 2).sum(1))
    order = np.lexsort((row_ids[b], distance, a))
    a, b, distance = a[order], b[order], distance[order]
    first = np.searchsorted(a, np.arange(len(q)))
    keep = np.arange(len(a)) - first[a] < k
    return a[keep], b[keep], distance[keep]


def _searcher(k: int):
    def search(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(rows):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        whole = lambda column: np.stack(column.to_list()).astype(float)
        ids, row_ids, known = queries["vec_id"].to_numpy(), rows["vec_id"].to_numpy(), queries["known"].to_numpy(dtype=float)
        v, turned, points, turned_points = whole(queries["v"]), whole(queries["turned"]), whole(rows["v"]), whole(rows["turned"])
        out, step = [], max(1, _PAIRS // len(points))
        for at in range(0, len(queries), step):
            part = slice(at, at + step)
            a, b, d = scan(v[part], ids[part], points, row_ids, (turned[part], turned_points), known[part], k)
            out.append(pd.DataFrame({"query_id": ids[part][a], "vec_id": row_ids[b], "score": d}))
        return pd.concat(out)

    return search


def search(vectors: DataFrame, k: int = K) -> DataFrame:
    """(vec_id, embedding) -> each query's ``k`` nearest found: (query_id, rank, vec_id, score).

    Queries are the rows whose vec_id is divisible by 100, candidates all rows with another id; the score is the
    Euclidean distance of the original vectors. Ties go to the smaller vec_id. A query probes its nearest lists, and
    more of them until they hold k rows beside its own, so that none comes back with fewer than there are. Rows
    without an id, and vectors that are null, zero, of an unusual length or hold null or non-finite components, take
    no part. Of repeated query ids one row asks; repeated candidates are listed as often as they occur. An empty
    table gives an empty result. The lists are fitted on FIT_ROWS vectors at most and hold every row.
    """
    rows = settle(usable(vectors, F.col("embedding"), zero=False))
    total = rows.count()
    spark, fitted = vectors.sparkSession, sample(rows, FIT_ROWS)
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lists = max(1, min(-(-len(fitted) // LEAST_FIT), round(LISTS * total**0.5)))
    centres, turn = (spark.sparkContext.broadcast(x) for x in (k_means(fitted, lists), rotation(fitted.shape[1])))

    @F.pandas_udf("list int, turned array<double>")
    def list_of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for v in batches:
            points = np.stack(v.to_list()).astype(float) if len(v) else np.zeros((0, len(turn.value)))
            yield pd.DataFrame({"list": nearest(points, centres.value)[0].astype(np.int32), "turned": pd.Series(list(points @ turn.value), dtype=object)})

    listed = settle(rows.withColumn("_l", list_of("v")).select("vec_id", "v", "_l.list", "_l.turned"))
    sizes = np.zeros(lists, dtype=np.int64)
    for at, n in listed.groupBy("list").count().collect():  # a row for each list
        sizes[at] = n
    probed = max(LEAST_PROBED, round(PROBED * lists))

    @F.pandas_udf("near array<int>, more array<int>")
    def lists_of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for v in batches:
            near, more = [], []
            for point in v:
                order = ((np.asarray(point, dtype=float) - centres.value) ** 2).sum(1).argsort(kind="stable").astype(np.int32)
                enough = int(np.searchsorted(sizes[order].cumsum(), k + 1)) + 1
                near.append(order[:enough])
                more.append(order[enough:probed])
            yield pd.DataFrame({"near": pd.Series(near, dtype=object), "more": pd.Series(more, dtype=object)})

    # first the nearest lists that hold enough rows, then the others with the distances found there as bounds
    asking = settle(listed.where("vec_id % 100 = 0").groupBy("vec_id").agg(F.min(F.struct("v", "turned")).alias("q")).select("vec_id", "q.v", "q.turned").withColumn("_l", lists_of("v")).select("vec_id", "v", "turned", "_l.near", "_l.more"))
    own = ["vec_id", "v", "turned", "known", "list"]
    first = asking.withColumn("known", F.lit(float("inf"))).withColumn("list", F.explode("near")).select(*own)
    found = settle(best(search_blocks(first, listed, "list", _searcher(k), "double", lists), F.col("score"), k))
    bounds = found.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("known"))
    rest = asking.join(bounds, "vec_id", "left").withColumn("known", F.coalesce("known", F.lit(float("inf")))).withColumn("list", F.explode("more")).select(*own)
    more = search_blocks(settle(rest), listed, "list", _searcher(k), "double", lists)
    return best(found.drop("rank").unionByName(more), F.col("score"), k)


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest found of every hundredth embedding."""
    return search(table(spark, sf_dir, "embeddings"))
