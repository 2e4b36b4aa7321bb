"""Exact top-k by inner product: cover trees over queries and rows, searched together."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motorfisc.llm.common import settle, table
from motorfisc.llm.vectors import BLOCK, best, nearest, queries_of, sample, sample_with_ids, search_blocks, usable

K = 10
SCALE = 1024
#: Vectors that serve as the roots of the data's cover trees, and of the queries' (one for each block of queries, at most
#: so many); rows that give first scores.
ROOTS, QUERY_ROOTS, SEEDS = 64, 8, 1024
#: A node of so many rows, or queries, isn't split further.
LEAF, QUERY_LEAF = 96, 32
#: Rows that a leaf of queries is compared with at once.
_BASE = 4096
_EXACT = float(1 << 53)
_LONG = 1 << 63


@dataclass
class Node:
    """A cover-tree node: a point as centre, the radius that covers its points, and children of half that radius at most.

    Of the children, which in many dimensions are many, the centres, lengths and radii stand in arrays.
    """

    centre: np.ndarray
    radius: float
    points: np.ndarray
    children: list[Node] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.norm = float(np.sqrt((self.centre**2).sum()))
        if self.children:
            self.centres = np.stack([c.centre for c in self.children])
            self.norms, self.radii = np.array([c.norm for c in self.children]), np.array([c.radius for c in self.children])


def cover_tree(vectors: np.ndarray, leaf: int = LEAF, points: np.ndarray | None = None, centre: np.ndarray | None = None) -> Node:
    """Splits points among centres that are more than half the radius apart and cover all within half the radius.

    A node's own centre is the first of its children's; the others are picked farthest first, as many as halving the
    radius takes. Each point goes to its nearest centre.
    """
    points = np.arange(len(vectors)) if points is None else points
    own = vectors[points]
    centre = own[((own - own.mean(0)) ** 2).sum(1).argmin()] if centre is None else centre
    away = np.sqrt(((own - centre) ** 2).sum(1))
    radius = float(away.max())
    if len(points) <= leaf or radius == 0:
        return Node(centre, radius, points)
    owner, lengths, centres = np.zeros(len(points), dtype=np.int64), (own**2).sum(1), [centre]
    while away.max() > radius / 2:
        at = int(away.argmax())
        d = np.sqrt(np.maximum(lengths + lengths[at] - 2 * (own @ own[at]), 0))
        d[at] = 0
        closer = d < away
        owner[closer], away = len(centres), np.minimum(away, d)
        centres.append(own[at])
    order = np.argsort(owner, kind="stable")
    parts = np.split(np.arange(len(points))[order], np.flatnonzero(np.diff(owner[order])) + 1)
    children = [(points[p], centres[owner[p[0]]]) for p in parts]
    return Node(centre, radius, points, [cover_tree(vectors, leaf, p, c) if len(p) > 1 else Node(c, 0.0, p) for p, c in children])


class DualSearch:
    """Top k of queries over rows: scores and ids so far, and the search of a pair of nodes."""

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, floor: np.ndarray, k: int) -> None:
        self.queries, self.query_ids, self.rows, self.row_ids, self.floor = queries, query_ids, rows, row_ids, floor
        largest = np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0) * queries.shape[1]
        self.exact = largest < _EXACT
        self.slack = largest * 1e-9 + 1
        self.scores = np.full((len(queries), k), -np.inf)
        self.ids = np.full((len(queries), k), np.iinfo(np.int64).max)

    def worst(self, points: np.ndarray) -> float:
        """The least score that could still enter the top k of one of these queries."""
        return float(np.maximum(self.scores[points, -1], self.floor[points]).min())

    def bounds(self, q: Node, centres: np.ndarray, norms: np.ndarray, radii: np.ndarray) -> np.ndarray:
        """No query of q scores higher with a row of these nodes."""
        return centres @ q.centre + q.radius * norms + radii * q.norm + q.radius * radii + self.slack

    def bound(self, q: Node, r: Node) -> float:
        return float(self.bounds(q, r.centre[None], np.array([r.norm]), np.array([r.radius]))[0])

    def search(self, q: Node, r: Node) -> None:
        if self.bound(q, r) < self.worst(q.points):
            return
        if not q.children and not r.children:
            self.base(q.points, r.points)
        elif r.children and (r.radius >= q.radius or not q.children):
            self.open_rows(q, r)
        else:
            # of queries the same bound holds the other way round
            self_bounds = self.bounds(r, q.centres, q.norms, q.radii)
            for i in np.argsort(-self_bounds, kind="stable"):
                self.search(q.children[i], r)

    def open_rows(self, q: Node, r: Node) -> None:
        """Searches the children of r, those that promise most first; the points of the childless ones in one go."""
        reach = self.bounds(q, r.centres, r.norms, r.radii)
        order = np.argsort(-reach, kind="stable")
        order = order[reach[order] >= self.worst(q.points)]
        plain = [i for i in order if not r.children[i].children]
        if plain and q.children:
            for child in q.children:
                own = self.bounds(child, r.centres[plain], r.norms[plain], r.radii[plain]) >= self.worst(child.points)
                self.plain(child, [r.children[i] for i, kept in zip(plain, own, strict=True) if kept])
        else:
            self.plain(q, [r.children[i] for i in plain])
        for i in order:
            if r.children[i].children:
                self.search(q, r.children[i])

    def plain(self, q: Node, nodes: list[Node]) -> None:
        """Rows of childless nodes, against the leaves under q."""
        if not nodes:
            return
        if q.children:
            centres, norms, radii = np.stack([n.centre for n in nodes]), np.array([n.norm for n in nodes]), np.array([n.radius for n in nodes])
            for child in q.children:
                kept = self.bounds(child, centres, norms, radii) >= self.worst(child.points)
                self.plain(child, [n for n, k in zip(nodes, kept, strict=True) if k])
            return
        points = np.concatenate([n.points for n in nodes])
        for at in range(0, len(points), _BASE):
            self.base(q.points, points[at : at + _BASE])

    def base(self, qs: np.ndarray, rs: np.ndarray) -> None:
        scores = self.queries[qs] @ self.rows[rs].T
        scores[self.query_ids[qs][:, None] == self.row_ids[rs]] = -np.inf
        least = np.maximum(self.scores[qs, -1], self.floor[qs])
        a, b = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
        if not len(a):
            return
        touched, k = np.unique(a), self.scores.shape[1]
        owner = np.concatenate([np.repeat(touched, k), a])
        score = np.concatenate([self.scores[qs[touched]].ravel(), scores[a, b]])
        ids = np.concatenate([self.ids[qs[touched]].ravel(), self.row_ids[rs[b]]])
        order = np.lexsort((ids, -score, owner))
        first = np.searchsorted(owner[order], touched)
        kept = order[(first[:, None] + np.arange(k)).ravel()]
        self.scores[qs[touched]], self.ids[qs[touched]] = score[kept].reshape(-1, k), ids[kept].reshape(-1, k)


def _large(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """Blocks whose scores outgrow exact doubles: Python's whole numbers, held to the range of a long."""
    q = np.stack(queries["v"].to_list()).astype(object)
    r = np.stack(rows["v"].to_list()).astype(object)
    out = []
    for one, query in zip(q, queries["vec_id"], strict=True):
        pairs = sorted((-min(_LONG - 1, max(-_LONG, int(s))), int(i)) for s, i in zip(r @ one, rows["vec_id"], strict=True) if i != query)
        out += [(query, i, -s) for s, i in pairs[:k]]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])


def _searcher(k: int):
    def search(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(rows):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        q, r = (np.stack(x["v"].to_list()).astype(float) for x in (queries, rows))
        ids = queries["vec_id"].to_numpy()
        dual = DualSearch(q, ids, r, rows["vec_id"].to_numpy(), queries["floor"].to_numpy(), k)
        if not dual.exact:
            return _large(queries, rows, k)
        dual.search(cover_tree(q, QUERY_LEAF), cover_tree(r))
        found = np.isfinite(dual.scores)
        return pd.DataFrame({"query_id": np.broadcast_to(ids[:, None], found.shape)[found], "vec_id": dual.ids[found], "score": dual.scores[found].astype(np.int64)})

    return search


def _root_udf(roots):
    @F.pandas_udf("root int, away double")
    def root_of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for v in batches:
            at, squared = nearest(np.stack(v.to_list()).astype(float), roots.value) if len(v) else (np.zeros(0), np.zeros(0))
            yield pd.DataFrame({"root": at.astype(np.int32), "away": np.sqrt(squared)})

    return root_of


def floors(queries: np.ndarray, query_ids: np.ndarray, seeds: np.ndarray, seed_ids: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score of each query over the seeds with another id, a little less; with fewer than k no floor."""
    if len(seeds) < k:
        return np.full(len(queries), -np.inf)
    scores = queries @ seeds.T
    scores[query_ids[:, None] == seed_ids] = -np.inf
    least = np.partition(scores, -k, axis=1)[:, -k]
    return np.where(np.isfinite(least), least - 1e-9 * np.abs(least) - 1, -np.inf)


def search(vectors: DataFrame, k: int = K) -> DataFrame:
    """(vec_id, embedding) -> each query's ``k`` highest scores: (query_id, rank, vec_id, score).

    Components are floor(1024 * x) as whole numbers, the score is their inner product, a long (beyond the range of a
    long: the nearest long). Queries are the rows whose vec_id is divisible by 100, candidates all rows with another
    id. Ties go to the smaller vec_id; a query with fewer candidates gets all. Rows without an id, and vectors that
    are null, of an unusual length or hold null or non-finite components, take no part. Of repeated query ids one row
    asks; repeated candidates are listed as often as they occur. An empty table gives an empty result.

    The roots of the trees are a bounded sample. A query's score floor is its k-th score over SEEDS rows with
    another id. Pairs of a
    query root and a row root whose covering radii can't reach the least floor below are dropped before any row is
    sent anywhere; the blocks of the others are searched by a pair of cover trees. Every row is under a root.
    """
    whole = F.transform("embedding", lambda x: F.floor(SCALE * x.cast("double")).cast("long"))
    rows = settle(usable(vectors, whole))
    asking = queries_of(rows)
    spark = vectors.sparkSession
    (point_ids, points), query_points = sample_with_ids(rows, SEEDS), sample(asking, min(QUERY_ROOTS, -(-asking.count() // BLOCK)))
    if not len(points) or not len(query_points):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    share = spark.sparkContext.broadcast
    row_roots, query_roots, seeds = share(points[:ROOTS]), share(query_points), share((point_ids, points))

    @F.pandas_udf("double")
    def floor_of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for own, v in batches:
            yield pd.Series(floors(np.stack(v.to_list()).astype(float), own.to_numpy(), *reversed(seeds.value), k) if len(v) else np.zeros(0))

    spread = lambda df, udf: settle(df.withColumn("_r", udf("v")).select(*df.columns, "_r.root", "_r.away"))
    rows = spread(rows, _root_udf(row_roots))
    asking = spread(asking.withColumn("floor", floor_of("vec_id", "v")), _root_udf(query_roots))
    radius = dict(rows.groupBy("root").agg(F.max("away")).collect())  # a row for each root
    groups = {r: (away, floor) for r, away, floor in asking.groupBy("root").agg(F.max("away"), F.min("floor")).collect()}
    pairs = []
    for at, (away, floor) in groups.items():
        for r, covered in radius.items():
            a, b = query_roots.value[at], row_roots.value[r]
            reach = a @ b + away * np.sqrt(b @ b) + covered * np.sqrt(a @ a) + away * covered
            if reach * (1 + 1e-9 * np.sign(reach)) + 1 >= floor:
                pairs.append((at, r, at * ROOTS + r))
    linked = F.broadcast(spark.createDataFrame(pairs or [(-1, -1, -1)], "query_root int, row_root int, pair int"))  # ROOTS * QUERY_ROOTS at most
    left = asking.withColumnRenamed("root", "query_root").join(linked, "query_root").select("vec_id", "v", "floor", "pair")
    right = rows.withColumnRenamed("root", "row_root").join(linked, "row_root").select("vec_id", "v", "pair")
    return best(search_blocks(left, right, "pair", _searcher(k), "long", ROOTS * QUERY_ROOTS), F.desc("score"), k)


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 highest inner products of every hundredth embedding."""
    return search(table(spark, sf_dir, "embeddings"))


#: The same over whole tables, for sizes at which a pair of a query and a row may be formed one by one.
ORACLE = """
WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, r.vec_id, CAST(list_sum(list_transform(list_zip(q.v, r.v), lambda z: z[1] * z[2])) AS BIGINT) AS score FROM u q JOIN u r ON q.vec_id % 100 = 0 AND r.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM p
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
"""
