from pathlib import Path

import numpy as np
import pytest

from motorfisc.llm import ann, exact, vectors
from motorfisc.llm.vectors import queries_of, usable
from pyspark.sql import functions as F


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "k") for i, v in rows], "vec_id long, embedding array<float>, score string")


def brute(rows, score, k=10):
    ids, vectors = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    out = {}
    for q in sorted({i for i in ids if i % 100 == 0}):
        s = score(vectors, vectors[list(ids).index(q)])
        order = [j for j in np.lexsort((ids, s)) if ids[j] != q][:k]
        out[int(q)] = [(int(ids[j]), s[j]) for j in order]
    return out


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(4)
    clusters = rng.standard_normal((12, 24))
    rows = [(i, (clusters[i % 12] + 0.5 * rng.standard_normal(24)).astype(np.float32)) for i in range(900)]
    return rows + [(5000 + i, rows[7][1]) for i in range(60)] + [(6000, rows[7][1])]


def test_exact_search_is_brute_force_with_ties(spark, points):
    got = {}
    for r in sorted(exact.search(frame(spark, points)).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    whole = [(i, np.floor(1024 * v.astype(float))) for i, v in points]
    want = {q: [(i, int(-s)) for i, s in xs] for q, xs in brute(whole, lambda m, q: -(m @ q)).items()}
    assert got == want


@pytest.mark.parametrize("copies", [3, 15])
def test_exact_search_with_a_repeated_query_id(spark, copies):
    rng = np.random.default_rng(8)
    rows = [(100, [9.0] * 6)] * copies + [(101 + i, rng.standard_normal(6).round(3)) for i in range(20)]
    got = [(r.vec_id, r.score) for r in sorted(exact.search(frame(spark, rows)).collect(), key=lambda r: r.rank)]
    whole = [(i, np.floor(1024 * np.array(v, dtype=np.float32).astype(float))) for i, v in rows]
    assert got == [(i, int(-s)) for i, s in brute(whole, lambda m, q: -(m @ q))[100]] and len(got) == 10


def test_ann_recall_and_exact_scores(spark, points):
    want = brute([(i, v.astype(float)) for i, v in points], lambda m, q: np.sqrt(((m - q) ** 2).sum(1)))
    rows = ann.search(frame(spark, points)).collect()
    vectors = {i: v.astype(float) for i, v in points}
    hits = 0
    for q, best in want.items():
        found = sorted((r for r in rows if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in found] == list(range(1, 11)) and all(r.vec_id != q for r in found)
        assert [(r.score, r.vec_id) for r in found] == sorted((r.score, r.vec_id) for r in found)
        assert all(abs(r.score - np.sqrt(((vectors[r.vec_id] - vectors[q]) ** 2).sum())) < 1e-12 for r in found)
        hits += sum(r.score <= best[-1][1] + 1e-12 for r in found)
    assert hits >= 0.9 * 10 * len(want)


def test_ann_recall_on_given_vectors(spark, sf_dir):
    path = Path(sf_dir).with_name("sf0.1")
    path = path if path.exists() else Path(sf_dir)
    rows = [(r.vec_id, np.array(r.embedding, dtype=float)) for r in spark.read.parquet(f"{path}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want = brute(rows, lambda m, q: np.sqrt(((m - q) ** 2).sum(1)))
    found = {(r.query_id, r.vec_id) for r in ann.op3_ann(spark, str(path)).collect()}
    assert sum((q, i) in found for q, best in want.items() for i, _ in best) >= 0.95 * sum(map(len, want.values()))


@pytest.mark.parametrize("search", ["ann", "exact"])
def test_several_blocks_of_queries_and_rows(spark, points, monkeypatch, search):
    def found():
        rows = (ann if search == "ann" else exact).search(frame(spark, points))
        return sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in rows.collect())

    whole = found()
    for module in (vectors, exact):
        monkeypatch.setattr(module, "BLOCK", 40)
    assert found() == whole


def test_children_of_a_cover_tree_have_half_the_radius():
    for vectors_ in (np.random.default_rng(2).standard_normal((500, 3)), np.random.default_rng(3).standard_normal((400, 48))):
        stack = [exact.cover_tree(vectors_)]
        while stack:
            node = stack.pop()
            assert all(c.radius <= node.radius / 2 * (1 + 1e-6) for c in node.children)
            centres = np.array([c.centre for c in node.children])
            if len(centres) > 1:
                apart = np.sqrt(((centres[:, None] - centres) ** 2).sum(2)) + np.eye(len(centres)) * node.radius
                assert apart.min() > node.radius / 2 * (1 - 1e-6) and (centres == node.centre).all(1).any()
            stack += node.children


ODD = [(0, [1, 2, 0]), (100, [0, 0, 0]), (1, [1, 2, 0.1]), (2, None), (3, [float("nan"), 1, 1]), (4, [float("inf"), 1, 1]), (5, [None, 1, 1]), (6, [1, 1]), (7, []), (None, [1, 1, 1]), (8, [1, 2, 0.1]), (0, [1, 2, 0])]


def test_odd_vectors(spark):
    df = frame(spark, ODD)
    assert sorted(r.vec_id for r in usable(df, F.col("embedding")).collect()) == [0, 0, 1, 8, 100]
    assert [r.vec_id for r in queries_of(usable(df, F.col("embedding"), zero=False)).collect()] == [0]
    assert [(r.query_id, r.rank, r.vec_id) for r in sorted(ann.search(df).collect())] == [(0, 1, 1), (0, 2, 8)]
    got = sorted(exact.search(df).collect())
    assert [(r.query_id, r.rank, r.vec_id) for r in got if r.query_id == 0] == [(0, 1, 1), (0, 2, 8), (0, 3, 100)]
    assert [(r.vec_id, r.score) for r in got if r.query_id == 100] == [(0, 0), (0, 0), (1, 0), (8, 0)]


def test_empty_and_alone(spark):
    for search in (ann.search, exact.search):
        assert search(frame(spark, [])).collect() == []
        assert search(frame(spark, [(100, [1, 2])])).collect() == []
        assert search(frame(spark, [(101, [1, 2])])).collect() == []


def test_scores_beyond_exact_doubles(spark):
    rows = [(0, [3e30, 1]), (1, [3e30, 5]), (2, [-3e30, 5]), (3, [0, 7])]
    got = sorted((r.rank, r.vec_id, r.score) for r in exact.search(frame(spark, rows)).collect())
    assert [v for _, v, _ in got] == [1, 3, 2] and got[0][2] == 2**63 - 1 and got[-1][2] == -(2**63)


def test_dual_trees_visit_less_than_all_pairs():
    rng = np.random.default_rng(1)
    centres = 40 * rng.standard_normal((20, 4))
    data = np.floor(np.concatenate([c + rng.standard_normal((200, 4)) for c in centres]) * 10)
    queries = data[::50]
    dual = exact.DualSearch(queries, np.arange(len(queries)) - 10**6, data, np.arange(len(data)), np.full(len(queries), -np.inf), 10)
    seen = []
    base = dual.base
    dual.base = lambda q, r: (seen.append(len(q) * len(r)), base(q, r))
    dual.search(exact.cover_tree(queries, exact.QUERY_LEAF), exact.cover_tree(data))
    assert sum(seen) < 0.7 * len(queries) * len(data)
    assert (dual.scores == -np.sort(-(queries @ data.T), axis=1)[:, :10]).all()


def test_cover_tree_covers():
    vectors = np.random.default_rng(0).standard_normal((700, 6))
    stack, leaves = [exact.cover_tree(vectors)], []
    while stack:
        node = stack.pop()
        assert np.sqrt(((vectors[node.points] - node.centre) ** 2).sum(1)).max() <= node.radius + 1e-9
        assert not node.children or sorted(np.concatenate([x.points for x in node.children])) == sorted(node.points)
        stack += node.children
        leaves += [] if node.children else list(node.points)
    assert sorted(leaves) == list(range(700))
