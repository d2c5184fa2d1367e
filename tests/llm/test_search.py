import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import ann, topk

SCHEMA = "vec_id long, embedding array<float>, label int, score int"
NAN, INF = float("nan"), float("inf")


def brute_top(rows, every, k, scale=64):
    best = {}
    for i, v, *_ in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            best[i] = min(best.get(i, v), v)
    whole = {i: [int(np.floor(np.float64(np.float32(x)) * scale)) for x in v] for i, v in best.items()}
    out = set()
    for q, a in whole.items():
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in whole.items() if i != q and len(a) == len(b))
            out |= {(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)}
    return out


def odd_vectors(rng):
    rows = [(i, rng.normal(size=16).astype(np.float32).tolist(), 1, 0) for i in range(300)]
    same = rng.normal(size=16).astype(np.float32).tolist()
    rows += [(i, same, 1, 0) for i in range(300, 400)]
    return rows + [
        (400, None, 1, 0), (401, [1.0] * 15 + [None], 1, 0), (402, [1.0] * 15 + [NAN], 1, 0), (403, [INF] * 16, 1, 0), (None, same, 1, 0),
        (404, [0.0] * 16, None, 0), (405, [1.0, 2.0], 1, None), (420, [2.0, 1.0], 1, 0), (20, rows[20][1], 1, 0), (440, [], 1, 0), (460, [], 1, 0),
    ]


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "SPAN", 64)
    rows = odd_vectors(np.random.default_rng(3))
    found = topk.top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0, 7).collect()
    assert {tuple(r) for r in found} == brute_top(rows, 20, 7)
    assert len(found) == len(brute_top(rows, 20, 7))


def test_top_k_of_large_components(spark):
    """Beyond the exact range of doubles, and beyond 64 bits, where scores saturate and ties go to smaller ids."""
    top = (1 << 63) - 1
    for size in (1e15, 1e4):
        rows = [(i, [float(np.float32(size * (i + 1))), -3 * size, 1.0, 0.7 * size], 1, 0) for i in range(12)]
        rows = [(i, [float(np.float32(x)) for x in v], *r) for i, v, *r in rows]
        whole = {i: [int(np.floor(x * 64)) for x in v] for i, v, *_ in rows}
        want = set()
        for q in (0, 5, 10):
            scored = sorted((-min(top, sum(x * y for x, y in zip(whole[q], w))), i) for i, w in whole.items() if i != q)
            want |= {(q, r, i, -s) for r, (s, i) in enumerate(scored[:3], 1)}
        assert {tuple(r) for r in topk.top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 5 == 0, 3).collect()} == want


def test_top_k_of_nothing(spark):
    assert topk.top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 20 == 0).collect() == []
    assert topk.top_k(spark.createDataFrame([(1, [1.0], 1, 0)], SCHEMA), F.col("vec_id") % 20 == 0).collect() == []
    assert topk.top_k(spark.createDataFrame([(20, [1.0], 1, 0)], SCHEMA), F.col("vec_id") % 20 == 0).collect() == []


def recall(rows, found, every, k):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], dtype=np.float64)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = total = 0
    for q in np.flatnonzero(ids % every == 0):
        s = unit @ unit[q]
        s[q] = -2
        kth = np.sort(s)[-k]
        own = [r for r in found if r["query_id"] == ids[q]]
        assert [r["rank"] for r in own] == list(range(1, k + 1))
        for a, b in zip(own, own[1:]):
            assert (-a["score"], a["vec_id"]) < (-b["score"], b["vec_id"])
        for r in own:
            assert abs(r["score"] - s[np.flatnonzero(ids == r["vec_id"])[0]]) < 1e-12
        hits += sum(r["score"] >= kth - 1e-12 for r in own)
        total += k
    return hits / total


def met_share(found, n):
    return np.mean(list({r["query_id"]: r["met"] for r in found}.values())) / n


@pytest.mark.parametrize("n", [60, 500, 3000])
def test_forest_recall(spark, monkeypatch, n):
    monkeypatch.setattr(ann, "CELL_ROWS", 1000)
    rng = np.random.default_rng(n)
    centers = rng.normal(size=(10, 64))
    rows = [(i, (centers[i % 10] + 1.5 * rng.normal(size=64)).astype(np.float32).tolist(), 1, 0) for i in range(n)]
    found = ann.nearest(spark.createDataFrame(rows, SCHEMA).repartition(5), F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()
    assert recall(rows, found, 50, 5) >= 0.9


def test_forest_meets_fewer_rows_the_more_there_are(spark):
    """On clustered rows the share that a query is compared with falls, at a recall of 0.9 and more."""
    rng, shares = np.random.default_rng(4), []
    centers = 3 * rng.normal(size=(40, 32))
    for n in (400, 1600, 6400):
        rows = [(i, (centers[i % 40] + rng.normal(size=32)).astype(np.float32).tolist(), 1, 0) for i in range(n)]
        found = ann.nearest(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()
        assert recall(rows, found, 50, 5) >= 0.9
        shares.append(met_share(found, n))
    assert shares[0] > 1.5 * shares[1] > 2.25 * shares[2] and shares[2] < 0.1


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_forest_on_the_table(spark, sf_dir, sf):
    table = spark.read.parquet(f"{sf_dir.replace('sf0.001', sf)}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    found = ann.nearest(table, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()
    assert recall(rows, found, 50, 5) >= 0.9 and met_share(found, len(rows)) < (0.6 if sf == "sf0.1" else 0.7)


def test_queue_visits_leaves_by_cost():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(700, 12))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    forest = ann.Forest.fit(unit, cells=4, trees=3, leaf_rows=10)
    leaf = forest.route(unit)
    assert sorted(np.unique(forest.cell(leaf))) == [0, 1, 2, 3] and np.allclose(forest.weights.sum(axis=1), 1)
    for t in range(3):
        assert np.allclose(np.bincount(leaf[:, t], minlength=forest.leaves) / 700, forest.weights[t], atol=2 / 700)
        assert all(forest.reach[t, n, c] for n, c in zip(leaf[:, t], forest.cell(leaf)))
    for u in unit[:5]:
        costs, seen = forest.costs(u), forest.visit(u, 1e9)
        assert len(seen) == costs.size == len(set(seen))
        order = [costs[s] for s in seen]
        assert np.allclose(order, sorted(order))
        some = forest.visit(u, 0.5)
        assert some == seen[: len(some)] and sum(forest.weights[s] for s in some[:-1]) < 0.5 <= sum(forest.weights[s] for s in some)


def test_forest_odd_vectors(spark):
    rows = odd_vectors(np.random.default_rng(3))
    found = ann.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0).collect()
    by = {}
    for r in found:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(by) == [0, 50, 100, 150, 200, 250, 300, 350]
    # The hundred equal vectors are each other's nearest, the smallest ids first.
    assert [v for _, v, _ in sorted(by[350])] == [300, 301, 302, 303, 304]
    assert all(abs(s - 1) < 1e-12 for *_, s in by[350])
    assert ann.nearest(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 50 == 0).collect() == []
    few = [(50, [1.0, 0.0], 1, 0), (51, [1.0, 1.0], 1, 0), (52, [0.0, 0.0], 1, 0), (53, [-1.0, 0.5], 1, 0)]
    assert [r["vec_id"] for r in ann.nearest(spark.createDataFrame(few, SCHEMA), F.col("vec_id") % 50 == 0).orderBy("rank").collect()] == [51, 53]


def test_forest_splits_hot_cells(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL_ROWS", 16)
    monkeypatch.setattr(ann, "CELL_QUERIES", 2)
    rng = np.random.default_rng(0)
    same = rng.normal(size=8).astype(np.float32).tolist()
    rows = [(i, same if i % 3 == 0 else rng.normal(size=8).astype(np.float32).tolist(), 1, 0) for i in range(400)]
    found = ann.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0, leaf_rows=400).orderBy("query_id", "rank").collect()
    assert recall(rows, found, 50, 5) == 1.0 and met_share(found, 400) == 399 / 400
