import numpy as np
import pytest
import xxhash

from quarry.llm import simhash


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, radius=2):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= radius:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


def expected(rows):
    fps = {plain_fingerprint(t) for _, t in rows}
    root = plain_components(fps)
    least = {}
    for i, t in rows:
        r = root[plain_fingerprint(t)]
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return sorted((str(i), f"{plain_fingerprint(t):016x}", str(least.get(root[plain_fingerprint(t)]))) for i, t in rows)


def test_odd_rows(odd, none):
    found = sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in simhash.near_duplicates(odd).collect())
    assert found == expected([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert simhash.near_duplicates(none).collect() == []


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in simhash.near_duplicates(docs).collect())
    assert found == expected([(r["doc_id"], r["text"]) for r in docs.collect()])


@pytest.mark.parametrize("radius", [0, 1, 2, 5])
def test_tree_finds_all_within(radius):
    rng = np.random.default_rng(radius)
    centers = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    values = np.unique(np.array([int(c) ^ sum(1 << b for b in set(rng.integers(0, 64, int(rng.integers(0, 6))).tolist())) for c in centers for _ in range(30)], dtype=np.uint64))
    tree = simhash.BKTree(values)
    found = {(int(q), int(n)) for a, b in tree.within(values, radius) for q, n in zip(a, b)}
    assert found == {(i, j) for i, x in enumerate(values) for j, y in enumerate(values) if int(x ^ y).bit_count() <= radius}


def test_links_keep_components_however_trees_are_cut(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    values = sorted({int(b) ^ sum(1 << k for k in set(rng.integers(0, 20, int(rng.integers(0, 4))).tolist())) for b in base for _ in range(80)})
    signed = [v - (1 << 64) if v >= 1 << 63 else v for v in values]
    table = spark.createDataFrame([(v,) for v in signed], "fp long")
    want = plain_components(set(values))
    for tree_rows in (7, 50, 4096):
        linked = simhash.links(table, 2, tree_rows)
        assert linked.count() <= 3 * 80 * len(values)
        roots = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in simhash.components(linked).collect()}
        groups = {}
        for v in values:
            groups.setdefault(want[v], set()).add(roots.get(v, v))
        assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(70)] + [(200, 201), (203, 201), (300, 300)], "a long, b long")
    found = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert found == {i: 0 for i in range(71)} | {200: 200, 201: 200, 203: 200, 300: 300}
