import zlib
from collections import defaultdict

import numpy as np
import pytest

from quarry.llm.sharding import BinTree, best_fit_decreasing, equal_bins, shard


def plain_best_fit(sizes, capacity):
    bins = []
    for s in sorted(sizes, reverse=True):
        fitting = [(b, i) for i, b in enumerate(bins) if b >= s]
        if fitting:
            b, i = min(fitting)
            bins[i] = b - s
        else:
            bins.append(max(capacity, s) - s)
    return sorted(bins)


def test_tree_finds_the_tightest():
    rng, tree, items = np.random.default_rng(1), BinTree(), set()
    for step in range(3000):
        if items and rng.random() < 0.4:
            gone = sorted(items)[int(rng.integers(len(items)))]
            items.discard(gone)
            tree.remove(gone)
        else:
            new = (int(rng.integers(200)), step)
            items.add(new)
            tree.insert(new)
        size = int(rng.integers(220))
        assert tree.tightest(size) == min((i for i in items if i[0] >= size), default=None)
    assert tree.root[3] <= 1.45 * np.log2(len(items) + 2) + 1


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_plain_best_fit(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 60, 300).tolist()
    counts = defaultdict(int)
    for s in sizes:
        counts[s] += 1
    runs = best_fit_decreasing(list(counts.items()), 97)
    loads = defaultdict(int)
    for size, _, n, b in runs:
        loads[b] += size * n
    assert sorted(97 - x for x in loads.values()) == plain_best_fit(sizes, 97)
    for size, n in counts.items():
        own = sorted((first, first + k) for s, first, k, _ in runs if s == size)
        assert own[0][0] == 0 and own[-1][1] == n and all(a[1] == b[0] for a, b in zip(own, own[1:]))


def test_equal_bins_with_a_group_beyond_the_mean():
    runs = equal_bins([(1000, 1), (10, 90)], 4)
    loads = defaultdict(int)
    for size, _, n, b in runs:
        loads[b] += size * n
    assert sorted(loads.values()) == [300, 300, 300, 1000]


def check(rows, n_in, shards):
    assert len(rows) == n_in
    slots, groups = defaultdict(list), defaultdict(set)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        groups[r["text_crc32"], r["size"]].add(r["shard"])
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert set(slots) <= set(range(shards))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(g) == 1 for g in groups.values())


def test_odd_rows(odd, none):
    rows = shard(odd, 4).collect()
    check(rows, odd.count(), 4)
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[2]["size"] == 8 and by_id[2]["text_crc32"] == 0 and by_id[2]["shard"] == by_id[3]["shard"]
    assert by_id[10]["text_crc32"] == zlib.crc32("Ünïcode ß 中文 \U0001f600 \x00 end".encode())
    assert shard(none, 4).collect() == []


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = shard(docs, 24).collect()
    check(rows, docs.count(), 24)
    loads = defaultdict(int)
    for r in rows:
        loads[r["shard"]] += r["size"]
    assert len(loads) == 24
    fixed = shard(docs, None, capacity=40_000).collect()
    loads = defaultdict(int)
    for r in fixed:
        loads[r["shard"]] += r["size"]
    groups = defaultdict(int)
    for r in fixed:
        groups[r["text_crc32"], r["size"]] += r["size"]
    assert all(x <= 40_000 or x in groups.values() for x in loads.values())
