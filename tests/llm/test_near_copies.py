import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quarry.llm import near_copies, simhash


def shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or ({b" ".join(w)} if w else set())


def plain_groups(texts, similarity=0.8):
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if (not a and not b) or len(a & b) >= similarity * len(a | b) > 0:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def classes(labels):
    out = {}
    for i, x in enumerate(labels):
        out.setdefault(x, set()).add(i)
    return sorted(map(sorted, out.values()))


def edited(rng, words, n):
    words = list(words)
    for i in rng.choice(len(words), n, replace=False):
        words[i] = f"new{rng.integers(10**6)}"
    return words


def corpus(rng):
    """Originals, copies with few edits, copies with many, and a passage that unlike texts share."""
    fresh = lambda n: [f"w{rng.integers(10**7)}" for _ in range(n)]
    passage, texts = fresh(60), []
    for i in range(25):
        base = fresh(int(rng.integers(80, 400)))
        texts.append(base)
        texts += [edited(rng, base, max(1, len(base) // 120)) for _ in range(int(rng.integers(0, 4)))]
        texts += [edited(rng, base, len(base) // 12) for _ in range(int(rng.integers(0, 2)))]
        texts.append(fresh(200) + passage)
    return [" ".join(t) for t in texts]


@pytest.mark.parametrize("rows", [2, 1024])
def test_equals_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(near_copies, "STAR_ROWS", rows)
    links = near_copies.links
    monkeypatch.setattr(near_copies, "links", lambda *a: links(*a, cell_rows=rows))
    texts = corpus(np.random.default_rng(8))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r["row"]["id"]: bytes(r["root"]) for r in near_copies.groups(docs).collect()}
    assert classes([found[i] for i in range(len(texts))]) == classes(plain_groups(texts))
    kept = sorted(r["doc_id"] for r in near_copies.drop(docs).collect())
    assert kept == [c[0] for c in sorted(classes(plain_groups(texts)))]


def test_recall_on_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    want = classes(plain_groups([t for _, t in rows]))
    found = {r["row"]["id"]: bytes(r["root"]) for r in near_copies.groups(docs).collect()}
    got = classes([found[i] for i, _ in rows])
    whole = {i: tuple(c) for c in want for i in c}
    # Nothing is joined that is not alike, and next to nothing alike is left apart.
    assert all(len({whole[i] for i in c}) == 1 for c in got)
    assert len(got) - len(want) <= 0.02 * len(want)


def test_repeated_line(spark):
    """A copy that repeats a line has nearly the same set of shingles."""
    rng = np.random.default_rng(3)
    fresh = lambda n: [f"w{rng.integers(10**7)}" for _ in range(n)]
    texts = []
    for _ in range(20):
        base, line = fresh(300), fresh(14)
        texts += [" ".join(base + line), " ".join(base + 20 * line)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = [c[0] for c in classes(plain_groups(texts))]
    assert want == list(range(0, 40, 2)) and sorted(r["doc_id"] for r in near_copies.drop(docs).collect()) == want


def test_pairs_at_the_edge(spark):
    """Pairs between 0.80 and 0.85, the farthest apart that are near copies."""
    rng, texts = np.random.default_rng(5), []
    while len(texts) < 800:
        base = [f"w{rng.integers(10**7)}" for _ in range(int(rng.integers(100, 300)))]
        pair = [" ".join(base), " ".join(edited(rng, base, len(base) // 45))]
        a, b = map(shingles, pair)
        if 0.8 * len(a | b) <= len(a & b) <= 0.85 * len(a | b):
            texts += pair
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r["doc_id"] for r in near_copies.drop(docs).collect()}
    # The shards lose 0.2 % at most; every text stands for its pair or is gone.
    assert kept >= set(range(0, 800, 2)) and len(kept) - 400 <= 3


@pytest.mark.parametrize("rows", [3, 1024])
def test_copies_that_are_alike_only_by_way_of_others(spark, monkeypatch, rows):
    """A shard whose least text is apart from most, and copies in a chain: all links of a shard are found."""
    links = near_copies.links
    monkeypatch.setattr(near_copies, "links", lambda *a: links(*a, cell_rows=rows))
    monkeypatch.setattr(near_copies, "band_keys", lambda h: [1] if len(h) else [])  # one shard of all texts
    rng = np.random.default_rng(2)
    fresh = lambda n: [f"w{rng.integers(10**7)}" for _ in range(n)]
    texts = []
    for _ in range(6):
        chain = fresh(150)
        for _ in range(8):
            texts.append(" ".join(chain))
            chain = edited(rng, chain, 2)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    found = {r["row"]["id"]: bytes(r["root"]) for r in near_copies.groups(docs).collect()}
    assert classes([found[i] for i in range(len(texts))]) == classes(plain_groups(texts))


def test_odd_rows(odd, none):
    kept = near_copies.drop(odd)
    rows = kept.collect()
    assert kept.columns == odd.columns
    # Equal texts, the three without words, and the repeated row are one each; an id may be null.
    assert sorted((r["doc_id"] for r in rows), key=str) == sorted([1, 2, 8, 9, 10, 11, 12, 13, None], key=str)
    assert near_copies.drop(none).collect() == []


def test_shards_are_blocks_of_the_fingerprint():
    """Texts share a shard just where a block of their SimHashes agrees, whose first word is op4's vote."""
    rng = np.random.default_rng(4)
    bits, usual, more = near_copies.block_plan(230_000)
    assert bits == 10 and usual < more and near_copies.block_plan(0)[0] == 8
    met = 0
    for _ in range(200):
        a = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
        b = np.concatenate([a[:267], rng.integers(0, 1 << 63, 33, dtype=np.uint64)])  # 267 of 333, just above 0.8
        x, y = near_copies.simhash(a, 6), near_copies.simhash(b, 6)
        assert int(np.packbits(x[:64], bitorder="little").view(np.uint64)[0]) == simhash.vote(a)
        assert (x != y)[:192].sum() <= near_copies.RADIUS
        p, q = (v[: usual * bits].reshape(usual, bits) for v in (x, y))
        same = {i for i, (m, n) in enumerate(zip(p, q, strict=True)) if (m == n).all()}
        keys = near_copies.band_keys(p), near_copies.band_keys(q)
        assert {i for i, (m, n) in enumerate(zip(*keys, strict=True)) if m == n} == same and len(set(keys[0]) & set(keys[1])) == len(same)
        met += bool(same)
    assert met >= 197


@pytest.mark.parametrize("rows", [8, 1024])
def test_neighbourhoods_against_brute_force(spark, rows):
    """Whatever two fingerprints of a shard are within the radius, they are in a group; none is there that is near no other."""
    rng, filed = np.random.default_rng(6), []
    for key in range(5):
        for _ in range(12):
            base = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
            filed.append((key, base))
            for n in (0, 20, 58, 64, 90)[: int(rng.integers(0, 6))]:
                bits = np.unpackbits(base.view(np.uint8))
                bits[rng.choice(192, n, replace=False)] ^= 1
                filed.append((key, np.packbits(bits).view(np.uint64)))
    table = spark.createDataFrame([(k, tuple(v.view(np.int64).tolist())) for k, v in filed], f"key long, fp {near_copies.FP}").repartition(3)
    groups = {}
    for r in near_copies.neighbourhoods(table, 60, tree_rows=rows).collect():
        groups.setdefault(tuple(r["fp"]), set()).add(r["key"])
    near = set()
    for i, (k, a) in enumerate(filed):
        for m, b in filed[:i]:
            if k == m and np.bitwise_count(a ^ b).sum() <= 60:
                one, other = tuple(a.view(np.int64).tolist()), tuple(b.view(np.int64).tolist())
                assert groups[one] & groups[other]
                near |= {one, other}
    assert set(groups) == near and len(near) < len(filed)


def test_a_passage_makes_no_neighbourhoods(spark):
    """Unlike texts with a passage in common stay out of neighbourhoods; near copies among them are found."""
    rng = np.random.default_rng(9)
    fresh = lambda n: [f"w{rng.integers(10**7)}" for _ in range(n)]
    passage = fresh(45)
    texts = [fresh(100) + passage for _ in range(400)]
    pairs = [[t, edited(rng, t, 1)] for t in (fresh(100) + passage for _ in range(20))]
    texts = [" ".join(t) for t in sum(pairs, []) + texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    rows = near_copies._sketches(docs, "doc_id", "text").select("row.id", "fp", "keys").cache()
    near = near_copies.neighbourhoods(rows.select("fp", F.explode("keys").alias("key")), near_copies.RADIUS)
    found = {r["id"] for r in near.join(rows, "fp").select("id").distinct().collect()}
    rows.unpersist()
    assert found >= set(range(40)) and len(found) <= 44


def test_rows_grow_with_a_group_not_with_its_square(spark, monkeypatch):
    """A large shard of copies, two strangers that are near each other, and one that is near none."""
    rng, made, by_cell = np.random.default_rng(7), [], near_copies._by_cell
    flipped = lambda base, n: np.packbits(np.unpackbits(base.view(np.uint8)) ^ np.isin(np.arange(192), rng.choice(192, n, replace=False))).view(np.uint64)
    monkeypatch.setattr(near_copies, "_by_cell", lambda cells, *a: made.append(cells.count()) or by_cell(cells, *a))
    totals = []
    for g in (64, 256):
        base, other, lone = rng.integers(0, 1 << 63, (3, 3), dtype=np.uint64)
        fps = [flipped(base, int(rng.integers(1, 12))) for _ in range(g)] + [other, flipped(other, 30), lone]
        fps = [tuple(v.view(np.int64).tolist()) for v in fps]
        table = spark.createDataFrame([(1, v) for v in fps], f"key long, fp {near_copies.FP}").repartition(3)
        made.clear()
        found = near_copies.neighbourhoods(table, 60, tree_rows=8).collect()
        assert sorted(tuple(r["fp"]) for r in found) == sorted(set(fps[:-1])) and {r["key"] for r in found} == {1}
        totals.append(sum(made))
    assert totals[1] <= 5 * totals[0]


def test_min_hashes_agree_as_often_as_sets_are_alike():
    rng = np.random.default_rng(1)
    same = total = 0
    for _ in range(60):
        a = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
        b = np.concatenate([a[:356], rng.integers(0, 1 << 63, 44, dtype=np.uint64)])
        x, y = near_copies.min_hashes(a, 80), near_copies.min_hashes(b, 80)
        same, total = same + int((x == y).sum()), total + 80
    assert abs(same / total - 356 / 444) < 0.03
    few = near_copies.min_hashes(np.array([xxhash.xxh64_intdigest(b"x")], dtype=np.uint64), 80)
    assert len(set(few.tolist())) == 80
