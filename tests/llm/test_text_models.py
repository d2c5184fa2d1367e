import math
import time
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import langid, lm_scoring, toxicity
from quarry.llm._util import crc_remainder


def held(i, modulus):
    return zlib.crc32(("" if i is None else str(i)).encode()) % modulus == 0


# Language-model scoring


def plain_counts(rows):
    words, pairs, n = Counter(), Counter(), 0
    for i, t in rows:
        if not held(i, 10):
            w = (t or "").encode().lower().split() + [b""]
            words.update(w)
            pairs.update(zip([b""] + w[:-1], w))
            n += len(w)
    return words, pairs, n


def check_scores(rows, found):
    words, pairs, n = plain_counts(rows)
    v = len(words)
    base = Counter()
    for i, t in rows:
        w = (t or "").encode().lower().split() + [b""]
        score = sum(math.log10((words[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        base[str(i), held(i, 10), len(w), sum(words[x] > 0 for x in w), n, round(score, 6)] += 1
    assert Counter((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found) == base
    assert all(r["score"] <= 0 and math.isfinite(r["score"]) for r in found)


def test_lm_odd_rows(odd, none, monkeypatch):
    check_scores([(r["doc_id"], r["text"]) for r in odd.collect()], lm_scoring.score(odd).collect())
    assert lm_scoring.score(none).collect() == []
    nothing = lm_scoring.score(odd, held_out=F.lit(True)).collect()
    assert all(r["score"] == 0 and r["base_score"] == 0 and r["train_tokens"] == 0 for r in nothing)


def test_lm_against_brute_force(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(3)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    caught = []
    learn = lm_scoring.learn_weights
    monkeypatch.setattr(lm_scoring, "learn_weights", lambda *a: caught.append(learn(*a)) or caught[0])
    monkeypatch.setattr(lm_scoring, "CHUNK_BYTES", 50_000)
    found = lm_scoring.score(docs).collect()
    check_scores(rows, found)
    words, pairs, n = plain_counts(rows)
    weights, v = caught[0], len(words)
    texts = dict(rows)
    for r in found:
        w = (texts[r["doc_id"]] or "").encode().lower().split() + [b""]
        total = 0.0
        for h, x in zip([b""] + w[:-1], w):
            l0, l1, l2 = weights[int(math.log2(words[h])) + 1 if words[h] else 0]
            total += math.log10(l0 / (v + 1) + l1 * words[x] / n + (l2 * pairs[h, x] / words[h] if words[h] else 0))
        assert abs(total - r["score"]) < 1e-6 * max(1, abs(total))
    # A distribution: what follows any context sums to one, with the unseen as one more word.
    for h in [b"", *list(words)[:20]]:
        l0, l1, l2 = weights[int(math.log2(words[h])) + 1]
        seen = sum(l0 / (v + 1) + l1 * words[x] / n + l2 * pairs[h, x] / words[h] for x in words)
        assert abs(seen + l0 / (v + 1) - 1) < 1e-9
    out = [r for r in found if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_lm_leaves_no_exchanges(spark, sf_dir):
    """Questions and events are exchanged before the scores are asked for; by then their files are gone."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        every = disk.getAllFiles()
        return {n for i in range(every.size()) if (n := every.apply(i).getName()).startswith("shuffle_")}

    before = files()
    scores = lm_scoring.score(docs)
    until = time.time() + 20
    while files() - before and time.time() < until:  # deleted in the background
        time.sleep(0.2)
    assert not files() - before
    assert scores.count() == docs.count()


def test_em_climbs():
    cells = np.array([(3 * 2048 + (1000 + 80)) * 2048 + 1000 + 20, (3 * 2048) * 2048 + 1000 + 40, (3 * 2048) * 2048])
    counts = np.array([500, 300, 20])
    p = np.stack([np.ones(3), [2**2.5, 2**5.0, 0], [2.0**10, 0, 0]], axis=1)
    likelihood = [float((counts * np.log(p @ lm_scoring.learn_weights(cells, counts, k)[3])).sum()) for k in (1, 2, 5, 20, 60)]
    assert likelihood == sorted(likelihood)


def test_codes_round_trip():
    rng = np.random.default_rng(0)
    keys = np.sort(rng.integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2))
    counts = rng.integers(0, 1000, 999)
    tokens = rng.integers(0, 70_000, 500)
    assert (lm_scoring.unpack_sorted(lm_scoring.pack_sorted(keys)) == keys).all()
    assert (lm_scoring.unpack_counts(lm_scoring.pack_counts(counts)) == counts).all()
    assert (lm_scoring.unpack_tokens(lm_scoring.pack_tokens(tokens)) == tokens).all()


# Language identification


def plain_probability(word, probability):
    """Sum over all segmentations, listed one by one."""
    text = b" " + word
    total = np.zeros(len(next(iter(probability.values()))))
    for r in range(len(text)):
        for cuts in combinations(range(1, len(text)), r):
            edges = [0, *cuts, len(text)]
            parts = [text[a:b] for a, b in zip(edges, edges[1:])]
            if all(p in probability for p in parts):
                total += np.prod([probability[p] for p in parts], axis=0)
    return total


def test_forward_sums_all_segmentations():
    known = [bytes([b]) for b in range(256)] + [b"ab", b"abc", b" a", b"bc", b"cab", b"a" * 16]
    rng = np.random.default_rng(2)
    p = np.vstack([rng.random((len(known), 3)), np.zeros(3)])
    table = langid.PieceTable(known)
    words = [b"abcab", b"a", b"cabcabc", b"zz", b"ab"]
    found = langid.score_words(table, p, words)
    for w, s in zip(words, found):
        assert np.allclose(np.exp(s), plain_probability(w, dict(zip(known, p))))


def summed(word, probability):
    """The same sum for a word of any length, by logarithms, from the definition of the forward pass."""
    text, logs = b" " + word, [np.zeros(len(next(iter(probability.values()))))]
    for end in range(1, len(text) + 1):
        into = [logs[end - n] + np.log(probability[text[end - n : end]]) for n in range(1, end + 1) if text[end - n : end] in probability]
        logs.append(np.logaddexp.reduce(into, axis=0) if into else np.full_like(logs[0], -np.inf))
    return logs[-1]


def test_long_words_are_summed_whole(monkeypatch):
    """No cut at any length, whether or not a piece crosses every border, and however the windows fall."""
    known = [bytes([b]) for b in range(256)] + [b"ab", b"abc", b" a", b"bc", b"cab", b"a" * 16, b"a" * 40]
    rng = np.random.default_rng(2)
    p = np.vstack([rng.random((len(known), 3)) * 0.01, np.zeros(3)])
    table = langid.PieceTable(known)
    words = [b"a" * 200, b"abc" * 70, b"xyz" * 50, "\u4e2d\u6587".encode() * 60, b"ab", b"a" * 3000, b"", b"abcab" + b"a" * 33]
    for window in (1 << 20, 64, 50):
        monkeypatch.setattr(langid, "WINDOW", window)
        for w, s in zip(words, langid.score_words(table, p, words)):
            assert np.allclose(s, summed(w, dict(zip(known, p)))) if w else (s == 0).all()


def test_learning_equals_plain_expectation():
    """Expected counts of one round against all segmentations, listed one by one."""
    known = [bytes([b]) for b in range(256)] + [b" a", b"ab", b"ba", b"aba"]
    counts = {b"abab": 7, b"ba": 3, b"abba": 1}
    expected, start = np.full(len(known), langid.SMOOTHING), 1 / len(known)
    for word, n in counts.items():
        text, ways = b" " + word, []
        for r in range(len(text)):
            for cuts in combinations(range(1, len(text)), r):
                parts = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]
                if all(x in known for x in parts):
                    ways.append((start ** len(parts), parts))
        whole = sum(w for w, _ in ways)
        for w, parts in ways:
            for x in parts:
                expected[known.index(x)] += n * w / whole
    found = langid.learn_one(langid.PieceTable(known), counts, rounds=1)
    assert np.allclose(found[:-1], expected / expected.sum()) and found[-1] == 0


def test_all_languages_are_learned(spark):
    rows, rng = [], np.random.default_rng(1)
    for i in range(300):
        own = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(12)]
        rows += [(4 * i + j, " ".join(rng.choice(own, 30)), f"l{i:03d}") for j in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = langid.fit(docs, F.col("doc_id") % 4 != 0)
    found = langid.identify(docs, model).where("doc_id % 4 = 0").collect()
    assert len(model[1]) == 300 and sum(r["lang"] == r["lang_pred"] for r in found) >= 295


def test_em_of_pieces_climbs():
    known = [bytes([b]) for b in range(256)] + [b" the", b"th", b"he", b"ing"]
    table, counts = langid.PieceTable(known), {"x": {b"the": 50, b"thing": 20, b"he": 5}, "y": {b"zz": 10}}
    last = -np.inf
    for rounds in (1, 2, 4, 8):
        languages, p = langid.learn(table, counts, rounds)
        assert languages == ["x", "y"] and np.allclose(p.sum(axis=0), 1)
        now = sum(n * langid.score_words(table, p, [w])[0, 0] for w, n in counts["x"].items())
        assert now >= last - 0.02
        last = now


def test_language_odd_rows(odd, none):
    model = langid.fit(odd, F.lit(True))
    rows = langid.identify(odd, model)
    assert rows.columns == [c for c in odd.columns if c != "score"] + ["lang_pred", "score"]
    found = {r["doc_id"]: r for r in rows.collect()}
    assert all(found[i]["lang_pred"] == "und" and found[i]["score"] == 0 for i in (2, 3, 7, 11))
    assert all(found[i]["lang_pred"] in ("en", "de", "fr", "es") and 0 < found[i]["score"] <= 1 for i in (1, 5, 8, 9, 10, 12))
    assert rows.count() == odd.count() and langid.identify(none, model).collect() == []
    nothing = langid.fit(none, F.lit(True))
    assert {r["lang_pred"] for r in langid.identify(odd, nothing).collect()} == {"und"}


def test_language_on_held_out_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    model = langid.fit(docs, crc_remainder(F.col("doc_id"), 5) != 0)
    rows = [r for r in langid.identify(docs, model, keep=["doc_id", "lang"]).collect() if held(r["doc_id"], 5)]
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)


# Toxicity


def grams_of(text):
    t = toxicity.normal(text)
    return {t[j : j + n] for n in toxicity.ORDERS for j in range(len(t) - n + 1)}


def gram_hash(gram):
    return int(toxicity.hashes(np.array([ord(c) + 1 for c in gram], dtype=np.uint64), len(gram))[0])


def test_present_ngrams(monkeypatch):
    texts = ["Ab  cd", None, "", "ab CD ab", "x y" * 40 + "end"]
    want = {(i, gram_hash(g)) for i, t in enumerate(texts) for g in grams_of(t)}
    for span in (1 << 19, 16):  # of one part, and of many
        monkeypatch.setattr(toxicity, "SPAN", span)
        pairs = [(int(r), int(g)) for a, c in toxicity.present(texts) for r, g in zip(a, c)]
        assert len(pairs) == len(set(pairs)) and set(pairs) == want
        some = np.array(sorted(h for _, h in want)[::3], dtype=np.uint64)
        sieved = [(int(r), int(g)) for a, c in toxicity.present(texts, toxicity.Sieve(some)) for r, g in zip(a, c)]
        assert sorted(sieved) == sorted((i, h) for i, h in want if h in set(some.tolist()))


def test_toxicity_equals_plain_scores(spark, monkeypatch):
    """Features, ratios and scores against dictionaries of n-grams, with the same regression."""
    rng = np.random.default_rng(8)
    rows, labels = [], []
    for i in range(400):
        words = [f"w{w}" for w in rng.integers(0, 60, 25)] + (["blargh"] if i % 6 == 0 else [])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 6 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(toxicity, "GATHERED", 5000)
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    learned = [(t, int(i % 6 == 0)) for i, t in rows if not held(i, 5)]
    n = Counter(y for _, y in learned)
    count = [Counter(), Counter()]
    for t, y in learned:
        count[y].update(grams_of(t))
    whole, features = [sum(c.values()) for c in count], {}
    for g in {*count[0], *count[1]}:
        p, q, both = count[1][g] / n[1], count[0][g] / n[0], (count[0][g] + count[1][g]) / len(learned)
        if abs(p - q) >= toxicity.LEAST_TELLING * math.sqrt((both * (1 - both) + 1e-9) * (1 / n[0] + 1 / n[1])):
            features[g] = math.log((count[1][g] + 1) / (whole[1] + 1)) - math.log((count[0][g] + 1) / (whole[0] + 1))
    assert {gram_hash(g) for g in features} == set(model[0].tolist()) and features
    order = sorted(features)
    at = [(r, order.index(g)) for r, (t, _) in enumerate(learned) for g in grams_of(t) if g in features]
    weights, intercept = toxicity.logistic(*(np.array(x) for x in zip(*at)), np.array([features[g] for g in order]), np.array([float(y) for _, y in learned]), len(order))
    found = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    for i, t in rows:
        z = intercept + sum(weights[order.index(g)] * features[g] for g in grams_of(t) if g in features)
        assert abs(found[i] - 1 / (1 + math.exp(-z))) < 1e-6


def test_regression_reaches_the_optimum():
    rng = np.random.default_rng(4)
    n, width = 400, 6
    x = rng.random((n, width)) < 0.4
    y = (rng.random(n) < 1 / (1 + np.exp(-(3 * x[:, 0] - 2 * x[:, 1])))).astype(float)
    rows, columns = np.nonzero(x)
    w, b = toxicity.logistic(rows, columns, np.ones(width), y, width)
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert np.abs(x.T @ (p - y) / n).max() < 5e-3 and w[0] > 1.5 and w[1] < -1


def test_toxicity_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (5, 1, 1), (5, 1, 0), (9, None, None), (None, 1, 1), (99, 0, 1), (8, 1, 0), (12, 1, 7)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.where("toxic = 0"), labels.limit(0)):
        model = toxicity.fit(odd, some, held_out=F.lit(False))
        rows = toxicity.score(odd, model).collect()
        assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
        assert len({r["score"] for r in rows if r["doc_id"] in (2, 3, 7)}) == 1
        assert toxicity.score(none, model).collect() == []
    assert toxicity.fit(none, labels)[0].size == 0


@pytest.mark.parametrize("word", ["blargh"])
def test_toxicity_on_held_out_rows(spark, word):
    rng = np.random.default_rng(6)
    rows, labels = [], []
    for i in range(1500):
        words = ["".join(rng.choice(list("aeioudnrst"), 5)) for _ in range(int(rng.integers(5, 120)))]
        toxic = i % 8 == 0
        if toxic:
            words.insert(int(rng.integers(len(words))), word.upper() if i % 16 else word)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    out = [r for r in toxicity.score(docs, model).collect() if held(r["doc_id"], 5)]
    assert sum((r["score"] >= 0.5) == (r["doc_id"] % 8 == 0) for r in out) >= 0.98 * len(out)
