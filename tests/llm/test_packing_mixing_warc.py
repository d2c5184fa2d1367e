import gzip
import hashlib
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm import mixing, packing, vocabulary, warc

# Packing


@cache
def _plain():
    return Tokenizer.from_file(vocabulary.default_path())


@cache
def ids_of(text):
    return _plain().encode(text or "", add_special_tokens=False).ids + [0]


def check_pieces(docs, found, length):
    whole = Counter()
    by_doc = defaultdict(list)
    for r in found:
        by_doc[r["doc_id"], r["doc_tokens"]].append((r["start"], r["length"], np.frombuffer(r["ids"], dtype="<u4").tolist()))
    texts = defaultdict(list)
    for r in docs:
        ids = ids_of(r["text"])
        texts[r["doc_id"], len(ids)].append(ids)
    for key, copies in texts.items():
        pieces = Counter((s, n, tuple(i)) for s, n, i in by_doc[key])
        covered = sum(n * k for (_, n, _), k in pieces.items())
        assert covered == key[1] * len(copies)
        assert all(any(tuple(c[s : s + n]) == i for c in copies) for s, n, i in pieces)
        whole[key] += covered
    assert sum(whole.values()) == sum(r["length"] for r in found)
    sequences = defaultdict(list)
    for r in found:
        assert 0 < r["length"] and r["offset"] + r["length"] <= length
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
    fills = [sum(n for _, n in sequences[s]) for s in sorted(sequences)]
    assert sorted(sequences) == list(range(len(sequences))) and all(f == length for f in fills[:-1])


def test_packing_odd_rows(odd, none):
    found = packing.pack(odd, length=32, window=4).collect()
    check_pieces(odd.collect(), found, 32)
    assert packing.pack(none).collect() == []


def test_packing_follows_targets(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(4)
    rows = docs.collect()
    for targets in (None, {"src1": 3, "src2": 1, "src3": 1}):
        found = packing.pack(docs, targets=targets, length=256, window=8).collect()
        check_pieces(rows, found, 256)
        source = {r["doc_id"]: r["source"] for r in rows}
        total = Counter()
        for r in rows:
            total[r["source"]] += len(ids_of(r["text"]))
        share = total if targets is None else targets
        windows = defaultdict(Counter)
        for r in found:
            windows[r["sequence_id"] // 8][source[r["doc_id"]]] += r["length"]
        for w in sorted(windows)[: 1 if targets else -1]:
            for s in total:
                want = 2048 * share.get(s, 0) / sum(share.values())
                assert abs(windows[w][s] - want) <= 2 * (np.log2(len(total)) + 2), (w, s)


def test_packing_follows_targets_of_many_sources(spark, monkeypatch):
    """With more sources than queues, targets and each source's own share hold as with few."""
    monkeypatch.setattr(packing, "MAX_QUEUES", 4)
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice(["red", "green", "blue"], 60)), f"s{i % 12}" if i % 12 else None) for i in range(480)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    for targets in (None, {"s1": 3, "s2": 1, "s3": 1}):
        found = packing.pack(docs, targets=targets, length=64, window=16).collect()
        check_pieces(docs.collect(), found, 64)
        total, windows = Counter(), defaultdict(Counter)
        for i, text, source in rows:
            total[source] += len(ids_of(text))
        for r in found:
            windows[r["sequence_id"] // 16][rows[r["doc_id"]][2]] += r["length"]
        share = total if targets is None else targets
        for w in sorted(windows)[: 3 if targets else -1]:
            for source in total:
                want = 1024 * share.get(source, 0) / sum(share.values())
                assert abs(windows[w][source] - want) <= 2 * (np.log2(len(total)) + 2), (w, source)


@pytest.mark.parametrize("seed", range(5))
def test_schedule_grants_every_token_once(seed):
    rng = np.random.default_rng(seed)
    totals = rng.integers(0, 40, int(rng.integers(1, 9))).tolist()
    weights = None if seed % 2 else rng.integers(0, 5, len(totals)).tolist()
    s = packing.Schedule(totals, weights)
    before = [0] * len(totals)
    for x in range(s.total + 1):
        if not s.total:
            break
        now = [s.at(i, x) for i in range(len(totals))]
        assert sum(own for _, own in now) == x
        assert [b for b, _ in now] == np.cumsum([0] + [own for _, own in now])[:-1].tolist()
        assert all(b[1] >= a for a, b in zip(before, now))
        before = [own for _, own in now]
    assert not s.total or before == totals


def test_encoder_equals_tokenizers():
    rng = np.random.default_rng(0)
    spec = vocabulary.read_spec(vocabulary.default_path())
    letters = list(" \t\n'sdmtrve09.,<|>é中\U0001f600́\x85\xa0Az")
    texts = ["".join(rng.choice(letters, int(rng.integers(0, 50)))) for _ in range(2000)] + ["<|endoftext|>", "a" * 3000, " " * 3000]
    end = "<|endoftext|>"
    for t in texts[:300]:
        cut = int(rng.integers(0, len(t) + 1))
        texts += [end + t, t + end, t[:cut] + end + t[cut:], t[:cut] + end + end + " " + t[cut:] + end[:-1]]
    assert [e.tolist() for e in vocabulary.encoder(spec)(texts)] == [ids_of(t)[:-1] for t in texts]


# Mixing

LABELS = "doc_id long, quality int, toxic int"


def test_few_labels_give_one_rate(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = mixing.document_rates(docs, labels.limit(12)).collect()
    assert len(rows) == docs.count() and len({round(r["rate"], 9) for r in rows}) == 1 and 0 < rows[0]["rate"] < 1


def test_some_labels_tell_rows_apart(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    some = labels.orderBy("doc_id").limit(40)
    rows = mixing.document_rates(docs, some).collect()
    toxic = {r["doc_id"] for r in some.where("toxic = 1").collect()}
    told = np.array([r["p_toxic"] for r in rows])
    assert len(np.unique(told.round(6))) > 20
    assert told[[r["doc_id"] in toxic for r in rows]].mean() > 1.2 * told[[r["doc_id"] not in toxic for r in rows]].mean()


def test_posteriors_equal_plain_sums(spark, sf_dir):
    """Evidence, sharpness and posteriors worked out word by word from the same tables."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    tables, c = mixing.fit(docs, labels)
    words, shapes, varieties = ({r[0]: r.asDict() for r in t.collect()} for t in tables)
    number = {r["w"]: (r["b"], r["s"]) for r in docs.select(F.explode(F.split("text", mixing.SPACE)).alias("w")).distinct().select(
        "w", F.expr(f"pmod(xxhash64(lower(w)), {mixing.WORD_BUCKETS})").alias("b"),
        F.expr(f"pmod(xxhash64(right(w, 1), w = upper(w) and w <> lower(w)), {mixing.SHAPE_BUCKETS})").alias("s")).collect()}
    found = {r["doc_id"]: r for r in mixing.document_rates(docs, labels).collect()}
    split = __import__("re").compile(mixing.SPACE)
    for row in docs.collect():
        parts = split.split(row["text"] or "")
        sums, held = np.zeros((3, 3)), np.zeros(3)
        for w in parts:
            for table, at, name in ((words, number[w][0], "_bucket"), (shapes, number[w][1], "_shape")):
                if w and at in table:
                    own = table[at]
                    ratio = np.array([own[f"_{name}{k}"] for k in range(3)])
                    sums[0 if own[f"_{name}_marker"] else 1] += ratio
                    held += (ratio > mixing.MARKER_RATIO) & own[f"_{name}_marker"]
        at = int(len(set(parts)) / len(parts) * (mixing.VARIETY_BUCKETS - 1))
        if at in varieties:
            sums[2] = [varieties[at][f"__variety{k}"] for k in range(3)]
        logs = np.array([c[:3] @ sums[:, d] + c[3 + 3 * d : 6 + 3 * d] @ (held > 0) + c[12 + d] for d in range(3)])
        p = np.exp(logs - logs.max())
        r = found[row["doc_id"]]
        assert np.allclose([r[f"p_{d}"] for d in mixing.DOMAINS], p / p.sum(), atol=1e-6)


def test_sharpness_is_never_negative():
    rng = np.random.default_rng(0)
    domain = rng.integers(0, 3, 30)
    evidence = np.zeros((30, 12))
    evidence[:, :3] = -2.0 * np.eye(3)[domain] + rng.normal(0, 0.1, (30, 3))  # speaks against the truth
    evidence[:, 3:6] = 2.0 * np.eye(3)[domain] + rng.normal(0, 0.1, (30, 3))
    c = mixing.calibrate(evidence, domain)
    assert c[0] == 0 and c[1] > mixing.SHARPNESS


def test_rates_meet_targets_within_reach(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")  # enough labels for words to tell
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    plain = mixing.document_rates(docs, labels).collect()
    p = np.array([[r[f"p_{d}"] for d in mixing.DOMAINS] for r in plain])
    t = np.array([r["tokens"] for r in plain])
    assert np.allclose(p.sum(axis=1), 1) and len(np.unique(p.round(6), axis=0)) > 3
    # Totals that some rates have are within reach.
    boosts = dict(zip(mixing.DOMAINS, ((t * (0.3 + p @ [0.9, 0.2, 0.1])) @ p / (t @ p)).tolist()))
    rows = mixing.document_rates(docs, labels, boosts).collect()
    assert len(rows) == docs.count()
    for k, d in enumerate(mixing.DOMAINS):
        found = sum(r["tokens"] * r["rate"] * r[f"p_{d}"] for r in rows)
        assert abs(found - boosts[d] * (t @ p)[k]) < 1e-3 * t.sum()
    assert all(r["rate"] >= 0 and abs(r["copies"] - r["rate"]) < 1 for r in rows)
    words = {r["doc_id"]: len((r["text"] or "").encode().split()) for r in docs.collect()}
    assert all(r["tokens"] == words[r["doc_id"]] for r in rows)


def test_projected_gradient_equals_plain_descent(spark):
    rng = np.random.default_rng(0)
    p = rng.dirichlet([0.4, 0.4, 0.4], 60)
    t = rng.integers(1, 50, 60)
    table = spark.createDataFrame([(int(n), *map(float, x)) for n, x in zip(t, p)], "tokens long, p0 double, p1 double, p2 double")
    boosts = {"good": 2.5, "poor": 0.05, "toxic": 0.6}  # out of reach for rates that are not negative
    steps = mixing.fit_rates(table, boosts, steps=60)
    rates = np.array([r[0] for r in table.select(mixing.rate(steps)).collect()])
    target = t @ p * np.array([2.5, 0.05, 0.6])
    weight = np.linalg.inv((p * t[:, None]).T @ p)
    plain, gaps = np.ones(60), []
    for _ in steps:
        gap = (t * plain) @ p - target
        gaps.append(gap @ weight @ gap)
        plain = np.maximum(0, plain - p @ weight @ gap)
    assert np.allclose(rates, plain) and (rates == 0).any() and (rates > 0).any()
    assert all(b <= a for a, b in zip(gaps, gaps[1:])) and gaps[-1] < 0.2 * gaps[0]
    capped = mixing.fit_rates(table, {"good": 1.0, "poor": 0.5, "toxic": 0.25}, most=1.0)
    rates = [r[0] for r in table.select(mixing.rate(capped, 1.0)).collect()]
    assert 0 < len(capped) < 60 and max(rates) == 1.0 and min(rates) >= 0


def test_rare_domain_meets_its_target(spark):
    rng = np.random.default_rng(2)
    logs = 3 * np.eye(3)[rng.choice(3, 4000, p=[0.95, 0.04, 0.01])] + np.log([0.95, 0.04, 0.01]) + rng.normal(0, 1, (4000, 3))
    p = np.exp(logs) / np.exp(logs).sum(axis=1, keepdims=True)
    t = rng.integers(20, 400, 4000)
    table = spark.createDataFrame([(int(n), *map(float, x)) for n, x in zip(t, p)], "tokens long, p0 double, p1 double, p2 double").coalesce(2)
    boosts = dict(zip(mixing.DOMAINS, ((t * np.maximum(0, 1 - p @ [-0.2, 3, 20])) @ p / (t @ p)).tolist()))
    rates = np.array([r[0] for r in table.select(mixing.rate(mixing.fit_rates(table, boosts))).collect()])
    assert np.allclose((t * rates) @ p / (t @ p), list(boosts.values()), rtol=2e-3)


def test_ordinary_words_tell(spark):
    rng, rows, labels = np.random.default_rng(9), [], []
    for i in range(2000):
        domain = 2 if i % 20 == 0 else 1 if i % 7 == 0 else 0
        words = [f"w{w}" for w in rng.integers(0, 300, 40)]
        if rng.random() < (0.6 if domain == 2 else 0.02):
            words[int(rng.integers(40))] = "spite"
        rows.append((i, " ".join(words)))
        labels.append((i, int(domain != 1), int(domain == 2)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, LABELS)
    found = {r["doc_id"]: r["p_toxic"] for r in mixing.document_rates(docs, known).collect()}
    told = [found[i] for i, text in rows if "spite" in text]
    assert np.mean(told) > 5 * np.mean([found[i] for i, text in rows if "spite" not in text])
    assert abs(np.mean(told) - np.mean([i % 20 == 0 for i, text in rows if "spite" in text])) < 0.2  # and calibrated


def test_mixing_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (5, 1, 0), (9, None, 1), (None, 1, 1), (77, 0, 1), (8, 5, 0)], LABELS)
    for some in (labels, labels.limit(0)):
        rows = mixing.document_rates(odd, some).collect()
        assert len(rows) == odd.count() and all(np.isfinite(r["rate"]) for r in rows)
        assert mixing.document_rates(none, some).collect() == []
        mixed = mixing.mix(odd, some)
        assert mixed.columns == odd.columns
        copies = {}
        for r in rows:
            copies.setdefault(r["doc_id"], r["copies"])
        want = sum(copies[r["doc_id"]] for r in odd.collect())
        assert mixed.count() == want


# WARC


def expected_records(rows, least=1000):
    last = {}
    for i, h in rows:
        b = (h or "").encode()
        if len(b) >= least and i is not None:
            last[b] = max(last.get(b, i), i)
    out = Counter()
    for i, h in rows:
        b = (h or "").encode()
        to = last.get(b)
        revisit = to is not None and i != to
        out[str(i), len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", str(to if revisit else None)] += 1
    return out


PAGES = "page_id long, url string, html string, shard int"


@pytest.mark.parametrize("sent", [0, 1000])
def test_warc_round_trip(spark, monkeypatch, sent):
    monkeypatch.setattr(warc, "SENT_DIGESTS", sent)
    big = "é" * 700 + "\r\n\r\nWARC/1.1\r\n" * 100
    rows = [(1, "u", big, 1), (2, None, big, 1), (2, None, big, 1), (3, "u", None, 1), (4, "u", "", None), (None, "u", big, 1), (5, "u", "small", 1), (6, "u", "small", 1), (7, "u", "x" * 100_000, 1), (8, "u", "\x00 ", 1)]
    pages = spark.createDataFrame(rows, PAGES).repartition(3)
    found = warc.round_trip(pages, chunk_bytes=999)
    table = found.collect()
    last = [r for r in table if r["is_last"]]
    assert Counter((str(r["page_id"]), r["payload_bytes"], r["running_sha1"], r["record_type"], str(r["refers_to"])) for r in last) == expected_records([(r[0], r[2]) for r in rows])
    records = defaultdict(list)
    for r in table:
        records[r["record_id"]].append(r)
    assert len(records) == len(rows)
    for own in records.values():
        own.sort(key=lambda r: r["chunk_no"])
        assert [r["chunk_no"] for r in own] == list(range(len(own))) and [r["is_last"] for r in own] == [False] * (len(own) - 1) + [True]
        digest, payload = hashlib.sha1(), b""
        for r in own:
            digest.update(r["chunk"])
            payload += bytes(r["chunk"])
            assert len(r["chunk"]) <= 999 and (r["record_type"] == "revisit" or r["running_sha1"] == digest.hexdigest())
        if own[0]["record_type"] == "response":
            assert len(payload) == own[0]["payload_bytes"] and payload in {(h or "").encode() for _, _, h, _ in rows}
    assert warc.round_trip(pages.limit(0)).collect() == []


def test_archives_are_plain_warc(spark, tmp_path):
    rows = [(i, "u", f"<p>{i}</p>" * (i + 1), 0) for i in range(40)]
    pages = spark.createDataFrame(rows, PAGES).repartition(2)
    folder = f"file://{tmp_path}/archives"
    (tmp_path / "archives").mkdir()
    manifest = warc.write(warc.decide(pages, "page_id", "html"), folder, 64, archive_bytes=1500).collect()
    assert len(manifest) > 2 and sum(r["records"] for r in manifest) == 40
    text = b"".join(gzip.decompress((tmp_path / "archives" / r["path"]).read_bytes()) for r in manifest)
    assert text.count(b"WARC/1.1\r\n") == 40 and all(f"\r\n\r\n{h}\r\n\r\n".encode() in text for _, _, h, _ in rows)
    broken = bytearray(next((tmp_path / "archives").iterdir()).read_bytes())
    with pytest.raises((ValueError, zlib.error)):
        for _, pieces in warc.records_of(__import__("io").BytesIO(bytes(broken[: len(broken) // 2])), 64):
            list(pieces)


# The pipeline and the registry


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = corpus_pipeline.materialize(stage(spark, docs, sf_dir), f"test-{name}")
        after = docs.collect()
        assert docs.columns == columns and all(before[r["doc_id"]] == r for r in after)
        if name == "near_dedup":
            assert len({r["text"] for r in after}) == len(after)
        if name == "language_id":
            assert len(after) == len(before)
        if name == "toxicity":
            kept = {r["doc_id"] for r in after}
            clean = [i for i, r in labels.items() if i in before and r["toxic"] == 0]
            assert sum(i in kept for i in clean) >= 0.97 * len(clean)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert pieces.agg(F.sum("length")).first()[0] == sum(len(ids_of(r["text"])) for r in docs.collect())


def test_pipeline_odd_rows(spark, odd, none, sf_dir):
    import corpus_pipeline

    # Columns by every name that the stages use inside.
    names = ("_row", "_id", "_key", "_hash", "_copies", "_copy", "_own_id", "row", "own", "h0", "h1", "k", "fp2", "root", "lang_pred", "LANG_SCORE", "toxic_score",
             "_lang_pred", "_stay0", "_mix_id", "queue", "n", "ids", "tokens", "rate", "p0", "a.b")
    wide = odd.select("*", *[F.lit(f"mine {n}").alias(n) for n in names])
    for docs in (wide, wide.limit(0), none):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            columns = docs.columns
            docs = stage(spark, docs, sf_dir)
            assert docs.columns == columns
            docs = corpus_pipeline.materialize(docs, "odd")
            if "queue" in columns:
                assert all(r[n] == f"mine {n}" for r in docs.collect() for n in names)
        corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()


def test_registry_has_one_query_per_operator():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in entry.queries()
