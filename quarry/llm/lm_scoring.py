"""Language-model scoring by deleted interpolation.

A bigram model mixes maximum-likelihood estimates of both orders and a uniform
distribution, P(w | h) = l2 c(h, w) / c(h) + l1 c(w) / N + l0 / (V + 1), with
weights per bucket of the context's frequency, floor(log2 c(h)). The weights
are learned by expectation-maximisation on deleted counts: each training
document in turn is held out, its own counts being taken off. All training
documents are held-out data once.

Counts are exchanged by chunks of about ``CHUNK_BYTES`` of text, not by tokens.
A chunk lists the hashes of its distinct words and word pairs with its own
training counts, dealt by hash over as many reducers as the corpus needs; a
reducer answers each chunk with the totals. A chunk's rows are bounded by its
text and a hot pair is one entry per chunk, so nothing grows with the frequency
of a word, and no table of all n-grams is held or sent anywhere. The files of
each exchange go when its results are there.

EM needs, per token, its bucket and the ratios of the three estimates. These
are summed over the corpus into a histogram of bounded size (ratios in steps
of 2 ** (1 / STEPS)) that the driver iterates on.

Words are known by 64-bit and pairs by 56-bit hashes: of n different pairs, one
shares its hash with another with probability n / 2**56.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import as_bytes, crc_remainder, exchanges_freed, materialize, mix64, slices, small_batches

CHUNK_BYTES = 5 << 20
REDUCER_BYTES = 16 << 20
PAIR_BITS = 56
STEPS = 8
ROUNDS = 60
LEAST_UNIFORM = 1e-6


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted unsigned 64-bit values as differences of the fewest whole bytes."""
    delta = np.diff(keys, prepend=np.uint64(0))
    width = max(1, (int(delta.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(delta.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack_sorted(blob: bytes) -> np.ndarray:
    width = blob[0]
    raw = np.frombuffer(blob, dtype=np.uint8, offset=1).reshape(-1, width)
    whole = np.zeros((len(raw), 8), dtype=np.uint8)
    whole[:, :width] = raw
    return np.cumsum(whole.view("<u8").reshape(-1), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts as bytes, large ones listed after, compressed."""
    raw = np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype("<i8").tobytes()
    return len(counts).to_bytes(4, "little") + zstandard.compress(raw, 1)


def unpack_counts(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:4], "little")
    raw = zstandard.decompress(blob[4:])
    counts = np.frombuffer(raw, dtype=np.uint8, count=n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(raw, dtype="<i8", offset=n)
    return counts


def pack_tokens(tokens: np.ndarray) -> bytes:
    """Small numbers as planes of bytes, compressed."""
    width = max(1, (int(tokens.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(tokens.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].T)
    return bytes([width]) + zstandard.compress(planes.tobytes(), 3)


def unpack_tokens(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob[1:]), dtype=np.uint8).reshape(blob[0], -1)
    whole = np.zeros((planes.shape[1], 4), dtype=np.uint8)
    whole[:, : blob[0]] = planes.T
    return whole.view("<u4").reshape(-1).astype(np.int64)


class Chunk:
    """Tokens of some documents, as numbers of the chunk's own words; number 0 is the end."""

    def __init__(self, keys: np.ndarray, tokens: np.ndarray, sizes: np.ndarray, train: np.ndarray) -> None:
        self.keys, self.tokens, self.sizes, self.train = keys, tokens, sizes, train
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        before = np.empty_like(tokens)
        before[1:], before[:1] = tokens[:-1], 0  # each document begins after an end
        self.before = before
        self.trained = train[self.doc]
        pair, self.pair_of = np.unique(before * len(keys) + tokens, return_inverse=True)
        a, b = keys[pair // len(keys)], keys[pair % len(keys)]
        self.pair_keys = mix64(a * np.uint64(0x9E3779B97F4A7C15) + mix64(b)) << np.uint64(64 - PAIR_BITS) >> np.uint64(64 - PAIR_BITS)

    @classmethod
    def of_texts(cls, texts: list[bytes], train: np.ndarray) -> Chunk:
        number = {b"": 0}
        tokens, sizes = [], []
        for text in texts:
            words = text.lower().split()
            own = [number.setdefault(w, len(number)) for w in words]
            own.append(0)
            tokens.append(np.array(own, dtype=np.int64))
            sizes.append(len(own))
        digest = xxhash.xxh64_intdigest
        keys = np.fromiter(map(digest, number), dtype=np.uint64, count=len(number))
        return cls(keys, np.concatenate(tokens), np.array(sizes, dtype=np.int64), train)

    def own_counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Training counts of the words and the pairs."""
        return (
            np.bincount(self.tokens[self.trained], minlength=len(self.keys)),
            np.bincount(self.pair_of[self.trained], minlength=len(self.pair_keys)),
        )


def _bodies(docs: DataFrame, held_out: Column, id_col: str, text_col: str) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        part, made = TaskContext.get().partitionId(), 0
        ids, held, texts, size = [], [], [], 0

        def flush():
            nonlocal made
            chunk = Chunk.of_texts(texts, ~np.array(held, dtype=bool))
            row = pa.RecordBatch.from_arrays(
                [pa.array([part << 24 | made], pa.int64()), pa.array([ids], pa.list_(id_type)), pa.array([held], pa.list_(pa.bool_())),
                 pa.array([chunk.sizes], pa.list_(pa.int64())), pa.array([chunk.keys.tobytes()]), pa.array([pack_tokens(chunk.tokens)])],
                names=["chunk", "ids", "held", "sizes", "keys", "tokens"],
            )
            made += 1
            for x in (ids, held, texts):
                x.clear()
            return row

        for batch in slices(batches):
            id_type = batch.schema.field("id").type
            for i, h, t in zip(batch.column("id").to_pylist(), batch.column("held").to_pylist(), as_bytes(batch.column("text")), strict=True):
                ids.append(i)
                held.append(h)
                texts.append(t)
                size += len(t) + 64
                if size >= CHUNK_BYTES:
                    yield flush()
                    size = 0
        if ids:
            yield flush()

    source = docs.select(F.col(id_col).alias("id"), held_out.alias("held"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"chunk long, ids array<{kind}>, held array<boolean>, sizes array<long>, keys binary, tokens binary")


def _chunk(row: dict) -> Chunk:
    return Chunk(np.frombuffer(row["keys"], dtype=np.uint64), unpack_tokens(row["tokens"]), np.array(row["sizes"]), ~np.array(row["held"], dtype=bool))


def _ask(bodies: DataFrame, reducer_bits: int) -> DataFrame:
    """(chunk, reducer, level, keys, counts): what each chunk asks each reducer."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]  # a row is megabytes
                chunk = _chunk(row)
                for level, keys, counts, bits in zip((1, 2), (chunk.keys, chunk.pair_keys), chunk.own_counts(), (64, PAIR_BITS), strict=True):
                    order = np.argsort(keys, kind="stable")
                    keys, counts = keys[order], counts[order]
                    reducers = np.arange(1 << reducer_bits, dtype=np.uint64)
                    cuts = np.searchsorted(keys, reducers << np.uint64(bits - reducer_bits)).tolist() + [len(keys)]
                    some = [(r, a, b) for r, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["chunk"]] * len(some), pa.int64()), pa.array([r for r, _, _ in some], pa.int32()), pa.array([level] * len(some), pa.int32()),
                         pa.array([pack_sorted(keys[a:b]) for _, a, b in some], pa.binary()), pa.array([pack_counts(counts[a:b]) for _, a, b in some], pa.binary())],
                        names=["chunk", "reducer", "level", "keys", "counts"],
                    )

    return bodies.mapInArrow(run, "chunk long, reducer int, level int, keys binary, counts binary")


def _answer(asked: DataFrame) -> DataFrame:
    """The same rows with total counts; words and tokens in training are on one row per reducer."""

    def run(table: pa.Table) -> pa.Table:
        chunk, level = table.column("chunk").to_numpy(), int(table.column("level")[0].as_py())
        keys = [unpack_sorted(b) for b in table.column("keys").to_pylist()]
        own = np.concatenate([unpack_counts(b) for b in table.column("counts").to_pylist()])
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.zeros(len(distinct), dtype=np.int64)
        np.add.at(totals, place, own)
        ends = np.cumsum([len(k) for k in keys])
        replies = [pack_counts(totals[p]) for p in np.split(place, ends[:-1])]
        words, tokens = np.zeros(len(chunk), dtype=np.int64), np.zeros(len(chunk), dtype=np.int64)
        if level == 1:
            words[0], tokens[0] = (totals > 0).sum(), totals.sum()
        return pa.table(
            [table.column("chunk"), table.column("reducer"), table.column("level"), pa.array(replies, pa.binary()), pa.array(words), pa.array(tokens)],
            names=["chunk", "reducer", "level", "totals", "words", "tokens"],
        )

    return asked.groupBy("reducer", "level").applyInArrow(run, "chunk long, reducer int, level int, totals binary, words long, tokens long")


def _resolved(body: pa.Table, replies: pa.Table) -> tuple[dict, Chunk, np.ndarray, np.ndarray]:
    """A chunk with the corpus' training counts of its words and pairs."""
    row = body.to_pylist()[0]
    chunk = _chunk(row)
    levels, reducers = replies.column("level").to_numpy(), replies.column("reducer").to_numpy()
    blobs = replies.column("totals").to_pylist()
    out = []
    for level, keys in ((1, chunk.keys), (2, chunk.pair_keys)):
        own = np.flatnonzero(levels == level)
        own = own[np.argsort(reducers[own])]
        totals = np.empty(len(keys), dtype=np.int64)
        totals[np.argsort(keys, kind="stable")] = np.concatenate([unpack_counts(blobs[i]) for i in own])
        out.append(totals)
    return row, chunk, *out


def _bucket(counts: np.ndarray) -> np.ndarray:
    """0 for unseen contexts, else 1 + floor(log2 of the count)."""
    return np.where(counts > 0, 1 + np.floor(np.log2(np.maximum(counts, 1))).astype(np.int64), 0)


def _level(ratio: np.ndarray) -> np.ndarray:
    """0 for none, else a step of the ratio's logarithm; ratios fit 2**-120 to 2**120."""
    steps = np.rint(np.log2(np.where(ratio > 0, ratio, 1.0)) * STEPS).astype(np.int64)
    return np.where(ratio > 0, 1000 + steps, 0)


def deleted_events(chunk: Chunk, words: np.ndarray, pairs: np.ndarray, vocabulary: int, tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """Histogram cells (bucket, level of each order's ratio to the uniform) and tokens in them."""
    own = chunk.trained
    if not own.any():
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    doc, token, before, pair = chunk.doc[own], chunk.tokens[own], chunk.before[own], chunk.pair_of[own]

    def in_document(item: np.ndarray, width: int) -> np.ndarray:
        _, place, n = np.unique(doc * width + item, return_inverse=True, return_counts=True)
        return n[place]

    # A context occurs as often as its word: each token is followed by one, and begins one if it is an end.
    c_w = words[token] - in_document(token, len(words))
    c_h = words[before] - in_document(before, len(words))
    c_hw = pairs[pair] - in_document(pair, len(pairs))
    left = tokens - chunk.sizes[doc]
    uniform = 1.0 / (vocabulary + 1)
    r2 = np.where(c_h > 0, c_hw / np.maximum(c_h, 1), 0) / uniform
    r1 = np.where(left > 0, c_w / np.maximum(left, 1), 0) / uniform
    cell = (_bucket(c_h) * 2048 + _level(r2)) * 2048 + _level(r1)
    return np.unique(cell, return_counts=True)


def learn_weights(cells: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Weights (uniform, words, pairs) of each of 65 buckets by expectation-maximisation.

    Buckets without events take those of the nearest bucket that has some.
    """
    bucket, l2, l1 = cells // (2048 * 2048), cells // 2048 % 2048, cells % 2048
    back = lambda level: np.where(level > 0, 2.0 ** ((level - 1000) / STEPS), 0.0)
    weights = np.full((65, 3), np.nan)
    for b in np.unique(bucket):
        own = bucket == b
        p = np.stack([np.ones(own.sum()), back(l1[own]), back(l2[own])], axis=1)
        n = counts[own].astype(np.float64)
        w = np.full(3, 1 / 3)
        for _ in range(rounds):
            share = p * w
            w = (share / share.sum(axis=1, keepdims=True) * n[:, None]).sum(axis=0) / n.sum()
        w = np.maximum(w, [LEAST_UNIFORM, 0, 0])
        weights[b] = w / w.sum()
    known = np.flatnonzero(~np.isnan(weights[:, 0]))
    if not len(known):
        return np.tile([1.0, 0.0, 0.0], (65, 1))
    for b in range(65):
        if np.isnan(weights[b, 0]):
            weights[b] = weights[known[np.argmin(np.abs(known - b))]]
    # An unseen context has no pairs to give weight to.
    weights[0] = np.array([*weights[0, :2], 0]) / weights[0, :2].sum()
    return weights


def score_chunk(chunk: Chunk, words: np.ndarray, pairs: np.ndarray, vocabulary: int, tokens: int, weights: np.ndarray):
    """n_known, base score and score of each document."""
    c_w, c_h, c_hw = words[chunk.tokens], words[chunk.before], pairs[chunk.pair_of]
    w = weights[_bucket(c_h)]
    p = w[:, 0] / (vocabulary + 1) + w[:, 1] * c_w / max(tokens, 1) + w[:, 2] * c_hw / np.maximum(c_h, 1)
    base = np.log10((c_w + 0.1) / (tokens + 0.1 * (vocabulary + 1)))
    n = len(chunk.sizes)
    return np.bincount(chunk.doc, c_w > 0, n).astype(np.int64), np.bincount(chunk.doc, base, n), np.bincount(chunk.doc, np.log10(p), n)


def score(docs: DataFrame, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Learns from the rows that are not held out (crc32 of the id as text, modulo
    10, is 0). Tokens are the lower-cased text's words and one end. base_score
    is the log10 probability under unigrams with 0.1 added to each count,
    score that under the interpolated model. A null or empty text has the end
    as its only token. Without training rows both scores are 0. Null or
    repeated ids are rows of their own. An empty table gives no rows. Further
    columns are not read.
    """
    held_out = crc_remainder(F.col(id_col), 10) == 0 if held_out is None else held_out
    with small_batches(docs.sparkSession), exchanges_freed(docs.sparkSession):
        size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
        reducer_bits = max(6, (size // REDUCER_BYTES).bit_length())
        bodies = materialize(_bodies(docs, held_out, id_col, text_col), "chunks")
        replies = materialize(_answer(_ask(bodies.select("chunk", "held", "sizes", "keys", "tokens"), reducer_bits)), "replies")
        totals = replies.agg(F.sum("words"), F.sum("tokens")).first()
    vocabulary, tokens = (int(x or 0) for x in totals)
    asked = replies.select("chunk", "reducer", "level", "totals").groupBy("chunk")

    def events(body: pa.Table, own: pa.Table) -> pa.Table:
        cells, counts = deleted_events(*_resolved(body, own)[1:], vocabulary, tokens)
        return pa.table([pa.array(cells), pa.array(counts)], names=["cell", "n"])

    with small_batches(docs.sparkSession), exchanges_freed(docs.sparkSession):
        found = (
            bodies.select("chunk", "held", "sizes", "keys", "tokens").groupBy("chunk").cogroup(asked)
            .applyInArrow(events, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        )
    weights = learn_weights(found.column("cell").to_numpy(), found.column("n").to_numpy())
    kind = docs.schema[id_col].dataType.simpleString()

    def result(body: pa.Table, own: pa.Table) -> pa.Table:
        row, chunk, words, pairs = _resolved(body, own)
        n_known, base, own_score = score_chunk(chunk, words, pairs, vocabulary, tokens, weights)
        ids = body.column("ids").combine_chunks().flatten()
        return pa.table(
            [ids, pa.array(row["held"], pa.bool_()), pa.array(chunk.sizes), pa.array(n_known), pa.array(np.full(len(ids), tokens)), pa.array(base), pa.array(own_score)],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return bodies.groupBy("chunk").cogroup(asked).applyInArrow(
        result, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
