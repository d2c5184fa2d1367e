"""Toxicity by a linear classifier on character n-grams.

Features are the n-grams present in a text, each scaled by its naive Bayes
log-count ratio; a logistic regression with an L2 penalty is fitted on them.
Every n-gram whose share of texts differs between the classes by more than
chance is a feature, however many those are. N-grams are known by 64-bit hashes.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import crc_remainder, discard, distinct, materialize, slices

ORDERS = (3, 4, 5)
#: Labelled rows that the model is fitted on at most: the least by a hash of the id.
TRAIN_ROWS = 20_000
#: Standard errors by which the classes must differ in how many of their texts hold it.
LEAST_TELLING = 5.0
PENALTY, STEPS = 1e-4, 200
_BASE, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Characters that are hashed together.
SPAN = 1 << 19
#: Counted n-grams that a task gathers before it hands them on.
GATHERED = 1 << 21
#: Bits of a hash by which most n-grams that are no features are told apart.
SIEVE_BITS = 20


def normal(text: str | None) -> str:
    """Lower case, runs of white space as one space, a space at either end; '' if there is no word."""
    text = (text or "").lower()
    # The same either way; a very long text is not made into a list of words.
    text = " ".join(text.split()) if len(text) <= SPAN else re.sub(r"\s+", " ", text).strip(" ")
    return f" {text} " if text else ""


def hashes(characters: np.ndarray, order: int) -> np.ndarray:
    """Hash of the n-gram that begins at each place."""
    h = np.full(max(0, len(characters) - order + 1), order, dtype=np.uint64)
    for j in range(order):
        h = h * _BASE + characters[j : len(characters) - order + 1 + j]
    h *= _SPREAD
    return h ^ (h >> np.uint64(32))


class Sieve:
    """Tells which hashes are wanted."""

    def __init__(self, wanted: np.ndarray) -> None:
        self.wanted = np.sort(wanted.astype(np.uint64))
        self.there = np.zeros(1 << SIEVE_BITS, dtype=bool)
        self.there[(self.wanted >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)] = True

    def __call__(self, found: np.ndarray) -> np.ndarray:
        """Places of the wanted ones among the hashes."""
        at = np.flatnonzero(self.there[(found >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)])
        place = np.searchsorted(self.wanted, found[at])
        return at[self.wanted[np.minimum(place, len(self.wanted) - 1)] == found[at]] if len(self.wanted) else at[:0]


def present(texts: list[str | None], sieve: Sieve | None = None):
    """(text, hash) pairs, each once, of the n-grams in the texts; with a sieve, only the wanted ones.

    Yields arrays of pairs for about ``SPAN`` characters at a time; a longer
    text is hashed in parts that overlap and comes out as one.
    """

    def hashed(characters: np.ndarray, owner: np.ndarray):
        rows, keys = [], []
        for order in ORDERS:
            found = hashes(characters, order)
            at = np.arange(len(found)) if sieve is None else sieve(found)
            # No n-gram runs over the border of two texts.
            at = at[owner[at] == owner[at + order - 1]]
            rows.append(owner[at])
            keys.append(found[at])
        return np.concatenate(rows), np.concatenate(keys)

    def pairs(group):
        lengths = np.array([len(t) for _, t in group])
        characters = np.frombuffer("".join(t for _, t in group).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
        rows, keys = hashed(characters, np.repeat(np.arange(len(group), dtype=np.int32), lengths))
        order = np.lexsort((keys, rows)) if len(group) > 1 else np.argsort(keys)
        rows, keys = rows[order], keys[order]
        first = np.ones(len(keys), dtype=bool)
        first[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])
        return np.array([i for i, _ in group])[rows[first]], keys[first]

    def parts(i, text):
        seen = np.zeros(0, dtype=np.uint64)
        for a in range(0, len(text), SPAN):
            part = text[a : a + SPAN + max(ORDERS) - 1]
            characters = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
            seen = distinct(np.concatenate([seen, distinct(hashed(characters, np.zeros(len(part), dtype=np.int32))[1])]))
        return np.full(len(seen), i), seen

    group, size = [], 0
    for i, text in enumerate(texts):
        text = normal(text)
        if len(text) > SPAN:
            yield parts(i, text)
        elif text:
            group.append((i, text))
            size += len(text)
            if size >= SPAN:
                yield pairs(group)
                group, size = [], 0
    if group:
        yield pairs(group)


def logistic(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, labels: np.ndarray, width: int) -> tuple[np.ndarray, float]:
    """Weights and intercept of a penalised logistic regression on sparse rows, by accelerated gradient descent."""
    n = len(labels)
    x = values[columns]
    # Columns are scaled to unit second moment, which evens the problem out.
    spread = np.sqrt(np.bincount(columns, x * x, minlength=width) / n) + 1e-3
    x = x / spread[columns]
    # The largest eigenvalue, by power iterations.
    v = np.ones(width + 1)
    for _ in range(20):
        v /= np.linalg.norm(v)
        along = np.bincount(rows, v[:-1][columns] * x, minlength=n) + v[-1]
        v = np.append(np.bincount(columns, along[rows] * x, minlength=width), along.sum()) / n
    limit = 0.3 * float(np.linalg.norm(v)) + PENALTY
    w, b = np.zeros(width), float(np.log((labels.sum() + 1) / (n - labels.sum() + 1)))
    ahead_w, ahead_b, momentum = w, b, 1.0
    for _ in range(STEPS):
        z = np.bincount(rows, ahead_w[columns] * x, minlength=n) + ahead_b
        error = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels
        next_w = ahead_w - (np.bincount(columns, error[rows] * x, minlength=width) / n + PENALTY * ahead_w) / limit
        next_b = ahead_b - error.mean() / limit
        step = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        ahead_w = next_w + (momentum - 1) / step * (next_w - w)
        ahead_b = next_b + (momentum - 1) / step * (next_b - b)
        w, b, momentum = next_w, next_b, step
    return w / spread, b


def fit(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"):
    """(n-grams, weights, intercept) of a model; learns from labels of rows whose crc32(id as text) mod 5 is not 0.

    At most ``TRAIN_ROWS`` labelled ids are used. An id labelled more than once
    counts as toxic if any label says so. Labels other than 0 and 1, null ids
    and labels without a document are passed over. Without both classes the
    model is the share of toxic labels alone (0 without labels).
    """
    held_out = crc_remainder(F.col(id_col), 5) == 0 if held_out is None else held_out
    usable = labels.where(~held_out & F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
    picked = (
        usable.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_y"))
        .orderBy(F.xxhash64("_id"), "_id").limit(TRAIN_ROWS)
    )
    # The sample is bounded by TRAIN_ROWS.
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    sample = materialize(source.join(F.broadcast(picked), "_id").select("_y", "text"), "labelled")
    rows = {r["_y"]: r["count"] for r in sample.groupBy("_y").count().collect()}
    if len(rows) < 2:
        share = np.clip(float(min(rows, default=0)), 1e-6, 1 - 1e-6)
        return np.zeros(0, dtype=np.uint64), np.zeros(0), float(np.log(share / (1 - share)))
    counted = sample.mapInArrow(_count, "gram long, clean int, toxic int").groupBy("gram")
    counts = materialize(counted.agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "grams")
    chosen = telling(counts, rows[0], rows[1]).orderBy("gram").toArrow()
    grams, ratios = chosen.column("gram").to_numpy().view(np.uint64), chosen.column("ratio").to_numpy()
    # One entry for each n-gram that tells the classes apart.
    sent = docs.sparkSession.sparkContext.broadcast(grams)

    def features(batches):
        sieve = Sieve(sent.value)
        place = np.argsort(sent.value, kind="stable").astype(np.int32)
        for batch in slices(batches):
            y = batch.column("_y").to_numpy()
            lists = [np.zeros(0, dtype=np.int32)] * len(y)
            for row, gram in present(batch.column("text").to_pylist(), sieve):
                there, first = np.unique(row, return_index=True)
                for i, own in zip(there, np.split(place[np.searchsorted(sieve.wanted, gram)], first[1:]), strict=False):
                    lists[i] = own
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(lists, pa.list_(pa.int32()))], names=["y", "grams"])

    table = sample.mapInArrow(features, "y int, grams array<int>").toArrow().combine_chunks()
    lists = table.column("grams").combine_chunks()
    y = table.column("y").to_numpy().astype(np.float64)
    columns = lists.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(y), dtype=np.int32), lists.value_lengths().to_numpy(zero_copy_only=False))
    discard(sample, counts)
    weights, intercept = logistic(row, columns, ratios, y, len(grams))
    return grams, weights * ratios, intercept


def _count(batches):
    """gram, clean, toxic: in how many of a task's texts of each class an n-gram is, in parts of bounded size."""
    keys, toxic, size = [], [], 0

    def merged():
        key, inverse, n = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        ones = np.bincount(inverse, np.concatenate(toxic), minlength=len(key)).astype(np.int32)
        return key, n.astype(np.int32) - ones, ones

    def handed():
        key, clean, ones = merged()
        for a in range(0, len(key), 1 << 17):
            part = slice(a, a + (1 << 17))
            yield pa.RecordBatch.from_arrays([pa.array(key[part].view(np.int64)), pa.array(clean[part]), pa.array(ones[part])], names=["gram", "clean", "toxic"])

    for batch in slices(batches):
        y = batch.column("_y").to_numpy()
        for row, gram in present(batch.column("text").to_pylist()):
            keys.append(gram)
            toxic.append((y[row] == 1).astype(np.int8))
            size += len(gram)
            if size >= GATHERED:
                yield from handed()
                keys, toxic, size = [], [], 0
    if size:
        yield from handed()


def telling(counts: DataFrame, clean: int, toxic: int) -> DataFrame:
    """gram and ratio (log-count ratio) of the n-grams that tell classes of so many texts apart."""
    whole = counts.agg(F.sum("clean"), F.sum("toxic")).first()
    ratio = F.log((F.col("toxic") + 1) / (whole[1] + 1)) - F.log((F.col("clean") + 1) / (whole[0] + 1))
    # How far the shares of the classes' texts that hold the n-gram differ, in standard errors.
    p, q = F.col("toxic") / toxic, F.col("clean") / clean
    both = (F.col("toxic") + F.col("clean")) / (clean + toxic)
    error = F.sqrt((both * (1 - both) + 1e-9) * (1 / clean + 1 / toxic))
    return counts.where(F.abs(p - q) / error >= LEAST_TELLING).select("gram", ratio.alias("ratio"))


def score(docs: DataFrame, model, text_col: str = "text", keep: list[str] | None = None, named: str = "score") -> DataFrame:
    """The columns ``keep`` (all, by default) and score, the probability of being toxic, ``named`` so.

    A null or empty text is scored by the intercept alone. Texts are scored
    whole. A column of the input with that name is replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() != named.lower()]
    # The text goes to Python once, whether it is kept or not; columns go by number, as their names may be any.
    every = list(dict.fromkeys([*keep, text_col]))
    at = every.index(text_col)
    source = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(every)])
    fields = [f"c{i} {source.schema[i].dataType.simpleString()}" for i in range(len(keep))]

    def run(batches):
        grams, own, intercept = sent.value
        sieve, weights = Sieve(grams), own[np.argsort(grams, kind="stable")]
        for batch in slices(batches):
            z = np.full(batch.num_rows, intercept)
            for row, gram in present(batch.column(at).to_pylist(), sieve):
                z += np.bincount(row, weights[np.searchsorted(sieve.wanted, gram)], minlength=batch.num_rows)
            p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(p)], names=[*(f"c{i}" for i in range(len(keep))), "score"])

    return source.mapInArrow(run, ", ".join([*fields, "score double"])).toDF(*keep, named)
