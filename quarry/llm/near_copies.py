"""Near copies by word-shingle similarity, found with SimHash fingerprints and BK-trees.

Two texts are near copies if the Jaccard similarity of their sets of five-word
shingles is at least 0.8. Each bit of a SimHash is the majority vote of the set's
hashes; bits beyond 64 are of their scramblings. Bits of texts at 0.8 agree with
probability ``AGREE`` or more, by simulation of sets of all sizes (``AGREE_FEW``: of
4 and 5 shingles). As that is too seldom for blocks of bits of which one has to
agree for certain, texts are sharded by as many blocks as leave at most ``LOSS`` of
the texts at 0.8 without a common one; a block has as many bits as make shards of
about ``SHARD_ROWS`` texts.

A shard's fingerprints, by their first 64 * ``WORDS`` bits, become a BK-tree that finds all
pairs within ``RADIUS`` bits. Texts at 0.8 are farther apart once in 100,000 pairs
(binomial), unlike texts are as near once in five million; but texts that share a passage
or a common line are so far more often, and chains of them would join whole shards. So all
64 * ``LONG_WORDS`` bits of what a tree finds have to be within ``LONG_RADIUS``, where
texts at 0.8 are but for 3 pairs in ten million. What chains of such
pairs join is a neighbourhood; equal neighbourhoods of several shards are one. A shard too
large for one tree has a centre, the fingerprint nearest to the majority of all: those near it
need no search, which makes a group of copies cost what its texts do, not what their pairs would.
The others are cut into lots and all into parts, and each part's tree meets the fingerprints
of every lot in tasks of their own; all that are near another are the shard's neighbourhood.

Exact sets then decide in each neighbourhood, and join all that comparing its texts
within the radius pair by pair would. First each text is compared with the least
one, once however many neighbourhoods the two share, and where that leaves some apart, with the
one whose fingerprint is nearest to the majority of all, as that of an
original is to its copies': a group of copies of any size is then a star, at a
cost that grows with its texts, not with their pairs. Only texts that this leaves
apart from their centre are compared with all others of the neighbourhood:
BK-trees propose the pairs, those joined already are passed over,
and exact sets decide. Sets are made for texts in neighbourhoods alone.
Texts that are equal but for case and white space are one text.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import as_bytes, discard, distinct, exchanges_freed, materialize, mix64, sent_if_small, slices, small_batches, unpacked, whole_row
from .simhash import BKTree, _forest, bits_apart, components, normalised, shingle_hashes

WIDTH, SIMILARITY = 5, 0.8
#: Words of a fingerprint that trees compare, and bits that near copies differ in at most.
WORDS, RADIUS = 3, 60
#: Words of a whole fingerprint, and bits of it that near copies differ in at most.
LONG_WORDS, LONG_RADIUS = 8, 142
AGREE, AGREE_FEW, FEW = 0.8375, 0.8125, 5
LOSS = 0.001
#: Texts of a shard, about, and of one tree at most.
SHARD_ROWS, TREE_ROWS = 256, 1024
#: Texts, and bytes of their sets, that a task compares with as many others at most, about.
CELL_ROWS, CELL_BYTES = 256, 64 << 20
#: Texts that meet a star's centre in one task, about.
STAR_ROWS = 256
#: Texts whose shingles are wanted are sent to all tasks up to this many (16 bytes each).
SENT_TEXTS = 1_000_000


def min_hashes(hashes: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation min-hash; an empty bin borrows from the next that is not. No query uses it any more."""
    out = np.full(bins, np.iinfo(np.uint64).max, dtype=np.uint64)
    np.minimum.at(out, (hashes % np.uint64(bins)).astype(np.int64), hashes // np.uint64(bins))
    full = np.flatnonzero(out != np.iinfo(np.uint64).max)
    if len(full) < bins:
        every = np.arange(bins)
        at = np.searchsorted(full, every)
        lender = full[at % len(full)]
        out = out[lender] + ((lender - every) % bins).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return out


def simhash(hashes: np.ndarray, words: int) -> np.ndarray:
    """64 * words bits, each 1 if it is set in over half of the hashes (the first 64) or of a scrambling of them."""
    seeds = np.arange(words, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
    places = np.arange(8, dtype=np.uint64)[:, None, None]
    ones = np.zeros((8, words, 8), dtype=np.int64)
    for a in range(0, len(hashes), 255):  # as many as a byte can count
        part = hashes[a : a + 255]
        mixed = mix64(part + seeds)
        mixed[0] = part
        # Of each byte of the sum, the hashes that have the bit of this place set in this byte.
        counts = ((mixed >> places) & np.uint64(0x0101010101010101)).sum(axis=2, dtype=np.uint64)
        ones += counts.view(np.uint8).reshape(8, words, 8)
    return (2 * ones > len(hashes)).transpose(1, 2, 0).reshape(-1)


def block_plan(texts: int) -> tuple[int, int, int]:
    """Bits of a block, and blocks of a text, and of one of at most FEW shingles."""
    bits = max(8, math.ceil(math.log2(max(texts, 1) / SHARD_ROWS)))
    return bits, *(math.ceil(math.log(LOSS) / math.log1p(-(agree**bits))) for agree in (AGREE, AGREE_FEW))


def band_keys(blocks: np.ndarray) -> list[int]:
    """The shards of a text: each row of bits, a block of its SimHash, by place and value."""
    places, bits = np.arange(len(blocks)), np.arange(blocks.shape[1])
    return (places << 40 | (blocks.astype(np.int64) << bits).sum(axis=1)).tolist()


def _row_hashes(id_col: str, text_col: str) -> list:
    return [F.xxhash64(id_col, text_col), F.xxhash64(text_col, id_col, F.lit(1))]


def _fp(fps: np.ndarray) -> pa.Array:
    """Fingerprints, rows of words, as Spark has them."""
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(w).view(np.int64)) for w in fps.T], names=[f"w{i}" for i in range(fps.shape[1])])


def _fps(column: pa.ChunkedArray) -> np.ndarray:
    return np.stack([w.to_numpy() for w in pa.concat_arrays(column.chunks).flatten()], axis=1).view(np.uint64)


FP, LONG_FP = (f"struct<{', '.join(f'w{i}: bigint' for i in range(n))}>" for n in (WORDS, LONG_WORDS))


def _apart_by(a: str, b: str, words: int = WORDS) -> Column:
    """Bits that two columns of fingerprints differ in, of so many words."""
    return reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{a}.w{i}").bitwiseXOR(F.col(f"{b}.w{i}"))) for i in range(words)])


def _near(a: str, b: str, radius: int, words: int) -> Column:
    """Whether two columns of fingerprints of so many words are as near as ``Sieve`` asks."""
    near = _apart_by(a, b) <= radius
    return near & (_apart_by(a, b, words) <= LONG_RADIUS) if words > WORDS else near


class Sieve:
    """A BK-tree over the first words of fingerprints, whose finds are compared by all words, if there are more."""

    def __init__(self, fps: np.ndarray) -> None:
        values, first = np.unique(fps[:, :WORDS], axis=0, return_inverse=True)
        first = first.reshape(-1)
        self.fps, self.tree, self.order = fps, BKTree(values), np.argsort(first, kind="stable")
        self.counts = np.bincount(first)
        self.starts = np.cumsum(self.counts) - self.counts

    def within(self, queries: np.ndarray, radius: int):
        """Places (query, fingerprint) of all near pairs, some at a time."""
        for a in range(0, len(queries), 256):
            for q, node in self.tree.within(queries[a : a + 256, :WORDS], radius):
                n = self.counts[node]
                ends = np.cumsum(n)
                q, at = np.repeat(q + a, n), self.order[np.repeat(self.starts[node] - ends + n, n) + np.arange(ends[-1])]
                if self.fps.shape[1] > WORDS:
                    near = bits_apart(queries[q], self.fps[at]) <= LONG_RADIUS
                    q, at = q[near], at[near]
                yield q, at


def _sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row (id and hashes), k (128 bits of the normalised text), fp, size (different shingles) and shard keys of every row."""
    row = F.struct(F.col(id_col).alias("id"), *[h.alias(f"h{i}") for i, h in enumerate(_row_hashes(id_col, text_col))])
    source = docs.select(row.alias("row"), F.col(text_col).alias("text"))
    bits, usual, more = block_plan(docs.count())

    def run(batches):
        for batch in slices(batches):
            k, fp, size, keys = [], [], [], []
            for text in as_bytes(batch.column("text")):
                text = normalised(text)
                # As a set: a repeated passage must not outweigh the rest, as similarity is of sets.
                h = distinct(shingle_hashes(text, WIDTH))
                n = more if len(h) <= FEW else usual
                votes = simhash(h, max(LONG_WORDS, -(-n * bits // 64)))
                k.append(xxhash.xxh3_128_digest(text))
                fp.append(np.packbits(votes[: 64 * LONG_WORDS], bitorder="little").view(np.uint64))
                size.append(len(h))
                keys.append(band_keys(votes[: n * bits if len(h) else 0].reshape(-1, bits)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(k, pa.binary()), _fp(np.array(fp).reshape(-1, LONG_WORDS)), pa.array(size, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                names=["row", "k", "fp", "size", "keys"],
            )

    return source.mapInArrow(run, f"row {source.schema['row'].dataType.simpleString()}, k binary, fp {LONG_FP}, size long, keys array<long>")


def neighbourhoods(filed: DataFrame, radius: int, tree_rows: int = TREE_ROWS) -> DataFrame:
    """Groups (key, fp) of the fingerprints filed under shards (key, fp) such that any two within the radius in a shard are in a group."""
    parts = F.ceil(F.count(F.lit(1)) / tree_rows).cast("int")
    large = materialize(filed.groupBy("key").agg(parts.alias("parts")).where("parts > 1"), "large")
    some = large.count()
    hint = sent_if_small(large)
    words = len(filed.schema["fp"].dataType)
    shape = f"key long, fp {filed.schema['fp'].dataType.simpleString()}"

    def whole(table: pa.Table) -> pa.Table:
        values, copies = np.unique(_fps(table.column("fp")), axis=0, return_counts=True)
        parent = np.arange(len(values))
        for q, node in Sieve(values).within(values, radius):
            parent = _forest(len(values), q, node, parent)
        met = np.flatnonzero(np.bincount(parent, copies, len(values))[parent] > 1)
        met = met[np.argsort(parent[met], kind="stable")]
        cuts = np.flatnonzero(np.diff(parent[met], prepend=-1))
        # Named by its members, which are in order, so that shards with the same one agree.
        names = [xxhash.xxh64_intdigest(m.tobytes()) for m in np.split(values[met], cuts[1:])] if len(met) else []
        keys = np.repeat(np.array(names, dtype=np.uint64), np.diff(cuts, append=len(met)))
        return pa.table([pa.array(keys.view(np.int64)), _fp(values[met])], names=["key", "fp"])

    own = filed.join(hint, "key", "left_anti") if some else filed
    out = _by_cell(own, ["key"], shape, whole)
    if not some:
        discard(large)
        return out

    def part(table: pa.Table) -> pa.Table:
        fps, asks = _fps(table.column("fp")), table.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        values, copies = np.unique(fps[~asks], axis=0, return_counts=True)
        queries = np.unique(fps[asks], axis=0)
        near, asked = np.zeros(len(values), dtype=bool), np.zeros(len(queries), dtype=bool)
        if len(values):
            for q, node in Sieve(values).within(queries, radius):
                # All that ask are among the others too.
                real = (queries[q] != values[node]).any(axis=1) | (copies[node] > 1)
                near[node[real]] = asked[q[real]] = True
        found = np.concatenate([values[near], queries[asked]])
        return pa.table([pa.array(np.full(len(found), table.column("key")[0].as_py())), _fp(found)], names=["key", "fp"])

    dealt = materialize(filed.join(hint, "key"), "dealt")
    counts, majority = _majority("fp", "n")
    middle = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *counts).select("key", majority.alias("majority"))
    middle = sent_if_small(materialize(middle, "middle"))
    centres = dealt.join(middle, "key").groupBy("key").agg(F.min(F.struct(_apart_by("fp", "majority").alias("far"), "fp")).alias("m"))
    centres = sent_if_small(materialize(centres.select("key", F.col("m.fp").alias("centre")), "centre"))
    told = materialize(dealt.join(centres, "key").select("key", "fp", "parts", (~_near("fp", "centre", radius, words)).alias("asks")), "told")
    sums = told.groupBy("key").agg(F.ceil(F.count_if("asks") / tree_rows).cast("int").alias("lots"), F.count_if(~F.col("asks")).alias("met"))
    sums = sent_if_small(materialize(sums, "sums"))
    told = told.join(sums, "key")
    # The centre itself is one of those near it.
    out = out.unionByName(told.where(~F.col("asks") & (F.col("met") > 1)).select("key", "fp").distinct())
    # Each lot of those far from the centre (i) meets each part of all (j); equal fingerprints are in one part.
    deal = lambda n: F.pmod(F.xxhash64("fp"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = told.where("lots > 0")
    first = left.where("asks").select("key", deal("lots").alias("i"), every("parts").alias("j"), "asks", "fp")
    second = left.select("key", every("lots").alias("i"), deal("parts").alias("j"), F.lit(False).alias("asks"), "fp")
    return out.unionByName(_by_cell(first.unionByName(second), ["key", "i", "j"], shape, part)).distinct()


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """k and the sorted set of 32-bit shingle hashes of the wanted texts (rows h0, h1, k)."""
    h0, h1 = _row_hashes(id_col, text_col)
    if wanted.count() <= SENT_TEXTS:
        wanted = F.broadcast(wanted)
    texts = docs.select(h0.alias("h0"), h1.alias("h1"), F.col(text_col).alias("text")).join(wanted, ["h0", "h1"]).select("k", "text")

    def run(batches):
        for batch in slices(batches):
            sets = [distinct((shingle_hashes(normalised(t), WIDTH) >> np.uint64(32)).astype(np.uint32)).tobytes() for t in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(sets, pa.binary())], names=["k", "shingles"])

    return texts.mapInArrow(run, "k binary, shingles binary").dropDuplicates(["k"])


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether the Jaccard similarity of two sorted sets reaches the threshold."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    both = np.sort(np.concatenate([a, b]))
    shared = int((both[1:] == both[:-1]).sum())
    return shared >= similarity * (len(a) + len(b) - shared)


def verified_links(left: np.ndarray, right: np.ndarray, fps: np.ndarray, sets: list[np.ndarray], label: np.ndarray, similarity: float, radius: int) -> list[tuple[int, int]]:
    """Links, by place, that join what chains of near copies between left and right join; equal labels are joined already."""
    sieve, label, found = Sieve(fps[left]), label.copy(), []
    for i in right.tolist():
        others = left[np.concatenate([at for _, at in sieve.within(fps[i : i + 1], radius)] or [np.zeros(0, dtype=np.int64)])]
        others = others[label[others] != label[i]]
        while len(others):
            j = int(others[0])
            if alike(sets[i], sets[j], similarity):
                found.append((i, j))
                label[label == label[j]] = label[i]
                others = others[label[others] != label[i]]
            else:
                others = others[1:]
    return found


def stars(members: DataFrame, sets: DataFrame, similarity: float, radius: int) -> DataFrame:
    """Links (a, b) of texts (k, fp, size) to their ``centre`` (a struct of the same), for all near copies among them, each pair once."""
    pairs = members.where("k <> centre.k").select("k", F.col("centre.k").alias("centre"), "fp", "size", F.col("centre.fp").alias("fp0"), F.col("centre.size").alias("size0")).distinct()
    # The first step of a tree whose root is the centre, and what sizes alone rule out; sizes are of sets of longer hashes.
    sizes = F.least("size", "size0") + 2 >= similarity * F.greatest("size", "size0")
    pairs = pairs.where(_near("fp", "fp0", radius, LONG_WORDS) & sizes).select("k", "centre")
    pairs = materialize(pairs, "pairs")
    parts = materialize(pairs.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / STAR_ROWS).cast("int").alias("parts")), "centres")
    centres = parts.join(sets.select(F.col("k").alias("centre"), F.col("shingles").alias("shingles0")), "centre")
    centres = centres.select("centre", "shingles0", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    dealt = pairs.join(sent_if_small(parts), "centre").select("k", "centre", F.pmod(F.xxhash64("k"), F.col("parts")).cast("int").alias("part"))
    met = dealt.join(sets, "k").join(centres.drop("parts"), ["centre", "part"]).select("k", "centre", "shingles", "shingles0")

    def run(batches):
        for batch in slices(batches):
            a, b = ([np.frombuffer(x, dtype=np.uint32) for x in batch.column(c).to_pylist()] for c in ("shingles", "shingles0"))
            good = [i for i, (x, y) in enumerate(zip(a, b, strict=True)) if alike(x, y, similarity)]
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(good, pa.int64())) for c in ("k", "centre")], names=["a", "b"])

    with small_batches(members.sparkSession):
        out = materialize(met.mapInArrow(run, "a binary, b binary"), "stars")
    discard(pairs, parts)
    return out


def _majority(fp: str, n: str) -> tuple[list[Column], Column]:
    """Aggregates that count the fingerprints' bits, and the fingerprint of those set in over half."""
    counts = [F.sum(F.shiftrightunsigned(f"{fp}.w{w}", i).bitwiseAND(1)).alias(f"b{w}_{i}") for w in range(WORDS) for i in range(64)]
    bit = lambda w, i: F.when(2 * F.col(f"b{w}_{i}") > F.col(n), F.lit(1 << i if i < 63 else -(1 << 63))).otherwise(F.lit(0))
    word = lambda w: reduce(lambda x, y: x.bitwiseOR(y), [bit(w, i).cast("long") for i in range(64)])
    return counts, F.struct(*[word(w).alias(f"w{w}") for w in range(WORDS)])


def _apart(members: DataFrame, links: DataFrame) -> DataFrame:
    """The members (key, k, .., centre) of shards where some are not joined to the centre, with label, rest (whether they are the ones) and how many are left."""
    roots = components(links)
    known = sent_if_small(roots)
    label = lambda of: known.select(F.col("node").alias(f"{of}_node"), F.col("root").alias(f"{of}_root"))
    told = members.join(label("own"), F.col("k") == F.col("own_node"), "left").join(label("centre"), F.col("centre.k") == F.col("centre_node"), "left")
    own = F.coalesce("own_root", "k")
    told = told.select(*members.columns, own.alias("label"), (own != F.coalesce("centre_root", F.col("centre.k"))).alias("rest"))
    told = materialize(told, "told")
    open_ = materialize(told.groupBy("key").agg(F.count_if("rest").alias("left")).where("left > 0"), "open")
    out = materialize(told.join(sent_if_small(open_), "key"), "apart")
    discard(told, open_)
    return out


def links(texts: DataFrame, docs: DataFrame, id_col: str, text_col: str, similarity: float, radius: int, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Links (a, b) between texts (row, k, fp, size, keys) that give the components of near copies."""
    texts = materialize(texts, "texts")
    near = materialize(neighbourhoods(texts.select("fp", F.explode("keys").alias("key")), radius), "neighbourhoods")
    filed = texts.select("row", "k", "fp", "size").join(near, "fp")
    groups = filed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles_"), F.min(F.struct("k", "fp", "size")).alias("centre")).where("n > 1")
    shards = materialize(filed.join(groups, "key"), "shards")
    discard(texts, near)
    wanted = shards.select("k", "row").distinct().select("row.h0", "row.h1", "k")
    sets = materialize(_sets(docs, wanted, id_col, text_col), "shingles")
    star = stars(shards, sets, similarity, radius)
    # In a shard of two there is nothing else to compare.
    some = _apart(shards.where("n > 2").drop("row"), star)
    if some.isEmpty():
        discard(some, shards, sets)
        return star
    counts, majority = _majority("fp", "n")
    middle = some.groupBy("key").agg(F.first("n").alias("n"), *counts).select("key", majority.alias("majority"))
    middle = sent_if_small(materialize(middle, "majorities"))
    far = _apart_by("fp", "majority")
    centres = some.join(middle, "key").groupBy("key").agg(F.min(F.struct(far.alias("far"), "k", "fp", "size")).alias("m"))
    centres = sent_if_small(materialize(centres.select("key", F.struct("m.k", "m.fp", "m.size").alias("centre")), "middles"))
    second = some.drop("centre", "label", "rest", "left").join(centres, "key")
    star = star.unionByName(stars(second, sets, similarity, radius))
    cells = _apart(second, star)
    discard(some)
    if cells.isEmpty():
        discard(cells, shards, sets)
        return star
    apart, cells = cells, cells.withColumn("bytes", F.col("shingles_") * 4)
    cells = cells.withColumn("parts", F.greatest(F.ceil(F.col("n") / cell_rows), F.ceil(F.col("bytes") / CELL_BYTES)).cast("int"))
    cells = cells.withColumn("lots", F.least(F.col("parts"), F.greatest(F.ceil(F.col("left") / cell_rows), F.ceil(F.col("bytes") / CELL_BYTES))).cast("int"))
    # Each lot of the texts left apart (i) meets each part of all (j); a text left apart is in both.
    deal = lambda n: F.pmod(F.xxhash64("k"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    first = cells.where("rest").select("key", deal("lots").alias("i"), every("parts").alias("j"), F.lit(True).alias("asks"), "k", "fp", "label")
    second = cells.select("key", every("lots").alias("i"), deal("parts").alias("j"), F.lit(False).alias("asks"), "k", "fp", "label")
    met = first.unionByName(second).join(sets, "k")

    def solve(table: pa.Table) -> pa.Table:
        asks, k = np.array(table.column("asks").to_pylist(), dtype=bool), table.column("k").to_pylist()
        found = []
        if asks.any() and not asks.all():
            sets = [np.frombuffer(b, dtype=np.uint32) for b in table.column("shingles").to_pylist()]
            fps = _fps(table.column("fp"))
            _, label = np.unique(np.array(table.column("label").to_pylist(), dtype=object), return_inverse=True)
            found = verified_links(np.flatnonzero(~asks), np.flatnonzero(asks), fps, sets, label, similarity, radius)
        return pa.table([pa.array([k[a] for a, _ in found], pa.binary()), pa.array([k[b] for _, b in found], pa.binary())], names=["a", "b"])

    with small_batches(docs.sparkSession):
        rest = materialize(_by_cell(met, ["key", "i", "j"], "a binary, b binary", solve), "rest")
    discard(apart, shards, sets)
    return star.unionByName(rest)


def _by_cell(cells: DataFrame, keys: list[str], shape: str, solve) -> DataFrame:
    """What ``solve`` makes of cells of two rows or more, once each, one after the other from sorted partitions: most are too small for a group each."""

    def run(batches):
        waiting = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            waiting = table if waiting is None else pa.concat_tables([waiting, table])
            m = np.stack([waiting.column(c).to_numpy() for c in keys], axis=1)
            done = int(np.argmax((m == m[-1]).all(axis=1)))
            if done:
                yield from each(waiting.slice(0, done), m[:done])
                waiting = waiting.slice(done)
        if waiting is not None:
            yield from each(waiting, np.stack([waiting.column(c).to_numpy() for c in keys], axis=1))

    def each(table, m):
        cuts = [0, *(np.flatnonzero((m[1:] != m[:-1]).any(axis=1)) + 1).tolist(), len(m)]
        out = [solve(table.slice(a, b - a)) for a, b in zip(cuts, cuts[1:], strict=False) if b > a + 1]
        if out:
            yield from pa.concat_tables(out).combine_chunks().to_batches()

    return cells.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, shape).distinct()


def groups(docs: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row (id, h0, h1) and root of every row: rows of one root are near copies by chains of links.

    Texts without words, null among them, are one text. Repeated rows are kept.
    """
    with exchanges_freed(docs.sparkSession):
        rows = materialize(_sketches(docs, id_col, text_col), "sketches")
        texts = rows.groupBy("k").agg(F.min("row").alias("row"), *[F.first(c).alias(c) for c in ("fp", "size", "keys")])
        roots = components(links(texts, docs, id_col, text_col, similarity, radius))
    return rows.select("row", "k").join(roots.withColumnRenamed("node", "k"), "k", "left").select("row", F.coalesce("root", "k").alias("root"))


def drop(docs: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group, all columns: that of the least id (null the least), then of the least hash.

    Of rows that repeat an id and its text one stays. An empty table gives no
    rows. Columns may have any names.
    """
    first = groups(docs, similarity, radius, id_col, text_col).groupBy("root").agg(F.min("row").alias("row"))
    stay = first.select(F.col("row.h0").alias("h0"), F.col("row.h1").alias("h1"))
    rows = docs.select(whole_row(docs).alias("own"), *[h.alias(f"h{i}") for i, h in enumerate(_row_hashes(id_col, text_col))])
    # One partitioning serves the join and what follows it.
    return rows.join(stay, ["h0", "h1"]).dropDuplicates(["h0", "h1"]).select(*unpacked("own", docs.columns))
