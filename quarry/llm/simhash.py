"""SimHash near-duplicate detection with BK-trees.

Fingerprints are 64-bit majority votes over the XXH64 of word shingles. Two
fingerprints within radius r agree in at least one of r + 1 blocks of bits, so
each distinct fingerprint is filed under r + 1 (block, value) shards. A shard
becomes BK-trees of bounded size: children keyed by their integer Hamming
distance to the parent, and a search follows only edges within the radius. A
shard too large for one tree is cut into parts, and each part's tree meets the
fingerprints of every part in tasks of their own. Trees travel to the tasks
by shuffle: sending them by way of the driver would collect the fingerprints of
all documents there. Each task returns a spanning forest of the links it
found, never all pairs of a group, and connected components come from
iterated minimum labels with pointer jumping.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import SENT_ROWS, as_bytes, discard, materialize, slices

SEED = 42
RADIUS = 2
#: Fingerprints of one tree at most.
TREE_ROWS = 4096


def normalised(text: bytes) -> bytes:
    """A-Z in lower case, one space between words."""
    return re.sub(rb"[\x20\x09-\x0D]+", b" ", text.lower()).strip(b" ")


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of every shingle of a normalised text, repeats included; of the whole text if it has fewer words."""
    if not text:
        return np.zeros(0, dtype=np.uint64)
    spaces = np.flatnonzero(np.frombuffer(text, dtype=np.uint8) == 32)
    starts, ends = np.append(0, spaces + 1), np.append(spaces, len(text))
    if len(starts) > width:
        starts, ends = starts[: 1 - width], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest, out = xxhash.xxh64_intdigest, np.empty(len(starts), dtype=np.uint64)
    for i in range(0, len(starts), 1 << 16):
        part = slice(i, i + (1 << 16))
        out[part] = [digest(text[a:b], SEED) for a, b in zip(starts[part].tolist(), ends[part].tolist(), strict=True)]
    return out


def vote(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes."""
    h, ones = hashes.astype(">u8"), np.zeros(64, dtype=np.int64)
    for a in range(0, len(h), 8192):
        part = h[a : a + 8192]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprint(text: bytes, width: int = 3) -> int:
    """Majority vote of the hashes of the lower-cased text's word shingles."""
    return vote(shingle_hashes(normalised(text), width))


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint, as a signed 64-bit number, of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in slices(batches):
            values = np.array([fingerprint(t, width) for t in as_bytes(batch.column("text"))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values.view(np.int64))], names=["doc_id", "fp"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"doc_id {kind}, fp long")


def bits_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints of one word each, or of several in the last dimension of two."""
    apart = np.bitwise_count(a ^ b)
    return apart.astype(np.int64) if apart.ndim == 1 else apart.sum(axis=1, dtype=np.int64)


class BKTree:
    """A BK-tree over distinct fingerprints (unsigned 64-bit values, or rows of them), built and searched level by level."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = values
        n = len(values)
        self.span = 64 * (1 if values.ndim == 1 else values.shape[1]) + 1
        # edges[node * span + distance] is the child; a dense table, as trees are small.
        edges = np.full(n * self.span, -1, dtype=np.int32)
        at = np.zeros(n, dtype=np.int32)  # the node that each value not yet placed has come to
        pending = np.arange(1, n)
        while len(pending):
            slot = at[pending].astype(np.int64) * self.span + bits_apart(values[pending], values[at[pending]])
            # The first to come to a free slot becomes the child there.
            _, first = np.unique(slot, return_index=True)
            edges[slot[first]] = pending[first]
            stay = np.ones(len(pending), dtype=bool)
            stay[first] = False
            at[pending] = edges[slot]
            pending = pending[stay]
        self.slots = np.flatnonzero(edges >= 0)
        self.children = edges[self.slots].astype(np.int64)

    def within(self, queries: np.ndarray, radius: int):
        """Places (query, node) of all pairs at most ``radius`` apart, a level at a time."""
        q = np.arange(len(queries))
        node = np.zeros(len(queries), dtype=np.int64)
        while len(q):
            distance = bits_apart(queries[q], self.values[node])
            near = distance <= radius
            if near.any():
                yield q[near], node[near]
            # Of a node's children, whose slots are in order, those along edges within the radius of its distance.
            low, high = np.maximum(distance - radius, 1), np.minimum(distance + radius, self.span - 1)
            first = np.searchsorted(self.slots, node * self.span + low)
            n = np.searchsorted(self.slots, node * self.span + high, "right") - first
            ends = np.cumsum(n)
            q, node = np.repeat(q, n), self.children[np.repeat(first - ends + n, n) + np.arange(ends[-1])]


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent = up


def _forest(n: int, a: np.ndarray, b: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Merge the classes of the pairs (a, b); parent holds each item's least known root."""
    while True:
        parent = _roots(parent)
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            return parent
        a, b = a[apart], b[apart]
        low, high = np.minimum(x[apart], y[apart]), np.maximum(x[apart], y[apart])
        np.minimum.at(parent, high, low)


def spanning_links(left: np.ndarray, right: np.ndarray, radius: int) -> np.ndarray:
    """Links (pairs of values) that join all of left + right that chains of pairs within the radius join."""
    tree = BKTree(left)
    values = np.concatenate([left, right])
    parent = np.arange(len(values))
    for a in range(0, len(right), 512):
        for q, node in tree.within(right[a : a + 512], radius):
            parent = _forest(len(values), q + len(left) + a, node, parent)
    linked = parent != np.arange(len(values))
    pairs = np.stack([values[parent[linked]], values[linked]], axis=1)
    return pairs[pairs[:, 0] != pairs[:, 1]]


def _bands(radius: int) -> list[tuple[int, int]]:
    """(shift, bits) of radius + 1 blocks that cover 64 bits."""
    edges = [64 * i // (radius + 1) for i in range(radius + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def links(distinct: DataFrame, radius: int = RADIUS, tree_rows: int = TREE_ROWS) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that give the same components as all pairs within the radius."""
    filed = distinct.select(
        "fp",
        F.explode(
            F.array(*[
                F.struct(F.lit(i).alias("_band"), F.shiftrightunsigned("fp", s).bitwiseAND((1 << n) - 1).alias("_value"))
                for i, (s, n) in enumerate(_bands(radius))
            ])
        ).alias("_s"),
    ).select("fp", "_s.*")
    sizes = filed.groupBy("_band", "_value").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    parts = F.ceil(F.col("_n") / tree_rows).cast("int")
    shared = filed.join(sizes, ["_band", "_value"]).withColumn("_parts", parts)
    own = F.pmod(F.xxhash64("fp"), F.col("_parts")).cast("int")
    # Every part's tree (i) meets the fingerprints of the parts j >= i; a shard of one part is one cell.
    cells = shared.withColumn("_own", own).select(
        "_band", "_value", "fp", "_own", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_other")
    ).select("_band", "_value", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"), "_own", "fp")

    keys = ["_band", "_value", "_i", "_j"]

    def run(batches):
        """Cells arrive sorted by key; a cell is at most two parts of a shard."""
        waiting = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            waiting = table if waiting is None else pa.concat_tables([waiting, table])
            last = {k: waiting.column(k)[-1].as_py() for k in keys}
            m = np.stack([waiting.column(k).to_numpy() for k in keys], axis=1)
            done = int(np.argmax((m == [last[k] for k in keys]).all(axis=1)))
            if done:
                yield from solve(waiting.slice(0, done))
                waiting = waiting.slice(done)
        if waiting is not None:
            yield from solve(waiting)

    def solve(table):
        m = np.stack([table.column(k).to_numpy() for k in keys], axis=1)
        fp, part = table.column("fp").to_numpy().view(np.uint64), table.column("_own").to_numpy()
        cuts = np.flatnonzero((m[1:] != m[:-1]).any(axis=1)) + 1
        found = []
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(m)]])
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            if b - a == 2:  # the commonest cell needs no tree
                if int(fp[a] ^ fp[a + 1]).bit_count() <= radius:
                    found.append(fp[a:b].reshape(1, 2))
                continue
            left = fp[a:b][part[a:b] == m[a, 2]]
            right = fp[a:b][part[a:b] == m[a, 3]]
            if len(left) and len(right):
                found.append(spanning_links(left, right, radius))
        if found:
            pairs = np.concatenate(found).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return cells.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long").distinct()


#: Links of a node that meet its label in one task, about.
HUB_ROWS = 100_000


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of the undirected links (a, b): the least node that can be reached.

    Each round gives every node the least label among its own and its
    neighbours', then follows labels to their own labels, until nothing
    changes. Rounds grow with the logarithm of the longest path. The links of
    a node with very many are dealt into parts, each of which gets its label;
    labels that have come to rest are not looked up again.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).distinct()
    both = both.select(F.col("a").alias("node"), F.col("b").alias("other"))
    links = own = materialize(both, "links")
    labels = links.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("root"), F.ceil(F.count(F.lit(1)) / HUB_ROWS).cast("int").alias("parts"))
    labels = first = materialize(labels, "labels")
    hubs = labels.where("parts > 1").select(F.col("node").alias("other"), "parts")
    salt = F.lit(0)
    if n := hubs.count():
        links = links.join(F.broadcast(hubs) if n <= SENT_ROWS else hubs, "other", "left")
        salt = F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1))).cast("int")
    links = links.select("node", "other", salt.alias("salt"))
    before: list[DataFrame] = []
    while True:
        reach = labels.select(F.col("node").alias("other"), F.col("root").alias("seen"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"))
        least = links.join(reach, ["other", "salt"]).groupBy("node").agg(F.min("seen").alias("least"))
        lower = materialize(labels.join(least, "node").select("node", "parts", F.col("root").alias("was"), F.least("root", "least").alias("root")), "labels")
        discard(*before)
        # Roots that have a lower one themselves; a root is a node too, as it began as one's label or neighbour.
        up = lower.where("root < node").select(F.col("node").alias("root"), F.col("root").alias("above"))
        moved = materialize(lower.select("root").distinct().join(up, "root"), "moved")
        before, n = [lower, moved], moved.count()
        if not n:
            if not lower.where(F.col("root") != F.col("was")).limit(1).count():
                discard(own, first, moved)
                return lower.select("node", "root")
            labels = lower.select("node", "parts", "root")
        else:
            raised = lower.join(F.broadcast(moved) if n <= SENT_ROWS else moved, "root", "left")
            labels = raised.select("node", "parts", F.coalesce("above", "root").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    component_id is the least doc_id among the rows whose fingerprints can be
    reached over links of at most ``radius`` differing bits. A text without
    words, or null, has fingerprint zero, linked like any other. Null ids are
    passed over when the least id is sought (a component with no other id gets
    null); repeated rows are kept. An empty table gives no rows. Further
    columns are not read.
    """
    rows = materialize(fingerprints(docs, width, id_col, text_col), "fingerprints")
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("_least"))
    roots = components(links(distinct.select("fp"), radius))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("_root", F.coalesce("root", "fp"))
    least = named.groupBy("_root").agg(F.min("_least").alias("component_id"))
    by_fp = named.select("fp", "_root").join(least, "_root").select("fp", "component_id")
    return rows.join(by_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
