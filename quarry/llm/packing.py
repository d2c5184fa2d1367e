"""Mixture-controlled packing by deficit round-robin.

Every source is a queue of tokens. Windows of ``window`` tokens are filled so
that each holds the target proportions: a window grants every queue its share
in whole tokens, and what rounding withheld or overpaid is carried into the
next window. With the queues as leaves of a binary tree, the first x tokens of
a node give floor(x * weight of left / weight of both) to its left child and
the rest to its right one. These cumulative grants never decrease, always fill
the window and stay within log2(queues) tokens of the exact share at every
window, whatever the length of the run: that is the carried deficit. Because
they are a closed form of the window number, a task that knows where its
documents stand in their queues knows where every token goes; windows need no
sequential pass, and deficits carry over partition borders exactly.

When a queue runs dry before the others, the round goes on with the rest at
their targets (a new phase; there are at most as many as queues).
"""

from __future__ import annotations

from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import vocabulary
from ._util import materialize, slices

LENGTH = 1024
#: Sequences of a mixture window.
WINDOW = 64
#: Places of parts in queues that are sent to all tasks; with more, rows and places are shuffled together.
SENT_OFFSETS = 500_000
#: With more sources than this, those without a target are dealt into groups by hash, of which the driver knows the sums alone.
MAX_QUEUES = 4096


class Schedule:
    """Who gets which tokens of the packed stream."""

    def __init__(self, totals: list[int], weights: list[int] | None = None) -> None:
        self.totals = totals
        self.total = sum(totals)
        self.starts: list[int] = []
        self.phases: list[tuple[list[int], list[int], list[int]]] = []  # taken before, taken before by lower queues, weight sums
        left, begun = list(totals), 0
        weights = list(totals) if weights is None else weights
        while any(left):
            use = [w if n else 0 for w, n in zip(weights, left, strict=True)]
            if not any(use):
                use = left[:]
            sums = [0]
            for w in use:
                sums.append(sums[-1] + w)
            taken = [t - n for t, n in zip(totals, left, strict=True)]
            below = [0]
            for t in taken:
                below.append(below[-1] + t)
            self.starts.append(begun)
            self.phases.append((taken, below, sums))
            low, high = 0, sum(left)
            while low < high:
                middle = (low + high + 1) // 2
                if all(self._grant(sums, i, middle)[1] <= n for i, n in enumerate(left)):
                    low = middle
                else:
                    high = middle - 1
            left = [n - self._grant(sums, i, low)[1] for i, n in enumerate(left)]
            begun += low

    @staticmethod
    def _grant(sums: list[int], i: int, x: int) -> tuple[int, int]:
        """Of a phase's first x tokens: those of the queues before i, and those of i."""
        low, high, before = 0, len(sums) - 1, 0
        while high - low > 1:
            middle = (low + high) // 2
            whole = sums[high] - sums[low]
            first = x * (sums[middle] - sums[low]) // whole if whole else 0
            if i < middle:
                high, x = middle, first
            else:
                low, before, x = middle, before + first, x - first
        return before, x

    def at(self, i: int, x: int) -> tuple[int, int]:
        """Of the stream's first x tokens: those of the queues before i, and those of i."""
        p = bisect_right(self.starts, x) - 1
        taken, below, sums = self.phases[p]
        before, own = self._grant(sums, i, x - self.starts[p])
        return below[i] + before, taken[i] + own


def path(sums: list[int], i: int) -> list[int]:
    """The way down the tree to leaf i: of every node the tokens of its left child and of both, and whether it goes right."""
    low, high, out = 0, len(sums) - 1, []
    while high - low > 1:
        middle = (low + high) // 2
        out += [sums[middle] - sums[low], sums[high] - sums[low], int(i >= middle)]
        low, high = (low, middle) if i < middle else (middle, high)
    return out


def down(way: list[int], x: int) -> tuple[int, int]:
    """Of a group's first x tokens: those of the leaves before the way's, and those of its own."""
    before = 0
    for left, both, right in zip(way[::3], way[1::3], way[2::3], strict=True):
        first = x * left // both if both else 0
        before, x = (before + first, x - first) if right else (before, first)
    return before, x


def _ways(table: pa.Table) -> pa.Table:
    """queue and way of every source of a group."""
    table = table.sort_by("queue")
    sums = [0]
    for n in table.column("n").to_pylist():
        sums.append(sums[-1] + n)
    return pa.table([table.column("queue"), pa.array([path(sums, i) for i in range(len(table))], pa.list_(pa.int64()))], names=["queue", "way"])


def place(schedule: Schedule, at, i: int, start: int, n: int, window: int, length: int):
    """Pieces (start, length, stream position) of the tokens start..start+n of queue i."""
    low, high = 0, -(-schedule.total // window)
    while high - low > 1:  # the last window that begins at or before the token
        middle = (low + high) // 2
        if at(i, middle * window)[1] <= start:
            low = middle
        else:
            high = middle
    w, done = low, 0
    while done < n:
        before, own = at(i, w * window)
        before_end, own_end = at(i, min((w + 1) * window, schedule.total))
        here = min(n - done, own_end - (start + done))
        position = w * window + (before_end - before) + (start + done - own)
        while here > 0:
            cut = min(here, length - position % length)
            yield done, cut, position
            done, here, position = done + cut, here - cut, position + cut
        w += 1


def tokenize(docs: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str, queue) -> DataFrame:
    """doc_id, queue, part, base (tokens of the queue before, in the part), n and ids of every row."""
    spec = vocabulary.read_spec(tokenizer)
    wide = max(max(spec["model"]["vocab"].values()), end_id) >= 1 << 16
    sent = docs.sparkSession.sparkContext.broadcast(spec)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        encode = vocabulary.once_per_worker(sent, vocabulary.encoder)
        part, passed = TaskContext.get().partitionId(), {}
        for batch in slices(batches):
            queues = batch.column("queue").to_pylist()
            texts = [t or "" for t in batch.column("text").to_pylist()]
            base, counts, blobs = [], [], []
            for q, ids in zip(queues, encode(texts), strict=True):
                ids = np.append(ids, np.uint32(end_id))
                base.append(passed.get(q, 0))
                counts.append(len(ids))
                passed[q] = base[-1] + len(ids)
                blobs.append(ids.astype("<u4" if wide else "<u2").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("queue"), pa.array([part] * len(texts), pa.int32()), pa.array(base, pa.int64()), pa.array(counts, pa.int64()), pa.array(blobs, pa.binary())],
                names=["doc_id", "queue", "part", "base", "n", "ids"],
            )

    source = docs.select(F.col(id_col).alias("doc_id"), queue.alias("queue"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"doc_id {kind}, queue string, part int, base long, n long, ids binary")


def pack(
    docs: DataFrame, tokenizer: str | None = None, targets: dict[str, int] | None = None, length: int = LENGTH,
    window: int = WINDOW, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """Pack all rows' tokens, each followed by ``end_id``, into sequences of ``length``.

    ``targets``: whole-number weights by source; by default each source's
    tokens, so that all queues last to the end. Sources without a weight come
    after the others have run dry. Both hold for any number of sources: where
    there are many, the leaves of the tree below the driver's groups are
    known to the tasks alone.

    Returns a row per piece: doc_id, start (tokens of the document before it),
    length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id,
    offset. Every sequence is full but the last. A null or empty text is its
    end token alone. A null source is a queue of its own. Null or repeated
    doc_ids are packed as rows of their own. An empty table gives no rows.
    Further columns are not read.
    """
    tokenizer = tokenizer or vocabulary.default_path()
    sources = docs.select(source_col).distinct().limit(MAX_QUEUES + 1).count()
    named = F.concat(F.lit("="), F.col(source_col).cast("string"))
    queue = F.coalesce(named, F.lit(""))
    rows = materialize(tokenize(docs, tokenizer, end_id, id_col, text_col, queue), "tokens")
    sums = rows.groupBy("part", "queue").agg(F.sum("n").alias("n"))
    group = F.col("queue")
    if sources > MAX_QUEUES:
        group = F.when(group.isin([f"={name}" for name in targets or ()]), group).otherwise(F.concat(F.lit("#"), F.pmod(F.xxhash64("queue"), F.lit(MAX_QUEUES)).cast("string")))
    by_queue = sums.groupBy("queue").agg(F.sum("n").alias("n")).withColumn("group", group)
    totals = {r["group"]: r["n"] for r in by_queue.groupBy("group").agg(F.sum("n").alias("n")).collect()}
    names = sorted(totals)
    weights = None if targets is None else [0 if q.startswith("#") else targets.get(q[1:], 0) for q in names]
    schedule, number = Schedule([totals[q] for q in names], weights), {q: i for i, q in enumerate(names)}
    span = window * length
    earlier = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("part", "queue", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def within(at, way):
        def own_at(i, x):
            lower, x = at(i, x)
            before, own = down(way, x)
            return lower + before, own

        return own_at

    def run(batches):
        at = lru_cache(1 << 16)(schedule.at)
        for batch in slices(batches):
            out = [[], [], [], [], [], []]
            for j, (q, way, first, n, ids) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("group", "way", "start", "n", "ids")), strict=True)):
                own_at = within(at, way) if way else at
                ids = np.frombuffer(ids, dtype="<u2" if len(ids) == 2 * n else "<u4").astype("<u4")
                for a, size, position in place(schedule, own_at, number[q], first, n, span, length):
                    for x, y in zip(out, (j, a, size, ids[a : a + size].tobytes(), n, position), strict=True):
                        x.append(y)
            row, start, size, blobs, n, position = out
            position = np.array(position, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(blobs, pa.binary()),
                 pa.array(n, pa.int64()), pa.array(position // length), pa.array(position % length)],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

    offsets = offsets.withColumn("group", group)
    if sources > MAX_QUEUES:
        ways = materialize(by_queue.select("group", "queue", "n").groupBy("group").applyInArrow(_ways, "queue string, way array<long>"), "ways")
        offsets = offsets.join(ways, "queue")
    else:
        offsets = offsets.withColumn("way", F.lit(None).cast("array<long>"))
    if sums.count() <= SENT_OFFSETS:
        offsets = F.broadcast(offsets)
    at_queue = rows.join(offsets, ["part", "queue"]).select("doc_id", "group", "way", (F.col("first") + F.col("base")).alias("start"), "n", "ids")
    return at_queue.mapInArrow(run, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
