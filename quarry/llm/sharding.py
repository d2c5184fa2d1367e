"""Sharding by best-fit-decreasing bin packing.

Indivisible groups (equal texts) are sorted by size and each enters the bin
whose remaining capacity is the tightest that still holds it; the open bins
stand in a balanced tree ordered by remaining capacity.

Only a histogram reaches the driver. Best fit decreasing depends on nothing but
the sizes: after a group of size s enters the tightest bin, that bin, if s
still fits, is again the tightest, so a class of n groups of one size is placed
in runs. Sizes are rounded up to ``SIGNIFICANT_BITS`` binary digits, exact below
2**13, so there are at most 2**12 classes per power of two whatever the input.
Which member of a class a group is, its rank, is found by a range partition and
per-partition counts; one driver row per (partition, class) pair is needed, and
as the partitions are ranges of classes those are at most classes + partitions.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._util import materialize

SIGNIFICANT_BITS = 13
#: Rows that are numbered together, one window group.
ROWS_PER_BLOCK = 2000


class BinTree:
    """AVL tree of (remaining capacity, bin) pairs."""

    __slots__ = ("root",)

    def __init__(self) -> None:
        self.root = None

    # A node is [key, left, right, height].
    @staticmethod
    def _height(node) -> int:
        return node[3] if node else 0

    def _rotate(self, node, heavy: int):
        other = 3 - heavy
        child = node[heavy]
        node[heavy], child[other] = child[other], node
        for n in (node, child):
            n[3] = 1 + max(self._height(n[1]), self._height(n[2]))
        return child

    def _balance(self, node):
        left, right = self._height(node[1]), self._height(node[2])
        node[3] = 1 + max(left, right)
        if abs(left - right) < 2:
            return node
        heavy = 1 if left > right else 2
        child = node[heavy]
        if self._height(child[3 - heavy]) > self._height(child[heavy]):
            node[heavy] = self._rotate(child, 3 - heavy)
        return self._rotate(node, heavy)

    def insert(self, key) -> None:
        def put(node):
            if node is None:
                return [key, None, None, 1]
            side = 1 if key < node[0] else 2
            node[side] = put(node[side])
            return self._balance(node)

        self.root = put(self.root)

    def remove(self, key) -> None:
        def take(node, key):
            if key != node[0]:
                side = 1 if key < node[0] else 2
                node[side] = take(node[side], key)
            elif node[1] is None or node[2] is None:
                return node[1] or node[2]
            else:
                least = node[2]
                while least[1]:
                    least = least[1]
                node[0] = least[0]
                node[2] = take(node[2], least[0])
            return self._balance(node)

        self.root = take(self.root, key)

    def tightest(self, size: int):
        """The smallest pair whose remaining capacity is at least ``size``."""
        node, best = self.root, None
        while node:
            if node[0][0] >= size:
                best, node = node[0], node[1]
            else:
                node = node[2]
        return best


def best_fit_decreasing(
    classes: list[tuple[int, int]], capacity: int, max_bins: int | None = None, first_bin: int = 0
) -> list[tuple[int, int, int, int]] | None:
    """Runs (size, first rank, groups, bin) for (size, groups) classes, largest first.

    Groups larger than the capacity each get a bin of their own. None if more
    than ``max_bins`` bins are needed.
    """
    tree, runs, opened = BinTree(), [], first_bin
    for size, count in sorted(classes, reverse=True):
        rank = 0
        while rank < count:
            found = tree.tightest(size)
            if found is None:
                if max_bins is not None and opened - first_bin >= max_bins:
                    return None
                found = (max(capacity, size), opened)
                opened += 1
            else:
                tree.remove(found)
            room, bin_ = found
            n = min(count - rank, room // size)
            runs.append((size, rank, n, bin_))
            rank += n
            tree.insert((room - n * size, bin_))
    return runs


def equal_bins(classes: list[tuple[int, int]], bins: int) -> list[tuple[int, int, int, int]]:
    """Best-fit-decreasing runs over exactly ``bins`` bins of near equal size.

    A group of at least the mean load takes a bin alone, as no bin can be
    smaller than it; the rest are packed at the least capacity, found by
    bisection, at which best fit decreasing needs no more than the other bins.
    """
    left = sorted(([s, n] for s, n in classes if n), reverse=True)
    total, runs, used = sum(s * n for s, n in left), [], 0
    taken: dict[int, int] = {}
    while left and bins - used > 1 and left[0][0] * (bins - used) >= total:
        size = left[0][0]
        runs.append((size, taken.get(size, 0), 1, used))
        taken[size] = taken.get(size, 0) + 1
        total -= size
        used += 1
        left[0][1] -= 1
        if not left[0][1]:
            left.pop(0)
    if not left:
        return runs
    rest = [(s, n) for s, n in left]
    mean = -(-total // (bins - used))
    low, high = mean, mean + left[0][0]
    found = best_fit_decreasing(rest, high, bins - used, used)
    while high > low:
        middle = (low + high) // 2
        attempt = best_fit_decreasing(rest, middle, bins - used, used)
        if attempt is None:
            low = middle + 1
        else:
            found, high = attempt, middle
        if high - low <= mean // 200_000:
            break
    return runs + [(s, first + taken.get(s, 0), n, b) for s, first, n, b in found]


def shard(
    docs: DataFrame,
    shards: int | None = 24,
    capacity: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Deal whole rows into shards; equal texts stay together.

    With ``shards``: that many shards of near equal bytes. With ``capacity``:
    as few shards of that many bytes as best fit decreasing finds. The size of
    a row is the UTF-8 bytes of its text plus 8.

    Returns doc_id, size, text_crc32, law ('bytes'), shard, slot (gapless from 0
    in its shard), grown_shard (null: this law has none). A null text has size
    8 and the crc of no bytes, and is of one group with the empty text. Null or
    repeated ids are kept as rows of their own. An empty table gives no rows.
    Columns that the input has besides are neither read nor returned.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(text.cast("binary")).alias("_key"),
    )
    shift = f"greatest(length(bin(_bytes)) - {SIGNIFICANT_BITS}, 0)"
    groups = (
        rows.groupBy("_key")
        .agg(F.sum("size").alias("_bytes"))
        .withColumn("_shift", F.expr(shift))
        .select("_key", F.expr("shiftleft(shiftright(_bytes - 1, _shift) + 1, _shift)").alias("_class"))
    )
    groups = materialize(
        groups.repartitionByRange("_class", "_key").select("*", F.spark_partition_id().alias("_part")), "groups"
    )
    counts = groups.groupBy("_part", "_class").agg(F.count(F.lit(1)).alias("n")).toArrow().to_pylist()
    if not counts:
        return rows.selectExpr(
            "doc_id", "size", "text_crc32", "'bytes' AS law", "0 AS shard", "0L AS slot", "CAST(NULL AS INT) AS grown_shard"
        ).limit(0)
    counts.sort(key=lambda r: (r["_class"], r["_part"]))
    total: dict[int, int] = {}
    for r in counts:
        r["base"] = total.get(r["_class"], 0)
        total[r["_class"]] = r["base"] + r["n"]
    runs = equal_bins(list(total.items()), shards) if capacity is None else best_fit_decreasing(list(total.items()), capacity)
    by_class: dict[int, list] = {}
    for size, first, n, bin_ in runs:
        by_class.setdefault(size, []).append((first, first + n, bin_))
    for own in by_class.values():
        own.sort()
    place: dict[str, list] = {k: [] for k in ("_part", "_class", "_starts", "_bins")}
    at: dict[int, int] = {}
    for r in counts:
        own, i = by_class[r["_class"]], at.get(r["_class"], 0)
        end, starts, bins_ = r["base"] + r["n"], [], []
        while i < len(own) and own[i][0] < end:
            starts.append(max(0, own[i][0] - r["base"]))
            bins_.append(own[i][2])
            if own[i][1] > end:
                break
            i += 1
        at[r["_class"]] = i
        for k, v in (("_part", r["_part"]), ("_class", r["_class"]), ("_starts", starts), ("_bins", bins_)):
            place[k].append(v)
    # At most classes + partitions rows, as the module's text shows.
    table = spark.createDataFrame(
        pa.table(
            {
                "_part": pa.array(place["_part"], pa.int32()),
                "_class": pa.array(place["_class"], pa.int64()),
                "_starts": pa.array(place["_starts"], pa.list_(pa.int64())),
                "_bins": pa.array(place["_bins"], pa.list_(pa.int32())),
            }
        )
    )
    rank = F.row_number().over(Window.partitionBy("_part", "_class").orderBy("_key")) - 1
    placed = (
        groups.withColumn("_rank", rank)
        .join(F.broadcast(table), ["_part", "_class"])
        .select("_key", F.expr("element_at(_bins, size(filter(_starts, s -> s <= _rank)))").alias("shard"))
    )
    # A hot text makes one skewed key here; adaptive execution splits the side of the rows.
    dealt = materialize(rows.join(placed, "_key").drop("_key"), "dealt")
    return _numbered(dealt)


def _numbered(dealt: DataFrame) -> DataFrame:
    """Number the rows of each shard from 0, in blocks that never hold a whole shard."""
    per_shard = dealt.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    blocks = max(1, per_shard // ROWS_PER_BLOCK)
    rows = dealt.withColumn("_block", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(blocks)).cast("int"))
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    first = (
        rows.groupBy("shard", "_block")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("shard", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    )
    own = F.row_number().over(Window.partitionBy("shard", "_block").orderBy("doc_id", "text_crc32", "size")) - 1
    return rows.withColumn("_own", own).join(first, ["shard", "_block"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("_first") + F.col("_own")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
