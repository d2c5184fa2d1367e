"""Approximate nearest neighbours by a forest of random-projection trees.

The forest is fitted on a bounded sample and sent to every task; all rows are
then indexed: a row is stored once, in a cell (the first tree's topmost levels
deal rows into cells of bounded size), with its leaf in every tree. A query
walks all trees through one shared priority queue, ordered by the squared
margins passed on the way, until the leaves met hold enough rows; it is then
sent, with those leaves, to the cells that their rows in the sample lie in. There
the leaves' rows are joined, so that a row counts once however many trees lead
to it, and reranked by exact cosine.

How much a query has to meet depends on the data: it is measured on the sample,
as what its own rows need to find their true neighbours there.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._util import finite_vector, materialize, matrix, row_count_and

#: Rows that the trees are fitted on, at most.
SAMPLE_ROWS = 20_000
TREES = 24
#: Sample rows of a leaf, about.
LEAF_ROWS = 40
#: Share of true neighbours within the sample that the budget has to find, and queries that it is measured with.
TARGET, MEASURED = 0.94, 150
#: Rows of a cell, about, and queries, at most, that one task takes; larger cells are split.
CELL_ROWS, CELL_QUERIES = 8192, 8192


@dataclass
class Forest:
    """Trees of full depth in heap order: node i has the children 2i+1, 2i+2."""

    normals: np.ndarray  # tree, node, dimension
    offsets: np.ndarray  # tree, node
    weights: np.ndarray  # tree, leaf: share of the sample's distinct rows
    levels: int  # levels of the first tree that tell cells apart
    reach: np.ndarray  # tree, leaf, cell: whether rows of the sample are there

    def __post_init__(self) -> None:
        self._weights = self.weights.tolist()

    @property
    def leaves(self) -> int:
        return self.weights.shape[1]

    @property
    def trees(self) -> int:
        return self.weights.shape[0]

    @classmethod
    def fit(cls, unit: np.ndarray, cells: int = 1, trees: int = TREES, leaf_rows: int = LEAF_ROWS, seed: int = 7) -> Forest:
        """Split at the median of the projection on the difference of two random rows. ``unit`` holds distinct rows of length 1."""
        rng = np.random.default_rng(seed)
        depth = max(0, int(np.ceil(np.log2(max(1, len(unit) / leaf_rows)))))
        grown = [_split(unit, depth, rng) for _ in range(trees)]
        weights = np.array([[len(leaf) for leaf in tree[2]] for tree in grown]) / max(1, len(unit))
        levels = min(depth, max(0, int(np.ceil(np.log2(max(1, cells))))))
        forest = cls(np.array([t[0] for t in grown]), np.array([t[1] for t in grown]), weights, levels, np.zeros((trees, 1 << depth, 1 << levels), dtype=bool))
        leaf = forest.route(unit)
        for t in range(trees):
            forest.reach[t, leaf[:, t], forest.cell(leaf)] = True
        return forest

    def route(self, unit: np.ndarray) -> np.ndarray:
        """The leaf of every row in every tree: rows by trees."""
        out = np.zeros((len(unit), self.trees), dtype=np.int32)
        for t in range(self.trees):
            node = np.zeros(len(unit), dtype=np.int64)
            while len(node) and node[0] < self.leaves - 1:
                # In single precision wherever a row is routed, so that it comes to one leaf.
                node = 2 * node + 1 + (np.einsum("ij,ij->i", unit, self.normals[t][node]) > self.offsets[t][node])
            out[:, t] = node - (self.leaves - 1)
        return out

    def cell(self, leaf: np.ndarray) -> np.ndarray:
        return leaf[:, 0] * (1 << self.levels) // self.leaves

    def visit(self, unit: np.ndarray, budget: float) -> list[tuple[int, int]]:
        """(tree, leaf) in the order of one query's shared queue, until their weights reach the budget."""
        margins = (self.normals @ unit - self.offsets).tolist()
        weights, inner = self._weights, self.leaves - 1
        queue = [(0.0, t, 0) for t in range(self.trees)]
        found, met = [], 0.0
        while queue and met < budget:
            cost, t, node = heapq.heappop(queue)
            margin = margins[t]
            while node < inner:
                m = margin[node]
                node, far = (2 * node + 2, 2 * node + 1) if m > 0 else (2 * node + 1, 2 * node + 2)
                heapq.heappush(queue, (cost + m * m, t, far))
            found.append((t, node - inner))
            met += weights[t][node - inner]
        return found

    def costs(self, unit: np.ndarray) -> np.ndarray:
        """What each leaf (tree, leaf) costs a query, the sum of squared margins to its far sides: its place in the queue's order."""
        margins = self.normals @ unit - self.offsets
        cost, node = np.zeros((self.trees, 1)), 0
        while node < self.leaves - 1:
            m = margins[:, node : node + cost.shape[1]]
            node += cost.shape[1]
            cost = np.stack([cost + np.where(m > 0, m * m, 0), cost + np.where(m > 0, 0, m * m)], axis=-1).reshape(self.trees, -1)
        return cost

    def budget(self, unit: np.ndarray, k: int, target: float = TARGET, queries: int = MEASURED) -> float:
        """The least budget at which so many rows of the sample find the given share of their k nearest there."""
        if len(unit) < 2:
            return 0.0
        leaf, needs = self.route(unit), []
        for i in np.random.default_rng(11).permutation(len(unit))[:queries]:
            scores = unit @ unit[i]
            scores[i] = -np.inf
            near = np.argsort(-scores)[: min(k, len(unit) - 1)]
            order = np.argsort(self.costs(unit[i]).reshape(-1), kind="stable")
            # What the leaves before each one weigh.
            before = np.empty(len(order))
            before[order] = np.concatenate([[0.0], np.cumsum(self.weights.reshape(-1)[order])[:-1]])
            needs += before.reshape(self.weights.shape)[np.arange(self.trees)[None, :], leaf[near]].min(axis=1).tolist()
        return float(np.quantile(needs, target, method="higher")) + 1e-9


def _split(unit: np.ndarray, levels: int, rng) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Normals, offsets and the leaves' rows of one tree."""
    inner = (1 << levels) - 1
    normals, offsets = np.zeros((inner, unit.shape[1]), dtype=np.float32), np.zeros(inner, dtype=np.float32)
    members = {0: np.arange(len(unit))}
    for node in range(inner):
        own = members.pop(node)
        normal = rng.standard_normal(unit.shape[1])
        if len(own) > 1:
            a, b = unit[rng.choice(own, 2, replace=False)]
            if (a != b).any():
                normal = a - b
        normals[node] = normal / np.linalg.norm(normal)
        margin = unit[own] @ normals[node].astype(np.float64)
        offsets[node] = float(np.median(margin)) if len(own) else 0.0
        right = margin > offsets[node]
        members[2 * node + 1], members[2 * node + 2] = own[~right], own[right]
    return normals, offsets, [members[i] for i in range(inner, 2 * inner + 1)]


def nearest_in_cell(q_ids, q, c_ids, c, k: int, candidates):
    """(query, row, cosine, rows met) of each query's k best among ``candidates(i)``, places of rows; rows met on its first row alone."""
    q_norm, c_norm = np.sqrt(np.square(q).sum(axis=1)), np.sqrt(np.square(c).sum(axis=1))
    rough = (c / c_norm[:, None]).astype(np.float32)
    asked = (q / q_norm[:, None]).astype(np.float32)
    # What single precision can be off by.
    slack = 1e-6 * (8 + q.shape[1])
    out: tuple[list, ...] = ([], [], [], [])
    for i in range(len(q)):
        at = candidates(i)
        at = at[c_ids[at] != q_ids[i]]
        if not len(at):
            continue
        scores = rough[at] @ asked[i]
        if len(at) > k:
            near = at[scores >= np.partition(scores, len(scores) - k)[len(scores) - k] - slack]
        else:
            near = at
        # Row by row, so that equal vectors get equal scores.
        exact = (c[near] * q[i]).sum(axis=1) / (q_norm[i] * c_norm[near])
        best = np.lexsort((c_ids[near], -exact))[:k]
        met = np.zeros(len(best), dtype=np.int64)
        met[0] = len(at)
        for x, y in zip(out, (np.full(len(best), q_ids[i]), c_ids[near][best], exact[best], met), strict=True):
            x.append(y)
    return [np.concatenate(x) if x else np.array([]) for x in out]


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
    trees: int = TREES, leaf_rows: int = LEAF_ROWS, target: float = TARGET, sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """Each query's k nearest other rows by cosine, of those that the forest meets.

    Returns query_id, rank (from 1), vec_id, score (the cosine of the original
    vectors in double precision) and met (how many rows the query was compared
    with); nearest first, ties to the smaller vec_id.

    Rows take no part if their id is null or their vector is null, zero or
    holds null or non-finite components. Rows that repeat an id count once,
    with the least of their vectors. Rows of another dimension than most of the
    sample are searched exactly among their own dimension. A query with fewer
    than k other rows of its dimension gets them all. An empty table gives no
    rows. Further columns are not read.
    """
    spark = vectors.sparkSession
    rows = (
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("_v"), F.coalesce(is_query, F.lit(False)).alias("_q"))
        .where(F.col("vec_id").isNotNull() & finite_vector(F.col("_v")) & F.exists("_v", lambda x: x != 0))
        .groupBy("vec_id")
        .agg(F.min("_v").alias("_v"), F.max("_q").alias("_q"))
    )
    total = row_count_and(rows)["rows"]
    sample = rows.orderBy(F.xxhash64("vec_id", F.lit(3))).limit(sample_rows).select("_v").toArrow().column("_v").to_pylist()
    sizes = [len(v) for v in sample]
    dims = max(set(sizes), key=lambda d: (sizes.count(d), d)) if sizes else 0
    kept = [v for v in sample if len(v) == dims]
    kept = np.array(kept, dtype=np.float64).reshape(len(kept), dims)
    unit = np.unique(kept / np.linalg.norm(kept, axis=1, keepdims=True), axis=0)
    forest = Forest.fit(unit, -(-total // CELL_ROWS), trees, leaf_rows)
    # Each tree holds every row once, so this meets more than k distinct rows of the sample.
    budget = max(forest.budget(unit, k, target), trees * (k + 1) / max(1, len(unit)))
    sent = spark.sparkContext.broadcast((forest.normals, forest.offsets, forest.weights, forest.levels, forest.reach))
    element = rows.schema["_v"].dataType.elementType.simpleString()
    schema = f"_cell int, vec_id long, _ask boolean, _v array<{element}>, _leaves binary"

    def index(asked: bool):
        def run(batches):
            forest = Forest(*sent.value)
            for batch in batches:
                lists = batch.column("_v")
                lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
                usual = np.flatnonzero(lengths == dims)
                # Rows of an odd dimension are in a cell of that dimension, without leaves.
                places = [(i, -1 - int(lengths[i]), b"") for i in np.flatnonzero(lengths != dims)]
                if len(usual):
                    unit = matrix(lists.take(pa.array(usual)), np.float64)
                    unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
                    if asked:
                        for i, u in zip(usual, unit, strict=True):
                            at = np.array(forest.visit(u, budget)).T
                            reached, number = forest.reach[at[0], at[1]], (at[0] * forest.leaves + at[1]).astype("<i4")
                            places += [(i, c, number[reached[:, c]].tobytes()) for c in np.flatnonzero(reached.any(axis=0)).tolist()]
                    else:
                        leaf = forest.route(unit)
                        number = (leaf + forest.leaves * np.arange(forest.trees)).astype("<i4")
                        places += [(i, c, n.tobytes()) for i, c, n in zip(usual, forest.cell(leaf).tolist(), number, strict=True)]
                if places:
                    at, cell, leaves = zip(*places, strict=True)
                    out = batch.take(pa.array(np.array(at, dtype=np.int64)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cell, pa.int32()), out.column("vec_id"), pa.array(np.full(len(at), asked)), out.column("_v"), pa.array(leaves, pa.binary())],
                        names=["_cell", "vec_id", "_ask", "_v", "_leaves"],
                    )

        return run

    lanes = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    lookups = materialize(rows.where("_q").select("vec_id", "_v").repartition(lanes).mapInArrow(index(True), schema), "lookups")
    indexed = materialize(rows.select("vec_id", "_v").mapInArrow(index(False), schema), "indexed")
    # A row per cell, of which there are no more than leaves, and one per odd dimension.
    much = lambda df, limit, name: df.groupBy("_cell").agg(F.ceil(F.count(F.lit(1)) / limit).cast("int").alias(name))
    cuts = F.broadcast(much(indexed, 2 * CELL_ROWS, "_parts").join(much(lookups, CELL_QUERIES, "_lots"), "_cell"))
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    fields = ("_cell", "vec_id", "_ask", "_v", "_leaves")
    indexed = indexed.join(cuts, "_cell").select(*fields, deal("_parts").alias("_part"), every("_lots").alias("_lot"))
    lookups = lookups.join(cuts, "_cell").select(*fields, every("_parts").alias("_part"), deal("_lots").alias("_lot"))

    def cell(table: pa.Table) -> pa.Table:
        ask = np.array(table.column("_ask").to_pylist(), dtype=bool)
        found = [[], [], [], []]
        if ask.any() and not ask.all():
            ids, m = table.column("vec_id").to_numpy(), matrix(table.column("_v"), np.float64)
            leaves = table.column("_leaves").to_pylist()
            asked = [np.frombuffer(leaves[i], dtype="<i4") for i in np.flatnonzero(ask)]
            own = np.flatnonzero(~ask)
            if table.column("_cell")[0].as_py() < 0:
                every = np.arange(len(own))
                candidates = lambda i: every
            else:
                numbers = np.frombuffer(b"".join(leaves[i] for i in own), dtype="<i4").reshape(len(own), -1)
                order = np.argsort(numbers.reshape(-1), kind="stable")
                rows_of = order // numbers.shape[1]
                starts = np.searchsorted(numbers.reshape(-1)[order], np.arange(numbers.max(initial=0) + 2)).tolist()

                def candidates(i: int) -> np.ndarray:
                    """The rows of a query's leaves, each once."""
                    there = np.zeros(len(own), dtype=bool)
                    parts = [rows_of[starts[b] : starts[b + 1]] for b in asked[i].tolist() if b + 1 < len(starts)]
                    if parts:
                        there[np.concatenate(parts)] = True
                    return np.flatnonzero(there)

            found = nearest_in_cell(ids[ask], m[ask], ids[own], m[own], k, candidates)
        types = (pa.int64(), pa.int64(), pa.float64(), pa.int64())
        return pa.table([pa.array(x, t) for x, t in zip(found, types, strict=True)], names=["query_id", "vec_id", "score", "met"])

    best = indexed.unionByName(lookups).groupBy("_cell", "_part", "_lot").applyInArrow(cell, "query_id long, vec_id long, score double, met long")
    mine = Window.partitionBy("query_id")
    ranked = best.select("query_id", F.row_number().over(mine.orderBy(F.desc("score"), "vec_id")).alias("rank"), "vec_id", "score", F.sum("met").over(mine).alias("met"))
    return ranked.where(F.col("rank") <= k)
