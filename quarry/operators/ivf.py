"""Inverted-file vector indexes: k-means centroids, and rows filed under the nearest one.

The centroids are few (the statement's LISTS) and live with the driver; probing
a list opens the files of one directory. Distances are in double precision,
ties go to the lower centroid and the earlier row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from ..errors import EngineError
from ..functions.distance import squared_l2, vector_literal
from ..functions.types import ROW_ID
from ..sources.store import IndexEntry, Store, TableEntry

ROUNDS, SEED = 15, 42
#: Rows of a list that meet a batch of queries in one task, about.
CELL_ROWS = 32_768
#: Queries of a batch that one task takes, at most.
CELL_QUERIES = 65_536
#: Rows that centroids are trained on, about, at most.
TRAIN_ROWS = 1_000_000
#: Lists that SQL probes and multiple of LIMIT that it fetches: fixed values of the dialect.
PROBES, OVERFETCH = 4, 4


def train(rows: DataFrame, column: str, lists: int) -> list[list[float]]:
    """Centroids by at most 15 Lloyd rounds from a seeded random start."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    total = rows.count()
    if total < lists:
        raise EngineError(f"{total} rows cannot fill {lists} lists")
    if total > TRAIN_ROWS:
        rows = rows.sample(TRAIN_ROWS / total, SEED)
    points = rows.select(array_to_vector(F.col(column).cast("array<double>")).alias("features"))
    model = KMeans(k=lists, maxIter=ROUNDS, tol=0.0, initMode="random", seed=SEED).fit(points)
    return [[float(x) for x in c] for c in model.clusterCenters()]


def assign(rows: DataFrame, column: str, centroids: list[list[float]]) -> DataFrame:
    """``rows`` with ``_cluster``, the nearest centroid's number."""
    centers = np.array(centroids, dtype=np.float64)

    def run(batches):
        for batch in batches:
            points = batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, centers.shape[1])
            nearest = np.empty(len(points), dtype=np.int32)
            for a in range(0, len(points), 1024):
                gaps = points[a : a + 1024, None, :] - centers[None, :, :] if len(centers) <= 64 else None
                squares = (gaps * gaps).sum(axis=2) if gaps is not None else np.stack([((points[a : a + 1024] - c) ** 2).sum(axis=1) for c in centers], axis=1)
                nearest[a : a + 1024] = squares.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest)], names=[*batch.schema.names, "_cluster"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("_cluster", IntegerType())]))


def write(store: Store, rows: DataFrame, name: str, column: str, centroids: list[list[float]], folder: str) -> list[str]:
    # The number is in the files as well as in their folder, for joins by it.
    filed = assign(rows, column, centroids).withColumn("_list", F.col("_cluster"))
    # Rebalancing keeps small lists together and splits large ones, by size.
    return store.write(filed.hint("rebalance", F.col("_cluster")), f"v/{name}/{folder}", "_cluster")


def probes(index: IndexEntry, query: list[float], nprobe: int) -> list[int]:
    """Numbers of the nearest centroids, ties to the lower."""
    centers = np.array(index.centroids, dtype=np.float64)
    if len(query) != centers.shape[1]:
        raise EngineError(f"a query vector of {len(query)} elements, where the index has {centers.shape[1]}")
    squares = ((centers - np.array(query)) ** 2).sum(axis=1)
    return np.argsort(squares, kind="stable")[:nprobe].tolist()


def candidates(
    store: Store, index: IndexEntry, table: TableEntry, query: list[float], fetch: int, nprobe: int,
    own_rows: DataFrame | None = None, own_tombs: list[str] = (),
) -> DataFrame:
    """The ``fetch`` nearest visible rows of the probed lists, with ``_dist``; own uncommitted rows take part."""
    wanted = [f"/_cluster={c}/" for c in probes(index, query, nprobe)]
    rows = store.read([p for p in index.files if any(w in p for w in wanted)], table.schema.struct())
    if own_rows is not None:
        rows = rows.unionByName(own_rows)
    rows = store.alive(rows, table, own_tombs).withColumn("_dist", squared_l2(F.col(index.column), vector_literal(query)))
    return rows.orderBy("_dist", *ROW_ID).limit(fetch)


def nearest_in_cell(queries: np.ndarray, points: np.ndarray, order: np.ndarray, k: int):
    """(query, point, squared distance) of each query's k nearest points; ties to the lower ``order``."""
    norms = np.square(points).sum(axis=1)
    out: list[list[np.ndarray]] = [[], [], []]
    for a in range(0, len(queries), 256):
        some = queries[a : a + 256]
        rough = norms[None, :] - 2 * (some @ points.T)
        # What the expansion can be off by.
        slack = 1e-9 * (norms.max(initial=0.0) + np.square(some).sum(axis=1) + 1)
        for i, r in enumerate(rough):
            near = np.arange(len(r))
            if len(r) > k:
                near = np.flatnonzero(r <= np.partition(r, k - 1)[k - 1] + slack[i])
            exact = np.square(points[near] - some[i]).sum(axis=1)
            best = np.lexsort((order[near], exact))[:k]
            for x, y in zip(out, (np.full(len(best), a + i), near[best], exact[best]), strict=True):
                x.append(y)
    return [np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in out]


def search_many(store: Store, index: IndexEntry, table: TableEntry, queries: DataFrame, k: int, nprobe: int = PROBES) -> DataFrame:
    """For each query (columns query_id and vector): its k nearest visible rows in the probed lists.

    Returns query_id, rank (from 1), the table's columns and dist. Queries and
    rows, as ids and vectors alone, meet in cells of one list's block of rows
    and one block of queries; a list has as many blocks as its own rows ask
    for. Cells are searched by matrix products and give k rows a query to be
    ranked; the other columns are fetched for what is left.
    """
    centers = np.array(index.centroids, dtype=np.float64)
    column, n = index.column, min(nprobe, len(centers))

    def run(batches):
        for batch in batches:
            points = np.array(batch.column("_vector").to_pylist(), dtype=np.float64).reshape(batch.num_rows, -1)
            squares = np.stack([np.square(points - c).sum(axis=1) for c in centers], axis=1)
            lists = np.argsort(squares, axis=1, kind="stable")[:, :n].astype(np.int32)
            out = batch.take(pa.array(np.repeat(np.arange(batch.num_rows), n)))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(lists.reshape(-1))], names=[*batch.schema.names, "_list"])

    schema = StructType([*table.schema.struct().fields, StructField("_list", IntegerType())])
    filed = store.read(index.files, schema)
    # A row per list.
    sizes = F.broadcast(filed.groupBy("_list").agg(F.ceil(F.count(F.lit(1)) / CELL_ROWS).cast("int").alias("_blocks")))
    lots = max(1, -(-queries.count() // CELL_QUERIES))
    own = F.pmod(F.xxhash64("query_id", "vector"), F.lit(lots)).cast("int")
    asked = queries.select(F.col("query_id").cast("long").alias("_query"), F.col("vector").cast("array<double>").alias("_vector"), own.alias("_lot"))
    asked = asked.mapInArrow(run, "_query long, _vector array<double>, _lot int, _list int").join(sizes, "_list")
    asked = asked.select("_list", "_lot", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block"), "_query", "_vector")
    rows = store.alive(filed, table)
    points = rows.select("_list", *ROW_ID, F.col(f"`{column}`").cast("array<double>").alias("_vector")).join(sizes, "_list")
    points = points.select("_list", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))).alias("_lot"), F.pmod(F.xxhash64(*ROW_ID), F.col("_blocks")).cast("int").alias("_block"), *ROW_ID, "_vector")
    fields = [StructField("_query", LongType()), *[StructField(c, LongType()) for c in ROW_ID], StructField("_dist", DoubleType())]

    def cell(t: pa.Table) -> pa.Table:
        is_query = np.asarray(t.column("_query").is_valid())
        points, wanted = t.filter(pa.array(~is_query)), t.filter(pa.array(is_query))
        if not len(points) or not len(wanted):
            return pa.Table.from_batches([], pa.schema([("_query", pa.int64()), *[(c, pa.int64()) for c in ROW_ID], ("_dist", pa.float64())]))
        flat = lambda x: x.column("_vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
        order = np.lexsort((points.column("_seq").to_numpy(), points.column("_xmin").to_numpy()))
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        q, p, d = nearest_in_cell(flat(wanted), flat(points), place, k)
        found = points.select(list(ROW_ID)).take(pa.array(p))
        return pa.table([wanted.column("_query").take(pa.array(q)), *found.columns, pa.array(d)], names=["_query", *ROW_ID, "_dist"])

    met = points.unionByName(asked, allowMissingColumns=True).groupBy("_list", "_lot", "_block").applyInArrow(cell, StructType(fields))
    best = Window.partitionBy("_query").orderBy("_dist", *ROW_ID)
    ranked = met.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= k)
    found = ranked.join(rows.select(*[F.col(f"`{c}`") for c in table.schema.names], *ROW_ID), list(ROW_ID))
    return found.select(F.col("_query").alias("query_id"), F.col("_rank").alias("rank"), *[F.col(f"`{c}`") for c in table.schema.names], F.col("_dist").alias("dist"))
