"""Secondary indexes: a covering copy of the rows, dealt into buckets of the key and sorted.

A lookup opens the files of one bucket, where Parquet's statistics skip to the
key's row groups. Buckets grow with the table whenever it is compacted. Buckets
with very many rows, of a hot key, say, are written by several tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import IndexEntry, Store, TableEntry

ROWS_PER_BUCKET = 1_000_000
LEAST_BUCKETS = 16


def buckets_for(rows: int) -> int:
    return max(LEAST_BUCKETS, rows // ROWS_PER_BUCKET)


def write(store: Store, rows: DataFrame, name: str, column: str, buckets: int, folder: str) -> list[str]:
    """Write rows into the index; the new files."""
    dealt = rows.withColumn("_b", F.pmod(F.col(column), F.lit(buckets)).cast("int"))
    # Rebalancing keeps small buckets together and splits large ones, by size.
    dealt = dealt.hint("rebalance", F.col("_b")).sortWithinPartitions("_b", column)
    return store.write(dealt, f"i/{name}/{folder}", "_b")


def _rows(store: Store, index: IndexEntry, table: TableEntry, paths: list[str]) -> DataFrame:
    return store.read(paths, table.schema.struct())


def lookup(store: Store, index: IndexEntry, table: TableEntry, key: int, own_tombs: list[str] = ()) -> DataFrame:
    """Visible rows whose column is the key."""
    bucket = f"/_b={key % index.buckets}/"
    rows = _rows(store, index, table, [p for p in index.files if bucket in p])
    return store.alive(rows.where(F.col(index.column) == key), table, own_tombs)


def between(store: Store, index: IndexEntry, table: TableEntry, low: int, high: int, own_tombs: list[str] = ()) -> DataFrame:
    """Visible rows whose column is from low to high, both included; files are sorted, so statistics prune."""
    return store.alive(_rows(store, index, table, index.files).where(F.col(index.column).between(low, high)), table, own_tombs)


def lookup_many(store: Store, index: IndexEntry, table: TableEntry, keys: DataFrame, own_tombs: list[str] = ()) -> DataFrame:
    """Visible rows for a table of keys (its first column), as one semi-join.

    Spark broadcasts the keys if they are small and shuffles otherwise.
    """
    wanted = keys.select(F.col(keys.columns[0]).cast("long").alias(index.column)).distinct()
    return store.alive(_rows(store, index, table, index.files).join(wanted, index.column, "left_semi"), table, own_tombs)
