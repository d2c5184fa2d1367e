"""Columnar snapshots: a table's integer columns, pinned in memory until refreshed.

The snapshot names its files, so that Spark's cache is not rebuilt when the
table's folder gets new ones: aggregates stay as stale as they should be.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.types import INT
from ..sources.store import Store, TableEntry


@dataclass
class Snapshot:
    rows: DataFrame
    columns: list[str]
    count: int


class ColumnarCache:
    """Snapshots by table, for the life of an engine."""

    def __init__(self, store: Store) -> None:
        self.store = store
        self.snapshots: dict[str, Snapshot] = {}

    def refresh(self, table: TableEntry) -> Snapshot:
        self.drop(table.name)
        columns = [c.name for c in table.schema.columns if c.kind == INT]
        visible = self.store.snapshot(table)
        # With no integer column the rows can still be counted.
        rows = visible.select(*columns) if columns else visible.select(F.lit(1).alias("_one"))
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        self.snapshots[table.name] = Snapshot(rows, columns, rows.count())
        return self.snapshots[table.name]

    def get(self, table: str) -> Snapshot | None:
        return self.snapshots.get(table)

    def drop(self, table: str) -> None:
        if old := self.snapshots.pop(table, None):
            old.rows.unpersist(blocking=True)
