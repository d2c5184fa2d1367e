"""Versioned tables: append-only Parquet and tombstones, named by the commit log.

A row's id is (_xmin, _seq): the transaction that wrote it and its number there.
A tombstone is a row's id; any committed one hides the row.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..errors import EngineError
from ..functions.types import INT, ROW_ID, VECTOR, Column, Schema, kind_of
from .files import Files
from .log import CommitLog, Record

#: Records after which the writer keeps a checkpoint.
CHECKPOINT_EVERY = 100
TOMBSTONE = T.StructType([T.StructField(n, T.LongType(), False) for n in ROW_ID])


@dataclass
class IndexEntry:
    name: str
    table: str
    column: str
    files: list[str] = field(default_factory=list)
    buckets: int = 0  # of a secondary index
    centroids: list[list[float]] = field(default_factory=list)  # of a vector index


@dataclass
class TableEntry:
    name: str
    schema: Schema
    data: list[str] = field(default_factory=list)
    tombs: list[str] = field(default_factory=list)
    external: str | None = None  # a registered Parquet path


class State:
    """What the published records add up to."""

    def __init__(self) -> None:
        self.tables: dict[str, TableEntry] = {}
        self.indexes: dict[str, IndexEntry] = {}
        self.vector_indexes: dict[str, IndexEntry] = {}
        self.committed: set[int] = set()

    def apply(self, record: Record) -> None:
        body = record.body
        if record.type == "TABLE":
            self.tables[body["name"]] = TableEntry(body["name"], Schema.from_json(body["schema"]))
        elif record.type == "INDEX":
            self.indexes[body["name"]] = IndexEntry(body["name"], body["table"], body["column"], list(body["files"]), buckets=body["buckets"])
        elif record.type == "VECTOR":
            self.vector_indexes[body["name"]] = IndexEntry(body["name"], body["table"], body["column"], list(body["files"]), centroids=body["centroids"])
        elif record.type in ("COMMIT", "COMPACT"):
            self.committed.add(record.txn)
            for name, own in body.get("tables", {}).items():
                table = self.tables[name]
                if record.type == "COMPACT":
                    table.data, table.tombs = [], []
                table.data += own.get("data", [])
                table.tombs += own.get("tombs", [])
            for kind, entries in (("indexes", self.indexes), ("vectors", self.vector_indexes)):
                for name, paths in body.get(kind, {}).items():
                    if record.type == "COMPACT":
                        entries[name].files = []
                    entries[name].files += paths
            for name, buckets in body.get("buckets", {}).items():
                self.indexes[name].buckets = buckets

    def to_json(self) -> dict:
        """All that records have added up to; registered tables are not part of it."""
        own = {n: t for n, t in self.tables.items() if t.external is None}
        return {
            "tables": {n: [t.schema.to_json(), t.data, t.tombs] for n, t in own.items()},
            "indexes": [asdict(i) for i in self.indexes.values()], "vectors": [asdict(i) for i in self.vector_indexes.values()],
            "committed": sorted(self.committed),
        }

    @classmethod
    def from_json(cls, raw: dict) -> State:
        state = cls()
        state.tables = {n: TableEntry(n, Schema.from_json(schema), data, tombs) for n, (schema, data, tombs) in raw["tables"].items()}
        state.indexes = {i["name"]: IndexEntry(**i) for i in raw["indexes"]}
        state.vector_indexes = {i["name"]: IndexEntry(**i) for i in raw["vectors"]}
        state.committed = set(raw["committed"])
        return state

    def table(self, name: str) -> TableEntry:
        if name not in self.tables:
            raise EngineError(f"Unknown table {name}")
        return self.tables[name]

    def index_on(self, table: str, column: str) -> IndexEntry | None:
        return next((i for i in self.indexes.values() if (i.table, i.column) == (table, column)), None)

    def vector_index_on(self, table: str, column: str) -> IndexEntry | None:
        return next((i for i in self.vector_indexes.values() if (i.table, i.column) == (table, column)), None)


class Store:
    """``upto``: the number of the last record to be read, for the state at that time."""

    def __init__(self, spark: SparkSession, root: str, upto: int | None = None) -> None:
        self.spark = spark
        self.files = Files(spark, root)
        self.log = CommitLog(self.files, upto)
        self.state = State() if self.log.checkpoint is None else State.from_json(self.log.checkpoint)
        self._applied = 0  # of the log's records
        self._apply()

    def _apply(self) -> int:
        """Apply the log's records that are not yet; their number."""
        new = self.log.records[self._applied :]
        for record in new:
            self.state.apply(record)
        self._applied += len(new)
        return len(new)

    def publish(self, kind: str, txn: int, body: dict) -> None:
        self.log.append(kind, txn, body)
        self._apply()
        if self.log.lsn % CHECKPOINT_EVERY == 0:
            self.checkpoint()

    def checkpoint(self) -> None:
        self.log.write_checkpoint(self.state.to_json())

    def receive(self, record: Record) -> None:
        """Apply a record that arrived by another way than the folder."""
        self.log.records.append(record)
        self._apply()

    def catch_up(self) -> int:
        """Apply records published by others; their number."""
        self.log.refresh()
        return self._apply()

    def read(self, paths: list[str], schema: T.StructType) -> DataFrame:
        """Exactly these files: a later commit into the same folder is not seen."""
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[self.files.at(p) for p in paths])

    def write(self, df: DataFrame, folder: str, *partition_by: str) -> list[str]:
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(self.files.at(folder))
        return self.files.parquet_files(folder)

    def alive(self, rows: DataFrame, table: TableEntry, own_tombs: list[str] = ()) -> DataFrame:
        """Without the rows that a committed or own tombstone hides."""
        tombs = [*table.tombs, *own_tombs]
        return rows.join(self.read(tombs, TOMBSTONE), list(ROW_ID), "left_anti") if tombs else rows

    def snapshot(self, table: TableEntry, own_rows: DataFrame | None = None, own_tombs: list[str] = ()) -> DataFrame:
        """The table's visible rows with their ids."""
        if table.external is not None:
            return external_rows(self.spark, table)
        rows = self.read(table.data, table.schema.struct())
        return self.alive(rows if own_rows is None else rows.unionByName(own_rows), table, own_tombs)

    def register_parquet(self, name: str, path: str) -> None:
        """Make a Parquet path a read-only table, for this engine's life."""
        df = self.spark.read.parquet(path)
        columns = []
        for f in df.schema.fields:
            kind = kind_of(f.dataType)
            if kind == VECTOR:
                first = df.select(f.name).where(f"{f.name} IS NOT NULL").first()
                columns.append(Column(f.name, VECTOR, len(first[0]) if first else 0))
            else:
                # A type that the dialect cannot name can be selected, and no more.
                columns.append(Column(f.name, kind or f.dataType.simpleString()))
        self.state.tables[name] = TableEntry(name, Schema(tuple(columns)), external=path)


def external_rows(spark: SparkSession, table: TableEntry) -> DataFrame:
    """Rows of a registered path in the dialect's widths. Such a table has no row ids, as nothing deletes from it."""
    df, casts = spark.read.parquet(table.external), {INT: "long", VECTOR: "array<float>"}
    return df.select(*[df[c.name].cast(casts[c.kind]).alias(c.name) if c.kind in casts else df[c.name] for c in table.schema.columns])
