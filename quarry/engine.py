"""The engine: statements in, results out, over a versioned store."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import EngineError
from .functions.text import value_text
from .functions.types import INT, VECTOR
from .operators import ivf, secondary
from .operators.columnar import ColumnarCache
from .plans import syntax
from .plans.planner import Own, Planner, finish
from .sources.store import TOMBSTONE, Store, TableEntry


@dataclass
class Transaction:
    """Buffered inserts by table and written, unpublished tombstones."""

    id: int
    state: str = "ACTIVE"
    inserts: dict[str, list] = field(default_factory=dict)
    loads: dict[str, list[str]] = field(default_factory=dict)
    tombs: dict[str, list[str]] = field(default_factory=dict)
    marks: int = 0  # folders written
    loaded: int = 0  # DataFrames loaded


@dataclass
class QueryResult:
    """``dataframe`` is lazy; ``rows`` brings a result to the driver."""

    is_select: bool = False
    column_names: list[str] = field(default_factory=list)
    rows_affected: int = 0
    explain: str = ""
    dataframe: DataFrame | None = None

    @cached_property
    def rows(self) -> list[list]:
        return [list(r) for r in self.dataframe.collect()] if self.dataframe is not None else []


class Engine:
    """One writer at a time; opening with ``write`` takes over from the last one.

    ``at`` opens, for reading, the state after that many records of the log.
    """

    def __init__(self, spark: SparkSession, root: str, write: bool = True, at: int | None = None) -> None:
        self.spark = spark
        self.store = Store(spark, root, at)
        self.cache = ColumnarCache(self.store)
        self.planner = Planner(self.store, self.cache)
        self.recovered = 0
        if write and at is None:
            self.promote()

    # Roles

    def promote(self, least: int = 0) -> int:
        """Become the writer in a new epoch (number ``least`` or later) and drop what earlier writers left unpublished; the epoch."""
        epoch = self.store.log.take_over(least)
        self.store.catch_up()
        self._next_txn = self.store.log.next_txn
        self.recovered = self._sweep()
        return epoch

    def _sweep(self) -> int:
        """Delete folders of transactions that were never published; their number."""
        state, dropped = self.store.state, 0
        known = {
            "t": {p.rsplit("/", 1)[0] for t in state.tables.values() for p in [*t.data, *t.tombs]},
            "i": {"/".join(p.split("/")[:3]) for i in state.indexes.values() for p in i.files},
            "v": {"/".join(p.split("/")[:3]) for i in state.vector_indexes.values() for p in i.files},
        }
        for name in state.tables:
            for kind in ("data", "tomb"):
                for folder in self.store.files.names(f"t/{name}/{kind}"):
                    if f"t/{name}/{kind}/{folder}" not in known["t"]:
                        self.store.files.delete(f"t/{name}/{kind}/{folder}")
                        dropped += 1
        for top in ("i", "v"):
            for name in self.store.files.names(top):
                for folder in self.store.files.names(f"{top}/{name}"):
                    if f"{top}/{name}/{folder}" not in known[top]:
                        self.store.files.delete(f"{top}/{name}/{folder}")
                        dropped += 1
        return dropped

    @property
    def epoch(self) -> int:
        return self.store.log.epoch

    def status(self) -> dict:
        state = self.store.state
        return {
            "role": "primary" if self.epoch else "replica", "epoch": self.epoch, "lsn": self.store.log.lsn,
            "tables": len(state.tables), "indexes": len(state.indexes) + len(state.vector_indexes), "committed": len(state.committed),
        }

    # Transactions

    def _new_id(self) -> int:
        if not self.epoch:
            raise EngineError("this server is not the primary -- writes must be sent to the primary")
        self._next_txn += 1
        return self._next_txn - 1

    def _folder(self, txn: int) -> str:
        """Where a transaction's files go: apart from those of an earlier writer that does not know yet that it was fenced."""
        return f"{self.epoch}-{txn}"

    def begin(self) -> Transaction:
        return Transaction(self._new_id())

    def _active(self, txn: Transaction) -> None:
        if txn.state != "ACTIVE":
            raise EngineError(f"transaction {txn.id} is {txn.state}")

    def _buffered(self, txn: Transaction | None, table: TableEntry) -> DataFrame | None:
        if txn is None:
            return None
        parts = []
        if rows := txn.inserts.get(table.name):
            parts.append(self.spark.createDataFrame(rows, table.schema.struct()))
        if paths := txn.loads.get(table.name):
            parts.append(self.store.read(paths, table.schema.struct()))
        if not parts:
            return None
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def _own(self, txn: Transaction | None, table: str) -> Own:
        if txn is None or table not in self.store.state.tables:
            return Own()
        return Own(self._buffered(txn, self.store.state.tables[table]), tuple(txn.tombs.get(table, ())))

    def commit(self, txn: Transaction) -> None:
        """Write the rows and their index entries, then publish all of it as one record."""
        self._active(txn)
        tables: dict[str, dict] = {}
        indexes: dict[str, list[str]] = {}
        vectors: dict[str, list[str]] = {}
        for name in {*txn.inserts, *txn.loads}:
            table = self.store.state.table(name)
            paths = list(txn.loads.get(name, []))
            if txn.inserts.get(name):
                rows = self.spark.createDataFrame(txn.inserts[name], table.schema.struct()).coalesce(1)
                paths += self.store.write(rows, f"t/{name}/data/{self._folder(txn.id)}")
            tables[name] = {"data": paths}
            new = self.store.read(paths, table.schema.struct())
            for index in self.store.state.indexes.values():
                if index.table == name:
                    indexes[index.name] = secondary.write(self.store, new, index.name, index.column, index.buckets, self._folder(txn.id))
            for index in self.store.state.vector_indexes.values():
                if index.table == name:
                    vectors[index.name] = ivf.write(self.store, new, index.name, index.column, index.centroids, self._folder(txn.id))
        for name, paths in txn.tombs.items():
            tables.setdefault(name, {})["tombs"] = paths
        self.store.publish("COMMIT", txn.id, {"tables": tables, "indexes": indexes, "vectors": vectors})
        txn.state = "COMMITTED"

    def abort(self, txn: Transaction) -> None:
        self._active(txn)
        txn.inserts, txn.loads, txn.tombs, txn.state = {}, {}, {}, "ABORTED"
        self.store.publish("ABORT", txn.id, {})

    # Statements

    def execute(self, sql: str, txn: Transaction | None = None) -> QueryResult:
        """Run one statement; INSERT and DELETE need a transaction."""
        stmt = syntax.parse(sql)
        if isinstance(stmt, syntax.Select):
            return self._select(stmt, txn)
        if isinstance(stmt, syntax.CreateTable):
            if stmt.table in self.store.state.tables:
                raise EngineError(f"Table {stmt.table} already exists")
            self.store.publish("TABLE", self._new_id(), {"name": stmt.table, "schema": stmt.schema.to_json()})
        elif isinstance(stmt, syntax.CreateIndex):
            self._create_index(stmt)
        elif isinstance(stmt, syntax.CreateVectorIndex):
            self.create_vector_index(stmt.name, stmt.table, stmt.column, stmt.lists)
        elif isinstance(stmt, syntax.RefreshColumnar):
            self.cache.refresh(self.store.state.table(stmt.table))
        else:
            if txn is None:
                raise EngineError(f"{type(stmt).__name__.upper()} requires an active transaction")
            self._active(txn)
            table = self.store.state.table(stmt.table)
            if table.external is not None:
                raise EngineError(f"{stmt.table} is read-only")
            return self._insert(stmt, table, txn) if isinstance(stmt, syntax.Insert) else self._delete(stmt, table, txn)
        return QueryResult()

    def sql(self, text: str) -> QueryResult:
        """Run one statement, INSERT and DELETE in a transaction of their own."""
        if not isinstance(syntax.parse(text), (syntax.Insert, syntax.Delete)):
            return self.execute(text)
        return self.executemany([text])

    def executemany(self, texts: list[str]) -> QueryResult:
        """Run statements in one transaction: one commit, one file per table."""
        txn = self.begin()
        try:
            affected = sum(self.execute(t, txn).rows_affected for t in texts)
        except Exception:
            self.abort(txn)
            raise
        self.commit(txn)
        return QueryResult(rows_affected=affected)

    def explain(self, sql: str, txn: Transaction | None = None) -> str:
        """How a SELECT would be run, without running it."""
        stmt = syntax.parse(sql)
        if not isinstance(stmt, syntax.Select):
            raise EngineError("only a SELECT can be explained")
        return self.planner.select(stmt, self._own(txn, stmt.table)).explain

    def _select(self, stmt: syntax.Select, txn: Transaction | None) -> QueryResult:
        plan = self.planner.select(stmt, self._own(txn, stmt.table))
        if stmt.aggregate is None:
            return QueryResult(True, plan.columns, explain=plan.explain, dataframe=plan.rows)
        row = plan.rows.first()
        value = finish(*stmt.aggregate, row["count"], row["value"])
        kind = T.StringType() if stmt.aggregate[0] == "AVG" else T.LongType()
        one = self.spark.createDataFrame([(value,)], T.StructType([T.StructField(plan.columns[0], kind, False)]))
        return QueryResult(True, plan.columns, explain=plan.explain, dataframe=one)

    def _insert(self, stmt: syntax.Insert, table: TableEntry, txn: Transaction) -> QueryResult:
        values = table.schema.admit(list(stmt.values))
        rows = txn.inserts.setdefault(table.name, [])
        rows.append((*values, txn.id, len(rows)))
        return QueryResult(rows_affected=1)

    def _delete(self, stmt: syntax.Delete, table: TableEntry, txn: Transaction) -> QueryResult:
        rows, _ = self.planner.scan(table, stmt.where, self._own(txn, table.name))
        txn.marks += 1
        paths = self.store.write(rows.select("_xmin", "_seq"), f"t/{table.name}/tomb/{self._folder(txn.id)}-{txn.marks}")
        count = self.store.read(paths, rows.select("_xmin", "_seq").schema).count() if paths else 0
        if count:
            txn.tombs.setdefault(table.name, []).extend(paths)
        return QueryResult(rows_affected=count)

    # Bulk data and indexes

    def register_parquet(self, name: str, path: str) -> None:
        if name in self.store.state.tables:
            raise EngineError(f"Table {name} already exists")
        self.store.register_parquet(name, path)

    def load(self, table: str, rows: DataFrame, txn: Transaction) -> None:
        """Add a DataFrame with the table's columns to a transaction, without passing the driver."""
        self._active(txn)
        entry = self.store.state.table(table)
        if entry.external is not None:
            raise EngineError(f"{table} is read-only")
        txn.marks += 1
        txn.loaded += 1
        if txn.loaded >= 1 << 7:
            raise EngineError("a transaction can load 127 DataFrames")
        columns = [_checked(c).alias(c.name) for c in entry.schema.columns]
        # Buffered rows count from 0, loaded ones from loaded * 2**56: the ids of up to 2**23 partitions keep apart.
        numbered = rows.select(*columns, F.lit(txn.id).cast("long").alias("_xmin"), (F.lit(txn.loaded << 56) + F.monotonically_increasing_id()).alias("_seq"))
        txn.loads.setdefault(table, []).extend(self.store.write(numbered, f"t/{table}/data/{self._folder(txn.id)}-{txn.marks}"))

    def _indexable(self, table: str, column: str, kind: str) -> tuple[TableEntry, DataFrame]:
        entry = self.store.state.table(table)
        if entry.schema[column].kind != kind:
            raise EngineError(f"{table}.{column} is not a column of type {kind}")
        rows = self.store.snapshot(entry)
        if entry.external is not None:
            rows = rows.select("*", F.lit(0).cast("long").alias("_xmin"), F.monotonically_increasing_id().alias("_seq"))
        return entry, rows

    def _create_index(self, stmt: syntax.CreateIndex) -> None:
        if stmt.name in self.store.state.indexes:
            raise EngineError(f"Index {stmt.name} already exists")
        _, rows = self._indexable(stmt.table, stmt.column, INT)
        txn, buckets = self._new_id(), secondary.buckets_for(rows.count())
        files = secondary.write(self.store, rows, stmt.name, stmt.column, buckets, self._folder(txn))
        self.store.publish("INDEX", txn, {"name": stmt.name, "table": stmt.table, "column": stmt.column, "buckets": buckets, "files": files})

    def create_vector_index(self, name: str, table: str, column: str, lists: int | None = None, centroids: list[list[float]] | None = None) -> None:
        """Train centroids, or take given ones, and file the committed rows under them."""
        if name in self.store.state.vector_indexes:
            raise EngineError(f"Vector index {name} already exists")
        _, rows = self._indexable(table, column, VECTOR)
        if centroids is None:
            centroids = ivf.train(rows, column, lists)
        txn = self._new_id()
        files = ivf.write(self.store, rows, name, column, centroids, self._folder(txn))
        self.store.publish("VECTOR", txn, {"name": name, "table": table, "column": column, "centroids": centroids, "files": files})

    def compact(self, table: str) -> None:
        """Rewrite a table's visible rows, and its indexes', into fresh files without tombstones.

        Secondary indexes get as many buckets as the rows ask for now.
        """
        entry, txn = self.store.state.table(table), self._new_id()
        data = self.store.write(self.store.snapshot(entry), f"t/{table}/data/{self._folder(txn)}")
        rows = self.store.read(data, entry.schema.struct())
        state = self.store.state
        own = [i for i in state.indexes.values() if i.table == table]
        buckets = secondary.buckets_for(rows.count()) if own else 0
        indexes = {i.name: secondary.write(self.store, rows, i.name, i.column, buckets, self._folder(txn)) for i in own}
        vectors = {i.name: ivf.write(self.store, rows, i.name, i.column, i.centroids, self._folder(txn)) for i in state.vector_indexes.values() if i.table == table}
        body = {"tables": {table: {"data": data}}, "indexes": indexes, "vectors": vectors, "buckets": {i.name: buckets for i in own}}
        self.store.publish("COMPACT", txn, body)

    def replace(self, table: str, rows: DataFrame, key: str, txn: Transaction) -> int:
        """Put in rows in place of the visible ones with their keys, as part of a transaction; the number taken out.

        Keys that ``rows`` holds more than once stay so.
        """
        self._active(txn)
        entry = self.store.state.table(table)
        if entry.external is not None:
            raise EngineError(f"{table} is read-only")
        if entry.schema[key].kind == VECTOR:
            raise EngineError(f"{key} of type {VECTOR} cannot be a key")
        txn.marks += 1
        old, _ = self.planner.scan(entry, (), self._own(txn, table))
        keys = rows.select(_checked(entry.schema[key]).alias(key)).distinct()
        gone = self.store.write(old.join(keys, key, "left_semi").select("_xmin", "_seq"), f"t/{table}/tomb/{self._folder(txn.id)}-{txn.marks}")
        count = self.store.read(gone, TOMBSTONE).count()
        if count:
            txn.tombs.setdefault(table, []).extend(gone)
        self.load(table, rows, txn)
        return count

    # Programmatic reads

    def dataframe(self, table: str) -> DataFrame:
        """The committed rows, for any Spark operation."""
        entry = self.store.state.table(table)
        return self.store.snapshot(entry).select(*entry.schema.names)

    def _index(self, name: str) -> tuple:
        if name not in self.store.state.indexes:
            raise EngineError(f"Unknown index {name}")
        index = self.store.state.indexes[name]
        return self.store, index, self.store.state.table(index.table)

    def lookup(self, index: str, key: int) -> DataFrame:
        store, entry, table = self._index(index)
        return secondary.lookup(store, entry, table, key).select(*table.schema.names)

    def lookup_many(self, index: str, keys: DataFrame) -> DataFrame:
        store, entry, table = self._index(index)
        return secondary.lookup_many(store, entry, table, keys).select(*table.schema.names)

    def between(self, index: str, low: int, high: int) -> DataFrame:
        store, entry, table = self._index(index)
        return secondary.between(store, entry, table, low, high).select(*table.schema.names)

    def search(self, index: str, query: list[float], k: int, nprobe: int = ivf.PROBES) -> DataFrame:
        """The k nearest rows with their squared distance, nearest first."""
        entry = self._vector_index(index)
        table = self.store.state.table(entry.table)
        rows = ivf.candidates(self.store, entry, table, query, k, min(nprobe, len(entry.centroids)))
        return rows.select(*table.schema.names, "_dist").withColumnRenamed("_dist", "dist")

    def search_many(self, index: str, queries: DataFrame, k: int, nprobe: int = ivf.PROBES) -> DataFrame:
        entry = self._vector_index(index)
        return ivf.search_many(self.store, entry, self.store.state.table(entry.table), queries, k, nprobe)

    def _vector_index(self, name: str):
        if name not in self.store.state.vector_indexes:
            raise EngineError(f"Unknown vector index {name}")
        return self.store.state.vector_indexes[name]


def _checked(column) -> SparkColumn:
    """A loaded column in the table's type; a null, or a vector of another length, fails the load."""
    value = F.col(f"`{column.name}`").cast({INT: "bigint", VECTOR: "array<float>"}.get(column.kind, "string"))
    good = value.isNotNull()
    if column.kind == VECTOR:
        good = good & (F.size(value) == column.dim) & ~F.exists(value, lambda x: x.isNull())
    return F.when(good, value).otherwise(F.raise_error(F.lit(f"{column.name}: a value that the table cannot hold")))


def encode(result: QueryResult) -> str:
    """A result as one line of the protocol. Separators within values are not escaped, as its readers expect."""
    rows = "|".join(";".join(value_text(v) for v in row) for row in result.rows)
    return f"OK\t{result.rows_affected}\t{','.join(result.column_names)}\t{rows}"


def answer(engine: Engine, line: str) -> str:
    """The reply to one line of SQL."""
    try:
        return encode(engine.sql(line.strip()))
    except EngineError as e:
        return f"ERR {e}"
