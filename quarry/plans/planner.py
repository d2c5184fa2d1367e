"""From a parsed SELECT or DELETE to a DataFrame and its explanation."""

from __future__ import annotations

import operator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions.text import all_of, four_decimals
from ..functions.types import INT, TEXT, Schema
from ..operators import ivf, secondary
from ..operators.columnar import ColumnarCache
from ..sources.store import Store, TableEntry
from .syntax import Predicate, Select

_COMPARE = {"=": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


@dataclass
class Own:
    """What an open transaction sees besides committed rows."""

    rows: DataFrame | None = None
    tombs: tuple[str, ...] = ()


@dataclass
class Plan:
    rows: DataFrame
    columns: list[str]
    explain: str


def condition(schema: Schema, where: tuple[Predicate, ...]) -> Column | None:
    """The conjunction; unknown columns and types that do not match are errors whatever the rows are."""
    found = []
    for p in where:
        column = schema[p.column]
        if not (column.kind == INT and isinstance(p.value, int) or column.kind == TEXT and isinstance(p.value, str)):
            raise EngineError(f"{p.column} of type {column.kind} cannot be compared with {p.value!r}")
        found.append(_COMPARE[p.op](F.col(f"`{p.column}`"), F.lit(p.value).cast("long") if column.kind == INT else F.lit(p.value)))
    return all_of(found) if found else None


class Planner:
    def __init__(self, store: Store, cache: ColumnarCache) -> None:
        self.store, self.cache = store, cache

    def scan(self, table: TableEntry, where: tuple[Predicate, ...], own: Own) -> tuple[DataFrame, str]:
        """Visible rows that meet all predicates, by an index if one serves an equality."""
        condition(table.schema, where)
        used = index = None
        for p in where:
            if p.op == "=" and isinstance(p.value, int) and (index := self.store.state.index_on(table.name, p.column)):
                used = p
                break
        if used:
            rows = secondary.lookup(self.store, index, table, used.value, own.tombs)
            if own.rows is not None:
                mine = self.store.alive(own.rows.where(condition(table.schema, (used,))), table, own.tombs)
                rows = rows.unionByName(mine)
            text = f"IndexScan({table.name}.{used.column} = {used.value})"
        else:
            rows = self.store.snapshot(table, own.rows, own.tombs)
            text = f"SeqScan({table.name}) [no matching index -> full scan]"
        rest = tuple(p for p in where if p is not used)
        if rest:
            rows = rows.where(condition(table.schema, rest))
            text = f"Filter({len(where)} predicates)\n {text}"
        return rows, text

    def select(self, stmt: Select, own: Own) -> Plan:
        table = self.store.state.table(stmt.table)
        if stmt.aggregate:
            return self._aggregate(stmt, table, own)
        columns = list(stmt.columns) or table.schema.names
        for c in columns:
            table.schema[c]
        if stmt.nearest:
            rows, text = self._nearest(stmt, table, own)
        else:
            rows, text = self.scan(table, stmt.where, own)
            text = f"Project({len(columns)} columns)\n {text}"
        return Plan(rows.select(*[F.col(f"`{c}`") for c in columns]), columns, text)

    def _nearest(self, stmt: Select, table: TableEntry, own: Own) -> tuple[DataFrame, str]:
        near = stmt.nearest
        table.schema[near.column]
        index = self.store.state.vector_index_on(table.name, near.column)
        if index is None:
            raise EngineError(f"No vector index on {table.name}.{near.column}")
        nprobe = min(ivf.PROBES, len(index.centroids))
        rows = ivf.candidates(self.store, index, table, list(near.vector), near.k * ivf.OVERFETCH, nprobe, own.rows, own.tombs)
        text = f"VectorIndexScan({table.name}.{near.column} <-> query, k={near.k}, nprobe={nprobe})"
        # After the fetch is cut, so that a selective predicate may leave fewer than k rows.
        if (only := condition(table.schema, stmt.where)) is not None:
            rows, text = rows.where(only), f"{text}\n PostFilter({len(stmt.where)} predicates)"
        return rows.orderBy("_dist", "_xmin", "_seq").limit(near.k), text

    def _aggregate(self, stmt: Select, table: TableEntry, own: Own) -> Plan:
        function, column = stmt.aggregate
        if column != "*":
            kind = table.schema[column].kind
            if function != "COUNT" and kind != INT:
                raise EngineError(f"{function} requires an INT column. {column} is not one.")
        cached = self.cache.get(table.name)
        if not stmt.where and cached and (function == "COUNT" or column in cached.columns):
            rows, text = cached.rows, f"ColumnarAggregate({function}({column})) [from REFRESH COLUMNAR cache]"
        else:
            rows, scan = self.scan(table, stmt.where, own)
            text = f"RowAggregate({function}({column}))\n {scan}"
        return Plan(aggregate(rows, function, column), [f"{function}({column})"], text)


def aggregate(rows: DataFrame, function: str, column: str) -> DataFrame:
    """One row of the count and of what the function needs; ``finish`` turns it into the value."""
    value = F.col(f"`{column}`") if function != "COUNT" else F.lit(1)
    of = {"COUNT": F.count, "SUM": F.sum, "AVG": F.sum, "MIN": F.min, "MAX": F.max}[function]
    return rows.agg(F.count(F.lit(1)).alias("count"), of(value).alias("value"))


def finish(function: str, column: str, count: int, value):
    if function == "COUNT":
        return count
    if not count:
        raise EngineError(f"{function}({column}) over zero matching rows is undefined")
    return four_decimals(float(value) / float(count)) if function == "AVG" else value
