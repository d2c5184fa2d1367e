"""The dialect's three column types and their Spark counterparts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

from ..errors import EngineError

INT, TEXT, VECTOR = "INT", "TEXT", "VECTOR"
#: Hidden columns: the transaction that wrote a row and the row's number in it.
ROW_ID = ("_xmin", "_seq")


@dataclass(frozen=True)
class Column:
    name: str
    kind: str
    dim: int = 0

    def field(self) -> T.StructField:
        if self.kind == INT:
            return T.StructField(self.name, T.LongType(), False)
        if self.kind == TEXT:
            return T.StructField(self.name, T.StringType(), False)
        if self.kind == VECTOR:
            return T.StructField(self.name, T.ArrayType(T.FloatType(), False), False, {"vector_dim": self.dim})
        return T.StructField(self.name, T.DataType.fromDDL(self.kind))

    def admit(self, value):
        """The value as the column stores it."""
        if self.kind == INT and isinstance(value, (int, float)) and not isinstance(value, bool):
            value = int(value)
            if not -(1 << 63) <= value < 1 << 63:
                raise EngineError(f"{self.name}: {value} is not a 64-bit integer")
            return value
        if self.kind == TEXT and isinstance(value, str):
            return value
        if self.kind == VECTOR and isinstance(value, (list, tuple)):
            if len(value) != self.dim:
                raise EngineError(f"{self.name}: a vector of {len(value)} elements where {self.dim} are needed")
            return [float(v) for v in value]
        raise EngineError(f"{self.name}: {value!r} is not of type {self.kind}")


@dataclass(frozen=True)
class Schema:
    columns: tuple[Column, ...]

    def __getitem__(self, name: str) -> Column:
        for c in self.columns:
            if c.name == name:
                return c
        raise EngineError(f"Unknown column {name}")

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def struct(self, hidden: bool = True) -> T.StructType:
        own = [c.field() for c in self.columns]
        return T.StructType(own + [T.StructField(n, T.LongType(), False) for n in ROW_ID] if hidden else own)

    def admit(self, values: list) -> list:
        if len(values) != len(self.columns):
            raise EngineError(f"{len(values)} values for {len(self.columns)} columns")
        return [c.admit(v) for c, v in zip(self.columns, values, strict=True)]

    def to_json(self) -> list:
        return [[c.name, c.kind, c.dim] for c in self.columns]

    @classmethod
    def from_json(cls, data: list) -> Schema:
        return cls(tuple(Column(*c) for c in data))


def kind_of(data_type: T.DataType) -> str | None:
    """The dialect's type of a column of a registered table; None for types that it cannot name."""
    if isinstance(data_type, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return INT
    if isinstance(data_type, T.StringType):
        return TEXT
    if isinstance(data_type, T.ArrayType) and isinstance(data_type.elementType, (T.FloatType, T.DoubleType)):
        return VECTOR
    return None
