"""The SQL dialect: seven statements, parsed into dataclasses.

Keywords are case-insensitive, names case-sensitive. A statement may end with a
semicolon; anything after it is an error.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..errors import SqlSyntaxError
from ..functions.types import INT, TEXT, VECTOR, Column, Schema

_TOKEN = re.compile(
    r"""\s*(?:(?P<word>[A-Za-z_]\w*)|(?P<number>-?\d+(?:\.\d*)?)|'(?P<string>[^']*)'|(?P<mark><->|<=|>=|!=|[=<>(),;*\[\]]))""",
    re.ASCII,
)
#: Type names: fixed values of the dialect.
_TYPES = {"INT": INT, "INTEGER": INT, "TEXT": TEXT, "VARCHAR": TEXT, "VECTOR": VECTOR}
_AGGREGATES = ("COUNT", "SUM", "AVG", "MIN", "MAX")
_COMPARISONS = ("=", "!=", "<", "<=", ">", ">=")


@dataclass(frozen=True)
class Predicate:
    column: str
    op: str
    value: int | str | tuple


@dataclass(frozen=True)
class CreateTable:
    table: str
    schema: Schema


@dataclass(frozen=True)
class CreateIndex:
    name: str
    table: str
    column: str


@dataclass(frozen=True)
class CreateVectorIndex:
    name: str
    table: str
    column: str
    lists: int


@dataclass(frozen=True)
class RefreshColumnar:
    table: str


@dataclass(frozen=True)
class Insert:
    table: str
    values: tuple


@dataclass(frozen=True)
class Delete:
    table: str
    where: tuple[Predicate, ...] = ()


@dataclass(frozen=True)
class Nearest:
    column: str
    vector: tuple
    k: int


@dataclass(frozen=True)
class Select:
    table: str
    columns: tuple[str, ...] = ()  # none: all
    aggregate: tuple[str, str] | None = None
    where: tuple[Predicate, ...] = ()
    nearest: Nearest | None = None


Statement = CreateTable | CreateIndex | CreateVectorIndex | RefreshColumnar | Insert | Delete | Select


@dataclass
class _Reader:
    text: str
    tokens: list[tuple[str, str]] = field(default_factory=list)
    at: int = 0

    def __post_init__(self) -> None:
        place, text = 0, self.text.rstrip()
        while place < len(text):
            m = _TOKEN.match(text, place)
            if not m:
                raise SqlSyntaxError(f"unexpected character at: {text[place:].strip()[:20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            place = m.end()

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ("end", "end of statement")

    def take(self, kind: str, what: str) -> str:
        found, value = self.peek()
        if found != kind:
            raise SqlSyntaxError(f"expected {what}, got {value!r}")
        self.at += 1
        return value

    def is_word(self, *words: str, ahead: int = 0) -> bool:
        kind, value = self.peek(ahead)
        return kind == "word" and value.upper() in words

    def word(self, *words: str) -> str:
        if not self.is_word(*words):
            raise SqlSyntaxError(f"expected {' or '.join(words)}, got {self.peek()[1]!r}")
        return self.take("word", "").upper()

    def may(self, kind: str, value: str) -> bool:
        if self.peek() == (kind, value):
            self.at += 1
            return True
        return False

    def mark(self, value: str) -> None:
        if not self.may("mark", value):
            raise SqlSyntaxError(f"expected {value!r}, got {self.peek()[1]!r}")

    def name(self) -> str:
        return self.take("word", "a name")

    def integer(self) -> int:
        # A fraction is cut off, towards zero.
        return int(self.take("number", "a number").partition(".")[0])

    def several(self, one, close: str) -> list:
        found = [one()]
        while self.may("mark", ","):
            found.append(one())
        self.mark(close)
        return found

    def vector(self) -> tuple:
        self.mark("[")
        return () if self.may("mark", "]") else tuple(self.several(lambda: float(self.take("number", "a number")), "]"))

    def literal(self):
        kind, value = self.peek()
        if kind == "number":
            return self.integer()
        if kind == "string":
            self.at += 1
            return value
        if (kind, value) == ("mark", "["):
            return self.vector()
        raise SqlSyntaxError(f"expected a literal, got {value!r}")

    def column(self) -> Column:
        name, kind = self.name(), _TYPES[self.word(*_TYPES)]
        dim = 0
        if kind == VECTOR:
            self.mark("(")
            dim = self.integer()
            self.mark(")")
            if dim < 1:
                raise SqlSyntaxError("a vector needs at least one element")
        return Column(name, kind, dim)

    def where(self) -> tuple[Predicate, ...]:
        if not self.is_word("WHERE"):
            return ()
        self.at += 1
        found = []
        while True:
            column = self.name()
            kind, op = self.peek()
            if kind != "mark" or op not in _COMPARISONS:
                raise SqlSyntaxError(f"expected a comparison, got {op!r}")
            self.at += 1
            found.append(Predicate(column, op, self.literal()))
            if not self.is_word("AND"):
                return tuple(found)
            self.at += 1


def _create(r: _Reader) -> Statement:
    what = r.word("TABLE", "INDEX", "VECTOR")
    if what == "TABLE":
        table = r.name()
        r.mark("(")
        columns = r.several(r.column, ")")
        if len({c.name for c in columns}) < len(columns):
            raise SqlSyntaxError("a column name is given twice")
        return CreateTable(table, Schema(tuple(columns)))
    if what == "VECTOR":
        r.word("INDEX")
    name = r.name()
    r.word("ON")
    table = r.name()
    r.mark("(")
    column = r.name()
    r.mark(")")
    if what == "INDEX":
        return CreateIndex(name, table, column)
    r.word("LISTS")
    lists = r.integer()
    if lists < 1:
        raise SqlSyntaxError("LISTS must be at least 1")
    return CreateVectorIndex(name, table, column, lists)


def _select(r: _Reader) -> Select:
    columns, aggregate = (), None
    if r.is_word(*_AGGREGATES) and r.peek(1) == ("mark", "("):
        function = r.word(*_AGGREGATES)
        r.mark("(")
        if function == "COUNT" and r.may("mark", "*"):
            aggregate = (function, "*")
        else:
            aggregate = (function, r.name())
        r.mark(")")
    elif not r.may("mark", "*"):
        columns = [r.name()]
        while r.may("mark", ","):
            columns.append(r.name())
    r.word("FROM")
    table, where, nearest = r.name(), r.where(), None
    if r.is_word("ORDER"):
        if aggregate:
            raise SqlSyntaxError("ORDER BY cannot follow an aggregate")
        r.at += 1
        r.word("BY")
        column = r.name()
        r.mark("<->")
        vector = r.vector()
        r.word("LIMIT")
        k = r.integer()
        if k < 0:
            raise SqlSyntaxError("LIMIT must not be negative")
        nearest = Nearest(column, vector, k)
    return Select(table, tuple(columns), aggregate, where, nearest)


def parse(text: str) -> Statement:
    r = _Reader(text)
    verb = r.word("CREATE", "REFRESH", "INSERT", "SELECT", "DELETE")
    if verb == "CREATE":
        found: Statement = _create(r)
    elif verb == "REFRESH":
        r.word("COLUMNAR")
        found = RefreshColumnar(r.name())
    elif verb == "INSERT":
        r.word("INTO")
        table = r.name()
        r.word("VALUES")
        r.mark("(")
        found = Insert(table, tuple(r.several(r.literal, ")")))
    elif verb == "DELETE":
        r.word("FROM")
        found = Delete(r.name(), r.where())
    else:
        found = _select(r)
    r.may("mark", ";")
    if r.peek()[0] != "end":
        raise SqlSyntaxError(f"unexpected {r.peek()[1]!r} after the statement")
    return found
