"""Syntax trees of the SQL dialect."""

from __future__ import annotations

from dataclasses import dataclass

from lakevec.types import SqlType

At = tuple[int, int]


@dataclass(frozen=True)
class Literal:
    """kind: number, string, boolean or null."""

    kind: str
    value: object
    at: At = (0, 0)


@dataclass(frozen=True)
class VectorLiteral:
    values: tuple[float, ...]
    at: At = (0, 0)


@dataclass(frozen=True)
class ColumnRef:
    table: str | None
    name: str
    at: At = (0, 0)


@dataclass(frozen=True)
class Unary:
    op: str
    operand: Expr
    at: At = (0, 0)


@dataclass(frozen=True)
class Binary:
    op: str
    left: Expr
    right: Expr
    at: At = (0, 0)


@dataclass(frozen=True)
class Call:
    """star: COUNT(*)."""

    name: str
    args: tuple[Expr, ...]
    distinct: bool = False
    star: bool = False
    at: At = (0, 0)


@dataclass(frozen=True)
class Between:
    operand: Expr
    low: Expr
    high: Expr
    negated: bool
    at: At = (0, 0)


@dataclass(frozen=True)
class Like:
    operand: Expr
    pattern: Expr
    escape: Expr | None
    negated: bool
    at: At = (0, 0)


@dataclass(frozen=True)
class InList:
    operand: Expr
    items: tuple[Expr, ...]
    negated: bool
    at: At = (0, 0)


@dataclass(frozen=True)
class IsNull:
    operand: Expr
    negated: bool
    at: At = (0, 0)


Expr = Literal | VectorLiteral | ColumnRef | Unary | Binary | Call | Between | Like | InList | IsNull


@dataclass(frozen=True)
class Item:
    """An entry of a select list; no expression means *."""

    expr: Expr | None
    alias: str | None = None


@dataclass(frozen=True)
class OrderKey:
    expr: Expr
    ascending: bool = True
    nulls_first: bool = False


@dataclass(frozen=True)
class Select:
    items: tuple[Item, ...]
    table: str
    alias: str | None = None
    distinct: bool = False
    where: Expr | None = None
    group: tuple[Expr, ...] = ()
    having: Expr | None = None
    order: tuple[OrderKey, ...] = ()
    limit: int | None = None
    offset: int = 0


@dataclass(frozen=True)
class Insert:
    table: str
    columns: tuple[str, ...] | None
    rows: tuple[tuple[Expr, ...], ...]


@dataclass(frozen=True)
class Update:
    table: str
    assignments: tuple[tuple[str, Expr], ...]
    where: Expr | None = None


@dataclass(frozen=True)
class Delete:
    table: str
    where: Expr | None = None


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: SqlType
    not_null: bool = False
    primary_key: bool = False
    unique: bool = False
    default: Expr | None = None


@dataclass(frozen=True)
class CreateTable:
    name: str
    columns: tuple[ColumnDef, ...]
    primary_key: tuple[str, ...] = ()
    options: tuple[tuple[str, str], ...] = ()
    if_not_exists: bool = False


@dataclass(frozen=True)
class DropTable:
    name: str
    if_exists: bool = False


@dataclass(frozen=True)
class CreateIndex:
    name: str
    table: str
    column: str
    method: str = "btree"
    options: tuple[tuple[str, str], ...] = ()
    if_not_exists: bool = False


@dataclass(frozen=True)
class DropIndex:
    name: str
    if_exists: bool = False


Statement = Select | Insert | Update | Delete | CreateTable | DropTable | CreateIndex | DropIndex

