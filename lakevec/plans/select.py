"""SELECT as a chain of DataFrame operations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakevec import errors, types
from lakevec.plans import ast as A
from lakevec.plans.analyzer import Scope, Typed, analyze, has_aggregate, predicate
from lakevec.plans.parser import AGGREGATES

#: The direction in which a metric's nearest vectors come first.
NEAREST = {"cosine": False, "inner": False, "l2": True}


@dataclass(frozen=True)
class Knn:
    """A recognised nearest-neighbour query: ORDER BY vector function of a column and a literal, LIMIT k."""

    column: str
    query: tuple[float, ...]
    metric: str
    k: int
    filtered: bool


def knn_of(s: A.Select) -> Knn | None:
    """The nearest-neighbour pattern of a SELECT, if it is one: one key in the metric's direction, no offset or grouping."""
    if s.limit is None or s.offset or len(s.order) != 1 or s.group or s.distinct:
        return None
    key = s.order[0]
    call = key.expr
    if not isinstance(call, A.Call) or call.name not in ("vector_similarity", "vector_distance") or len(call.args) != 3:
        return None
    a, b, m = call.args
    if isinstance(a, A.VectorLiteral):
        a, b = b, a
    if not (isinstance(a, A.ColumnRef) and isinstance(b, A.VectorLiteral) and isinstance(m, A.Literal) and m.kind == "string"):
        return None
    how = types.metric(str(m.value))
    return Knn(a.name, b.values, how, s.limit, s.where is not None) if key.ascending == NEAREST[how] else None


def _sorted(c: Column, key: A.OrderKey) -> Column:
    """NULLs come last in both directions unless the query says otherwise."""
    if key.ascending:
        return c.asc_nulls_first() if key.nulls_first else c.asc_nulls_last()
    return c.desc_nulls_first() if key.nulls_first else c.desc_nulls_last()


def _page(df: DataFrame, s: A.Select) -> DataFrame:
    if s.offset:
        df = df.offset(s.offset)
    return df if s.limit is None else df.limit(s.limit)


def _constant(e: A.Expr) -> bool:
    return isinstance(e, (A.Literal, A.VectorLiteral))


def outputs(s: A.Select, scope: Scope) -> list[tuple[str, Column, A.Expr | None]]:
    """Name, column and expression of each output; an expression without alias is col_ and its place."""
    out: list[tuple[str, Column, A.Expr | None]] = []
    for item in s.items:
        if item.expr is None:
            out += [(n, F.col(f"`{n}`"), A.ColumnRef(None, n)) for n in scope.fields]
        else:
            t = analyze(item.expr, scope)
            out.append((item.alias or t.name or f"col_{len(out)}", t.column, item.expr))
    return out


def plan(df: DataFrame, s: A.Select) -> DataFrame:
    """Filter, sort, page and project df: conditions and keys see all columns of the table.

    A sort key is resolved against the table first, then as an output's alias; a constant, also a number, orders
    nothing. With DISTINCT or grouping the keys must be outputs, since they are sorted after.
    """
    scope = Scope(df.schema, tuple(n for n in (s.table, s.alias) if n))
    grouping = bool(s.group) or s.having is not None or any(i.expr is not None and has_aggregate(i.expr) for i in s.items)
    out = outputs(s, scope)
    if s.where is not None:
        if has_aggregate(s.where):
            raise errors.Unsupported("WHERE can't have an aggregate")
        df = df.filter(predicate(s.where, scope))
    if grouping:
        return _grouped(df, s, scope, out)
    if s.distinct:
        return _page(_sort_outputs(df.select(*(c.alias(n) for n, c, _ in out)).distinct(), s, out), s)
    aliases = {n: c for n, c, _ in out}
    keys = []
    for k in s.order:
        if _constant(k.expr):
            continue
        try:
            keys.append(_sorted(analyze(k.expr, scope).column, k))
        except errors.ColumnNotFound:
            if not (isinstance(k.expr, A.ColumnRef) and k.expr.table is None and k.expr.name in aliases):
                raise
            keys.append(_sorted(aliases[k.expr.name], k))
    if keys:
        df = df.orderBy(*keys)
    return _page(df, s).select(*(c.alias(n) for n, c, _ in out))


def _same(a: A.Expr | None, b: A.Expr) -> bool:
    """Whether two expressions are equal but for their places and qualifiers."""
    if isinstance(a, A.ColumnRef) and isinstance(b, A.ColumnRef):
        return a.name == b.name
    if type(a) is not type(b) or a is None:
        return False
    for f in a.__dataclass_fields__:
        if f != "at":
            x, y = getattr(a, f), getattr(b, f)
            if isinstance(x, tuple) and isinstance(y, tuple):
                if len(x) != len(y) or not all(_same(i, j) if hasattr(i, "__dataclass_fields__") else i == j for i, j in zip(x, y)):
                    return False
            elif hasattr(x, "__dataclass_fields__"):
                if not _same(x, y):
                    return False
            elif x != y:
                return False
    return True


def rebuilt(e: A.Expr, make: Callable[[A.Expr], A.Expr]) -> A.Expr:
    """e with make() of each expression in it."""
    parts = {}
    for f in fields(e):
        x = getattr(e, f.name)
        if isinstance(x, A.Expr):
            parts[f.name] = make(x)
        elif isinstance(x, tuple) and x and all(isinstance(i, A.Expr) for i in x):
            parts[f.name] = tuple(map(make, x))
    return replace(e, **parts) if parts else e


def _sort_outputs(df: DataFrame, s: A.Select, out: list[tuple[str, Column, A.Expr | None]]) -> DataFrame:
    keys = []
    for k in s.order:
        if _constant(k.expr):
            continue
        name = next((n for n, _, e in out if _same(e, k.expr) or (isinstance(k.expr, A.ColumnRef) and k.expr.name == n)), None)
        if name is None:
            raise errors.Unsupported("ORDER BY must name an output here")
        keys.append(_sorted(F.col(f"`{name}`"), k))
    return df.orderBy(*keys) if keys else df


def _grouped(df: DataFrame, s: A.Select, scope: Scope, out: list[tuple[str, Column, A.Expr | None]]) -> DataFrame:
    """Grouping: outputs and HAVING see group keys and aggregates only.

    Aggregates are computed once each beside the keys; what is made of them, and HAVING, comes after. A column outside an
    aggregate must be part of a group key.
    """
    keys = [(g, f"__g{i}", analyze(g, scope)) for i, g in enumerate(s.group)]
    found: list[tuple[A.Expr, str, Typed]] = []

    def after(e: A.Expr) -> A.Expr:
        """e with group keys and aggregates replaced by the columns that hold them."""
        for g, name, _ in keys:
            if _same(e, g):
                return A.ColumnRef(None, name)
        if isinstance(e, A.Call) and has_aggregate(e) and e.name in AGGREGATES:
            if any(map(has_aggregate, e.args)):
                raise errors.Unsupported("an aggregate can't have an aggregate")
            for x, name, _ in found:
                if _same(e, x):
                    return A.ColumnRef(None, name)
            found.append((e, f"__a{len(found)}", analyze(e, scope)))
            return A.ColumnRef(None, found[-1][1])
        if isinstance(e, A.ColumnRef):
            scope.resolve(e)
            raise errors.Unsupported(f"{e.name} is neither grouped nor in an aggregate")
        return rebuilt(e, after)

    made = [(n, after(e)) for n, _, e in out]
    having = after(s.having) if s.having is not None else None
    columns = [t.column.alias(name) for _, name, t in found]
    grouped = df.groupBy(*(t.column.alias(name) for _, name, t in keys)).agg(*(columns or [F.count(F.lit(1)).alias("__n")]))
    inside = Scope.of({name: t for _, name, t in [*keys, *found]})
    if having is not None:
        grouped = grouped.filter(predicate(having, inside))
    result = grouped.select(*(analyze(e, inside).column.alias(n) for n, e in made))
    if s.distinct:
        result = result.distinct()
    return _page(_sort_outputs(result, s, out), s)
