"""From syntax trees to typed Spark columns; every rule of the dialect that Spark doesn't share is applied here."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakevec import errors, types
from lakevec.functions import vector as vectors
from lakevec.plans import ast as A
from lakevec.plans.parser import AGGREGATES

INT_MAX, LONG_MAX = 2**31 - 1, 2**63 - 1


@dataclass(frozen=True)
class Typed:
    """A column with its type; constant is the value of a literal, name that of a plain column reference."""

    column: Column
    type: types.SqlType
    constant: object = None
    name: str | None = None
    literal: bool = False


class Scope:
    """The columns that expressions see: those of one table, by its name or alias."""

    def __init__(self, schema: T.StructType, names: tuple[str, ...]):
        self.fields = {f.name: f for f in schema}
        self.names = names
        self._typed: dict[str, Typed] = {}

    @classmethod
    def of(cls, columns: dict[str, Typed]) -> Scope:
        """The columns of an intermediate result, by name, with the types that they are known to have."""
        s = cls(T.StructType([]), ())
        s._typed = {n: Typed(F.col(f"`{n}`"), t.type, name=n) for n, t in columns.items()}
        return s

    def resolve(self, ref: A.ColumnRef) -> Typed:
        if ref.table is not None and ref.table not in self.names:
            raise errors.TableNotFound(f"there is no table {ref.table} here", ref.at)
        if ref.name in self._typed:
            return self._typed[ref.name]
        f = self.fields.get(ref.name)
        if f is None:
            raise errors.ColumnNotFound(f"there is no column {ref.name}", ref.at)
        return Typed(F.col(f"`{ref.name}`"), types.from_spark(f), name=ref.name)


def analyze(e: A.Expr, scope: Scope) -> Typed:
    """The typed column of an expression; type errors are raised here, before anything runs."""
    return Analyzer(scope).expr(e)


def predicate(e: A.Expr, scope: Scope) -> Column:
    """The column of a condition, which must be Boolean; a bare NULL isn't."""
    t = analyze(e, scope)
    if t.type.kind != "BOOLEAN":
        raise errors.TypeMismatch(f"a condition must be BOOLEAN, not {t.type}", getattr(e, "at", None))
    return t.column


def store(t: Typed, f: T.StructField, at: A.At | None = None) -> Column:
    """A value as it is stored in a column: widened, or refused with TypeMismatch."""
    target = types.from_spark(f)
    if t.type.kind == "VECTOR" and target.kind == "VECTOR" and target.dimension and t.type.dimension not in (0, target.dimension):
        raise errors.DimensionMismatch(f"column {f.name} has dimension {target.dimension}, the value {t.type.dimension}", at)
    double_literal = t.literal and t.type.kind == "DOUBLE" and target.kind == "FLOAT"
    if not (types.assignable(t.type, target) or double_literal) or (t.type.kind == "TEXT" and target.kind == "TIMESTAMP" and not t.literal):
        raise errors.TypeMismatch(f"{t.type} can't be stored in {f.name} {target}", at)
    if t.literal and t.constant is None and not f.nullable:
        raise errors.NullViolation(f"column {f.name} can't be NULL", at)
    return t.column.cast(f.dataType)


class Analyzer:
    def __init__(self, scope: Scope):
        self.scope = scope

    def expr(self, e: A.Expr) -> Typed:
        return getattr(self, "_" + type(e).__name__.lower())(e)

    def _literal(self, e: A.Literal) -> Typed:
        if e.kind == "null":
            return Typed(F.lit(None), types.NULL, literal=True)
        if e.kind == "boolean":
            return Typed(F.lit(bool(e.value)), types.BOOLEAN, e.value, literal=True)
        if e.kind == "string":
            return Typed(F.lit(e.value), types.TEXT, e.value, literal=True)
        text = str(e.value)
        if any(c in text for c in ".eE"):
            return Typed(F.lit(float(text)), types.DOUBLE, float(text), literal=True)
        n = int(text)
        if -INT_MAX - 1 <= n <= INT_MAX:
            return Typed(F.lit(n).cast("int"), types.INTEGER, n, literal=True)
        if -LONG_MAX - 1 <= n <= LONG_MAX:
            return Typed(F.lit(n).cast("long"), types.BIGINT, n, literal=True)
        raise errors.TypeMismatch(f"{text} is too large for BIGINT", e.at)

    def _vectorliteral(self, e: A.VectorLiteral) -> Typed:
        return Typed(F.array(*(F.lit(v) for v in e.values)), types.vector(len(e.values)), e.values, literal=True)

    def _columnref(self, e: A.ColumnRef) -> Typed:
        return self.scope.resolve(e)

    def _unary(self, e: A.Unary) -> Typed:
        t = self.expr(e.operand)
        if e.op == "NOT":
            if t.type.kind not in ("BOOLEAN", "NULL"):
                raise errors.InvalidOperator(f"NOT needs BOOLEAN, not {t.type}", e.at)
            return Typed(~t.column.cast("boolean"), types.BOOLEAN)
        if not types.numeric(t.type) and t.type.kind != "NULL":
            raise errors.InvalidOperator(f"- needs a number, not {t.type}", e.at)
        return Typed(-t.column, t.type)

    def _binary(self, e: A.Binary) -> Typed:
        a, b = self.expr(e.left), self.expr(e.right)
        if e.op in ("AND", "OR"):
            for t in (a, b):
                if t.type.kind not in ("BOOLEAN", "NULL"):
                    raise errors.InvalidOperator(f"{e.op} needs BOOLEAN, not {t.type}", e.at)
            x, y = a.column.cast("boolean"), b.column.cast("boolean")
            return Typed(x & y if e.op == "AND" else x | y, types.BOOLEAN)
        if e.op == "||":
            for t in (a, b):
                if t.type.kind not in ("TEXT", "NULL"):
                    raise errors.InvalidOperator(f"|| needs TEXT, not {t.type}", e.at)
            return Typed(F.concat(a.column.cast("string"), b.column.cast("string")), types.TEXT)
        if e.op in ("=", "<>", "<", ">", "<=", ">="):
            x, y = self._alike(a, b, e.at)
            compared = {"=": x == y, "<>": x != y, "<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[e.op]
            return Typed(compared, types.BOOLEAN)
        return self._arithmetic(e, a, b)

    def _arithmetic(self, e: A.Binary, a: Typed, b: Typed) -> Typed:
        kind = types.arithmetic(a.type, b.type)
        if kind.kind == "NULL":
            return Typed(F.lit(None), types.NULL)
        to = types.to_spark(kind)
        x, y = a.column.cast(to), b.column.cast(to)
        whole = kind.kind in ("INTEGER", "BIGINT")
        if e.op == "%":
            if not whole:
                raise errors.InvalidOperator("% needs whole numbers", e.at)
            return Typed(x % y, kind)
        if e.op == "/":
            # whole numbers are divided towards zero; a zero divisor is an error for all numbers
            return Typed(F.call_function("div", x, y).cast(to) if whole else (x / y).cast(to), kind)
        return Typed({"+": x + y, "-": x - y, "*": x * y}[e.op], kind)

    def _alike(self, a: Typed, b: Typed, at: A.At) -> tuple[Column, Column]:
        """Both sides in a common type for a comparison. A string literal is read as a timestamp beside one."""
        for s, o in ((a, b), (b, a)):
            if s.type.kind == "TEXT" and s.literal and o.type.kind == "TIMESTAMP":
                moment = F.lit(_moment(str(s.constant), at)).cast("timestamp_ntz")
                return (moment, o.column) if s is a else (o.column, moment)
        try:
            types.comparable(a.type, b.type)
        except errors.TypeMismatch as err:
            raise type(err)(err.message, at) from None
        if types.numeric(a.type) and types.numeric(b.type) and a.type != b.type:
            to = types.to_spark(types.arithmetic(a.type, b.type))
            return a.column.cast(to), b.column.cast(to)
        return a.column, b.column

    def _between(self, e: A.Between) -> Typed:
        v, low, high = self.expr(e.operand), self.expr(e.low), self.expr(e.high)
        x, y = self._alike(v, low, e.at)
        z, w = self._alike(v, high, e.at)
        within = (x >= y) & (z <= w)
        return Typed(~within if e.negated else within, types.BOOLEAN)

    def _like(self, e: A.Like) -> Typed:
        v, p = self.expr(e.operand), self.expr(e.pattern)
        for t in (v, p):
            if t.type.kind not in ("TEXT", "NULL"):
                raise errors.InvalidOperator(f"LIKE needs TEXT, not {t.type}", e.at)
        mark = "\\"
        if e.escape is not None:
            s = self.expr(e.escape)
            if s.type.kind != "TEXT" or not s.literal or len(str(s.constant)) != 1:
                raise errors.TypeMismatch("ESCAPE needs a string of one character", e.at)
            mark = str(s.constant)
        found = F.like(v.column.cast("string"), p.column.cast("string"), F.lit(mark))
        return Typed(~found if e.negated else found, types.BOOLEAN)

    def _inlist(self, e: A.InList) -> Typed:
        v = self.expr(e.operand)
        if not e.items:
            return Typed(F.lit(e.negated), types.BOOLEAN)
        pairs = [self._alike(v, self.expr(i), e.at) for i in e.items]
        if all(x is pairs[0][0] for x, _ in pairs):
            found = pairs[0][0].isin(*(y for _, y in pairs))
        else:
            found = pairs[0][0] == pairs[0][1]
            for x, y in pairs[1:]:
                found = found | (x == y)
        return Typed(~found if e.negated else found, types.BOOLEAN)

    def _isnull(self, e: A.IsNull) -> Typed:
        t = self.expr(e.operand)
        return Typed(t.column.isNotNull() if e.negated else t.column.isNull(), types.BOOLEAN)

    def _call(self, e: A.Call) -> Typed:
        if e.name in ("vector_similarity", "vector_distance"):
            return self._vector_function(e)
        if e.name in AGGREGATES:
            return self._aggregate(e)
        raise errors.Unsupported(f"there is no function {e.name}", e.at)

    def _vector_function(self, e: A.Call) -> Typed:
        if len(e.args) != 3:
            raise errors.TypeMismatch(f"{e.name} has 3 arguments, not {len(e.args)}", e.at)
        a, b, m = (self.expr(x) for x in e.args)
        for t in (a, b):
            if t.type.kind != "VECTOR":
                raise errors.TypeMismatch(f"{e.name} needs vectors, not {t.type}", e.at)
        if a.type.dimension and b.type.dimension and a.type.dimension != b.type.dimension:
            raise errors.DimensionMismatch(f"vectors of dimension {a.type.dimension} and {b.type.dimension}", e.at)
        if m.type.kind != "TEXT" or not m.literal:
            raise errors.InvalidMetric("the metric must be a string", e.at)
        return Typed(vectors.vector_similarity(a.column, b.column, str(m.constant)), types.DOUBLE)

    def _aggregate(self, e: A.Call) -> Typed:
        """count is BIGINT, avg DOUBLE, sum of whole numbers BIGINT, the others have their argument's type."""
        if e.star:
            if e.name != "count":
                raise errors.TypeMismatch(f"{e.name}(*) has no meaning", e.at)
            return Typed(F.count(F.lit(1)), types.BIGINT)
        if len(e.args) != 1:
            raise errors.TypeMismatch(f"{e.name} has 1 argument, not {len(e.args)}", e.at)
        t = self.expr(e.args[0])
        if e.name == "count":
            return Typed(F.count_distinct(t.column) if e.distinct else F.count(t.column), types.BIGINT)
        if e.name in ("min", "max"):
            types.comparable(t.type, t.type)
            return Typed(F.min(t.column) if e.name == "min" else F.max(t.column), t.type)
        if not types.numeric(t.type):
            raise errors.TypeMismatch(f"{e.name} needs numbers, not {t.type}", e.at)
        if e.name == "avg":
            return Typed(F.try_divide(F.sum_distinct(t.column.cast("double")), F.count_distinct(t.column)) if e.distinct else F.avg(t.column), types.DOUBLE)
        total = F.sum_distinct(t.column) if e.distinct else F.sum(t.column)
        whole = t.type.kind in ("INTEGER", "BIGINT")
        return Typed(total if whole else total.cast(types.to_spark(t.type)), types.BIGINT if whole else t.type)


def _moment(text: str, at: A.At) -> datetime:
    try:
        return datetime.fromisoformat(text)
    except ValueError:
        raise errors.TypeMismatch(f"{text!r} isn't a timestamp", at) from None


def has_aggregate(e: A.Expr | None) -> bool:
    """Whether an expression contains an aggregate."""
    if isinstance(e, A.Call):
        return e.name in AGGREGATES or any(map(has_aggregate, e.args))
    if isinstance(e, A.Binary):
        return has_aggregate(e.left) or has_aggregate(e.right)
    if isinstance(e, (A.Unary, A.IsNull)):
        return has_aggregate(e.operand)
    if isinstance(e, A.Between):
        return any(map(has_aggregate, (e.operand, e.low, e.high)))
    if isinstance(e, A.InList):
        return has_aggregate(e.operand) or any(map(has_aggregate, e.items))
    if isinstance(e, A.Like):
        return has_aggregate(e.operand)
    return False
