"""Lazy and eager frames: select, with_columns, filter, group_by and agg, as Spark plans."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakevec import errors

_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_KEYS = (*_NUMBERS, T.BooleanType, T.StringType)


class Expr:
    """An expression over a frame's columns; it becomes a column once the schema is known."""

    def __init__(self, make: Callable[[T.StructType], tuple[Column, T.DataType]], kind: str, name: str | None = None, needs: frozenset[str] = frozenset()):
        self._make, self.kind, self.name, self.needs = make, kind, name, needs

    def alias(self, name: str) -> Expr:
        return Expr(self._make, self.kind if self.kind in ("column", "aggregate") else "alias", name, self.needs)

    def resolve(self, schema: T.StructType) -> tuple[Column, T.DataType]:
        return self._make(schema)

    def _two(self, other: object, kind: str, make: Callable[[Column, Column, T.DataType], Column], result: T.DataType | None = None) -> Expr:
        right = other if isinstance(other, Expr) else lit(other)

        def build(schema: T.StructType) -> tuple[Column, T.DataType]:
            (a, s), (b, t) = self.resolve(schema), right.resolve(schema)
            common = _common(s, t, kind)
            return make(a.cast(common), b.cast(common), common), result or common

        return Expr(build, kind, needs=self.needs | right.needs)

    def __add__(self, o: object) -> Expr:
        return self._two(o, "number", lambda a, b, _: a + b)

    def __sub__(self, o: object) -> Expr:
        return self._two(o, "number", lambda a, b, _: a - b)

    def __mul__(self, o: object) -> Expr:
        return self._two(o, "number", lambda a, b, _: a * b)

    def __truediv__(self, o: object) -> Expr:
        """Whole numbers divide towards zero, and by zero is an error; others follow IEEE 754."""
        return self._two(o, "number", _quotient)

    def __eq__(self, o: object) -> Expr:  # type: ignore[override]
        return self._two(o, "compare", lambda a, b, _: a == b, T.BooleanType())

    def __ne__(self, o: object) -> Expr:  # type: ignore[override]
        return self._two(o, "compare", lambda a, b, _: a != b, T.BooleanType())

    def __lt__(self, o: object) -> Expr:
        return self._two(o, "compare", lambda a, b, _: a < b, T.BooleanType())

    def __le__(self, o: object) -> Expr:
        return self._two(o, "compare", lambda a, b, _: a <= b, T.BooleanType())

    def __gt__(self, o: object) -> Expr:
        return self._two(o, "compare", lambda a, b, _: a > b, T.BooleanType())

    def __ge__(self, o: object) -> Expr:
        return self._two(o, "compare", lambda a, b, _: a >= b, T.BooleanType())

    def __and__(self, o: object) -> Expr:
        return self._two(o, "logic", lambda a, b, _: a & b, T.BooleanType())

    def __or__(self, o: object) -> Expr:
        return self._two(o, "logic", lambda a, b, _: a | b, T.BooleanType())

    def __invert__(self) -> Expr:
        def build(schema: T.StructType) -> tuple[Column, T.DataType]:
            c, t = self.resolve(schema)
            if not isinstance(t, (T.BooleanType, T.NullType)):
                raise errors.TypeMismatch(f"not needs a Boolean, not {t.simpleString()}")
            return ~c.cast("boolean"), T.BooleanType()

        return Expr(build, "logic", needs=self.needs)

    def _null(self, yes: bool) -> Expr:
        def build(schema: T.StructType) -> tuple[Column, T.DataType]:
            c, _ = self.resolve(schema)
            return (c.isNull() if yes else c.isNotNull()), T.BooleanType()

        return Expr(build, "logic", needs=self.needs)

    def is_null(self) -> Expr:
        return self._null(True)

    def is_not_null(self) -> Expr:
        return self._null(False)

    def _aggregate(self, name: str, make: Callable[[Column, T.DataType], tuple[Column, T.DataType]], numbers: bool) -> Expr:
        if self.kind not in ("column", "literal"):
            raise errors.Unsupported(f"{name} takes a column or a literal")

        def build(schema: T.StructType) -> tuple[Column, T.DataType]:
            c, t = self.resolve(schema)
            if numbers and not isinstance(t, _NUMBERS):
                raise errors.TypeMismatch(f"{name} needs numbers, not {t.simpleString()}")
            return make(c, t)

        return Expr(build, "aggregate", self.name, self.needs)

    def sum(self) -> Expr:
        """Exact; of whole numbers a long, otherwise of the input's type; null if nothing is there."""
        return self._aggregate("sum", lambda c, t: (F.sum(c), T.LongType()) if isinstance(t, _WHOLE) else (F.sum(c).cast(t), t), True)

    def mean(self) -> Expr:
        return self._aggregate("mean", lambda c, _: (F.avg(c), T.DoubleType()), True)

    def count(self) -> Expr:
        """Values that aren't null; of a literal all rows."""
        return self._aggregate("count", lambda c, _: (F.count(c), T.LongType()), False)

    def min(self) -> Expr:
        return self._aggregate("min", lambda c, t: (F.min(c), t), True)

    def max(self) -> Expr:
        return self._aggregate("max", lambda c, t: (F.max(c), t), True)

    __hash__ = None  # type: ignore[assignment]


def _quotient(a: Column, b: Column, kind: T.DataType) -> Column:
    if isinstance(kind, _WHOLE):
        return F.call_function("div", a, b).cast(kind)
    infinite = F.when(a > 0, float("inf")).when(a < 0, float("-inf")).otherwise(float("nan"))
    return F.when(b == 0, F.when(a.isNull(), None).otherwise(infinite)).otherwise(F.try_divide(a, b)).cast(kind)


def _common(a: T.DataType, b: T.DataType, kind: str) -> T.DataType:
    """The type in which two operands meet: numbers widen, others must be equal, null fits all."""
    if kind == "logic":
        for t in (a, b):
            if not isinstance(t, (T.BooleanType, T.NullType)):
                raise errors.TypeMismatch(f"and/or need Booleans, not {t.simpleString()}")
        return T.BooleanType()
    if isinstance(a, T.NullType):
        return b
    if isinstance(b, T.NullType) or a == b:
        if kind == "number" and not isinstance(a, (*_NUMBERS, T.NullType)):
            raise errors.TypeMismatch(f"arithmetic needs numbers, not {a.simpleString()}")
        return a
    if isinstance(a, _NUMBERS) and isinstance(b, _NUMBERS):
        if isinstance(a, _WHOLE) and isinstance(b, _WHOLE):
            return a if _WHOLE.index(type(a)) > _WHOLE.index(type(b)) else b
        return T.DoubleType()
    raise errors.TypeMismatch(f"{a.simpleString()} doesn't go with {b.simpleString()}")


def col(name: str) -> Expr:
    def build(schema: T.StructType) -> tuple[Column, T.DataType]:
        for f in schema:
            if f.name == name:
                return F.col(f"`{name}`"), f.dataType
        raise errors.ColumnNotFound(f"there is no column {name}")

    return Expr(build, "column", name, frozenset([name]))


def lit(value: object) -> Expr:
    kinds = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType(), type(None): T.NullType()}
    if type(value) not in kinds:
        raise errors.TypeMismatch(f"a literal is None, a bool, int, float or str, not {type(value).__name__}")
    kind = kinds[type(value)]
    return Expr(lambda _: (F.lit(value).cast(kind) if value is not None else F.lit(None), kind), "literal")


def all_columns() -> Expr:
    """Every column of the frame."""
    return Expr(lambda _: (_ for _ in ()).throw(errors.Unsupported("all_columns() stands alone in a select")), "all")


def _expr(e: Expr | str) -> Expr:
    return col(e) if isinstance(e, str) else e


class LazyFrame:
    """A plan; nothing runs before collect. Catalyst pushes predicates and prunes columns."""

    def __init__(self, df: DataFrame):
        self.df = df

    def select(self, *exprs: Expr | str) -> LazyFrame:
        """The given expressions; unnamed ones get Spark's name for them."""
        out: list[Column] = []
        for e in map(_expr, exprs):
            if e.kind == "all":
                out += [F.col(f"`{n}`") for n in self.df.columns]
                continue
            if e.kind == "aggregate":
                raise errors.Unsupported("aggregates belong into agg")
            c, _ = e.resolve(self.df.schema)
            out.append(c.alias(e.name) if e.name else c)
        return LazyFrame(self.df.select(*out))

    def with_columns(self, *exprs: Expr) -> LazyFrame:
        """Columns added at the end, or replaced in place; all see the frame as it was before."""
        new: dict[str, Column] = {}
        for e in exprs:
            if not e.name:
                raise errors.InvalidOption("an expression in with_columns needs an alias")
            new[e.name] = e.resolve(self.df.schema)[0]
        kept = [new[n].alias(n) if n in new else F.col(f"`{n}`") for n in self.df.columns]
        return LazyFrame(self.df.select(*kept, *(c.alias(n) for n, c in new.items() if n not in self.df.columns)))

    def filter(self, e: Expr) -> LazyFrame:
        c, t = e.resolve(self.df.schema)
        if not isinstance(t, T.BooleanType):
            raise errors.TypeMismatch(f"a predicate must be Boolean, not {t.simpleString()}")
        return LazyFrame(self.df.filter(c))

    def group_by(self, *keys: Expr | str) -> LazyGroupBy:
        return LazyGroupBy(self, [_expr(k) for k in keys])

    def collect(self) -> Frame:
        return Frame(self.df)

    def explain(self, optimized: bool = True) -> str:
        """The logical plan as text, after or before Catalyst's rules."""
        q = self.df._jdf.queryExecution()
        return (q.optimizedPlan() if optimized else q.analyzed()).toString()

    @property
    def schema(self) -> T.StructType:
        return self.df.schema


class LazyGroupBy:
    def __init__(self, frame: LazyFrame, keys: Sequence[Expr]):
        if not keys:
            raise errors.InvalidOption("group_by needs a key")
        self._frame, self._keys = frame, keys

    def agg(self, *aggregates: Expr) -> LazyFrame:
        """Keys, then aggregates. A null key is a group of its own."""
        schema = self._frame.df.schema
        keys = []
        for k in self._keys:
            if k.kind != "column":
                raise errors.Unsupported("a group key is a column")
            c, t = k.resolve(schema)
            if not isinstance(t, _KEYS):
                raise errors.TypeMismatch(f"{t.simpleString()} can't be a group key")
            keys.append(c.alias(k.name or ""))
        out = []
        for a in aggregates:
            if a.kind != "aggregate":
                raise errors.Unsupported("agg takes aggregates")
            c, _ = a.resolve(schema)
            out.append(c.alias(a.name) if a.name else c)
        if not out:
            raise errors.InvalidOption("agg needs an aggregate")
        return LazyFrame(self._frame.df.groupBy(*keys).agg(*out))


class Frame:
    """An eager view of a plan: the same operations, each giving a Frame. Rows move only when they are asked for."""

    def __init__(self, df: DataFrame):
        self.df = df

    @classmethod
    def from_columns(cls, spark: SparkSession, columns: dict[str, Sequence[object]], schema: T.StructType | str) -> Frame:
        """A frame of given values; columns must be as long as each other and named once."""
        lengths = {len(v) for v in columns.values()}
        if len(lengths) > 1:
            raise errors.SchemaMismatch("columns differ in length")
        kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        names = [f.name for f in kind]  # type: ignore[union-attr]
        if len(set(names)) < len(names) or set(names) != set(columns):
            raise errors.SchemaMismatch("names must be those of the schema, each once")
        rows = list(zip(*(columns[n] for n in names))) if columns else []
        try:
            return cls(spark.createDataFrame(rows, kind))
        except Exception as e:
            raise errors.TypeMismatch(str(e).splitlines()[0]) from None

    def lazy(self) -> LazyFrame:
        return LazyFrame(self.df)

    def select(self, *exprs: Expr | str) -> Frame:
        return self.lazy().select(*exprs).collect()

    def with_columns(self, *exprs: Expr) -> Frame:
        return self.lazy().with_columns(*exprs).collect()

    def filter(self, e: Expr) -> Frame:
        return self.lazy().filter(e).collect()

    def group_by(self, *keys: Expr | str) -> GroupBy:
        return GroupBy(self.lazy().group_by(*keys))

    @property
    def schema(self) -> T.StructType:
        return self.df.schema

    @property
    def width(self) -> int:
        return len(self.df.columns)

    def height(self) -> int:
        return self.df.count()

    def column(self, name: str) -> list[object]:
        """A column's values, which come to the driver."""
        return [r[0] for r in self.df.select(col(name).resolve(self.df.schema)[0]).collect()]

    def rows(self) -> list[tuple]:
        return [tuple(r) for r in self.df.collect()]


class GroupBy:
    def __init__(self, lazy: LazyGroupBy):
        self._lazy = lazy

    def agg(self, *aggregates: Expr) -> Frame:
        return self._lazy.agg(*aggregates).collect()

