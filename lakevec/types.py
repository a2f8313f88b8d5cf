"""The dialect's types, their Spark types, and the rules of widening, comparing and assigning."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

from lakevec.errors import InvalidMetric, InvalidOperator, TypeMismatch

METRICS = ("cosine", "l2", "inner")


@dataclass(frozen=True)
class SqlType:
    """A type of the dialect; vectors carry their dimension and metric."""

    kind: str
    dimension: int = 0
    metric: str = "cosine"

    def __str__(self) -> str:
        return f"VECTOR({self.dimension}, {self.metric.upper()})" if self.kind == "VECTOR" else self.kind


INTEGER, BIGINT, FLOAT, DOUBLE = SqlType("INTEGER"), SqlType("BIGINT"), SqlType("FLOAT"), SqlType("DOUBLE")
TEXT, BLOB, BOOLEAN, TIMESTAMP, NULL = SqlType("TEXT"), SqlType("BLOB"), SqlType("BOOLEAN"), SqlType("TIMESTAMP"), SqlType("NULL")

NAMES = {"INTEGER": INTEGER, "INT": INTEGER, "BIGINT": BIGINT, "FLOAT": FLOAT, "DOUBLE": DOUBLE, "TEXT": TEXT, "BLOB": BLOB, "BOOLEAN": BOOLEAN, "BOOL": BOOLEAN, "TIMESTAMP": TIMESTAMP}

_SPARK = {
    "INTEGER": T.IntegerType(),
    "BIGINT": T.LongType(),
    "FLOAT": T.FloatType(),
    "DOUBLE": T.DoubleType(),
    "TEXT": T.StringType(),
    "BLOB": T.BinaryType(),
    "BOOLEAN": T.BooleanType(),
    "TIMESTAMP": T.TimestampNTZType(),
    "NULL": T.NullType(),
    "VECTOR": T.ArrayType(T.FloatType(), True),
}
_WIDTH = {"INTEGER": 0, "BIGINT": 1, "FLOAT": 2, "DOUBLE": 3}


def metric(name: str) -> str:
    """A metric's name in lower case; white space around it and case don't count."""
    m = name.strip().lower()
    if m not in METRICS:
        raise InvalidMetric(f"unknown metric '{name}': it must be one of {', '.join(METRICS)}")
    return m


def vector(dimension: int, how: str = "cosine") -> SqlType:
    return SqlType("VECTOR", dimension, metric(how))


def to_spark(t: SqlType) -> T.DataType:
    return _SPARK[t.kind]


def field(name: str, t: SqlType, nullable: bool = True) -> T.StructField:
    """A column of a stored table; a vector's dimension and metric are in the metadata."""
    meta = {"vector": {"dim": t.dimension, "metric": t.metric}} if t.kind == "VECTOR" else {}
    return T.StructField(name, to_spark(t), nullable, meta)


def from_spark(f: T.StructField) -> SqlType:
    """The dialect's type of a column of any DataFrame; a vector without metadata has dimension 0 (any)."""
    d = f.dataType
    if isinstance(d, (T.ByteType, T.ShortType, T.IntegerType)):
        return INTEGER
    if isinstance(d, T.LongType):
        return BIGINT
    if isinstance(d, T.FloatType):
        return FLOAT
    if isinstance(d, (T.DoubleType, T.DecimalType)):
        return DOUBLE
    if isinstance(d, (T.StringType, T.CharType, T.VarcharType)):
        return TEXT
    if isinstance(d, T.BinaryType):
        return BLOB
    if isinstance(d, T.BooleanType):
        return BOOLEAN
    if isinstance(d, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return TIMESTAMP
    if isinstance(d, T.ArrayType) and isinstance(d.elementType, (T.FloatType, T.DoubleType)):
        v = (f.metadata or {}).get("vector", {})
        return SqlType("VECTOR", v.get("dim", 0), v.get("metric", "cosine"))
    if isinstance(d, T.NullType):
        return NULL
    return SqlType(d.simpleString().upper())


def numeric(t: SqlType) -> bool:
    return t.kind in _WIDTH


def arithmetic(a: SqlType, b: SqlType) -> SqlType:
    """The type of a sum, difference, product or quotient: the wider one; BIGINT with FLOAT is DOUBLE."""
    if a.kind == "NULL" or b.kind == "NULL":
        return b if numeric(b) else a if numeric(a) else NULL
    if not (numeric(a) and numeric(b)):
        raise InvalidOperator(f"arithmetic needs numbers, not {a} and {b}")
    if {a.kind, b.kind} == {"BIGINT", "FLOAT"}:
        return DOUBLE
    return a if _WIDTH[a.kind] >= _WIDTH[b.kind] else b


def comparable(a: SqlType, b: SqlType, ordering: bool = True) -> None:
    """Raises unless the types can be compared: equal ones, numbers, NULL. Vectors have neither order nor equality."""
    if "VECTOR" in (a.kind, b.kind):
        raise InvalidOperator("vectors can't be compared; use vector_similarity or vector_distance")
    if a.kind == "NULL" or b.kind == "NULL" or a.kind == b.kind or (numeric(a) and numeric(b)):
        return
    raise TypeMismatch(f"{a} can't be compared with {b}")


def castable(a: SqlType, b: SqlType) -> bool:
    """Whether a widens to b by itself."""
    if a.kind == "VECTOR" and b.kind == "VECTOR":
        return a.dimension == b.dimension or 0 in (a.dimension, b.dimension)
    if a.kind == b.kind or a.kind == "NULL":
        return True
    return (a.kind, b.kind) in {("INTEGER", "BIGINT"), ("INTEGER", "FLOAT"), ("INTEGER", "DOUBLE"), ("BIGINT", "DOUBLE"), ("FLOAT", "DOUBLE")}


def assignable(a: SqlType, b: SqlType) -> bool:
    """Whether a value of type a may be stored in a column of type b."""
    return castable(a, b) or (a.kind, b.kind) in {("BIGINT", "FLOAT"), ("TEXT", "TIMESTAMP")}


def of_frame(name: str) -> str:
    """The dialect's name of a DataFrame column type, for tables that are created from a DataFrame."""
    return from_spark(T.StructField("c", T._parse_datatype_string(name))).kind
