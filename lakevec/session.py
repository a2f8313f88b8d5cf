"""The engine: scripts of the dialect, frames, the catalog and vector search over one Spark session."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakevec import errors, types
from lakevec.operators import dml
from lakevec.operators.vector_search import search_lsh
from lakevec.plans import ast as A
from lakevec.plans import select
from lakevec.plans.parser import parse
from lakevec.sources.catalog import Catalog, Transaction

#: Options of CREATE TABLE and of an HNSW index, and their bounds (fixed values of the dialect).
STORAGE, COMPRESSION, ROWID = ("row", "columnar"), ("none", "lz4", "zstd"), ("none", "direct")
ROW_GROUP, HNSW_M, MOST_DIMENSIONS = (1_000, 1_000_000), (2, 100), 65_535
RESERVED_INDEX = "__pk_"


@dataclass(frozen=True)
class Result:
    """What a statement gave: rows (a DataFrame), a number of affected rows, or nothing."""

    rows: DataFrame | None = None
    affected: int | None = None


class Engine:
    """Runs scripts of the dialect. Tables are those of the catalog and registered DataFrames, which can only be read."""

    def __init__(self, spark: SparkSession, root: str | None = None, approximate: bool = False):
        """approximate: nearest-neighbour queries without WHERE on a column with an HNSW index take candidates from random projections."""
        self.spark, self.approximate = spark, approximate
        self.catalog = Catalog(spark, root) if root else None
        self._frames: dict[str, DataFrame] = {}
        self._paths: dict[str, str] = {}

    def register(self, name: str, df: DataFrame) -> None:
        """Makes a DataFrame a table that can be queried."""
        self._frames[name] = df

    def register_parquet(self, directory: str, *names: str) -> None:
        """Makes Parquet files of a directory tables; a file's schema is read when it is first queried."""
        self._paths.update({n: f"{directory}/{n}.parquet" for n in names})

    def table(self, name: str) -> DataFrame:
        if name not in self._frames and name in self._paths:
            self._frames[name] = self.spark.read.parquet(self._paths[name])
        if name in self._frames:
            return self._frames[name]
        if self.catalog is None:
            raise errors.TableNotFound(f"there is no table {name}")
        return self.catalog.read(name)

    def sql(self, script: str) -> DataFrame:
        """The rows of a script's last statement, which must be a SELECT; lazily."""
        result = self.execute(script)
        if result.rows is None:
            raise errors.Unsupported("the last statement gives no rows")
        return result.rows

    def execute(self, script: str) -> Result:
        """Runs a script as one transaction and gives the last statement's result. An error undoes all of it."""
        statements = parse(script)
        result = Result()
        changes = any(not isinstance(s, A.Select) for s in statements)
        if changes and self.catalog is not None and self.catalog._txn is None:
            with self.catalog.begin():
                for s in statements:
                    result = self._run(s)
        else:
            for s in statements:
                result = self._run(s)
        return result

    def stream(self, query: str, prefetch: bool = True) -> Iterator[Row]:
        """The rows of a SELECT one after another, partition by partition."""
        return self.sql(query).toLocalIterator(prefetchPartitions=prefetch)

    def with_rows(self, query: str, take: Callable[[Iterator[Row]], object]) -> object:
        """Hands the rows of a SELECT to a function as an iterator."""
        return take(self.stream(query))

    def explain(self, query: str) -> str:
        """Spark's formatted plan of a SELECT."""
        return self.spark._jvm.PythonSQLUtils.explainString(self.sql(query)._jdf.queryExecution(), "formatted")

    def begin(self, read_only: bool = False) -> Transaction:
        """A transaction over several calls."""
        return self._need().begin(read_only)

    def _need(self) -> Catalog:
        if self.catalog is None:
            raise errors.Unsupported("this engine has no catalog: give it a root directory")
        return self.catalog

    def _writable(self, table: str) -> Catalog:
        if table in self._frames or table in self._paths:
            raise errors.ReadOnly(f"{table} is a registered DataFrame")
        catalog = self._need()
        if not catalog.table_exists(table):
            raise errors.TableNotFound(f"there is no table {table}")
        return catalog

    def _run(self, s: A.Statement) -> Result:
        if isinstance(s, A.Select):
            return Result(rows=select.plan(self._candidates(s), s))
        if isinstance(s, A.Insert):
            return Result(affected=dml.insert(self._writable(s.table), s))
        if isinstance(s, A.Update):
            return Result(affected=dml.update(self._writable(s.table), s))
        if isinstance(s, A.Delete):
            return Result(affected=dml.delete(self._writable(s.table), s))
        if isinstance(s, A.CreateTable):
            return self._create_table(s)
        if isinstance(s, A.DropTable):
            self._need().drop_table(s.name, if_exists=s.if_exists)
            return Result()
        if isinstance(s, A.CreateIndex):
            return self._create_index(s)
        if s.name.startswith(RESERVED_INDEX):
            raise errors.InvalidOption(f"{s.name} belongs to a primary key")
        self._need().drop_index(s.name, if_exists=s.if_exists)
        return Result()

    def _candidates(self, s: A.Select) -> DataFrame:
        """The table of a SELECT; for an approximate nearest-neighbour query only rows near the query, which are then scored exactly."""
        df = self.table(s.table)
        knn = select.knn_of(s) if self.approximate else None
        if knn is None or knn.filtered or knn.metric == "inner" or s.table in self._frames or self.catalog is None:
            return df
        key = self.catalog.get_table(s.table)["primary_key"]
        indexes = (self.catalog.get_index(i) for i in self.catalog.list_indexes(s.table))
        if not key or not any(i["method"] == "hnsw" and i["column"] == knn.column for i in indexes):
            return df
        return search_lsh(df, knn.query, knn.metric, 4 * knn.k, key[0], knn.column).drop("score")

    def vector_search(self, table: str, column: str, query: Sequence[float], metric: str, k: int = 10) -> DataFrame:
        """The primary key and score of the k nearest rows of a table with a key, as SQL scores them."""
        key = self._need().get_table(table)["primary_key"]
        if not key:
            raise errors.InvalidOption(f"table {table} has no primary key")
        m = types.metric(metric)
        call = A.Call("vector_similarity", (A.ColumnRef(None, column), A.VectorLiteral(tuple(map(float, query))), A.Literal("string", m)))
        items = (*(A.Item(A.ColumnRef(None, c)) for c in key), A.Item(call, "score"))
        order = (A.OrderKey(call, select.NEAREST[m]), *(A.OrderKey(A.ColumnRef(None, c)) for c in key))
        return select.plan(self.table(table), A.Select(items, table, order=order, limit=k))

    def index_statistics(self, index: str) -> dict[str, object]:
        """An index's table, column, method and options, and the number of rows it covers."""
        entry = self._need().get_index(index)
        return {**entry, "node_count": self.table(entry["table"]).count()}

    def _create_table(self, s: A.CreateTable) -> Result:
        catalog = self._need()
        if s.if_not_exists and catalog.table_exists(s.name):
            return Result()
        names = [c.name for c in s.columns]
        if len(set(names)) < len(names):
            raise errors.AmbiguousColumn(f"table {s.name} has a column twice")
        key = s.primary_key or tuple(c.name for c in s.columns if c.primary_key)
        for k in key:
            if k not in names:
                raise errors.ColumnNotFound(f"there is no column {k} for the primary key")
        for c in s.columns:
            if c.type.kind == "VECTOR" and c.type.dimension > MOST_DIMENSIONS:
                raise errors.InvalidOption(f"a vector has at most {MOST_DIMENSIONS} dimensions")
        schema = T.StructType([types.field(c.name, c.type, not (c.not_null or c.name in key)) for c in s.columns])
        catalog.create_table(s.name, schema, primary_key=key, options=table_options(s.options))
        if key:
            catalog.create_index(f"{RESERVED_INDEX}{s.name}", s.name, key[0], options={"columns": list(key), "unique": True})
        return Result()

    def _create_index(self, s: A.CreateIndex) -> Result:
        catalog = self._need()
        if s.name.startswith(RESERVED_INDEX):
            raise errors.InvalidOption(f"index names can't begin with {RESERVED_INDEX}")
        schema = catalog.schema(s.table)
        f = next((f for f in schema if f.name == s.column), None)
        if f is None:
            raise errors.ColumnNotFound(f"there is no column {s.column} in {s.table}")
        options = index_options(s.method, s.options)
        if s.method == "hnsw":
            if types.from_spark(f).kind != "VECTOR":
                raise errors.TypeMismatch(f"an HNSW index needs a VECTOR column, {s.column} is {types.from_spark(f)}")
            if not catalog.read(s.table).filter(F.col(f"`{s.column}`").isNull()).isEmpty():
                raise errors.NullViolation(f"column {s.column} has NULL and can't get an HNSW index")
        catalog.create_index(s.name, s.table, s.column, s.method, options, if_not_exists=s.if_not_exists)
        return Result()


def _unique(options: tuple[tuple[str, str], ...], known: tuple[str, ...]) -> dict[str, str]:
    out: dict[str, str] = {}
    for k, v in options:
        if k not in known:
            raise errors.InvalidOption(f"unknown option {k}")
        if k in out:
            raise errors.InvalidOption(f"option {k} is given twice")
        out[k] = v.strip()
    return out


def _number(options: dict[str, str], name: str, low: int, high: int | None = None) -> None:
    if name in options:
        if not options[name].isdigit() or int(options[name]) < low or (high is not None and int(options[name]) > high):
            raise errors.InvalidOption(f"{name} must be a number from {low}" + (f" to {high}" if high is not None else ""))


def table_options(options: tuple[tuple[str, str], ...]) -> dict[str, str]:
    """The checked options of CREATE TABLE with their defaults; compression is the Parquet codec, storage only a hint."""
    out = _unique(options, ("storage", "compression", "row_group_size", "rowid_mode"))
    for name, allowed in (("storage", STORAGE), ("compression", COMPRESSION), ("rowid_mode", ROWID)):
        if name in out:
            out[name] = out[name].lower()
            if out[name] not in allowed:
                raise errors.InvalidOption(f"{name} must be one of {', '.join(allowed)}")
    _number(out, "row_group_size", *ROW_GROUP)
    return {"storage": "row", "compression": "lz4", "row_group_size": "100000", "rowid_mode": "direct"} | out


def index_options(method: str, options: tuple[tuple[str, str], ...]) -> dict[str, str]:
    """The checked options of CREATE INDEX; of an HNSW index m (default 16) and ef_construction (default 200, at least m)."""
    if method != "hnsw":
        return _unique(options, ())
    out = _unique(options, ("m", "ef_construction"))
    _number(out, "m", *HNSW_M)
    m = int(out.get("m", 16))
    _number(out, "ef_construction", m)
    return {"m": str(m), "ef_construction": out.get("ef_construction", "200")}
