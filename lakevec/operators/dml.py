"""INSERT, UPDATE and DELETE as copy-on-write table versions, with their constraints."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakevec import errors, types
from lakevec.plans import ast as A
from lakevec.plans.analyzer import Scope, analyze, predicate, store
from lakevec.sources.catalog import Catalog


def check_not_null(rows: DataFrame, schema: T.StructType) -> None:
    """Raises NullViolation if a column that can't be NULL is."""
    needed = [f.name for f in schema if not f.nullable]
    if needed:
        bad = rows.select(*(F.max(F.col(f"`{n}`").isNull()).alias(n) for n in needed)).first()
        for n in needed:
            if bad is not None and bad[n]:
                raise errors.NullViolation(f"column {n} can't be NULL")


def check_dimensions(rows: DataFrame, schema: T.StructType) -> None:
    """Raises DimensionMismatch if a vector doesn't have its column's dimension or has an element that is null."""
    for f in schema:
        t = types.from_spark(f)
        if t.kind == "VECTOR" and t.dimension:
            c = F.col(f"`{f.name}`")
            if not rows.filter(c.isNotNull() & ((F.size(c) != t.dimension) | F.exists(c, lambda x: x.isNull()))).isEmpty():
                raise errors.DimensionMismatch(f"column {f.name} has dimension {t.dimension}")


def check_unique(rows: DataFrame, key: Sequence[str], existing: DataFrame | None = None) -> None:
    """Raises ConstraintViolation if a key occurs twice in rows, or in rows and existing. Keys with a null are free."""
    if not key:
        return
    full = reduce(lambda a, b: a & b, (F.col(f"`{k}`").isNotNull() for k in key))
    keyed = rows.filter(full).select(*key)
    twice = keyed.groupBy(*key).count().filter("count > 1")
    if not twice.isEmpty() or (existing is not None and not existing.select(*key).join(keyed, list(key), "left_semi").isEmpty()):
        raise errors.ConstraintViolation(f"the primary key ({', '.join(key)}) isn't unique")


def insert_rows(catalog: Catalog, table: str, rows: DataFrame) -> int:
    """Appends rows that have the table's schema, after all checks; the number of rows."""
    entry, schema = catalog.get_table(table), catalog.schema(table)
    # each value is computed once for the checks and the write
    rows = rows.persist()
    try:
        n = rows.count()
        check_not_null(rows, schema)
        check_dimensions(rows, schema)
        check_unique(rows, entry["primary_key"], catalog.read(table) if entry["paths"] else None)
        if n:
            catalog.append(table, rows)
        return n
    finally:
        rows.unpersist()


def insert(catalog: Catalog, s: A.Insert) -> int:
    """INSERT … VALUES. Every column needs a value; defaults aren't filled in. Expressions see no columns."""
    schema = catalog.schema(s.table)
    columns = list(s.columns) if s.columns is not None else schema.names
    for c in columns:
        if c not in schema.names:
            raise errors.ColumnNotFound(f"there is no column {c} in {s.table}")
    if len(set(columns)) < len(columns):
        raise errors.AmbiguousColumn("a column is given twice")
    missing = [n for n in schema.names if n not in columns]
    if missing:
        raise errors.ColumnCountMismatch(f"column {missing[0]} needs a value")
    scope = Scope(T.StructType([]), ())
    rows = []
    for values in s.rows:
        if len(values) != len(columns):
            raise errors.ColumnCountMismatch(f"{len(columns)} columns, {len(values)} values")
        by_name = {c: store(analyze(v, scope), schema[c], getattr(v, "at", None)) for c, v in zip(columns, values)}
        rows.append(F.struct(*(by_name[n].alias(n) for n in schema.names)))
    one = catalog.spark.range(1, numPartitions=1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return insert_rows(catalog, s.table, _as(one, schema))


def _as(rows: DataFrame, schema: T.StructType) -> DataFrame:
    return rows.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema))


def _touched(rows: DataFrame, hit: Column) -> tuple[list[str], int]:
    """Files with rows that hit, and the number of these rows. Only metadata comes to the driver, a row a file."""
    found = rows.withColumn("__lv_file", F.col("_metadata.file_path")).filter(hit).groupBy("__lv_file").agg(F.count(F.lit(1)).alias("n")).collect()
    return [unquote(r["__lv_file"]) for r in found], sum(r["n"] for r in found)


def _rewrite(catalog: Catalog, table: str, files: Sequence[str], new: DataFrame) -> None:
    """Replaces files of a table by a new version of their rows; all other files stay as they are."""
    entry = catalog.get_table(table)
    catalog.set_paths(table, [*catalog.other_files(entry["paths"], files), catalog.write_rows(entry, new)])


def delete(catalog: Catalog, s: A.Delete) -> int:
    """DELETE; rows whose condition is NULL stay. Only files with rows to delete are written again."""
    rows = catalog.read(s.table)
    hit = F.coalesce(predicate(s.where, Scope(rows.schema, (s.table,))), F.lit(False)) if s.where is not None else F.lit(True)
    if not catalog.get_table(s.table)["paths"]:
        return 0
    files, n = _touched(rows, hit)
    if n:
        reader = catalog.spark.read.schema(rows.schema)
        _rewrite(catalog, s.table, files, reader.parquet(*files).filter(~hit))
    return n


def update(catalog: Catalog, s: A.Update) -> int:
    """UPDATE; values see the old row. Rows that don't change aren't counted, and files without changes aren't written again."""
    rows, schema, entry = catalog.read(s.table), catalog.schema(s.table), catalog.get_table(s.table)
    scope = Scope(schema, (s.table,))
    new: dict[str, Column] = {}
    for c, e in s.assignments:
        if c not in schema.names:
            raise errors.ColumnNotFound(f"there is no column {c} in {s.table}")
        if c in new:
            raise errors.AmbiguousColumn(f"column {c} is set twice")
        new[c] = store(analyze(e, scope), schema[c], getattr(e, "at", None))
    where = F.coalesce(predicate(s.where, scope), F.lit(False)) if s.where is not None else F.lit(True)
    if not entry["paths"]:
        return 0
    changed = reduce(lambda a, b: a | b, (~F.col(f"`{c}`").eqNullSafe(v) for c, v in new.items()))
    files, n = _touched(rows, where & changed)
    if not n:
        return 0
    old = catalog.spark.read.schema(schema).parquet(*files)
    updated = old.select(*(F.when(where, new[f.name]).otherwise(F.col(f"`{f.name}`")).alias(f.name) if f.name in new else F.col(f"`{f.name}`") for f in schema))
    checked = T.StructType([f for f in schema if f.name in new])
    check_not_null(updated, checked)
    check_dimensions(updated, checked)
    _rewrite(catalog, s.table, files, updated)
    if set(entry["primary_key"]) & set(new):
        check_unique(catalog.read(s.table), entry["primary_key"])
    return n
