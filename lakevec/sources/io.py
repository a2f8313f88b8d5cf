"""CSV and Parquet files as frames, bulk loading into tables, and results as text."""

from __future__ import annotations

import os
from collections.abc import Sequence
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakevec import errors, types
from lakevec.operators import dml
from lakevec.plans.frame import Expr, Frame, LazyFrame
from lakevec.sources.catalog import Catalog


@dataclass(frozen=True)
class CsvOptions:
    """How a CSV file is read. infer_schema_length rows give the types; quote None means that nothing is quoted."""

    has_header: bool = True
    delimiter: str = ","
    quote: str | None = '"'
    null_values: Sequence[str] = field(default_factory=tuple)
    infer_schema_length: int | None = 100
    projection: Sequence[str] | None = None
    predicate: Expr | None = None

    def check(self) -> None:
        for name, value in (("delimiter", self.delimiter), ("quote", self.quote)):
            if value is not None and (len(value) != 1 or value == "\0"):
                raise errors.InvalidOption(f"{name} must be one character other than NUL")


@dataclass(frozen=True)
class ParquetOptions:
    """How Parquet files are read. Row groups are chosen by predicate, not by number."""

    columns: Sequence[str] | None = None
    predicate: Expr | None = None
    row_groups: Sequence[int] | None = None


def _pick(df: DataFrame, columns: Sequence[str] | None, predicate: Expr | None) -> LazyFrame:
    lazy = LazyFrame(df)
    if predicate is not None:
        lazy = lazy.filter(predicate)
    return lazy if columns is None else lazy.select(*columns)


def scan_csv(spark: SparkSession, path: str, options: CsvOptions | None = None) -> LazyFrame:
    """A CSV file or directory as a lazy frame. Types are inferred from the first rows, which alone come to the driver."""
    o = options or CsvOptions()
    o.check()
    settings = {"header": str(o.has_header).lower(), "sep": o.delimiter, "quote": o.quote or "", "enforceSchema": "true", "mode": "FAILFAST"}
    reader = spark.read.options(**settings)
    if o.infer_schema_length is None:
        schema = reader.option("inferSchema", "true").csv(path).schema
    else:
        head = [r[0] for r in spark.read.text(path).limit(o.infer_schema_length + o.has_header).collect()]
        lines = spark.sparkContext.parallelize(head, 1) if head else None
        schema = reader.option("inferSchema", "true").csv(lines).schema if lines is not None else T.StructType([])
    if not o.has_header:
        schema = T.StructType([T.StructField(f"column_{i + 1}", f.dataType) for i, f in enumerate(schema)])
    if o.null_values:
        text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
        df = reader.schema(text).csv(path)
        nulls = list(o.null_values)
        df = df.select(*(F.when(~F.col(f"`{f.name}`").isin(nulls), F.col(f"`{f.name}`")).cast(_without_nulls(head if o.infer_schema_length is not None else [], o, i, f)).alias(f.name) for i, f in enumerate(schema)))
    else:
        df = reader.schema(schema).csv(path)
    return _pick(df, o.projection, o.predicate)


def _without_nulls(head: Sequence[str], o: CsvOptions, i: int, f: T.StructField) -> T.DataType:
    """The type of a column once the values that stand for null are left out."""
    if not isinstance(f.dataType, T.StringType):
        return f.dataType
    values = [c[i] for c in (line.split(o.delimiter) for line in head[o.has_header :]) if len(c) > i]
    values = [v.strip(o.quote or "") for v in values if v not in o.null_values]
    for kind, parse in ((T.IntegerType(), int), (T.DoubleType(), float)):
        try:
            if values and all(parse(v) is not None for v in values):
                return kind
        except ValueError:
            pass
    return f.dataType


def read_csv(spark: SparkSession, path: str, options: CsvOptions | None = None) -> Frame:
    return scan_csv(spark, path, options).collect()


def write_csv(frame: Frame | DataFrame, path: str) -> None:
    """Writes CSV files with a header into a directory."""
    df = frame.df if isinstance(frame, Frame) else frame
    df.write.csv(path, header=True)


def scan_parquet(spark: SparkSession, path: str, options: ParquetOptions | None = None) -> LazyFrame:
    """Parquet files as a lazy frame; predicate and columns reach the files."""
    o = options or ParquetOptions()
    if o.row_groups is not None:
        raise errors.Unsupported("row groups can't be chosen by number: give a predicate")
    return _pick(spark.read.parquet(path), o.columns, o.predicate)


def read_parquet(spark: SparkSession, path: str, options: ParquetOptions | None = None) -> Frame:
    return scan_parquet(spark, path, options).collect()


def write_parquet(frame: Frame | DataFrame, path: str, compression: str = "snappy") -> None:
    df = frame.df if isinstance(frame, Frame) else frame
    df.write.option("compression", compression).parquet(path)


def check_path(path: str, allowed: Sequence[str] | None) -> str:
    """A local path for COPY: it exists, isn't a link, can be read, and lies in an allowed directory if any are given."""
    p = Path(path)
    if not p.exists():
        raise errors.PathNotAllowed(f"there is no file {path}")
    if allowed is not None and not any(p.resolve().is_relative_to(Path(a).resolve()) for a in allowed):
        raise errors.PathNotAllowed(f"{path} isn't in an allowed directory")
    if p.is_symlink():
        raise errors.PathNotAllowed(f"{path} is a link")
    if not (p.is_file() or p.is_dir()) or not os.access(p, os.R_OK):
        raise errors.PathNotAllowed(f"{path} can't be read")
    return str(p)


def data_files(directory: str) -> list[str]:
    """The data files in a local directory, by name."""
    return sorted(str(p) for p in Path(directory).iterdir() if p.is_file() and not p.name.startswith(("_", ".")))


def _parsed(text: Column, t: types.SqlType) -> Column:
    """A value of a bulk-loaded line: null in any case is NULL, timestamps are microseconds, vectors stand in brackets."""
    v = F.trim(text)
    if t.kind == "BOOLEAN":
        low = F.lower(v)
        out = F.when(low.isin("true", "1"), True).when(low.isin("false", "0"), False).otherwise(F.raise_error(F.concat(F.lit("not a BOOLEAN: "), v)).cast("boolean"))
    elif t.kind == "TIMESTAMP":
        out = F.timestamp_micros(v.cast("long")).cast("timestamp_ntz")
    elif t.kind == "VECTOR":
        numbers = F.transform(F.split(F.regexp_replace(v, r"^\[|\]$", ""), ","), lambda x: F.trim(x).cast("float"))
        wrong = F.raise_error(F.concat(F.lit(f"not a vector of dimension {t.dimension}: "), v)).cast("array<float>")
        out = F.when((F.size(numbers) == t.dimension) | F.lit(t.dimension == 0), numbers).otherwise(wrong)
    elif t.kind == "BLOB":
        out = F.encode(v, "UTF-8")
    else:
        out = v.cast(types.to_spark(t))
    return F.when(F.lower(v) != "null", out)


def _lines(spark: SparkSession, path: str, schema: T.StructType, header: bool) -> DataFrame:
    """Lines of a plain CSV file, nothing quoted: fields are trimmed, blank lines skipped, a last vector may have commas."""
    n = len(schema)
    vector_last = bool(n) and types.from_spark(schema[-1]).kind == "VECTOR"
    lines = spark.read.text(path).filter(F.trim("value") != "")
    if header:
        names = lines.first()
        found = [x.strip() for x in names[0].split(",")] if names else []
        if names and found != schema.names:
            raise errors.SchemaMismatch(f"the header has {found}, the table {schema.names}")
        # the first line of each file that isn't blank, found where its file begins; equal lines further on are data
        where = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))
        where = where.filter(F.trim("value") != "")
        first = where.groupBy("file").agg(F.min(F.struct("block", "place")).alias("at")).select(F.col("file").alias("of"), "at.block", "at.place")
        head = F.broadcast(first.withColumnsRenamed({"block": "at_block", "place": "at_place"}))  # a row a file
        same = (F.col("file") == F.col("of")) & (F.col("block") == F.col("at_block")) & (F.col("place") == F.col("at_place"))
        lines = where.join(head, same, "left_anti").select("value")
    parts = F.split("value", ",", n if vector_last else -1)
    checked = F.when(F.size(parts) == n, parts).otherwise(F.raise_error(F.concat(F.lit(f"a line hasn't {n} fields: "), F.col("value"))).cast("array<string>"))
    cells = lines.select(checked.alias("p"))
    return cells.select(*(_parsed(F.col("p")[i], types.from_spark(f)).cast(f.dataType).alias(f.name) for i, f in enumerate(schema)))


def copy_into(catalog: Catalog, table: str, path: str, file_format: str = "csv", header: bool = True, allowed: Sequence[str] | None = None) -> int:
    """Bulk-loads a CSV or Parquet file into a table with all its constraints; the number of rows.

    Columns go by place, and where the file names them the names must be equal. Parquet columns may widen.
    """
    path = check_path(path, allowed)
    schema = catalog.schema(table)
    if file_format == "csv":
        rows = _lines(catalog.spark, path, schema, header)
    elif file_format == "parquet":
        rows = catalog.spark.read.parquet(path)
        if len(rows.columns) != len(schema):
            raise errors.ColumnCountMismatch(f"the file has {len(rows.columns)} columns, the table {len(schema)}")
        for mine, theirs in zip(schema, rows.schema):
            if mine.name != theirs.name:
                raise errors.SchemaMismatch(f"column {theirs.name} should be {mine.name}")
            if not types.castable(types.from_spark(theirs), types.from_spark(mine)):
                raise errors.TypeMismatch(f"column {mine.name}: {types.from_spark(theirs)} doesn't widen to {types.from_spark(mine)}")
        rows = rows.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema))
    else:
        raise errors.InvalidOption(f"unknown format {file_format}")
    if catalog._txn:
        return dml.insert_rows(catalog, table, rows)
    with catalog.begin():
        return dml.insert_rows(catalog, table, rows)


FORMATS = ("table", "json", "jsonl", "csv", "tsv")


def render(df: DataFrame, form: str = "table", limit: int | None = None) -> str:
    """Rows as text: a table, a JSON array, JSON lines, CSV or TSV. They come to the driver one partition at a time."""
    import csv
    import io
    import json

    if form not in FORMATS:
        raise errors.InvalidOption(f"unknown format {form}: it must be one of {', '.join(FORMATS)}")
    rows = (df if limit is None else df.limit(limit)).toLocalIterator()
    names = df.columns
    if form in ("json", "jsonl"):
        lines = [json.dumps(dict(zip(names, r)), default=str, ensure_ascii=False) for r in rows]
        return "[" + ",\n ".join(lines) + "]\n" if form == "json" else "".join(x + "\n" for x in lines)
    text = [["" if v is None else "true" if v is True else "false" if v is False else str(v) for v in r] for r in rows]
    if form == "tsv":
        clean = lambda v: v.replace("\\", "\\\\").replace("\t", "\\t").replace("\n", "\\n").replace("\r", "\\r")
        return "".join("\t".join(map(clean, r)) + "\n" for r in [names, *text])
    if form == "csv":
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerows([names, *text])
        return out.getvalue()
    width = [max(map(len, c)) for c in zip(names, *text)] if text else list(map(len, names))
    rule = "+" + "+".join("-" * (w + 2) for w in width) + "+\n"
    line = lambda r: "|" + "|".join(f" {v:<{w}} " for v, w in zip(r, width)) + "|\n"
    return rule + line(names) + rule + "".join(map(line, text)) + rule
