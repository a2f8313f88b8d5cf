"""Columnar segments: sets of rows in Parquet files with stable row ids."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from lakevec import errors
from lakevec.sources.files import Files

#: Bits of a row id that hold the place in the segment (fixed value of the format).
OFFSET_BITS = 44


def encode_row_id(segment: Column | str, offset: Column | str) -> Column:
    """A row's id from its segment (20 bits) and place (44 bits)."""
    return F.shiftleft(F.col(segment).cast("long") if isinstance(segment, str) else segment.cast("long"), OFFSET_BITS).bitwiseOR((F.col(offset) if isinstance(offset, str) else offset).cast("long"))


def decode_row_id(row_id: Column | str) -> tuple[Column, Column]:
    """Segment and place of a row id."""
    c = F.col(row_id) if isinstance(row_id, str) else row_id
    return F.shiftrightunsigned(c, OFFSET_BITS).alias("segment"), c.bitwiseAND(F.lit((1 << OFFSET_BITS) - 1)).alias("offset")


class SegmentStore:
    """Segments of tables under a directory: one numbered directory of Parquet files each."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)

    def _path(self, table: str, segment: int) -> str:
        return f"{self.root}/{table}/segment={segment}"

    def list(self, table: str | None = None) -> list[tuple[str, int]]:
        """Tables and numbers of all segments."""
        tables = [table] if table else self.files.names(self.root)
        return sorted((t, int(n[8:])) for t in tables for n in self.files.names(f"{self.root}/{t}") if n.startswith("segment="))

    def write(self, table: str, rows: DataFrame, compression: str = "zstd", row_group_size: int | None = None, bloom: Sequence[str] = ()) -> int:
        """Writes rows as a new segment and gives its number; the columns of bloom get bloom filters in the files."""
        if not rows.columns:
            raise errors.SchemaMismatch("a segment needs a column")
        segment = max((n for _, n in self.list(table)), default=-1) + 1
        writer = rows.write.option("compression", compression)
        if row_group_size is not None:
            writer = writer.option("parquet.block.row.count.limit", row_group_size)
        for c in bloom:
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
        writer.parquet(self._path(table, segment))
        return segment

    def ingest(self, table: str, path: str, form: str = "parquet", delimiter: str = ",", header: bool = True, compression: str = "lz4", row_group_size: int | None = None) -> int:
        """Writes a CSV or Parquet file as a new segment."""
        if form == "csv":
            rows = self.spark.read.options(sep=delimiter, header=header, inferSchema=True, mode="FAILFAST").csv(path)
        elif form in ("parquet", "pq"):
            rows = self.spark.read.parquet(path)
        else:
            raise errors.InvalidOption(f"unknown format {form}")
        return self.write(table, rows, compression, row_group_size)

    def read(self, table: str, segment: int, columns: Sequence[str] | None = None, where: Column | None = None) -> DataFrame:
        """A segment's rows; columns and condition reach the files."""
        if not self.files.exists(self._path(table, segment)):
            raise errors.TableNotFound(f"table {table} has no segment {segment}")
        df = self.spark.read.parquet(self._path(table, segment))
        for c in columns or []:
            if c not in df.columns:
                raise errors.ColumnNotFound(f"there is no column {c}")
        if where is not None:
            df = df.filter(where)
        return df.select(*columns) if columns else df

    def _offsets(self, table: str) -> DataFrame:
        """For every file of a table's segments the number of rows in the files before it in its segment: one row a file, from the footers."""
        files = [f for _, n in self.list(table) for f in self.files.parquet_files(self._path(table, n))]
        rows = self.spark.read.parquet(*files).select(F.col("_metadata.file_path").alias("file")).groupBy("file").agg(F.count(F.lit(1)).alias("n")) if files else None
        if rows is None:
            return self.spark.createDataFrame([], "of string, before long")
        in_segment = Window.partitionBy(F.regexp_extract("file", r"/segment=(\d+)/", 1)).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
        return rows.select(F.col("file").alias("of"), F.coalesce(F.sum("n").over(in_segment), F.lit(0)).alias("before"))

    def scan(self, table: str, columns: Sequence[str] | None = None, where: Column | None = None, row_ids: bool = False) -> DataFrame:
        """The rows of all segments, with their row ids if asked for: segment and place, counted through the segment's files in order of name."""
        df = self.spark.read.option("basePath", f"{self.root}/{table}").parquet(f"{self.root}/{table}")
        names = [c for c in (columns or df.columns) if c != "segment"]
        if row_ids:
            placed = df.withColumns({"__lv_file": F.col("_metadata.file_path"), "__lv_at": F.col("_metadata.row_index")})
            # a row a file: metadata
            df = placed.join(F.broadcast(self._offsets(table)), F.col("__lv_file") == F.col("of")).withColumn("row_id", encode_row_id("segment", F.col("before") + F.col("__lv_at")))
        if where is not None:
            df = df.filter(where)
        return df.select(*names, *(["row_id"] if row_ids else []))

    def batches(self, table: str, segment: int) -> Iterator[Row]:
        """A segment's rows one after another, partition by partition."""
        return self.read(table, segment).toLocalIterator(prefetchPartitions=True)

    def statistics(self, table: str, segment: int) -> dict[str, int]:
        """Rows, columns and bytes of a segment."""
        df = self.read(table, segment)
        return {"row_count": df.count(), "column_count": len(df.columns), "size_bytes": self.files.size(self._path(table, segment))}

    def drop(self, table: str, segment: int) -> None:
        self.files.delete(self._path(table, segment))


    def search(self, table: str, vector: str, query: Sequence[float], metric: str, k: int, columns: Sequence[str] | None = None) -> DataFrame:
        """The k rows that score highest, with score and row_id, equal scores in order of row_id: late materialisation.

        The first scan reads the vectors and row ids only; the other columns are fetched for the k rows found.
        """
        from lakevec.operators.vector_search import search_flat

        best = search_flat(self.scan(table, [vector], row_ids=True), query, metric, k, "row_id", vector).select("row_id", "score")
        return fetch_by_row_id(self.scan(table, columns, row_ids=True), best)


def fetch_by_row_id(df: DataFrame, row_ids: DataFrame, row_id: str = "row_id") -> DataFrame:
    """The wide rows of a few row ids, with the other columns of row_ids, by a join that broadcasts these where they are few."""
    return df.join(row_ids, row_id)
