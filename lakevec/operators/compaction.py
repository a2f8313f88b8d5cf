"""Consolidating many small files into few well-sized ones along a Hilbert curve."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakevec import runtime

#: Bits of a dimension in a code, so that a group has at most 2 ** (BITS * dimensions) codes.
BITS = 6
#: Parts into which the rows of one code are hashed, so that a code holding most rows is split.
SALTS = 16
#: Bytes of a new file at most, about, and from which on the rows are spread over all tasks instead of fewer files.
TARGET_BYTES, LEAST_BYTES = 128 << 20, 128 << 10
#: Cells of groups over which running totals are kept in one small table.
CELLS = 1024


class CompactionError(RuntimeError):
    """Source and destination differ."""


def hilbert_codes(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of points with integer coordinates below 2 ** bits, one row per point.

    Coordinates are turned into the transposed Hilbert index by undoing excess work from the highest bit
    down, then Gray coding, and the bits are interleaved.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = top
    while q > 1:
        flip ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    code = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            code = (code << 1) | ((x[i] >> b) & 1)
    return code


def _sortable(values: pd.Series, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Values that order as Spark orders them, and which of them are present."""
    there = values.notna().to_numpy()
    if kind == "bytes":
        out = np.array([(v.encode() if isinstance(v, str) else bytes(v)) if ok else b"" for v, ok in zip(values, there)], dtype=object)
    else:
        out = pd.to_numeric(values.where(there, 0)).to_numpy(dtype=np.float64)
    return out, there


def _plain(c: str, kind: T.DataType) -> tuple[Column, str]:
    """A dimension as a string or a number."""
    col = F.col(f"`{c}`")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return col, "bytes"
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(col.cast("timestamp")).cast("double"), "number"
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(col).cast("double"), "number"
    if isinstance(kind, T.DateType):
        return F.unix_date(col).cast("double"), "number"
    return F.nanvl(col.cast("double"), F.lit(None)), "number"


def _edges(values: DataFrame, bits: int) -> list[list]:
    """For each column of values the 2 ** bits - 1 quantiles of all its present values, exactly: those at the places k * n >> bits in order.

    Equal values are counted before they are sorted, all columns in one pass; the driver gets a number of values for each task and column, and the quantiles.
    A column without a present value has none.
    """
    spark, names = values.sparkSession, values.columns
    # in the runs of a column the other columns are null, and its own where it isn't present
    of = F.coalesce(*(F.when(F.col(c).isNotNull(), F.lit(i)) for i, c in enumerate(names)))
    runs = values.groupingSets([[c] for c in names], *names).agg(F.count(F.lit(1)).alias("n")).withColumn("dim", of).filter("dim IS NOT NULL")
    runs = runtime.written(runs.repartitionByRange(runtime.width(spark), "dim", *names).withColumn("part", F.spark_partition_id()), "runs")
    starts, total = [], [0] * len(names)
    for r in runs.groupBy("dim", "part").agg(F.sum("n").alias("m")).orderBy("dim", "part").collect():
        starts.append((r["dim"], r["part"], total[r["dim"]]))
        total[r["dim"]] += r["m"]
    if not starts:
        return [[] for _ in names]
    offsets = spark.createDataFrame([(*s, total[s[0]]) for s in starts], "dim int, part int, first long, total long")
    in_part = Window.partitionBy("dim", "part").orderBy(*names).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = runs.withColumn("upto", F.sum("n").over(in_part)).join(F.broadcast(offsets), ["dim", "part"]).withColumn("upto", F.col("first") + F.col("upto"))
    # the places below a number of values
    below = lambda count: f"greatest(({count}) * {1 << bits} - 1, 0) div total"
    marked = end.withColumn("times", F.expr(f"{below('upto')} - {below('upto - n')}")).filter("times > 0")
    edges: list[list] = [[] for _ in names]
    for r in marked.orderBy("dim", "upto").collect():
        edges[r["dim"]] += [r[names[r["dim"]]]] * r["times"]
    runtime.forget(runs)
    return edges


def with_codes(rows: DataFrame, dimensions: Sequence[str], out: str, bits: int = BITS) -> DataFrame:
    """rows with their Hilbert code in the column out.

    Each dimension is cut into 2 ** bits cells at the quantiles of all rows. A null or NaN falls into the first cell. With no rows there are no edges and every code is 0.
    """
    runtime.ship(rows.sparkSession)
    types = {f.name: f.dataType for f in rows.schema}
    plain = [_plain(c, types[c]) for c in dimensions]
    found = _edges(rows.select(*(c.alias(f"d{i}") for i, (c, _) in enumerate(plain))), bits)
    edges = [_sortable(pd.Series(e, dtype=object), kind)[0] for e, (_, kind) in zip(found, plain)]
    kinds = [k for _, k in plain]

    def codes(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for part in parts:
            part = part if isinstance(part, tuple) else (part,)  # one column comes as it is
            cells = np.zeros((len(part[0]), len(part)), dtype=np.int64)
            for i, s in enumerate(part):
                v, there = _sortable(s, kinds[i])
                if len(edges[i]):
                    cells[:, i] = np.where(there, np.searchsorted(edges[i], v, side="right"), 0)
            yield pd.Series(hilbert_codes(cells, bits))

    return rows.withColumn(out, F.pandas_udf(codes, "long")(*(c for c, _ in plain)))


def digest(rows: DataFrame, group: str, columns: Sequence[str], prefix: str = "") -> DataFrame:
    """Number and order-free digest of the rows of each group: exclusive or and sum of 64-bit row hashes."""
    h = F.xxhash64(*(F.col(f"`{c}`") for c in columns))
    return rows.groupBy(group).agg(
        F.count(F.lit(1)).alias(f"{prefix}rows"),
        F.bit_xor(h).alias(f"{prefix}xor"),
        F.sum(h.bitwiseAND(F.lit(0xFFFFFF))).alias(f"{prefix}sum"),
    )


@dataclass
class Compaction:
    """A finished consolidation: the written table, its number of files and the verified digests by group."""

    path: str
    files: int
    rows: DataFrame
    digests: DataFrame


def _bytes(rows: DataFrame) -> Column:
    """About the bytes of a row: those of its strings, and 8 for each other value."""
    parts = [F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) + 4 if isinstance(f.dataType, (T.StringType, T.BinaryType)) else F.lit(8) for f in rows.schema]
    total = F.lit(0).cast("long")
    for p in parts:
        total = total + p
    return total


def planned_files(total_bytes: int, tasks: int, target_bytes: int = TARGET_BYTES) -> int:
    """Number of new files: none larger than target_bytes, and one for each task as long as they don't get smaller than LEAST_BYTES."""
    return max(1, -(-total_bytes // target_bytes), min(tasks, total_bytes // LEAST_BYTES))


def compact(rows: DataFrame, group: str, dimensions: Sequence[str], row_id: str, path: str, target_bytes: int = TARGET_BYTES, source: DataFrame | None = None, check: str | None = None) -> Compaction:
    """Writes rows to path in files of nearly equal size in bytes, ordered by group and Hilbert code, and verifies them.

    An exact histogram of the rows and their bytes by group, code and salt gives every row's place in the order and so its file: file
    f holds the places, in bytes, from f * size on. The range shuffle follows these cuts, not a sample, and one task
    writes one file. A hot group or code spans as many files as its rows need, since the rows of one code
    are spread by the hash of row_id. Each row is written once; afterwards number and digest of every group are compared
    between source and destination, and a difference raises CompactionError. source: where the rows come from, compared by the
    groups of check in its own columns; by default rows by group. Rows with a null group form a
    group. Repeated rows are rows. No rows: an empty table.
    """
    spark = rows.sparkSession
    columns = rows.columns
    clash = {c.lower() for c in columns}

    def own(name: str) -> str:
        while name.lower() in clash:
            name += "_"
        clash.add(name.lower())
        return name

    code, salt, cell, n, before, first, file, wide = map(own, ("lv_code", "lv_salt", "lv_cell", "lv_n", "lv_before", "lv_first", "lv_file", "lv_bytes"))
    u_group, u_code, u_salt = map(own, ("lv_u_group", "lv_u_code", "lv_u_salt"))
    spread = F.xxhash64(F.col(f"`{row_id}`"))
    coded = runtime.written(
        with_codes(rows, dimensions, code).withColumn(wide, _bytes(rows)).withColumn(salt, F.pmod(spread, F.lit(SALTS)).cast("int")).withColumn(cell, F.pmod(F.xxhash64(F.lit("cell"), F.col(group)), F.lit(CELLS)).cast("int")),
        "coded",
    )
    units = coded.groupBy(cell, group, code, salt).agg(F.sum(wide).alias(n))
    in_cell = Window.partitionBy(cell).orderBy(group, code, salt).rowsBetween(Window.unboundedPreceding, -1)
    units = units.withColumn(before, F.coalesce(F.sum(n).over(in_cell), F.lit(0)))
    # at most CELLS rows: a fixed bound
    cells = units.groupBy(cell).agg(F.sum(n).alias("m")).orderBy(cell).collect()
    total = sum(r["m"] for r in cells)
    files = planned_files(total, runtime.width(spark), target_bytes)
    size = max(1, -(-total // files))
    starts, at = [], 0
    for r in cells:
        starts.append((r[cell], at))
        at += r["m"]
    offsets = spark.createDataFrame(starts, f"`{cell}` int, `{first}` long")
    placed = units.join(F.broadcast(offsets), cell).select(
        F.col(group).alias(u_group), F.col(code).alias(u_code), F.col(salt).alias(u_salt), F.col(n), (F.col(first) + F.col(before)).alias(before)
    )
    spot = F.pmod(F.xxhash64(F.lit("place"), F.col(f"`{row_id}`")), F.col(n))
    sorted_into = (
        coded.join(placed, F.col(group).eqNullSafe(F.col(u_group)) & (F.col(code) == F.col(u_code)) & (F.col(salt) == F.col(u_salt)))
        .withColumn(file, F.floor((F.col(before) + spot) / F.lit(float(size))).cast("int"))
        .select(*columns, code, cell, file)
        .repartitionById(files, file)
        .sortWithinPartitions(cell, group, code)
    )
    sorted_into.drop(code, cell, file).write.parquet(path)
    back = spark.read.schema(rows.schema).parquet(path)
    source, by = (rows, group) if source is None else (source, check or group)
    # the group may have been given to the rows on their way
    same = [c for c in source.columns if by == group or c.lower() != group.lower()]
    both = digest(source, by, same).join(
        digest(back, by, same, "new_").withColumnRenamed(by, "new_group"), F.col(by).eqNullSafe(F.col("new_group")), "full"
    )
    digests = runtime.written(both, "digests")
    wrong = digests.filter(~(F.col("rows").eqNullSafe(F.col("new_rows")) & F.col("xor").eqNullSafe(F.col("new_xor")) & F.col("sum").eqNullSafe(F.col("new_sum"))))
    if bad := wrong.count():
        raise CompactionError(f"{bad} groups differ between source and destination")
    return Compaction(path, files, back, digests.select(by, "rows", "xor", "sum"))


def list_files(listing: DataFrame, entries: DataFrame, configs: DataFrame) -> DataFrame:
    """Each listed file once, with its number of entries and the limits of its store's configuration.

    listing: file_id, store_id, config_id, entry_count; a file may be listed more than once, and the number may be
    missing in some listings. If it is in none, the file's rows in entries are counted (none: 0). Entries
    are counted before the shuffle within tasks. Listings without a file_id, and files whose configuration is
    unknown, are left out: no limit holds for them.
    """
    files = (
        listing.filter(F.col("file_id").isNotNull())
        .groupBy("file_id")
        .agg(F.max("store_id").alias("store_id"), F.max("config_id").alias("config_id"), F.max("entry_count").alias("stated"))
    )
    counted = entries.filter(F.col("file_id").isNotNull()).groupBy("file_id").agg(F.count(F.lit(1)).alias("counted"))
    limits = configs.select("config_id", "min_entry_count", "max_pending_sections")
    return (
        files.join(counted, "file_id", "left")
        .join(limits, "config_id")
        .select("file_id", "store_id", F.coalesce("stated", "counted", F.lit(0)).cast("long").alias("entry_count"), "min_entry_count", "max_pending_sections")
    )


def small_files(files: DataFrame) -> DataFrame:
    """Of the result of list_files, the small files of stores that have more of them than max_pending_sections."""
    small = files.filter(F.col("entry_count") < F.col("min_entry_count"))
    busy = small.groupBy("store_id").agg(F.count(F.lit(1)).alias("n"), F.max("max_pending_sections").alias("most")).filter("n > most").select(F.col("store_id").alias("busy_store"))
    return small.join(busy, F.col("store_id").eqNullSafe(F.col("busy_store")), "left_semi").select("store_id", "file_id", "entry_count")


def compact_small_files(listing: DataFrame, entries: DataFrame, configs: DataFrame, path: str, target_bytes: int = TARGET_BYTES) -> tuple[DataFrame, Compaction]:
    """Consolidates the small files of all stores that have too many; the files taken and the written table.

    The new files hold runs of whole stores in order of store and (key, timestamp) code; a store that is larger
    than a file spans several. Each row of entries in one of the small files is in the table exactly once, with
    its store_id: the digests of every small file are compared between entries and the table.
    """
    taken = runtime.written(small_files(list_files(listing, entries, configs)), "small-files")
    held = taken.select(F.col("file_id").alias("taken_id"), F.col("store_id").alias("taken_store"))
    rows = entries.join(held, F.col("file_id") == F.col("taken_id")).withColumn("store_id", F.col("taken_store")).drop("taken_id", "taken_store")
    source = entries.join(taken.select(F.col("file_id").alias("taken_id")), F.col("file_id") == F.col("taken_id"), "left_semi")
    return taken, compact(rows, "store_id", ["key", "timestamp"], "entry_id", path, target_bytes, source, "file_id")
