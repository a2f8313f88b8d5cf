"""A key-value table: versions of binary pairs, read by key, prefix or range in transactions."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakevec import errors
from lakevec.operators.changes import apply_changes
from lakevec.sources.catalog import Catalog

_SCHEMA = T.StructType([T.StructField("key", T.BinaryType(), False), T.StructField("value", T.BinaryType()), T.StructField("seq", T.LongType(), False)])


class KeyValue:
    """Pairs of bytes in one table of a catalog. Every commit appends its changes; reads see the newest of each key."""

    def __init__(self, spark: SparkSession, root: str, table: str = "kv"):
        self.spark, self.table, self.catalog = spark, table, Catalog(spark, root)
        if not self.catalog.table_exists(table):
            self.catalog.create_table(table, _SCHEMA)

    def begin(self, read_only: bool = False) -> KeyValueTransaction:
        return KeyValueTransaction(self, read_only)

    def state(self) -> DataFrame:
        """key, value of all present pairs."""
        log = self.catalog.read(self.table)
        return apply_changes(log, ["key"], ["seq"], F.col("value").isNull()).select("key", "value")

    def compact(self) -> None:
        """Rewrites the log as the present pairs only."""
        log = self.catalog.read(self.table)
        with self.catalog.begin():
            self.catalog.overwrite(self.table, apply_changes(log, ["key"], ["seq"], F.col("value").isNull()))


class KeyValueTransaction:
    """Reads one version with its own changes over it; commit fails if the table was changed since."""

    def __init__(self, store: KeyValue, read_only: bool):
        self._store, self.read_only = store, read_only
        self._version = store.catalog.get_table(store.table)["version"]
        self._base = store.state()
        self._changes: dict[bytes, bytes | None] = {}

    def put(self, key: bytes, value: bytes) -> None:
        self._write(key, value)

    def delete(self, key: bytes) -> None:
        self._write(key, None)

    def _write(self, key: bytes, value: bytes | None) -> None:
        if self.read_only:
            raise errors.ReadOnly("the transaction is read-only")
        self._changes[bytes(key)] = None if value is None else bytes(value)

    def get(self, key: bytes) -> bytes | None:
        if key in self._changes:
            return self._changes[key]
        row = self._base.filter(F.col("key") == F.lit(bytearray(key))).first()
        return bytes(row["value"]) if row else None

    def _merged(self, rows: DataFrame, inside) -> Iterator[tuple[bytes, bytes]]:  # noqa: ANN001
        stored = ((bytes(r["key"]), bytes(r["value"])) for r in rows.orderBy("key").toLocalIterator())
        own = sorted((k, v) for k, v in self._changes.items() if inside(k))
        kept = ((k, v) for k, v in stored if k not in self._changes)
        yield from heapq.merge(kept, ((k, v) for k, v in own if v is not None))

    def scan_prefix(self, prefix: bytes) -> Iterator[tuple[bytes, bytes]]:
        """Pairs whose key begins with prefix, in order of key."""
        return self._merged(self._base.filter(F.col("key").startswith(F.lit(bytearray(prefix)))), lambda k: k.startswith(prefix))

    def scan_range(self, start: bytes, end: bytes) -> Iterator[tuple[bytes, bytes]]:
        """Pairs from start on and before end, in order of key."""
        rows = self._base.filter((F.col("key") >= F.lit(bytearray(start))) & (F.col("key") < F.lit(bytearray(end))))
        return self._merged(rows, lambda k: start <= k < end)

    def commit(self) -> None:
        catalog = self._store.catalog
        if not self._changes:
            return
        with catalog.begin():
            if catalog.get_table(self._store.table)["version"] != self._version:
                raise errors.TxnConflict("the pairs were changed by another transaction")
            last = catalog.read(self._store.table).agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
            rows = [(bytearray(k), None if v is None else bytearray(v), last + 1) for k, v in self._changes.items()]
            catalog.append(self._store.table, self._store.spark.createDataFrame(rows, _SCHEMA))
        self._changes = {}

    def rollback(self) -> None:
        self._changes = {}
