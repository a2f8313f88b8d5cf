"""Structured Streaming: windowed counts, change feeds into a table, and vector search on micro-batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lakevec.operators.changes import apply_changes
from lakevec.operators.vector_search import search_flat
from lakevec.sources.catalog import Catalog


def windowed(events: DataFrame, time: str, length: str, keys: Sequence[str] = (), late: str = "10 minutes", slide: str | None = None, value: str | None = None) -> DataFrame:
    """Counts (and sums of value) per window and keys; events later than late behind the newest are left out.

    Works on streams and on tables. Output: keys, window_start, window_end, n (, total).
    """
    rows = events.withWatermark(time, late) if events.isStreaming else events
    w = F.window(time, length, slide) if slide else F.window(time, length)
    aggregates = [F.count(F.lit(1)).alias("n"), *([F.sum(value).alias("total")] if value else [])]
    out = rows.groupBy(w.alias("w"), *keys).agg(*aggregates)
    return out.select(*keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", *(["total"] if value else []))


def changes_into(feed: DataFrame, catalog: Catalog, table: str, keys: Sequence[str], order: Sequence[str], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Applies a change feed to a catalog table, micro-batch by micro-batch; the query starts.

    The table keeps the newest change of each key, deletes included, so that later and repeated deliveries of older changes
    don't come through; a batch that is run again changes nothing. Read it with present().
    """

    def apply(batch: DataFrame, _: int) -> None:
        if not catalog.table_exists(table):
            catalog.create_table(table, batch.schema, primary_key=keys)
        with catalog.begin():
            both = batch.unionByName(catalog.read(table).select(*batch.columns))
            catalog.overwrite(table, apply_changes(both, keys, order, F.lit(False)))

    writer = feed.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def present(catalog: Catalog, table: str, deleted: Column) -> DataFrame:
    """The rows of a table of changes_into that aren't deletes."""
    return catalog.read(table).filter(~F.coalesce(deleted, F.lit(False)))


def search_stream(vectors: DataFrame, query: Sequence[float], metric: str, k: int, catalog: Catalog, table: str, checkpoint: str, key: str = "key", vector: str = "vector") -> StreamingQuery:
    """Keeps the k best vectors of a stream in a table: those of each micro-batch are merged with the ones kept.

    The newest vector of a key counts; one that leaves the best by a worse vector doesn't bring back what was dropped before. Keys
    are unique in a micro-batch.
    """

    def apply(batch: DataFrame, _: int) -> None:
        best = search_flat(batch.select(key, vector), query, metric, k, key, vector)
        if not catalog.table_exists(table):
            catalog.create_table(table, best.schema, primary_key=[key])
        with catalog.begin():
            # a kept vector whose key comes again is replaced by the new one
            kept = catalog.read(table).select(*best.columns).join(batch.select(key), key, "left_anti").select(*best.columns)
            both = best.unionByName(kept)
            catalog.overwrite(table, both.orderBy(F.desc("score"), F.asc(key)).limit(k))

    return vectors.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
