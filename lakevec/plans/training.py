"""Queries of the general training-data problems over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakevec import runtime
from lakevec.operators import changes, compaction


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry that holds the present value of every key."""
    entries = runtime.table(spark, sf_dir, "sstable_entries").select("key", "timestamp", "sequence", "value")
    return changes.apply_changes(entries, ["key"], ["timestamp", "sequence"], F.col("value").isNull()).select("key", "timestamp", "sequence")


def p4_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table after applying the incoming feed to the state that the stored entries give."""
    columns = ["key", "value", "timestamp", "sequence"]
    deleted = F.col("value").isNull()
    stored = runtime.table(spark, sf_dir, "sstable_entries").select(*columns)
    feed = runtime.table(spark, sf_dir, "incoming_entries").select(*columns)
    order = ["timestamp", "sequence"]
    # the base keeps its tombstones: they must still beat an older change that arrives late
    base = runtime.written(changes.apply_changes(stored, ["key"], order, deleted, tie=["value"], keep_deletes=True), "base")
    return changes.apply_changes(feed, ["key"], order, deleted, base, ["value"])


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the feed holds: rows, changes, repeated deliveries, deletes and keys."""
    entries = runtime.table(spark, sf_dir, "sstable_entries")
    return changes.change_counts(entries, ["key"], ["timestamp", "sequence"], F.col("value").isNull())


def _compacted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, compaction.Compaction]:
    t = lambda name: runtime.table(spark, sf_dir, name)
    return compaction.compact_small_files(t("sstable_files"), t("sstable_entries"), t("store_configs"), runtime.new_dir(spark, "compacted"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that were consolidated, after the new files were verified against them."""
    return _compacted(spark, sf_dir)[0].select("file_id")


def p5_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the new files."""
    return _compacted(spark, sf_dir)[1].rows.select("store_id", "entry_id", "key", "timestamp", "sequence")


def p5_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per store: its files, small files and entries in small files, and whether it has too many."""
    t = lambda name: runtime.table(spark, sf_dir, name)
    files = compaction.list_files(t("sstable_files"), t("sstable_entries"), t("store_configs"))
    small = F.col("entry_count") < F.col("min_entry_count")
    return (
        files.groupBy("store_id")
        .agg(
            F.count(F.lit(1)).alias("n_files"),
            F.count(F.when(small, 1)).alias("n_small"),
            F.coalesce(F.sum(F.when(small, F.col("entry_count"))), F.lit(0)).alias("small_entries"),
            F.max("max_pending_sections").alias("most"),
        )
        .select("store_id", "n_files", "n_small", "small_entries", (F.col("n_small") > F.col("most")).alias("too_many"))
    )


QUERIES = {"p4_found": p4_found, "p4_state": p4_state, "p4_counts": p4_counts, "p5_found": p5_found, "p5_rows": p5_rows, "p5_stores": p5_stores}

_FILES = """
    files AS (
        SELECT f.file_id, max(f.store_id) AS store_id, max(f.config_id) AS config_id, max(f.entry_count) AS stated
        FROM sstable_files f WHERE f.file_id IS NOT NULL GROUP BY f.file_id),
    counted AS (SELECT file_id, count(*) AS counted FROM sstable_entries GROUP BY file_id),
    sized AS (
        SELECT f.file_id, f.store_id, coalesce(f.stated, c.counted, 0) AS entry_count, s.min_entry_count, s.max_pending_sections
        FROM files f LEFT JOIN counted c ON f.file_id = c.file_id JOIN store_configs s ON f.config_id = s.config_id),
    small AS (SELECT * FROM sized WHERE entry_count < min_entry_count),
    busy AS (SELECT store_id FROM small GROUP BY store_id HAVING count(*) > max(max_pending_sections)),
    taken AS (SELECT * FROM small WHERE store_id IN (SELECT store_id FROM busy))"""

SQL = {
    "p4_found": """
        SELECT key, "timestamp", sequence FROM (
            SELECT *, row_number() OVER (PARTITION BY key ORDER BY "timestamp" DESC, sequence DESC) AS rn
            FROM sstable_entries WHERE key IS NOT NULL)
        WHERE rn = 1 AND value IS NOT NULL""",
    "p4_state": """
        SELECT key, value, "timestamp", sequence FROM (
            SELECT *, row_number() OVER (PARTITION BY key ORDER BY "timestamp" DESC, sequence DESC, value DESC NULLS LAST) AS rn
            FROM (SELECT key, value, "timestamp", sequence FROM sstable_entries
                  UNION ALL SELECT key, value, "timestamp", sequence FROM incoming_entries)
            WHERE key IS NOT NULL)
        WHERE rn = 1 AND value IS NOT NULL""",
    "p4_counts": """
        WITH c AS (
            SELECT key, "timestamp", sequence, count(*) AS n, max(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS d
            FROM sstable_entries WHERE key IS NOT NULL GROUP BY 1, 2, 3)
        SELECT (SELECT count(*) FROM sstable_entries) AS n_rows,
               (SELECT count(*) FROM sstable_entries WHERE key IS NULL) AS n_without_key,
               count(*) AS n_changes, CAST(sum(n - 1) AS BIGINT) AS n_repeated, CAST(sum(d) AS BIGINT) AS n_deletes,
               count(DISTINCT key) AS n_keys
        FROM c""",
    "p5_found": f"WITH {_FILES} SELECT file_id FROM taken",
    "p5_rows": f"""
        WITH {_FILES}
        SELECT t.store_id, e.entry_id, e.key, e."timestamp", e.sequence
        FROM sstable_entries e JOIN taken t ON e.file_id = t.file_id""",
    "p5_stores": f"""
        WITH {_FILES}
        SELECT store_id, count(*) AS n_files, count(*) FILTER (entry_count < min_entry_count) AS n_small,
               CAST(coalesce(sum(entry_count) FILTER (entry_count < min_entry_count), 0) AS BIGINT) AS small_entries,
               count(*) FILTER (entry_count < min_entry_count) > max(max_pending_sections) AS too_many
        FROM sized GROUP BY store_id""",
}
