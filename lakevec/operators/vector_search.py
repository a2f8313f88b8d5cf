"""Top-k vector search over DataFrames, and a store of vector segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakevec import errors, types
from lakevec.functions import vector as vectors

#: Vectors of a segment, and the part of deleted ones from which it is compacted (fixed values).
SEGMENT_VECTORS, COMPACT_FROM = 65_536, 0.3


def search_flat(df: DataFrame, query: Sequence[float], metric: str, k: int, key: str = "key", vector: str = "vector", where: Column | None = None) -> DataFrame:
    """The k rows that score highest, with their score; equal scores in order of key.

    The filter comes before the scores. Rows with a null vector are left out. Of each task only its k best rows move.
    """
    if k < 0:
        raise errors.InvalidOption("k can't be negative")
    if not len(query):
        raise errors.InvalidOption("the query vector is empty")
    df = df.filter(F.col(vector).isNotNull())
    if where is not None:
        df = df.filter(where)
    scored = df.withColumn("score", vectors.score(vector, query, metric))
    return scored.orderBy(F.desc("score"), F.asc(key)).limit(k)


def search_similar(df: DataFrame, query: Sequence[float], metric: str, k: int, filter_keys: Sequence[object] | None = None, key: str = "key", vector: str = "vector", stored_metric: str | None = None) -> DataFrame:
    """search_flat over stored entries: key, score. Another metric than the stored one, or another dimension, is an error."""
    m = types.metric(metric)
    if stored_metric is not None and types.metric(stored_metric) != m:
        raise errors.InvalidMetric(f"the vectors are stored for {stored_metric}")
    where = F.col(key).isin(list(filter_keys)) if filter_keys is not None else None
    size = F.size(F.col(vector))
    checked = F.when(size == len(query), F.col(vector)).otherwise(F.raise_error(F.concat(F.lit(f"dimension {len(query)} against "), size)).cast(df.schema[vector].dataType))
    return search_flat(df.withColumn(vector, checked), query, m, k, key, vector, where).select(key, "score")


def search_lsh(df: DataFrame, query: Sequence[float], metric: str, k: int, key: str = "key", vector: str = "vector", tables: int = 8, bucket_length: float = 2.0) -> DataFrame:
    """An approximate search_flat for cosine and l2: candidates from hash tables of random projections, ranked by exact score.

    If the buckets of the query hold fewer than k rows, the exact search runs instead, so that k rows come out. What was found comes to
    the driver for that: at most 4 * k rows.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    m = types.metric(metric)
    if m == "inner":
        raise errors.Unsupported("random projections need a distance: use cosine or l2")
    norm = vectors.norm(vector)
    unit = F.transform(vectors.as_vector(vector), lambda x: x / F.when(norm == 0, 1.0).otherwise(norm)) if m == "cosine" else vectors.as_vector(vector)
    rows = df.filter(F.col(vector).isNotNull()).withColumn("__lv_v", array_to_vector(unit))
    length = sum(x * x for x in query) ** 0.5 or 1.0
    point = Vectors.dense([x / length for x in query] if m == "cosine" else list(map(float, query)))
    model = BucketedRandomProjectionLSH(inputCol="__lv_v", outputCol="__lv_h", bucketLength=bucket_length, numHashTables=tables, seed=7).fit(rows.limit(1))
    near = model.approxNearestNeighbors(rows, point, 4 * k, distCol="__lv_d").drop("__lv_v", "__lv_h", "__lv_d")
    found = near.collect()
    if len(found) < k:
        return search_flat(df, query, m, k, key, vector)
    return search_flat(df.sparkSession.createDataFrame(found, near.schema), query, m, k, key, vector)


class VectorStore:
    """Vectors in segments: appended, deleted by flag, compacted and searched.

    rows: key, vector, segment, deleted. Each operation gives a new store over a new plan; nothing is changed in place.
    """

    SCHEMA = T.StructType([T.StructField("key", T.LongType()), T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("segment", T.LongType()), T.StructField("deleted", T.BooleanType())])

    def __init__(self, spark: SparkSession, dimension: int, metric: str, rows: DataFrame | None = None):
        if dimension < 1:
            raise errors.InvalidOption("a vector has at least 1 dimension")
        self.spark, self.dimension, self.metric = spark, dimension, types.metric(metric)
        self.rows = rows if rows is not None else spark.createDataFrame([], self.SCHEMA)

    def _with(self, rows: DataFrame) -> VectorStore:
        return VectorStore(self.spark, self.dimension, self.metric, rows)

    def append(self, rows: DataFrame, key: str = "key", vector: str = "vector") -> VectorStore:
        """Adds vectors in new segments of about SEGMENT_VECTORS. Another dimension, or an element that isn't finite, is an error."""
        v = F.col(vector).cast("array<float>")
        wrong = F.raise_error(F.lit(f"a vector isn't finite or not of dimension {self.dimension}")).cast("array<float>")
        ok = (F.size(v) == self.dimension) & vectors.finite(v)
        start = self.rows.agg(F.coalesce(F.max("segment"), F.lit(-1))).first()[0] + 1
        segments = max(1, -(-rows.count() // SEGMENT_VECTORS))
        segment = F.lit(start) + F.pmod(F.xxhash64(key), F.lit(segments))
        new = rows.select(F.col(key).cast("long").alias("key"), F.when(ok, v).otherwise(wrong).alias("vector"), segment.alias("segment"), F.lit(False).alias("deleted"))
        return self._with(self.rows.unionByName(new))

    def delete(self, keys: DataFrame, key: str = "key") -> VectorStore:
        """Flags vectors as deleted; unknown keys don't matter."""
        gone = keys.select(F.col(key).cast("long").alias("key")).distinct().withColumn("gone", F.lit(True))
        joined = self.rows.join(gone, "key", "left")
        return self._with(joined.select("key", "vector", "segment", (F.col("deleted") | F.coalesce("gone", F.lit(False))).alias("deleted")))

    def upsert(self, rows: DataFrame, key: str = "key", vector: str = "vector") -> VectorStore:
        """Replaces the vectors of equal keys and adds the others."""
        keys = rows.select(F.col(key).cast("long").alias("key")).distinct()
        return self._with(self.rows.join(keys, "key", "left_anti").select("key", "vector", "segment", "deleted")).append(rows, key, vector)

    def get(self, keys: Sequence[int]) -> DataFrame:
        """The live vectors of some keys."""
        return self.rows.filter(F.col("key").isin(list(keys)) & ~F.col("deleted")).select("key", "vector")

    def statistics(self) -> DataFrame:
        """Per segment: active_count, deleted_count, deletion_ratio, norm_min, norm_max (of all vectors)."""
        n = vectors.norm("vector")
        counts = self.rows.groupBy("segment").agg(
            F.count(F.when(~F.col("deleted"), 1)).alias("active_count"),
            F.count(F.when(F.col("deleted"), 1)).alias("deleted_count"),
            F.min(n).alias("norm_min"),
            F.max(n).alias("norm_max"),
        )
        return counts.select("segment", "active_count", "deleted_count", (F.col("deleted_count") / (F.col("active_count") + F.col("deleted_count"))).alias("deletion_ratio"), "norm_min", "norm_max")

    def needing_compaction(self, from_ratio: float = COMPACT_FROM) -> DataFrame:
        return self.statistics().filter(F.col("deletion_ratio") >= from_ratio).select("segment")

    def compact(self, segments: Sequence[int] | None = None) -> VectorStore:
        """Drops the deleted vectors of segments, or of all that need it."""
        if segments is not None:
            return self._with(self.rows.filter(~(F.col("segment").isin(list(segments)) & F.col("deleted"))))
        needed = self.needing_compaction().withColumn("hit", F.lit(True))
        joined = self.rows.join(needed, "segment", "left").filter(~(F.coalesce("hit", F.lit(False)) & F.col("deleted")))
        return self._with(joined.select("key", "vector", "segment", "deleted"))

    def search(self, query: Sequence[float], k: int, metric: str | None = None, where: Column | None = None, approximate: bool = False) -> tuple[DataFrame, Observation]:
        """The k best live vectors (key, score) and what was scanned, to be read after they have run: segments, rows, matched."""
        m = types.metric(metric or self.metric)
        if m != self.metric:
            raise errors.InvalidMetric(f"the vectors are stored for {self.metric}")
        if len(query) != self.dimension:
            raise errors.DimensionMismatch(f"dimension {len(query)} against {self.dimension}")
        matched = ~F.col("deleted") if where is None else ~F.col("deleted") & where
        seen = Observation("vector search")
        rows = self.rows.observe(seen, F.count(F.lit(1)).alias("rows_scanned"), F.count(F.when(matched, 1)).alias("rows_matched"), F.max("segment").alias("last_segment"))
        live = rows.filter(matched)
        found = search_lsh(live, query, m, k) if approximate else search_flat(live, query, m, k)
        return found.select("key", "score"), seen


def norm_stats(df: DataFrame, group: str, vector: str) -> DataFrame:
    """Number and least and greatest norm of the vectors of each group."""
    n = vectors.norm(vector)
    return df.groupBy(group).agg(F.count(F.col(vector)).alias("n"), F.min(n).alias("norm_min"), F.max(n).alias("norm_max"))

