"""Queries of the operators in this package over the test tables, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakevec import runtime
from lakevec.llm import clusters, encode, mixture, neighbours, seen, truncation


def _clustered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, clusters.Clusters]:
    segments = runtime.table(spark, sf_dir, "vector_segments")
    return segments, clusters.cluster(segments, runtime.table(spark, sf_dir, "vector_collections"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live segment vectors in clusters of mutually similar ones."""
    return clusters.members(_clustered(spark, sf_dir)[1]).select(F.col("label").alias("cluster_key"), F.col("key").alias("vec_key"))


def p1_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cluster with its size and most typical keys."""
    return clusters.describe(*_clustered(spark, sf_dir))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of vectors of which one is among the most similar ones of the other."""
    t = lambda name: runtime.table(spark, sf_dir, name)
    rows = neighbours.vector_rows(t("vector_segments"), t("vector_upserts"), t("knowledge_chunks"))
    return neighbours.nearest_pairs(rows, t("vector_collections")).select("id_a", "id_b")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming records whose key occurred in the stored entries or in an earlier record."""
    history = runtime.table(spark, sf_dir, "sstable_entries").select("key")
    incoming = runtime.table(spark, sf_dir, "incoming_entries").select("incoming_id", "key")
    return seen.seen_before(history, incoming, "key", "incoming_id").select("incoming_id")


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per configuration the rate of wrong answers against its bloom_filter_fpr."""
    t = lambda name: runtime.table(spark, sf_dir, name)
    return seen.report(
        t("sstable_entries").select("key"), t("incoming_entries").select("incoming_id", "key", "config_id"), t("store_configs"), "key", "incoming_id", "config_id", "bloom_filter_fpr"
    )


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document by byte_bpe_50k."""
    runtime.ship(spark)
    return runtime.table(spark, sf_dir, "documents").select("doc_id", encode.token_ids("text", encode.read_ranks()).alias("ids"))


def p6_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of bytes that every document's ids decode to, -1 where they aren't the text's."""
    ranks = encode.read_ranks()
    runtime.ship(spark)
    ids = runtime.table(spark, sf_dir, "documents").select("doc_id", "text", encode.token_ids("text", ranks).alias("ids"))
    return ids.select("doc_id", encode.byte_lengths("ids", "text", ranks).alias("n_bytes"))


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    runtime.ship(spark)
    docs = runtime.table(spark, sf_dir, "documents").select("doc_id", "source", encode.token_counts("text", encode.read_ranks()).alias("n_tokens"))
    return mixture.mix(docs, "doc_id", "source", "n_tokens", runtime.table(spark, sf_dir, "source_weights"))


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often every document occurs in the mixture."""
    return _mixed(spark, sf_dir)[0].select(F.col("doc").alias("doc_id"), "source", F.col("size").alias("n_tokens"), "copies")


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares of tokens that the sources have in the mixture, beside their targets."""
    return _mixed(spark, sf_dir)[1]


def _cut(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    shaped = truncation.shapes(runtime.table(spark, sf_dir, "documents"), "doc_id", "text", "source")
    limits = truncation.limits(shaped)
    return shaped, limits, truncation.truncated(shaped, limits)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text was cut."""
    return _cut(spark, sf_dir)[2].select(F.col("doc").alias("doc_id"))


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source the number and rate of cut texts."""
    shaped, _, cut = _cut(spark, sf_dir)
    return truncation.rates(shaped, cut)


def p8_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The significant lengths of each source."""
    return _cut(spark, sf_dir)[1]


QUERIES = {"p1_found": p1_found, "p1_clusters": p1_clusters, "p2_found": p2_found, "p3_found": p3_found, "p3_report": p3_report, "p6_ids": p6_ids, "p6_roundtrip": p6_roundtrip, "p7_mixture": p7_mixture, "p7_shares": p7_shares, "p8_found": p8_found, "p8_rates": p8_rates, "p8_limits": p8_limits}

_LIVE = """
    seg AS (SELECT DISTINCT s.segment_id, s.table_name, s.vectors, s.keys, s.deleted, c.dimension AS dim, c.metric AS how, c.top_k, c.min_score
            FROM vector_segments s JOIN vector_collections c ON s.table_name = c.table_name),
    live AS (SELECT DISTINCT table_name, how, top_k, min_score, keys[i] AS id, CAST(vectors[(i - 1) * dim + 1 : i * dim] AS DOUBLE[]) AS v
             FROM (SELECT *, unnest(range(1, len(keys) + 1)) AS i FROM seg) WHERE NOT deleted[i])"""

_SCORE = """CASE a.how WHEN 'l2' THEN -list_distance(a.v, b.v) WHEN 'inner' THEN list_inner_product(a.v, b.v)
            ELSE CASE WHEN list_inner_product(a.v, a.v) = 0 OR list_inner_product(b.v, b.v) = 0 THEN 0 ELSE list_cosine_similarity(a.v, b.v) END END"""

SQL = {
    "p1_found": f"""
        WITH {_LIVE}
        SELECT least(a.id, min(b.id)) AS cluster_key, a.id AS vec_key
        FROM live a JOIN live b ON a.table_name = b.table_name AND a.id <> b.id
        WHERE {_SCORE} >= a.min_score GROUP BY a.table_name, a.id""",
    "p3_found": """
        SELECT incoming_id FROM (
            SELECT incoming_id, key, min(incoming_id) OVER (PARTITION BY key) AS first FROM incoming_entries WHERE key IS NOT NULL) i
        WHERE incoming_id > first OR key IN (SELECT key FROM sstable_entries WHERE key IS NOT NULL)""",
    "p3_report": """
        WITH i AS (
            SELECT incoming_id, config_id, key, min(incoming_id) OVER (PARTITION BY key) AS first FROM incoming_entries WHERE key IS NOT NULL),
        n AS (SELECT (SELECT count(*) FROM sstable_entries) + (SELECT count(*) FROM incoming_entries) AS n,
                     (SELECT min(bloom_filter_fpr) FROM store_configs WHERE bloom_filter_fpr > 0) AS rate),
        sized AS (SELECT greatest(1, CAST(ceil(n / 262144) AS BIGINT)) AS parts,
                         CAST(ceil(log2(greatest(2, 2 * least(n, 262144)))) + ceil(-log2(rate)) AS INTEGER) AS bits FROM n),
        marked AS (
            SELECT src, pos, key, CAST('0x' || substr(md5(key), 18, 15) AS BIGINT) % parts AS part, CAST('0x' || substr(md5(key), 1, 15) AS BIGINT) >> (60 - bits) AS mark
            FROM (SELECT 0 AS src, CAST(-1 AS BIGINT) AS pos, key FROM sstable_entries UNION ALL SELECT 1, incoming_id, key FROM incoming_entries) e, sized
            WHERE key IS NOT NULL),
        earliest AS (SELECT part, mark, min(CASE src WHEN 0 THEN -1 ELSE pos END) AS first_mark FROM marked GROUP BY 1, 2),
        said AS (SELECT m.pos AS incoming_id, m.pos > e.first_mark AS said FROM marked m JOIN earliest e ON m.part = e.part AND m.mark = e.mark WHERE m.src = 1),
        s AS (SELECT i.*, said, incoming_id > first OR key IN (SELECT key FROM sstable_entries WHERE key IS NOT NULL) AS seen FROM i JOIN said USING (incoming_id)),
        per AS (SELECT s.config_id, count(*) AS n_records, count(*) FILTER (said) AS n_seen, count(*) FILTER (said <> seen) AS n_wrong,
                       CASE WHEN count(*) FILTER (NOT seen) > 0 THEN count(*) FILTER (said <> seen) / count(*) FILTER (NOT seen) ELSE 0 END AS wrong_rate, c.bloom_filter_fpr AS allowed_rate
                FROM s LEFT JOIN store_configs c ON s.config_id = c.config_id GROUP BY s.config_id, c.bloom_filter_fpr)
        SELECT *, wrong_rate <= coalesce(allowed_rate, 0) AS within FROM per""",
    "p6_roundtrip": "SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes FROM documents",
}
