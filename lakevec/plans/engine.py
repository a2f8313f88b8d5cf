"""Queries of the engine's own operators over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakevec import errors, runtime
from lakevec.functions import vector as vectors
from lakevec.operators import segments, stats, vector_search
from lakevec.operators.changes import apply_changes
from lakevec.plans.frame import LazyFrame, all_columns, col, lit
from lakevec.session import Engine
from lakevec.sources import io, kv
from lakevec.streaming import feeds

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings")


def _add(name: str, sql: str | None) -> Callable[[Query], Query]:
    def keep(q: Query) -> Query:
        QUERIES[name] = q
        if sql:
            SQL[name] = sql
        return q

    return keep


def engine(spark: SparkSession, sf_dir: str, root: str | None = None) -> Engine:
    """An engine with the test tables."""
    e = Engine(spark, root)
    e.register_parquet(sf_dir, *TABLES)
    return e


def _dialect(name: str, text: str, sql: str) -> None:
    """A query that is one SELECT of the dialect."""
    _add(name, sql)(lambda spark, sf_dir: engine(spark, sf_dir).sql(text))


_dialect(
    "scan_project_alias",
    "SELECT l_orderkey AS ok, l_linenumber ln, l_quantity FROM lineitem",
    "SELECT l_orderkey AS ok, l_linenumber AS ln, l_quantity FROM lineitem",
)
_dialect("select_star", "SELECT * FROM nation", "SELECT * FROM nation")
_dialect(
    "select_star_plus_expr",
    "SELECT *, n_nationkey * 10 + n_regionkey AS x FROM nation",
    "SELECT *, n_nationkey * 10 + n_regionkey AS x FROM nation",
)
_dialect(
    "unnamed_outputs",
    "SELECT n_nationkey, n_nationkey + 1, n_name || '!' FROM nation",
    "SELECT n_nationkey, n_nationkey + 1 AS col_1, n_name || '!' AS col_2 FROM nation",
)
_dialect(
    "table_alias",
    "SELECT c.c_custkey, customer.c_name FROM customer AS c WHERE c.c_acctbal < 0",
    "SELECT c_custkey, c_name FROM customer WHERE c_acctbal < 0",
)
_dialect(
    "filter_compare",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 200000 AND o_orderstatus <> 'F' AND o_custkey != 7",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 200000 AND o_orderstatus <> 'F' AND o_custkey <> 7",
)
_dialect(
    "filter_and_or_not",
    "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity > 45 OR l_discount = 0.05) AND NOT l_returnflag = 'N'",
    "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity > 45 OR l_discount = 0.05) AND NOT l_returnflag = 'N'",
)
_dialect(
    "filter_is_null",
    "SELECT doc_id FROM documents WHERE title IS NULL OR (lang IS NOT NULL AND source IS NULL)",
    "SELECT doc_id FROM documents WHERE title IS NULL OR (lang IS NOT NULL AND source IS NULL)",
)
_dialect(
    "filter_null_logic",
    "SELECT doc_id, (lang = 'en') IS NULL AS unknown, (NOT (source = 'bot_stubs' AND lang = 'en')) IS NULL AS neither FROM documents WHERE NOT (lang = 'en' AND source = 'dump_full')",
    "SELECT doc_id, (lang = 'en') IS NULL AS unknown, (NOT (source = 'bot_stubs' AND lang = 'en')) IS NULL AS neither FROM documents WHERE NOT (lang = 'en' AND source = 'dump_full')",
)
_dialect(
    "filter_between",
    "SELECT l_orderkey, l_linenumber, l_quantity NOT BETWEEN 10 AND 20 AS outside FROM lineitem WHERE l_extendedprice BETWEEN 1000 AND 20000.5",
    "SELECT l_orderkey, l_linenumber, l_quantity NOT BETWEEN 10 AND 20 AS outside FROM lineitem WHERE l_extendedprice BETWEEN 1000 AND 20000.5::DOUBLE",
)
_dialect("filter_like", "SELECT p_partkey, p_name FROM part WHERE p_type LIKE '%A_%'", "SELECT p_partkey, p_name FROM part WHERE p_type LIKE '%A_%'")
_dialect(
    "filter_not_like_escape",
    "SELECT user_id, event_id FROM events WHERE event_type NOT LIKE '%!_%' ESCAPE '!'",
    "SELECT user_id, event_id FROM events WHERE event_type NOT LIKE '%!_%' ESCAPE '!'",
)
_dialect(
    "filter_in",
    "SELECT c_custkey FROM customer WHERE c_nationkey IN (1, 3, 5) AND c_mktsegment IN ('BUILDING', 'MACHINERY')",
    "SELECT c_custkey FROM customer WHERE c_nationkey IN (1, 3, 5) AND c_mktsegment IN ('BUILDING', 'MACHINERY')",
)
_dialect(
    "filter_not_in",
    "SELECT doc_id, (lang NOT IN ('en', NULL)) IS NULL AS unknown FROM documents WHERE source NOT IN ('dump_full', 'mirror_api')",
    "SELECT doc_id, (lang NOT IN ('en', NULL)) IS NULL AS unknown FROM documents WHERE source NOT IN ('dump_full', 'mirror_api')",
)
_dialect("filter_in_empty", "SELECT n_nationkey FROM nation WHERE NOT n_nationkey IN ()", "SELECT n_nationkey FROM nation")
_dialect(
    "filter_timestamp",
    "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= '1997-01-01' AND o_orderdate < '1997-07-01 00:00:00'",
    "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1997-07-01'",
)
_dialect(
    "arith_int_div",
    "SELECT l_orderkey, l_linenumber, l_orderkey / 7 AS q, (0 - l_linenumber) / 2 AS h FROM lineitem",
    "SELECT l_orderkey, l_linenumber, l_orderkey // 7 AS q, CAST(trunc((0 - l_linenumber) / 2.0::DOUBLE) AS INTEGER) AS h FROM lineitem",
)
_dialect(
    "arith_mod",
    "SELECT o_orderkey, o_orderkey % 10 AS m, -o_orderkey % 7 AS n FROM orders",
    "SELECT o_orderkey, o_orderkey % 10 AS m, -o_orderkey % 7 AS n FROM orders",
)
_dialect(
    "arith_promote",
    "SELECT l_orderkey, l_linenumber, l_linenumber + l_orderkey AS b, l_linenumber * l_discount AS d, l_quantity / 4 AS f FROM lineitem",
    "SELECT l_orderkey, l_linenumber, l_linenumber + l_orderkey AS b, l_linenumber * l_discount AS d, l_quantity / 4 AS f FROM lineitem",
)
_dialect(
    "arith_neg",
    "SELECT s_suppkey, -s_acctbal + 1.5 AS n, -(s_suppkey - 3) AS m FROM supplier",
    "SELECT s_suppkey, -s_acctbal + 1.5::DOUBLE AS n, -(s_suppkey - 3) AS m FROM supplier",
)
_dialect(
    "string_concat",
    "SELECT doc_id, lang || ':' || source AS tag FROM documents",
    "SELECT doc_id, lang || ':' || source AS tag FROM documents",
)
_dialect(
    "precedence",
    "SELECT o_orderkey FROM orders WHERE o_custkey + 2 * 3 = 10 OR NOT o_orderstatus = 'O' AND o_totalprice > 100000 - 50 * 2",
    "SELECT o_orderkey FROM orders WHERE o_custkey + 2 * 3 = 10 OR NOT o_orderstatus = 'O' AND o_totalprice > 100000 - 50 * 2",
)
_dialect(
    "order_multi_nulls",
    "SELECT doc_id, lang, source FROM documents ORDER BY source DESC, lang ASC NULLS FIRST, doc_id LIMIT 200",
    "SELECT doc_id, lang, source FROM documents ORDER BY source DESC NULLS LAST, lang ASC NULLS FIRST, doc_id LIMIT 200",
)
_dialect(
    "order_unprojected",
    "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50",
    "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50",
)
_dialect(
    "limit_offset",
    "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey, o_orderkey LIMIT 25 OFFSET 40",
    "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey, o_orderkey LIMIT 25 OFFSET 40",
)
_dialect(
    "top_k",
    "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS revenue FROM lineitem ORDER BY l_extendedprice * (1 - l_discount) DESC, l_orderkey, l_linenumber LIMIT 20",
    "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS revenue FROM lineitem ORDER BY l_extendedprice * (1 - l_discount) DESC, l_orderkey, l_linenumber LIMIT 20",
)
_dialect(
    "select_distinct",
    "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem ORDER BY l_returnflag, l_linestatus",
    "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem",
)
_dialect(
    "sql_agg",
    "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, SUM(l_linenumber) AS lines, AVG(l_quantity) AS avg_qty, MIN(l_shipdate) AS first_ship, MAX(l_extendedprice) AS top FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines, avg(l_quantity) AS avg_qty, min(l_shipdate) AS first_ship, max(l_extendedprice) AS top FROM lineitem GROUP BY ALL",
)
_dialect(
    "sql_agg_having",
    "SELECT o_custkey, COUNT(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY o_custkey HAVING COUNT(*) > 12",
    "SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY o_custkey HAVING count(*) > 12",
)
_dialect(
    "count_distinct",
    "SELECT event_type, COUNT(DISTINCT user_id) AS users, COUNT(user_id) AS n FROM events GROUP BY event_type",
    "SELECT event_type, count(DISTINCT user_id) AS users, count(user_id) AS n FROM events GROUP BY event_type",
)

# frames


def _lazy(spark: SparkSession, sf_dir: str, name: str) -> LazyFrame:
    return io.scan_parquet(spark, f"{sf_dir}/{name}.parquet")


@_add("with_columns_add_overwrite", "SELECT CAST(n_nationkey + 100 AS INTEGER) AS n_nationkey, n_name, n_regionkey, CAST(n_nationkey * n_regionkey AS BIGINT) AS x FROM nation")
def with_columns_add_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = (col("n_nationkey") + lit(100)).alias("n_nationkey")
    out = _lazy(spark, sf_dir, "nation").with_columns(shifted, (col("n_nationkey") * col("n_regionkey") * lit(1)).alias("x")).df
    return out.withColumn("n_nationkey", F.col("n_nationkey").cast("int"))


@_add("group_sum_mean_min_max_count", "SELECT event_type, round(sum(value), 4) AS s, round(avg(value), 6) AS m, min(value) AS lo, max(value) AS hi, count(value) AS n FROM events GROUP BY event_type")
def group_sum_mean_min_max_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = col("value")
    g = _lazy(spark, sf_dir, "events").group_by("event_type").agg(v.sum().alias("s"), v.mean().alias("m"), v.min().alias("lo"), v.max().alias("hi"), v.count().alias("n")).df
    return g.withColumns({"s": F.round("s", 4), "m": F.round("m", 6)})


@_add("group_multi_key", "SELECT l_returnflag, l_linestatus, l_linenumber AS line, max(l_quantity) AS top FROM lineitem GROUP BY ALL")
def group_multi_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lazy(spark, sf_dir, "lineitem").group_by("l_returnflag", "l_linestatus", col("l_linenumber").alias("line")).agg(col("l_quantity").max().alias("top")).df


@_add("group_count_literal", "SELECT source, count(*) AS n, count(text) AS n_text FROM documents GROUP BY source")
def group_count_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lazy(spark, sf_dir, "documents").group_by("source").agg(lit(1).count().alias("n"), col("text").count().alias("n_text")).df


@_add("group_int_sum", "SELECT l_linestatus, CAST(sum(l_linenumber) AS BIGINT) AS s, CAST(sum(l_orderkey) AS BIGINT) AS k FROM lineitem GROUP BY l_linestatus")
def group_int_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lazy(spark, sf_dir, "lineitem").group_by("l_linestatus").agg(col("l_linenumber").sum().alias("s"), col("l_orderkey").sum().alias("k")).df


@_add("filter_then_group", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_totalprice > 50000 AND o_orderstatus = 'O' GROUP BY o_orderpriority")
def filter_then_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    lazy = _lazy(spark, sf_dir, "orders").filter((col("o_totalprice") > 50000.0) & (col("o_orderstatus") == "O"))
    return lazy.group_by("o_orderpriority").agg(lit(1).count().alias("n")).df


@_add("project_pushdown", "SELECT p_partkey, p_retailprice * 2 AS twice FROM part WHERE p_size >= 40")
def project_pushdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lazy(spark, sf_dir, "part").filter(col("p_size") >= 40).select("p_partkey", (col("p_retailprice") * 2.0).alias("twice")).df


@_add("frame_select_all", "SELECT *, n_regionkey AS r FROM nation WHERE n_name IS NOT NULL AND NOT n_regionkey = 2")
def frame_select_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lazy(spark, sf_dir, "nation").filter(col("n_name").is_not_null() & ~(col("n_regionkey") == 2)).select(all_columns(), col("n_regionkey").alias("r")).df


@_add("frame_division", "SELECT o_orderkey, o_orderkey // 3 AS q, CASE WHEN o_totalprice - o_totalprice = 0 THEN 'inf' END AS kind, o_totalprice / 4 AS f FROM orders")
def frame_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_zero = col("o_totalprice") / (col("o_totalprice") - col("o_totalprice"))
    out = _lazy(spark, sf_dir, "orders").select("o_orderkey", (col("o_orderkey") / 3).alias("q"), by_zero.alias("z"), (col("o_totalprice") / 4).alias("f")).df
    return out.select("o_orderkey", "q", F.when(F.col("z") == float("inf"), "inf").alias("kind"), "f")


# statistics


@_add(
    "column_stats",
    """SELECT 'o_orderkey' AS "column", CAST(min(o_orderkey) AS VARCHAR) AS min_value, CAST(max(o_orderkey) AS VARCHAR) AS max_value, count(o_orderkey) AS n_values, count(*) - count(o_orderkey) AS null_count, count(DISTINCT o_orderkey) AS distinct_count FROM orders
       UNION ALL SELECT 'o_orderstatus', min(o_orderstatus), max(o_orderstatus), count(o_orderstatus), count(*) - count(o_orderstatus), count(DISTINCT o_orderstatus) FROM orders
       UNION ALL SELECT 'o_custkey', CAST(min(o_custkey) AS VARCHAR), CAST(max(o_custkey) AS VARCHAR), count(o_custkey), count(*) - count(o_custkey), count(DISTINCT o_custkey) FROM orders""",
)
def column_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.column_stats(runtime.table(spark, sf_dir, "orders"), ["o_orderkey", "o_orderstatus", "o_custkey"], distinct=True)


@_add(
    "row_group_stats",
    """SELECT l_orderkey // 1000 AS part, 'l_partkey' AS "column", CAST(min(l_partkey) AS VARCHAR) AS min_value, CAST(max(l_partkey) AS VARCHAR) AS max_value, count(l_partkey) AS n_values, count(*) - count(l_partkey) AS null_count FROM lineitem GROUP BY 1
       UNION ALL SELECT l_orderkey // 1000, 'l_returnflag', min(l_returnflag), max(l_returnflag), count(l_returnflag), count(*) - count(l_returnflag) FROM lineitem GROUP BY 1""",
)
def row_group_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = runtime.table(spark, sf_dir, "lineitem").withColumn("part", F.expr("l_orderkey div 1000"))
    return stats.grouped_stats(df.select("part", "l_partkey", "l_returnflag"), ["part"])


@_add(
    "merged_stats",
    """SELECT 'l_partkey' AS "column", CAST(min(l_partkey) AS VARCHAR) AS min_value, CAST(max(l_partkey) AS VARCHAR) AS max_value, count(l_partkey) AS n_values, CAST(0 AS BIGINT) AS null_count FROM lineitem
       UNION ALL SELECT 'l_returnflag', min(l_returnflag), max(l_returnflag), count(l_returnflag), CAST(0 AS BIGINT) FROM lineitem""",
)
def merged_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.merge_stats(row_group_stats(spark, sf_dir).drop("part"), ["l_partkey"])


# vectors; the query vector is that of vec_id 0 on both sides

_Q = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runtime.table(spark, sf_dir, "embeddings")


def _query(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(_vectors(spark, sf_dir).filter("vec_id = 0").first()["embedding"])


def _literal(spark: SparkSession, sf_dir: str) -> str:
    return "[" + ", ".join(repr(float(x)) for x in _query(spark, sf_dir)) + "]"


def _similarity(metric: str, function: str = "vector_similarity") -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = engine(spark, sf_dir).sql(f"SELECT vec_id, {function}(embedding, {_literal(spark, sf_dir)}, '{metric}') AS s FROM embeddings")
        return df.withColumn("s", F.round("s", 6))

    return run


_DUCK = {"cosine": "list_cosine_similarity", "l2": "list_distance", "inner": "list_inner_product"}
for _m, _f in _DUCK.items():
    _add(f"vec_{_m}", f"SELECT vec_id, round({_f}(embedding::DOUBLE[], {_Q}), 6) AS s FROM embeddings")(_similarity(_m))
_add("vec_distance_alias", f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {_Q}), 6) AS s FROM embeddings")(_similarity(" COSINE ", "vector_distance"))


def _knn(metric: str, where: str = "") -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        call = f"vector_similarity(embedding, {_literal(spark, sf_dir)}, '{metric}')"
        order = "ASC" if metric == "l2" else "DESC"
        df = engine(spark, sf_dir).sql(f"SELECT vec_id, label, {call} AS score FROM embeddings {where} ORDER BY {call} {order}, vec_id LIMIT 20")
        return df.withColumn("score", F.round("score", 6))

    return run


for _m, _f in _DUCK.items():
    _order = "ASC" if _m == "l2" else "DESC"
    _add(f"knn_{_m}", f"SELECT vec_id, label, round({_f}(embedding::DOUBLE[], {_Q}), 6) AS score FROM embeddings ORDER BY {_f}(embedding::DOUBLE[], {_Q}) {_order}, vec_id LIMIT 20")(_knn(_m))
_add("knn_filtered", f"SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], {_Q}), 6) AS score FROM embeddings WHERE label = 3 ORDER BY 3 DESC, vec_id LIMIT 20")(_knn("cosine", "WHERE label = 3"))
flagship = QUERIES["knn_filtered"]


@_add("flat_search_score", f"SELECT vec_id, round(0 - list_distance(embedding::DOUBLE[], {_Q}), 6) AS score FROM embeddings ORDER BY list_distance(embedding::DOUBLE[], {_Q}), vec_id LIMIT 15")
def flat_search_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector_search.search_flat(_vectors(spark, sf_dir), _query(spark, sf_dir), "l2", 15, "vec_id", "embedding")
    return found.select("vec_id", F.round("score", 6).alias("score"))


@_add("flat_search_filter_keys", f"SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], {_Q}), 6) AS score FROM embeddings WHERE vec_id IN (3, 5, 8, 13, 21, 34) ORDER BY 2 DESC, vec_id LIMIT 4")
def flat_search_filter_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector_search.search_similar(_vectors(spark, sf_dir), _query(spark, sf_dir), "inner", 4, [3, 5, 8, 13, 21, 34], "vec_id", "embedding")
    return found.withColumn("score", F.round("score", 6))


@_add("vec_norm_stats", "SELECT label, count(embedding) AS n, round(min(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6) AS norm_min, round(max(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6) AS norm_max FROM embeddings GROUP BY label")
def vec_norm_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.norm_stats(_vectors(spark, sf_dir), "label", "embedding").withColumns({"norm_min": F.round("norm_min", 6), "norm_max": F.round("norm_max", 6)})


@_add("vec_delete_then_search", f"SELECT vec_id AS key, round(list_cosine_similarity(embedding::DOUBLE[], {_Q}), 6) AS score FROM embeddings WHERE label <> 4 ORDER BY list_cosine_similarity(embedding::DOUBLE[], {_Q}) DESC, vec_id LIMIT 10")
def vec_delete_then_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    store = vector_search.VectorStore(spark, 64, "cosine").append(rows, "vec_id", "embedding")
    store = store.delete(rows.filter("label = 4"), "vec_id").compact()
    return store.search(_query(spark, sf_dir), 10)[0].withColumn("score", F.round("score", 6))


@_add("vec_finite", "SELECT vec_id, len(embedding) AS dim FROM embeddings WHERE len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0")
def vec_finite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).filter(vectors.finite("embedding")).select("vec_id", F.size("embedding").cast("long").alias("dim"))


# row ids, writes and DML; each works on tables of its own in the shared folder


@_add("rowid_encode", "SELECT l_orderkey, l_linenumber, (l_linenumber::BIGINT << 44) | l_orderkey AS row_id, l_linenumber::BIGINT AS segment, l_orderkey AS place FROM lineitem")
def rowid_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = runtime.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", segments.encode_row_id("l_linenumber", "l_orderkey").alias("row_id"))
    segment, place = segments.decode_row_id("row_id")
    return df.select("l_orderkey", "l_linenumber", "row_id", segment.alias("segment"), place.alias("place"))


@_add("segment_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000")
def segment_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = runtime.table(spark, sf_dir, "orders")
    store = segments.SegmentStore(spark, runtime.new_dir(spark, "segments"))
    store.write("orders", orders.filter("o_orderstatus = 'O'"))
    store.write("orders", orders.filter("o_orderstatus <> 'O'"))
    return store.scan("orders", ["o_orderkey", "o_totalprice"], F.col("o_totalprice") > 100000)


def _written(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    e = engine(spark, sf_dir, runtime.new_dir(spark, "catalog"))
    customers = e.table("customer").select("c_custkey", "c_name", "c_acctbal")
    old = customers.filter("c_custkey <= 100")
    new = customers.filter("c_custkey > 50").withColumn("c_acctbal", F.col("c_acctbal") + 1000)
    e.catalog.write_table(old, "default", "default", "t", "overwrite")
    e.catalog.write_table(new, "default", "default", "t", mode, ["c_custkey"] if mode == "merge" else None)
    return e.catalog.scan_table("default", "default", "t")


_OLD, _NEW = "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey <= 100", "SELECT c_custkey, c_name, c_acctbal + 1000 AS c_acctbal FROM customer WHERE c_custkey > 50"
_add("write_append", f"{_OLD} UNION ALL {_NEW}")(lambda s, d: _written(s, d, "append"))
_add("write_overwrite", _NEW)(lambda s, d: _written(s, d, "overwrite"))
_add("write_merge", f"{_OLD} AND c_custkey <= 50 UNION ALL {_NEW}")(lambda s, d: _written(s, d, "merge"))


def _written_whole(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    """The whole customer table and then, under doubled keys, all of it again: half of the keys are there already."""
    e = engine(spark, sf_dir, runtime.new_dir(spark, "catalog"))
    customers = e.table("customer").select("c_custkey", "c_name", "c_acctbal")
    changed = customers.withColumns({"c_custkey": F.col("c_custkey") * 2, "c_acctbal": F.col("c_acctbal") + 1000})
    e.catalog.write_table(customers, "default", "default", "t", "overwrite")
    e.catalog.write_table(changed, "default", "default", "t", mode, ["c_custkey"] if mode == "merge" else None)
    return e.catalog.scan_table("default", "default", "t")


_WHOLE, _CHANGED = "SELECT c_custkey, c_name, c_acctbal FROM customer", "SELECT c_custkey * 2 AS c_custkey, c_name, c_acctbal + 1000 AS c_acctbal FROM customer"
_add("write_append_whole", f"{_WHOLE} UNION ALL {_CHANGED}")(lambda s, d: _written_whole(s, d, "append"))
_add("write_overwrite_whole", _CHANGED)(lambda s, d: _written_whole(s, d, "overwrite"))
_add("write_merge_whole", f"{_WHOLE} o WHERE NOT EXISTS (SELECT 1 FROM customer n WHERE n.c_custkey * 2 = o.c_custkey) UNION ALL {_CHANGED}")(lambda s, d: _written_whole(s, d, "merge"))


def _suppliers(spark: SparkSession, sf_dir: str) -> Engine:
    e = engine(spark, sf_dir, runtime.new_dir(spark, "catalog"))
    e.execute("CREATE TABLE s (id BIGINT PRIMARY KEY, name TEXT NOT NULL, nation INT, balance DOUBLE) WITH (compression = 'zstd')")
    rows = e.table("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    e.catalog.append("s", rows)
    return e


_S = "SELECT s_suppkey AS id, s_name AS name, s_nationkey AS nation, s_acctbal AS balance FROM supplier"


@_add("dml_insert", f"{_S} UNION ALL VALUES (1000001::BIGINT, 'new one', 3, 1.5::DOUBLE), (1000002, 'it''s new', 4, NULL)")
def dml_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _suppliers(spark, sf_dir)
    return e.sql("INSERT INTO s VALUES (1000001, 'new one', 3, 1.5), (1000002, 'it''s new', 4, NULL); SELECT * FROM s")


@_add("dml_update", f"SELECT id, CASE WHEN nation < 5 THEN name || '*' ELSE name END AS name, nation, CASE WHEN nation < 5 THEN balance * 2 ELSE balance END AS balance FROM ({_S})")
def dml_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _suppliers(spark, sf_dir).sql("UPDATE s SET balance = balance * 2, name = name || '*' WHERE nation < 5; SELECT * FROM s")


@_add("dml_delete", f"SELECT * FROM ({_S}) WHERE NOT (balance < 0 OR nation IN (1, 2))")
def dml_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _suppliers(spark, sf_dir).sql("DELETE FROM s WHERE balance < 0 OR nation IN (1, 2); SELECT * FROM s")


# files


@_add("copy_parquet", "SELECT n_nationkey AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation")
def copy_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark, runtime.new_dir(spark, "catalog"))
    e.execute("CREATE TABLE n (n_nationkey INT PRIMARY KEY, n_name TEXT, n_regionkey BIGINT)")
    io.copy_into(e.catalog, "n", f"{sf_dir}/nation.parquet", "parquet")
    return e.sql("SELECT * FROM n")


@_add("csv_roundtrip", "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey > 0")
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = runtime.new_dir(spark, "csv")
    io.write_csv(runtime.table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), path)
    return io.scan_csv(spark, path).filter(col("n_regionkey") > 0).df


@_add("parquet_roundtrip", "SELECT p_partkey, p_brand FROM part WHERE p_size < 10")
def parquet_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = runtime.new_dir(spark, "parquet")
    io.write_parquet(runtime.table(spark, sf_dir, "part"), path, "zstd")
    return io.scan_parquet(spark, path, io.ParquetOptions(["p_partkey", "p_brand"], col("p_size") < 10)).df


# an extension: windows over the event stream, here over the table


@_add("event_windows", "SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = runtime.table(spark, sf_dir, "events")
    out = feeds.windowed(events, "ts", "1 hour", ["event_type"], value="value")
    return out.withColumn("total", F.round("total", 4))


@_add("kv_prefix", "SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY \"timestamp\" DESC, sequence DESC) AS r FROM sstable_entries WHERE key LIKE 'user:%') WHERE r = 1 AND value IS NOT NULL")
def kv_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = runtime.table(spark, sf_dir, "sstable_entries").select("key", "value", "timestamp", "sequence")
    return apply_changes(log.filter(F.col("key").startswith("user:")), ["key"], ["timestamp", "sequence"], F.col("value").isNull()).select("key", "value")


# operators that the queries above don't reach; small outcomes come as rows

_dialect(
    "having_on_keys",
    "SELECT l_suppkey + 1 AS s, SUM(l_linenumber) - COUNT(*) AS d FROM lineitem GROUP BY l_suppkey HAVING l_suppkey > 10 AND MIN(l_linenumber) = 1",
    "SELECT l_suppkey + 1 AS s, CAST(sum(l_linenumber) - count(*) AS BIGINT) AS d FROM lineitem GROUP BY l_suppkey HAVING l_suppkey > 10 AND min(l_linenumber) = 1",
)
_dialect(
    "avg_distinct",
    "SELECT l_returnflag, AVG(DISTINCT l_linenumber) AS a, SUM(DISTINCT l_linenumber) AS s FROM lineitem GROUP BY l_returnflag",
    "SELECT l_returnflag, avg(DISTINCT l_linenumber) AS a, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY l_returnflag",
)


@_add("rowid_scan", "SELECT CAST(s AS BIGINT) AS segment, count(*) AS n_rows, count(*) AS n_ids, CAST(0 AS BIGINT) AS first_place, count(*) - 1 AS last_place FROM (SELECT CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END AS s FROM orders) GROUP BY s")
def rowid_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row ids of segments that are several files each."""
    orders = runtime.table(spark, sf_dir, "orders")
    store = segments.SegmentStore(spark, runtime.new_dir(spark, "segments"))
    store.write("orders", orders.filter("o_orderstatus = 'O'").repartition(4), row_group_size=1000)
    store.write("orders", orders.filter("o_orderstatus <> 'O'").repartition(3), row_group_size=1000)
    ids = store.scan("orders", ["o_orderkey"], row_ids=True)
    segment, place = segments.decode_row_id("row_id")
    return ids.select("row_id", segment, place).groupBy("segment").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("row_id").alias("n_ids"), F.min("offset").alias("first_place"), F.max("offset").alias("last_place"))


@_add("knn_late_materialisation", f"SELECT vec_id, label, round(0 - list_distance(embedding::DOUBLE[], {_Q}), 6) AS score FROM embeddings ORDER BY list_distance(embedding::DOUBLE[], {_Q}), vec_id LIMIT 15")
def knn_late_materialisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest row ids first, then the other columns of these rows."""
    store = segments.SegmentStore(spark, runtime.new_dir(spark, "segments"))
    store.write("embeddings", _vectors(spark, sf_dir).orderBy("vec_id").coalesce(1))
    found = store.search("embeddings", "embedding", _query(spark, sf_dir), "l2", 15, ["vec_id", "label"])
    return found.select("vec_id", "label", F.round("score", 6).alias("score"))


@_add("copy_csv", "SELECT n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation")
def copy_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = runtime.new_dir(spark, "csv").removeprefix("file://")
    io.write_csv(runtime.table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").repartition(2), path)
    e = Engine(spark, runtime.new_dir(spark, "catalog"))
    e.execute("CREATE TABLE n (n_nationkey INT PRIMARY KEY, n_name TEXT NOT NULL, n_regionkey BIGINT)")
    for f in io.data_files(path):
        io.copy_into(e.catalog, "n", f)
    return e.sql("SELECT * FROM n")


@_add("csv_options", "SELECT CAST(c_custkey AS INTEGER) AS column_1, c_name AS column_2, NULLIF(c_mktsegment, 'BUILDING') AS column_3 FROM customer WHERE c_custkey > 20")
def csv_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = runtime.new_dir(spark, "csv")
    runtime.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment").write.csv(path, sep=";")
    options = io.CsvOptions(has_header=False, delimiter=";", null_values=["BUILDING"], predicate=col("column_1") > 20)
    return io.scan_csv(spark, path, options).df


@_add("kv_scan", "SELECT n_name AS key, 'r' || n_regionkey AS value FROM nation WHERE n_name LIKE 'NATION_1%' AND n_nationkey <> 12 UNION ALL SELECT 'NATION_1x', 'new'")
def kv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs put, deleted and read by prefix in transactions."""
    store = kv.KeyValue(spark, runtime.new_dir(spark, "kv"))
    rows = runtime.table(spark, sf_dir, "nation").collect()  # 25 rows
    t = store.begin()
    for r in rows:
        t.put(r["n_name"].encode(), f"r{r['n_regionkey']}".encode())
    t.commit()
    t = store.begin()
    t.delete(next(r["n_name"] for r in rows if r["n_nationkey"] == 12).encode())
    t.put(b"NATION_1x", b"new")
    pairs = [(k.decode(), v.decode()) for k, v in t.scan_prefix(b"NATION_1")]
    t.rollback()
    return spark.createDataFrame(pairs, "key string, value string")


def _outcome(run: Callable[[], object]) -> str:
    """The class of error that a call raises, or what it gives."""
    try:
        return str(run())
    except errors.LakevecError as e:
        return type(e).__name__


@_add("write_modes", "SELECT * FROM (VALUES ('append, missing', 'None'), ('error, there', 'TableExists'), ('error, missing', 'WriteTargetNotFound'), ('ignore, missing', 'WriteTargetNotFound'), ('ignore, there', 'None'), ('merge without key', 'InvalidOption'), ('other', 'InvalidOption'), ('append, other columns', 'SchemaMismatch')) t(step, outcome) UNION ALL SELECT 'rows', CAST(count(*) AS VARCHAR) FROM nation")
def write_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Engine(spark, runtime.new_dir(spark, "catalog")).catalog
    n = runtime.table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    write = lambda table, mode, df=n: _outcome(lambda: c.write_table(df, "default", "default", table, mode))
    steps = [("append, missing", write("t", "append")), ("error, there", write("t", "error")), ("error, missing", write("u", "error")), ("ignore, missing", write("u", "ignore")), ("ignore, there", write("t", "ignore"))]
    steps += [("merge without key", write("t", "merge")), ("other", write("t", "upsert")), ("append, other columns", write("t", "append", n.select("n_name")))]
    return spark.createDataFrame([*steps, ("rows", str(c.read("t").count()))], "step string, outcome string")


@_add("constraints", "SELECT * FROM (VALUES ('null in a key', 'NullViolation'), ('null', 'NullViolation'), ('key there', 'ConstraintViolation'), ('key twice', 'ConstraintViolation'), ('update onto a key', 'ConstraintViolation'), ('dimension', 'DimensionMismatch'), ('type', 'TypeMismatch'), ('column missing', 'ColumnCountMismatch')) t(step, outcome) UNION ALL SELECT 'rows', CAST(count(*) AS VARCHAR) FROM region")
def constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements that break a constraint change nothing."""
    e = engine(spark, sf_dir, runtime.new_dir(spark, "catalog"))
    e.execute("CREATE TABLE r (id INT PRIMARY KEY, name TEXT NOT NULL, v VECTOR(2, L2))")
    rows = e.table("region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"), F.array(F.lit(0.0), F.lit(1.0)).cast("array<float>").alias("v"))
    e.catalog.append("r", rows)
    bad = {
        "null in a key": "INSERT INTO r VALUES (NULL, 'x', [1, 2])",
        "null": "INSERT INTO r VALUES (100, NULL, [1, 2])",
        "key there": "INSERT INTO r VALUES (0, 'x', [1, 2])",
        "key twice": "INSERT INTO r VALUES (100, 'x', [1, 2]), (100, 'y', [1, 2])",
        "update onto a key": "UPDATE r SET id = 1 WHERE id = 0",
        "dimension": "INSERT INTO r VALUES (100, 'x', [1, 2, 3])",
        "type": "INSERT INTO r VALUES ('a', 'x', [1, 2])",
        "column missing": "INSERT INTO r (id, name) VALUES (100, 'x')",
    }
    steps = [(k, _outcome(lambda q=q: e.execute(q))) for k, q in bad.items()]
    return spark.createDataFrame([*steps, ("rows", str(e.sql("SELECT * FROM r").count()))], "step string, outcome string")


@_add("drop_tables", "SELECT * FROM (VALUES ('tables', 'b'), ('indexes', '__pk_b'), ('again', 'TableNotFound'), ('if exists', 'Result(rows=None, affected=None)'), ('reserved', 'InvalidOption'), ('index gone', 'IndexNotFound')) t(step, outcome)")
def drop_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark, runtime.new_dir(spark, "catalog"))
    e.execute("CREATE TABLE a (id INT PRIMARY KEY); CREATE TABLE b (id INT PRIMARY KEY, v INT); CREATE INDEX i ON b (v); DROP TABLE a; DROP INDEX i")
    steps = [("tables", ",".join(e.catalog.list_tables())), ("indexes", ",".join(e.catalog.list_indexes()))]
    steps += [("again", _outcome(lambda: e.execute("DROP TABLE a"))), ("if exists", _outcome(lambda: e.execute("DROP TABLE IF EXISTS a")))]
    steps += [("reserved", _outcome(lambda: e.execute("DROP INDEX __pk_b"))), ("index gone", _outcome(lambda: e.execute("DROP INDEX i")))]
    return spark.createDataFrame(steps, "step string, outcome string")


@_add("catalog_tree", "SELECT * FROM (VALUES ('catalogs', 'default,lake'), ('namespaces', 'raw'), ('tables', 't'), ('not empty', 'NamespaceError'), ('bad name', 'InvalidOption'), ('default stays', 'NamespaceError'), ('after rollback', 'default,lake'), ('after force', 'default')) t(step, outcome)")
def catalog_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Engine(spark, runtime.new_dir(spark, "catalog")).catalog
    c.create_catalog("lake")
    c.create_namespace("lake", "raw")
    c.create_table("t", runtime.table(spark, sf_dir, "region").schema, "lake", "raw")
    names = lambda: ",".join(c.list_catalogs())
    steps = [("catalogs", names()), ("namespaces", ",".join(c.list_namespaces("lake"))), ("tables", ",".join(c.list_tables("lake", "raw")))]
    steps += [("not empty", _outcome(lambda: c.delete_catalog("lake"))), ("bad name", _outcome(lambda: c.create_namespace("lake", "9x"))), ("default stays", _outcome(lambda: c.delete_catalog("default", force=True)))]
    txn = c.begin()
    c.delete_catalog("lake", force=True)
    txn.rollback()
    steps.append(("after rollback", names()))
    c.delete_catalog("lake", force=True)
    return spark.createDataFrame([*steps, ("after force", names())], "step string, outcome string")


@_add("vec_upsert_get", "SELECT vec_id AS key, CASE WHEN label = 2 THEN 1.0::DOUBLE ELSE round(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]), 4) END AS square FROM embeddings WHERE label IN (2, 3)")
def vec_upsert_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of a label are replaced by unit ones and read back by key."""
    rows = _vectors(spark, sf_dir)
    one = F.transform("embedding", lambda x, i: F.when(i == 0, 1.0).otherwise(0.0).cast("float"))
    store = vector_search.VectorStore(spark, 64, "l2").append(rows, "vec_id", "embedding").upsert(rows.filter("label = 2").withColumn("embedding", one), "vec_id", "embedding")
    wanted = rows.filter("label IN (2, 3)").select(F.col("vec_id").alias("key"))
    return store.rows.filter("NOT deleted").join(wanted, "key", "left_semi").select("key", F.round(vectors.inner_product("vector", "vector"), 4).alias("square"))


@_add("indexed_search", f"SELECT vec_id AS id, round(list_distance(embedding::DOUBLE[], {_Q}), 5) AS score FROM embeddings WHERE label <> 1 ORDER BY list_distance(embedding::DOUBLE[], {_Q}), vec_id LIMIT 10")
def indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table with a vector index: rows are deleted after it was made, and the search call sees that."""
    e = Engine(spark, runtime.new_dir(spark, "catalog"))
    e.execute("CREATE TABLE items (id BIGINT PRIMARY KEY, label INT, v VECTOR(64, L2))")
    e.catalog.append("items", _vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("v")))
    e.execute("CREATE INDEX near ON items (v) USING HNSW WITH (m = 8, ef_construction = 32); DELETE FROM items WHERE label = 1")
    return e.vector_search("items", "v", _query(spark, sf_dir), "l2", 10).select("id", F.round("score", 5).alias("score"))


@_add("cursor", "SELECT o_orderkey FROM orders WHERE o_totalprice > 400000")
def cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a SELECT one after another, partition by partition, and back."""
    found = engine(spark, sf_dir).stream("SELECT o_orderkey FROM orders WHERE o_totalprice > 400000")
    return spark.createDataFrame([(r["o_orderkey"],) for r in found], "o_orderkey long")
