import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from lakevec import errors
from lakevec.functions import vector as V
from lakevec.operators import vector_search as S

ROWS = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, [1.0, 0.0]), (5, None)]


@pytest.fixture
def df(spark):
    return spark.createDataFrame(ROWS, "key long, vector array<float>")


def brute(q, metric, k):
    def score(v):
        dot = sum(a * b for a, b in zip(q, v))
        if metric == "inner":
            return dot
        if metric == "l2":
            return -math.dist(q, v)
        n = math.hypot(*q) * math.hypot(*v)
        return dot / n if n else 0.0

    return [k_ for k_, _ in sorted(((k_, score(v)) for k_, v in ROWS if v), key=lambda x: (-round(x[1], 9), x[0]))][:k]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-3, 3), min_size=2, max_size=2), st.sampled_from(["cosine", "l2", "inner"]), st.integers(0, 4))
def test_flat_search_is_brute_force(df, q, metric, k):
    assert [r.key for r in S.search_flat(df, q, metric, k).collect()] == brute(q, metric, k)


def test_ties_go_by_key_and_filters_come_first(df):
    assert [r.key for r in S.search_flat(df, [1.0, 0.0], "inner", 2).collect()] == [1, 4]
    assert [r.key for r in S.search_similar(df.filter("key < 5"), [1.0, 0.0], "cosine", 9, [2, 4]).collect()] == [4, 2]
    for bad in (lambda: S.search_flat(df, [], "l2", 1), lambda: S.search_flat(df, [1.0], "dot", 1), lambda: S.search_flat(df, [1.0], "l2", -1), lambda: S.search_similar(df, [1.0, 0.0], "l2", 1, stored_metric="cosine")):
        with pytest.raises(errors.LakevecError):
            bad()
    with pytest.raises(SparkRuntimeException):
        S.search_similar(df, [1.0], "l2", 1).collect()


def test_functions(df):
    one = lambda c: df.filter("key = 1").select(c).first()[0]
    assert one(V.vector_similarity("vector", [3.0, 4.0], "cosine")) == pytest.approx(0.6)
    assert one(V.score("vector", [4.0, 4.0], "l2")) == -5.0 and one(V.norm("vector")) == 1.0
    with pytest.raises(SparkRuntimeException):
        df.select(V.vector_similarity("vector", [1.0, 0.0], "l2")).collect()
    assert df.filter(V.finite("vector")).count() == 4


def test_lsh_finds_the_nearest(spark):
    rows = [(i, [math.cos(i / 50), math.sin(i / 50), float(i % 3) / 100]) for i in range(300)]
    df = spark.createDataFrame(rows, "key long, vector array<float>")
    for metric in ("cosine", "l2"):
        exact = {r.key for r in S.search_flat(df, [1.0, 0.0, 0.0], metric, 10).collect()}
        near = {r.key for r in S.search_lsh(df, [1.0, 0.0, 0.0], metric, 10).collect()}
        assert len(exact & near) >= 8
    with pytest.raises(errors.Unsupported):
        S.search_lsh(df, [1.0, 0.0, 0.0], "inner", 3)


def test_store(spark, df):
    store = S.VectorStore(spark, 2, "l2").append(df.filter("key < 5"))
    store = store.delete(spark.createDataFrame([(1,), (99,)], "key long"))
    s = store.statistics().first()
    assert (s.active_count, s.deleted_count, s.deletion_ratio, s.norm_max) == (3, 1, 0.25, 1.0)
    assert store.needing_compaction().count() == 0 and store.needing_compaction(0.2).count() == 1
    assert store.compact([0]).rows.count() == 3
    found, seen = store.search([1.0, 0.0], 2)
    assert [r.key for r in found.collect()] == [4, 3] and seen.get["rows_scanned"] == 4 and seen.get["rows_matched"] == 3
    assert [r.key for r in store.get([1, 2]).collect()] == [2]
    again = store.upsert(spark.createDataFrame([(4, [9.0, 9.0])], "key long, vector array<float>"))
    assert [r.key for r in again.search([9.0, 9.0], 1)[0].collect()] == [4] and again.rows.count() == 4
    for bad in (lambda: store.search([1.0], 1), lambda: store.search([1.0, 0.0], 1, "cosine"), lambda: S.VectorStore(spark, 0, "l2")):
        with pytest.raises(errors.LakevecError):
            bad()
    with pytest.raises(SparkRuntimeException):
        store.append(spark.createDataFrame([(7, [1.0, float("nan")])], "key long, vector array<float>")).rows.collect()


def test_norm_stats(df):
    r = S.norm_stats(df.withColumn("g", F.lit(1)), "g", "vector").first()
    assert (r.n, r.norm_min, r.norm_max) == (4, 0.0, 1.0)
