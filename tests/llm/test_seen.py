import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakevec.llm import seen


@given(st.integers(1, 62), st.lists(st.integers(0, 2**62 - 1), max_size=300), st.lists(st.integers(0, 2**62 - 1), max_size=50))
def test_round_trip_probe_and_merge(bits, values, more):
    top = np.uint64((1 << bits) - 1)
    v, w = (np.unique(np.array(x, dtype=np.uint64) & top) for x in (values, more))
    ef = seen.EliasFano.encode(v, bits)
    assert (ef.decode() == v).all()
    probes = np.concatenate([v, w, np.array([0, top], dtype=np.uint64)])
    assert (ef.contains(probes) == np.isin(probes, v)).all()
    assert (ef.merge(w).decode() == np.union1d(v, w)).all()


def test_size():
    v = np.unique(np.random.default_rng(1).integers(0, 1 << 46, 50_000, dtype=np.uint64))
    ef = seen.EliasFano.encode(v, 46)
    assert 8 * (len(ef.high) + len(ef.low)) / len(v) < 2 + 46 - np.log2(len(v)) + 1.5


def brute(history, incoming):
    known, out = {k for k in history if k is not None}, set()
    for i, k in sorted(incoming):
        if k is not None:
            if k in known:
                out.add(i)
            known.add(k)
    return out


def run(spark, history, incoming, **k):
    h = spark.createDataFrame([(x,) for x in history], "key string").withColumn("part", F.lit(1))
    i = spark.createDataFrame(incoming, "id long, key string").withColumn("mark", F.lit("m"))
    return {r.id for r in seen.seen_before(h, i, "key", "id", **k).collect()}


HISTORY = ["a", "a", "A", None, "", "é", "x "]
INCOMING = [(5, "n"), (3, "a"), (9, "n"), (1, None), (2, ""), (4, "é"), (6, "x"), (7, "X"), (8, None), (10, "hot"), *[(i, "hot") for i in range(11, 60)]]


def test_is_brute_force(spark):
    assert run(spark, HISTORY, INCOMING) == brute(HISTORY, INCOMING)


def test_repeats_in_the_same_and_in_later_batches(spark, monkeypatch):
    merged, real = [], seen.merge_batch
    monkeypatch.setattr(seen, "merge_batch", lambda *a: merged.append(1) or real(*a))
    rows = [(100 + i, f"k{i % 37}" if i % 5 else None) for i in range(200)]
    for batches in (1, 2, 7):
        merged.clear()
        assert run(spark, HISTORY, rows, batches=batches) == brute(HISTORY, rows) and len(merged) == batches - 1


def test_empty_tables(spark):
    assert run(spark, [], []) == set() and run(spark, ["a"], []) == set()
    assert run(spark, [], INCOMING) == brute([], INCOMING) and run(spark, [None], [(1, "a")]) == set()


def test_extra_columns_stay(spark):
    h = spark.createDataFrame([("a",)], "key string")
    i = spark.createDataFrame([(1, "a", 7, 8, 9)], "id long, key string, first int, part int, mark int")
    assert tuple(seen.seen_before(h, i, "key", "id").first()) == (1, "a", 7, 8, 9)


def test_many_partitions_and_batches(spark):
    keys = [f"k{i}" for i in range(3000)]
    parts, bits = seen.plan(3000, per_partition=200)
    assert parts == 15
    index = seen.build_index(spark.createDataFrame([(k,) for k in keys[:1000]], "key string"), "key", parts, bits)
    known = set(keys[:1000])
    for a, b in ((500, 1500), (1400, 3000)):
        batch = spark.createDataFrame([(i, keys[i]) for i in range(a, b)], "id long, key string")
        new = {r["first"] for r in seen.unseen(index, batch, "key", "id", parts, bits).collect()}
        assert new == {i for i in range(a, b) if keys[i] not in known}
        index = seen.merge_batch(index, batch, "key", parts, bits)
        known |= set(keys[a:b])
    assert index.agg(F.sum("n")).first()[0] == len(known)


def test_report_measures_wrong_answers(spark):
    history = spark.createDataFrame([(f"h{i}",) for i in range(2000)], "key string")
    incoming = spark.range(3000).select("id", F.concat(F.lit("n"), "id").alias("key"), (F.col("id") % 2).cast("int").alias("config_id"))
    configs = spark.createDataFrame([(0, 0.2), (1, None)], "config_id int, fpr double")
    coarse = {r.config_id: r for r in seen.report(history, incoming, configs, "key", "id", "config_id", "fpr", wrong_rate=0.1).collect()}
    assert 0 < coarse[0].wrong_rate <= 0.2 and coarse[0].within and not coarse[1].within
    strict = {r.config_id: r for r in seen.report(history, incoming, configs, "key", "id", "config_id", "fpr").collect()}
    assert seen.strictest(configs, "fpr") == 0.2 and seen.strictest(configs.limit(0), "fpr") == seen.WRONG_RATE
    assert 0 < strict[0].wrong_rate <= 0.2 and strict[0].within
    exact = seen.report(history, incoming, configs, "key", "id", "config_id", "fpr", wrong_rate=seen.WRONG_RATE).collect()
    assert all(r.n_wrong == 0 and r.within and r.n_records == 1500 for r in exact)


@pytest.mark.parametrize(("keys", "rate"), [(1, 0.5), (10**9, 2**-30)])
def test_plan(keys, rate):
    parts, bits = seen.plan(keys, rate)
    assert parts >= 1 and min(keys, seen.KEYS_PER_PARTITION) / 2**bits <= rate
