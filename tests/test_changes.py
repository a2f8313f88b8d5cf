import random

import pytest
from pyspark.sql import functions as F

from lakevec.operators.changes import apply_changes, change_counts
from lakevec.sources.catalog import Catalog
from lakevec.streaming import feeds

KIND = "key string, value string, timestamp long, sequence long"


def brute(rows):
    last = {}
    for k, v, t, s in rows:
        if k is not None and (k not in last or (t, s) >= last[k][:2]):
            last[k] = (t, s, v)
    return {(k, v, t, s) for k, (t, s, v) in last.items() if v is not None}


def run(spark, rows, base=None, **k):
    df = spark.createDataFrame(rows, KIND)
    b = spark.createDataFrame(base, KIND) if base is not None else None
    return {tuple(r) for r in apply_changes(df, ["key"], ["timestamp", "sequence"], F.col("value").isNull(), b, **k).collect()}


def test_any_order_and_repeats(spark):
    r = random.Random(5)
    distinct = {(r.choice("abcdé"), r.randrange(20), r.randrange(5)) for _ in range(200)}
    rows = [(k, r.choice(["", "NULL", "x", None]), t, s) for k, t, s in distinct]
    rows += [(None, "v", 1, 1)] * 3
    want = brute(rows)
    for _ in range(3):
        again = rows + r.sample(rows, 50)
        r.shuffle(again)
        assert run(spark, again) == want


def test_edges(spark):
    assert run(spark, []) == set()
    # look-alike keys are different, a null position is the oldest, an empty value is a value
    assert run(spark, [("k", "a", 1, 1), ("K", "b", 1, 1), ("k ", "c", 1, 1), ("k", "old", None, 9), ("k", "", 2, None)]) == {("k", "", 2, None), ("K", "b", 1, 1), ("k ", "c", 1, 1)}
    base = [("a", "1", 5, 0), ("b", "1", 5, 0)]
    assert run(spark, [("a", None, 6, 0), ("b", "2", 4, 0), ("c", "3", 1, 0)], base) == {("b", "1", 5, 0), ("c", "3", 1, 0)}
    # a delete in the base beats an older change that comes late, as in a replay of the whole feed
    first, late = [("a", "v", 1, 0), ("a", None, 10, 0), ("b", "w", 3, 0)], [("a", "late", 7, 0), ("b", None, 2, 0)]
    state = run(spark, first, keep_deletes=True)
    assert state == {("a", None, 10, 0), ("b", "w", 3, 0)}
    assert run(spark, late, sorted(state)) == run(spark, first + late) == {("b", "w", 3, 0)}
    assert run(spark, [("a", "x", 1, 1), ("a", "y", 1, 1)], tie=["value"]) == {("a", "y", 1, 1)}


def test_clashing_columns(spark):
    df = spark.createDataFrame([("a", "1", 1, 1)], KIND).withColumn("__lv_delete", F.lit(7)).withColumn("__lv_rank", F.lit(8)).withColumn("n", F.lit(1))
    out = apply_changes(df, ["key"], ["timestamp", "sequence"], F.col("value").isNull())
    assert out.columns == df.columns and tuple(out.first())[4:6] == (7, 8)


def test_hot_key_is_pruned_before_the_shuffle(spark):
    key = F.when(F.col("id") > 900, "rare").otherwise("hot")
    df = spark.range(1000).select(key.alias("key"), F.lit("v").alias("value"), F.col("id").alias("timestamp"), F.lit(0).cast("long").alias("sequence"))
    out = apply_changes(df, ["key"], ["timestamp", "sequence"], F.col("value").isNull())
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert {r["timestamp"] for r in out.collect()} == {900, 999}


def test_counts(spark):
    df = spark.createDataFrame([("a", "1", 1, 1), ("a", "1", 1, 1), ("a", None, 2, 1), (None, "x", 1, 1), (None, "x", 1, 1)], KIND)
    assert tuple(change_counts(df, ["key"], ["timestamp", "sequence"], F.col("value").isNull()).first()) == (5, 2, 2, 1, 1, 1)
    assert tuple(change_counts(df.limit(0), ["key"], ["timestamp", "sequence"], F.col("value").isNull()).first()) == (0, 0, 0, 0, 0, 0)


@pytest.fixture
def feed(spark, tmp_path):
    rows = [("a", "1", 1, 1), ("b", "2", 2, 1), ("a", None, 3, 1), ("b", "old", 1, 0), ("c", "4", 4, 0)]
    for i, part in enumerate((rows[:2], rows[2:], rows[:3])):
        spark.createDataFrame(part, KIND).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    return spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))


def test_stream_of_changes(spark, tmp_path, feed):
    cat = Catalog(spark, str(tmp_path / "cat"))
    q = feeds.changes_into(feed, cat, "t", ["key"], ["timestamp", "sequence"], str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert {tuple(r)[:2] for r in feeds.present(cat, "t", F.col("value").isNull()).collect()} == {("b", "2"), ("c", "4")}


def test_stream_windows_and_search(spark, tmp_path):
    spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.9, 0.1])], "key long, vector array<float>").write.parquet(str(tmp_path / "v"))
    stream = spark.readStream.schema("key long, vector array<float>").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "v"))
    cat = Catalog(spark, str(tmp_path / "cat"))
    feeds.search_stream(stream, [1.0, 0.0], "cosine", 2, cat, "best", str(tmp_path / "ck")).awaitTermination(120)
    assert {r.key for r in cat.read("best").collect()} == {1, 3}
    events = spark.sql("SELECT timestamp_micros(id * 1000000) AS ts, 1.0 AS value FROM range(120)")
    assert sorted(r.n for r in feeds.windowed(events, "ts", "1 minute", value="value").collect()) == [60, 60]
    events.write.parquet(str(tmp_path / "e"))
    live = feeds.windowed(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")), "ts", "1 minute", late="10 seconds")
    q = live.writeStream.format("memory").queryName("w").outputMode("append").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("w").count() >= 1
