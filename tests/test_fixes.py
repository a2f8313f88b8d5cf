import pytest
from pyspark.sql import functions as F

from lakevec import errors
from lakevec.operators import segments, stats
from lakevec.session import Engine
from lakevec.sources import io


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def engine(spark):
    e = Engine(spark)
    e.register("t", spark.createDataFrame([(1, 9), (1, 1), (1, 1), (2, 4), (None, 7), (2, None)], "k int, x int"))
    return e


def test_having_sees_keys_and_aggregates(engine):
    with pytest.raises(errors.Unsupported):
        engine.sql("SELECT k FROM t GROUP BY k HAVING x > 5")
    assert rows(engine.sql("SELECT k, COUNT(*) AS n FROM t GROUP BY k HAVING k IS NOT NULL")) == [(1, 3), (2, 2)]
    assert rows(engine.sql("SELECT k + 1 AS a, SUM(x) - COUNT(x) AS b FROM t GROUP BY k HAVING k > 0 AND MAX(x) >= 4")) == [(2, 8), (3, 3)]
    assert rows(engine.sql("SELECT COUNT(*) AS n FROM t HAVING COUNT(*) > 100")) == []
    with pytest.raises(errors.Unsupported):
        engine.sql("SELECT x, COUNT(*) FROM t GROUP BY k")
    with pytest.raises(errors.ColumnNotFound):
        engine.sql("SELECT k FROM t GROUP BY k HAVING nope > 1")


def test_avg_distinct(engine):
    assert rows(engine.sql("SELECT k, AVG(DISTINCT x) AS a, AVG(x) AS b FROM t WHERE k = 1 GROUP BY k")) == [(1, 5.0, 11 / 3)]
    assert rows(engine.sql("SELECT AVG(DISTINCT x) AS a FROM t WHERE x IS NULL")) == [(None,)]


def test_copy_keeps_lines_equal_to_the_header(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"))
    e.execute("CREATE TABLE c (a TEXT, b TEXT)")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.csv").write_text("\na,b\nx,y\na,b\n")
    (tmp_path / "in" / "2.csv").write_text("a,b\na,b\n")
    assert io.copy_into(e.catalog, "c", str(tmp_path / "in")) == 3
    assert rows(e.sql("SELECT * FROM c")) == [("a", "b"), ("a", "b"), ("x", "y")]


def test_dml_under_a_root_with_odd_characters(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "a b%20c"))
    e.execute("CREATE TABLE s (id INT PRIMARY KEY, v INT); INSERT INTO s VALUES (1, 1), (2, 2); INSERT INTO s VALUES (3, 3)")
    assert e.execute("UPDATE s SET v = v * 10 WHERE id >= 2").affected == 2
    assert e.execute("DELETE FROM s WHERE id = 1").affected == 1
    assert rows(e.sql("SELECT * FROM s")) == [(2, 20), (3, 30)]


def test_merged_statistics_of_large_numbers(spark):
    big = 2**53
    parts = [("a", str(big), str(big)), ("a", str(big + 1), str(big + 1)), ("a", "9", "9"), ("f", "1.5", "-2e3"), ("f", "-10.25", "7")]
    s = spark.createDataFrame([(*p, 1, 0) for p in parts], "column string, min_value string, max_value string, n_values long, null_count long")
    assert rows(stats.merge_stats(s, ["a", "f"]).select("column", "min_value", "max_value")) == [("a", "9", str(big + 1)), ("f", "-10.25", "7")]


def test_row_ids_of_a_segment_of_several_files(spark, tmp_path):
    store = segments.SegmentStore(spark, str(tmp_path / "segments"))
    for part in range(2):
        store.write("t", spark.range(500).select((F.col("id") + 500 * part).alias("id"), F.array(F.col("id").cast("float"), F.lit(float(part))).alias("v"), F.lit("wide").alias("w")).repartition(4))
    ids = store.scan("t", ["id"], row_ids=True)
    assert ids.select("row_id").distinct().count() == 1000
    assert rows(ids.select(*segments.decode_row_id("row_id")).groupBy("segment").agg(F.min("offset"), F.max("offset"))) == [(0, 0, 499), (1, 0, 499)]
    found = store.search("t", "v", [3.2, 1.0], "l2", 3, ["id", "w"]).orderBy(F.desc("score"))
    assert [(r.id, r.w) for r in found.collect()] == [(503, "wide"), (504, "wide"), (3, "wide")]


def test_merge_writes_only_touched_files_and_computes_once(spark, tmp_path):
    c = Engine(spark, str(tmp_path / "db 1")).catalog
    kind = "id int, v string"
    write = lambda rows, mode, key=None: c.write_table(spark.createDataFrame(rows, kind), "default", "default", "t", mode, key)
    write([(1, "a"), (2, "b")], "append")
    write([(10, "x"), (None, "n")], "append")
    before = c.get_table("t")["paths"]
    calls = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            calls.add(len(b))
            yield b

    new = spark.createDataFrame([(2, "bb"), (3, "c"), (None, "m")], kind).coalesce(1).mapInPandas(count, kind)
    c.write_table(new, "default", "default", "t", "merge", ["id"])
    assert sorted(map(tuple, c.read("t").collect()), key=str) == sorted([(1, "a"), (2, "bb"), (3, "c"), (10, "x"), (None, "m"), (None, "n")], key=str)
    assert before[1] in c.get_table("t")["paths"] and before[0] not in c.get_table("t")["paths"]
    assert calls.value == 3
    write([(99, "z")], "merge", ["id"])
    assert c.read("t").count() == 7


def test_row_group_size_reaches_the_files(spark, tmp_path):
    import pyarrow.parquet as pq

    e = Engine(spark, str(tmp_path / "db"))
    e.execute("CREATE TABLE c (id BIGINT) WITH (storage = 'columnar', row_group_size = 1000, compression = 'zstd')")
    e.catalog.append("c", spark.range(3500).coalesce(1))
    [f] = e.catalog.files.parquet_files(e.catalog.get_table("c")["paths"][0])
    meta = pq.ParquetFile(f.removeprefix("file:")).metadata
    assert [meta.row_group(i).num_rows for i in range(meta.num_row_groups)] == [1000, 1000, 1000, 500]
    assert meta.row_group(0).column(0).compression == "ZSTD"
