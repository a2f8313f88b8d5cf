import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from lakevec import errors
from lakevec.operators import segments, stats
from lakevec.plans.frame import Frame, all_columns, col, lit
from lakevec.session import Engine
from lakevec.sources import io


@pytest.fixture
def gv(spark):
    return Frame.from_columns(spark, {"g": ["x", "x", "y", "y", "y"], "v": [10, None, 3, 7, None]}, "g string, v long")


def test_aggregates(gv):
    v = col("v")
    out = gv.group_by("g").agg(v.sum().alias("s"), v.mean().alias("m"), v.min().alias("lo"), v.max().alias("hi"), v.count().alias("n"), lit(1).count().alias("rows"))
    assert out.df.columns == ["g", "s", "m", "lo", "hi", "n", "rows"]
    assert sorted(out.rows()) == [("x", 10, 10.0, 10, 10, 1, 2), ("y", 10, 5.0, 3, 7, 2, 3)]


def test_aggregate_errors(gv):
    with pytest.raises(errors.TypeMismatch):
        gv.group_by("v").agg(col("g").sum())
    with pytest.raises(errors.InvalidOption):
        gv.group_by()
    with pytest.raises(errors.Unsupported):
        (col("v") + 1).sum()
    with pytest.raises(errors.Unsupported):
        gv.group_by((col("v") + 1).alias("q")).agg(col("v").sum())


def test_with_columns_sees_the_frame_before(spark):
    ab = Frame.from_columns(spark, {"a": [1, 2, 3], "b": [10, 20, 30]}, "a long, b long")
    out = ab.with_columns((col("a") + col("b")).alias("c"), (col("a") + 1).alias("a"))
    assert out.df.columns == ["a", "b", "c"] and sorted(out.rows()) == [(2, 10, 11), (3, 20, 22), (4, 30, 33)]
    with pytest.raises(errors.InvalidOption):
        ab.with_columns(col("a") + 1)
    assert ab.select(all_columns(), col("a").alias("z")).df.columns == ["a", "b", "z"]
    assert sorted(ab.filter(col("a") > 1).rows()) == sorted(ab.lazy().filter(col("a") > 1).collect().rows()) == [(2, 20), (3, 30)]
    for bad in (lambda: ab.filter(col("a")), lambda: ab.filter(col("a") == "x"), lambda: ab.select("A"), lambda: ab.select(~col("a"))):
        with pytest.raises(errors.LakevecError):
            bad()


def test_division(spark):
    f = Frame.from_columns(spark, {"a": [1.0, -1.0, 0.0, None], "b": [0.0, 0.0, 0.0, 0.0]}, "a double, b double")
    out = [r[0] for r in f.select((col("a") / col("b")).alias("q")).rows()]
    assert out[0] == math.inf and out[1] == -math.inf and math.isnan(out[2]) and out[3] is None


def test_bad_frames(spark):
    with pytest.raises(errors.SchemaMismatch):
        Frame.from_columns(spark, {"a": [1], "b": [1, 2]}, "a long, b long")
    with pytest.raises(errors.TypeMismatch):
        Frame.from_columns(spark, {"a": ["x"]}, "a long")


def test_pushdown_is_equivalent(spark, tmp_path):
    p = str(tmp_path / "p")
    io.write_parquet(Frame.from_columns(spark, {"a": [1, 2, 3], "b": ["x", "y", "z"], "c": [10, 20, None]}, "a long, b string, c long"), p)
    out = io.scan_parquet(spark, p).filter(col("c") > 10).select("a", "b")
    assert out.collect().rows() == [(2, "y")]
    assert "c#" in out.explain() and "Relation" in out.explain(optimized=False)
    assert io.read_parquet(spark, p, io.ParquetOptions(["b"], col("a") > 1)).height() == 2
    with pytest.raises(errors.Unsupported):
        io.scan_parquet(spark, p, io.ParquetOptions(row_groups=[0]))


def test_csv_options(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a;b\n1;x\nNA;y\n3;\n")
    out = io.read_csv(spark, str(tmp_path / "a.csv"), io.CsvOptions(delimiter=";", null_values=["NA", ""]))
    assert out.rows() == [(1, "x"), (None, "y"), (3, None)]
    assert io.read_csv(spark, str(tmp_path / "a.csv")).width == 1
    (tmp_path / "b.csv").write_text("1,10\n2,20\n")
    none = io.read_csv(spark, str(tmp_path / "b.csv"), io.CsvOptions(has_header=False))
    assert none.rows() == [(1, 10), (2, 20)]
    assert io.read_csv(spark, str(tmp_path / "b.csv"), io.CsvOptions(has_header=False, projection=["column_2"], predicate=col("column_1") > 1)).rows() == [(20,)]
    with pytest.raises(errors.InvalidOption):
        io.read_csv(spark, str(tmp_path / "b.csv"), io.CsvOptions(delimiter="\0"))


@pytest.fixture
def loaded(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"))
    e.execute("CREATE TABLE t (id INT PRIMARY KEY, ok BOOLEAN, at TIMESTAMP, name TEXT, v VECTOR(2))")
    return e


def test_copy_csv(spark, loaded, tmp_path):
    f = tmp_path / "t.csv"
    f.write_text("id,ok,at,name,v\n1, true ,1000000,ann,[1, 2.5]\n\n2,0,NULL,null,null\n")
    assert io.copy_into(loaded.catalog, "t", str(f), allowed=[str(tmp_path)]) == 2
    assert loaded.sql("SELECT * FROM t ORDER BY id").collect() == [(1, True, dt.datetime(1970, 1, 1, 0, 0, 1), "ann", [1.0, 2.5]), (2, False, None, None, None)]
    with pytest.raises(errors.ConstraintViolation):
        io.copy_into(loaded.catalog, "t", str(f))
    f.write_text("id,ok,at,nom,v\n3,1,1,x,[1,2]\n")
    with pytest.raises(errors.SchemaMismatch):
        io.copy_into(loaded.catalog, "t", str(f))
    f.write_text("3,1,1,x,[1,2,3]\n")
    with pytest.raises(Exception, match="dimension 2"):
        io.copy_into(loaded.catalog, "t", str(f), header=False)
    assert loaded.sql("SELECT count(*) FROM t").first()[0] == 2


def test_copy_paths(loaded, tmp_path):
    f = tmp_path / "x.csv"
    f.write_text("")
    (tmp_path / "link.csv").symlink_to(f)
    for path, allowed in ((str(tmp_path / "no.csv"), None), (str(tmp_path / "link.csv"), None), (str(f), [str(tmp_path / "db")])):
        with pytest.raises(errors.PathNotAllowed):
            io.copy_into(loaded.catalog, "t", path, allowed=allowed)


def test_copy_parquet_widens(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"))
    e.execute("CREATE TABLE t (a BIGINT, b DOUBLE)")
    spark.createDataFrame([(1, 2.5)], "a int, b float").write.parquet(str(tmp_path / "p"))
    assert io.copy_into(e.catalog, "t", str(tmp_path / "p"), "parquet") == 1
    spark.createDataFrame([("x", 2.5)], "a string, b float").write.parquet(str(tmp_path / "q"))
    with pytest.raises(errors.TypeMismatch):
        io.copy_into(e.catalog, "t", str(tmp_path / "q"), "parquet")


def test_render(spark):
    df = spark.createDataFrame([(1, 'a"b', True), (2, None, False)], "n int, s string, b boolean").coalesce(1)
    assert io.render(df, "csv") == 'n,s,b\n1,"a""b",true\n2,,false\n'
    assert io.render(df, "jsonl", 1) == '{"n": 1, "s": "a\\"b", "b": true}\n'
    assert io.render(df, "tsv").splitlines()[2] == "2\t\tfalse"
    assert io.render(df, "json").startswith("[{") and "| n |" in io.render(df)


def test_segments(spark, tmp_path):
    store = segments.SegmentStore(spark, str(tmp_path / "s"))
    df = spark.createDataFrame([(1, 10), (2, 20)], "id long, val long").coalesce(1)
    assert [store.write("t", df), store.write("t", df.withColumn("val", F.col("val") + 1))] == [0, 1]
    assert store.list() == [("t", 0), ("t", 1)] and [r.val for r in store.read("t", 0, ["val"]).collect()] == [10, 20]
    assert store.statistics("t", 1)["row_count"] == 2 and len(list(store.batches("t", 0))) == 2
    ids = store.scan("t", ["val"], F.col("id") == 2, row_ids=True)
    assert sorted((r.val, r.row_id) for r in ids.collect()) == [(20, 1), (21, (1 << 44) + 1)]
    assert segments.fetch_by_row_id(store.scan("t", row_ids=True), ids).count() == 2
    (tmp_path / "i.csv").write_text("id|val\n7|70\n")
    assert store.ingest("c", str(tmp_path / "i.csv"), "csv", "|") == 0 and store.read("c", 0).collect() == [(7, 70)]
    assert store.write("b", df, bloom=["id"]) == 0 and store.read("b", 0, where=F.col("id") == 2).count() == 1
    with pytest.raises(errors.LakevecError):
        store.read("t", 9)
    store.drop("t", 0)
    assert store.list("t") == [("t", 1)]


def test_stats(spark):
    df = spark.createDataFrame([(1, "b", [1]), (None, "a", None), (11, None, [2])], "n long, s string, l array<int>")
    got = {r["column"]: tuple(r)[1:] for r in stats.column_stats(df, distinct=True).collect()}
    assert got == {"n": ("1", "11", 2, 1, 2), "s": ("a", "b", 2, 1, 2), "l": (None, None, 2, 1, 2)}
    parts = stats.column_stats(df.filter("n = 1")).unionByName(stats.column_stats(df.filter("n = 11"))).unionByName(stats.column_stats(df.limit(0)))
    merged = {r["column"]: (r.min_value, r.max_value, r.n_values) for r in stats.merge_stats(parts, ["n"]).collect()}
    assert merged["n"] == ("1", "11", 2)
