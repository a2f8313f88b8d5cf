import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakevec.operators import compaction as C
from lakevec.sources.files import Files

ENTRY = "entry_id long, file_id long, key string, value string, timestamp long"


@pytest.mark.parametrize(("bits", "n"), [(3, 2), (2, 3), (1, 2), (4, 1)])
def test_the_curve_visits_neighbours(bits, n):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=n)))
    codes = C.hilbert_codes(cells, bits)
    assert sorted(codes) == list(range(len(cells)))
    assert np.abs(np.diff(cells[np.argsort(codes)], axis=0)).sum(axis=1).max() == 1


def test_cells_are_cut_at_the_quantiles_of_all_rows(spark):
    """20,000 skewed rows with a hot value, nulls, negative zero, NaN and infinities; a column without values; the same from one task or many."""
    n = 20000
    i = F.col("id")
    number = F.when(i % 9 == 0, None).when(i % 4 == 0, 5.0).when(i % 1001 == 0, float("nan")).when(i % 1003 == 0, float("-inf")).when(i % 1007 == 0, -0.0).otherwise(F.exp((i * 7919 % n) / 1000.0))
    text = F.when(i % 10 == 0, None).when(i % 3 == 0, "hot").otherwise(F.concat(F.when(i % 2 == 0, "é").otherwise("z"), F.hash("id").cast("string")))
    df = spark.range(n).select("id", number.alias("x"), text.alias("s"), F.lit(None).cast("long").alias("none"))
    kept = df.orderBy("id").toPandas()
    for bits in (6, 3):
        cells = []
        for c in ("x", "s"):
            there = kept[c].notna().to_numpy()
            v = np.array([u.encode() for u in kept[c][there]], dtype=object) if c == "s" else kept[c][there].to_numpy(dtype=float)
            edges = np.sort(v)[(np.arange(1, 1 << bits) * len(v)) >> bits]
            cell = np.zeros(n, dtype=np.int64)
            cell[there] = np.searchsorted(edges, v, side="right")
            cells.append(cell)
        want = C.hilbert_codes(np.stack([*cells, np.zeros(n, dtype=np.int64)], axis=1), bits)
        for parts in (1, 7):
            got = C.with_codes(df.repartition(parts), ["x", "s", "none"], "code", bits).orderBy("id").select("code").toPandas()["code"]
            assert (got.to_numpy() == want).all()


def test_edges_of_few_values(spark):
    df = spark.createDataFrame([(3.0, None), (1.0, None), (None, None), (1.0, "b")], "a double, b string")
    assert C._edges(df, 2) == [[1.0, 1.0, 3.0], ["b"] * 3] and C._edges(df.limit(0), 2) == [[], []]


def rows(spark, n=2000):
    """A third of the rows under one key and store, nulls in all other columns, repeated payloads."""
    hot = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 97))
    return spark.range(n).select(
        F.col("id").alias("entry_id"),
        F.when(F.col("id") % 3 == 0, "big").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("g"),
        F.when(F.col("id") % 11 == 0, None).otherwise(hot).alias("key"),
        F.when(F.col("id") % 13 == 0, None).otherwise(F.col("id") % 10).alias("timestamp"),
        F.lit("lv").alias("lv_code"),
    )


def test_files_are_even_and_whole(spark, tmp_path):
    df = rows(spark)
    total = df.agg(F.sum(C._bytes(df))).first()[0]
    c = C.compact(df, "g", ["key", "timestamp"], "entry_id", str(tmp_path / "out"), target_bytes=-(-total // 7))
    assert c.files == 7 and c.rows.columns == df.columns
    assert c.rows.exceptAll(df).count() == 0 and df.exceptAll(c.rows).count() == 0
    sizes = [r["count"] for r in c.rows.groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) == 7 and max(sizes) <= 330
    assert len(Files(spark).parquet_files(str(tmp_path / "out"))) == 7


def test_as_many_files_as_tasks_while_they_are_large_enough():
    assert C.planned_files(0, 8) == 1 and C.planned_files(C.LEAST_BYTES - 1, 8) == 1
    assert C.planned_files(3 * C.LEAST_BYTES, 8) == 3 and C.planned_files(1 << 30, 8) == 8
    assert C.planned_files(1 << 40, 8) == (1 << 40) // C.TARGET_BYTES


def test_the_query_writes_several_files(spark, sf, tmp_path, monkeypatch):
    """All stores of the small data, in files of a bounded size, each row of a small file once."""
    t = lambda name: spark.read.parquet(f"{sf}/{name}.parquet")
    monkeypatch.setattr(C, "LEAST_BYTES", 1 << 10)
    taken, c = C.compact_small_files(t("sstable_files"), t("sstable_entries"), t("store_configs"), str(tmp_path / "out"))
    assert c.files == 4 == len(Files(spark).parquet_files(str(tmp_path / "out")))
    want = t("sstable_entries").join(taken, "file_id", "left_semi").select(*t("sstable_entries").columns)
    assert c.rows.drop("store_id").exceptAll(want).count() == 0 and c.rows.count() == want.count() == c.digests.agg(F.sum("rows")).first()[0]


def test_no_rows(spark, tmp_path):
    c = C.compact(rows(spark, 0), "g", ["key", "timestamp"], "entry_id", str(tmp_path / "out"))
    assert c.rows.count() == 0 and c.digests.count() == 0


def test_a_lost_row_is_noticed(spark, tmp_path, monkeypatch):
    whole = C.digest
    monkeypatch.setattr(C, "digest", lambda df, g, cols, prefix="": whole(df.filter("entry_id <> 5") if prefix else df, g, cols, prefix))
    with pytest.raises(C.CompactionError):
        C.compact(rows(spark, 50), "g", ["key"], "entry_id", str(tmp_path / "out"))


@pytest.mark.parametrize("how", ["lost", "doubled"])
def test_rows_that_the_join_loses_or_doubles_are_noticed(spark, tmp_path, how):
    """The digests are compared with the source, not with what was made of it on the way."""
    source = rows(spark, 60)
    made = source.filter("entry_id <> 7") if how == "lost" else source.unionAll(source.filter("entry_id = 7"))
    with pytest.raises(C.CompactionError):
        C.compact(made, "g", ["key"], "entry_id", str(tmp_path / "out"), source=source, check="timestamp")


def test_which_files_are_taken(spark, tmp_path):
    configs = spark.createDataFrame([(1, 10, 1), (2, 10, 5)], "config_id int, min_entry_count long, max_pending_sections int")
    listing = spark.createDataFrame(
        [(1, "a", 1, 3), (1, "a", 1, None), (2, "a", 1, None), (3, "a", 1, 10), (4, "b", 2, 0), (5, "b", 2, 1), (6, "a", 1, None), (7, "a", 9, 1), (None, "a", 1, 1)],
        "file_id long, store_id string, config_id int, entry_count long",
    )
    entries = spark.createDataFrame([(i, 2 if i < 4 else 1, f"k{i}", None, i) for i in range(7)] + [(9, 99, "z", "z", 1)], ENTRY)
    files = {r.file_id: r.entry_count for r in C.list_files(listing, entries, configs).collect()}
    assert files == {1: 3, 2: 4, 3: 10, 4: 0, 5: 1, 6: 0}
    taken, c = C.compact_small_files(listing, entries, configs, str(tmp_path / "out"))
    assert sorted(r.file_id for r in taken.collect()) == [1, 2, 6]
    assert sorted(r.entry_id for r in c.rows.collect()) == list(range(7))
