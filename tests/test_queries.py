import duckdb
import pytest

import __spark_entry__ as entry
from lakevec.__main__ import main



def rows(table):
    return sorted(tuple("~" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in table)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    from pathlib import Path

    for p in Path("/root/testdata/sf0.001").glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", ["entry", *("select_star_plus_expr arith_int_div order_multi_nulls sql_agg_having frame_division merged_stats knn_l2 vec_delete_then_search write_merge dml_update copy_parquet csv_roundtrip event_windows p4_found p5_rows p5_stores".split())])
def test_same_rows_as_sql(spark, sf, duck, name):
    if name == "entry":
        assert entry.entry(spark).count() > 0
        return
    df = entry.queries()[name](spark, sf)
    names = sorted(df.columns)
    have = rows(df.select(*names).collect())
    result = duck.execute(entry.oracle_sql()[name])
    order = [[d[0] for d in result.description].index(n) for n in names]
    assert have == rows([tuple(r[i] for i in order) for r in result.fetchall()])


@pytest.mark.parametrize("mode", ["append", "overwrite", "merge"])
def test_whole_tables_are_written(spark, sf, duck, mode):
    """Into a base of all customers, all customers again under doubled keys."""
    have = entry.queries()[f"write_{mode}_whole"](spark, sf).select("c_custkey", "c_name", "c_acctbal")
    assert rows(have.collect()) == rows(duck.execute(entry.oracle_sql()[f"write_{mode}_whole"]).fetchall())
    n = duck.execute("SELECT count(*) FROM customer").fetchone()[0]
    assert have.count() == {"append": 2 * n, "overwrite": n, "merge": 2 * n - -(-n // 2)}[mode]


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_command_line(spark, sf, capsys):
    assert main(["SELECT n_name FROM nation WHERE n_nationkey = 3", "--data", sf, "--output", "jsonl"]) == 0
    assert '"n_name"' in capsys.readouterr().out
    assert main(["SELECT nope FROM nation", "--data", sf]) == 1
