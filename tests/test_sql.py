import pytest
from pyspark.errors import ArithmeticException, SparkRuntimeException

from lakevec import errors
from lakevec.plans import select
from lakevec.plans.parser import parse
from lakevec.session import Engine


@pytest.fixture
def db(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"))
    e.execute("CREATE TABLE users (id INT PRIMARY KEY, name TEXT NOT NULL, age INT); INSERT INTO users VALUES (1, 'alice', 30), (2, 'bob', 25), (3, 'carol', NULL)")
    e.execute("CREATE TABLE items (id INT PRIMARY KEY, v VECTOR(2, L2)); INSERT INTO items VALUES (1, [0, 0]), (2, [1, 0]), (3, [2, 0])")
    return e


def rows(db, q):
    return [tuple(r) for r in db.sql(q).collect()]


def test_nulls_last_both_ways(db):
    assert rows(db, "SELECT age FROM users ORDER BY age") == [(25,), (30,), (None,)]
    assert rows(db, "SELECT age FROM users ORDER BY age DESC") == [(30,), (25,), (None,)]
    assert rows(db, "SELECT age FROM users ORDER BY age DESC NULLS FIRST LIMIT 1") == [(None,)]


def test_arithmetic(db):
    assert rows(db, "SELECT 7/2, -7/2, -7%3, 7/2.0, 1+3000000000, -age+5 FROM users WHERE id = 1") == [(3, -3, -1, 3.5, 3000000001, -25)]
    for bad in ("2147483647 + id", "id / 0", "1.5 / 0", "9223372036854775807 * 2"):
        with pytest.raises(ArithmeticException):
            rows(db, f"SELECT {bad} FROM users")


@pytest.mark.parametrize(
    ("q", "error"),
    [
        ("name = 1", errors.TypeMismatch),
        ("age + 1", errors.TypeMismatch),
        ("NULL", errors.TypeMismatch),
        ("nope = 1", errors.ColumnNotFound),
        ("Name = 'x'", errors.ColumnNotFound),
        ("other.id = 1", errors.TableNotFound),
        ("name LIKE 1", errors.InvalidOperator),
        ("upper(name) = 'X'", errors.Unsupported),
        ("1.5 % 2 = 1", errors.InvalidOperator),
        ("name || 1 = 'x'", errors.InvalidOperator),
    ],
)
def test_type_errors_come_before_running(db, q, error):
    with pytest.raises(error):
        db.sql(f"SELECT id FROM users WHERE {q}")


def test_predicates(db):
    assert rows(db, "SELECT id FROM users WHERE age NOT IN (30, NULL)") == []
    assert rows(db, "SELECT id FROM users WHERE age IN ()") == []
    assert rows(db, "SELECT id FROM users WHERE name LIKE '_o%' AND age BETWEEN 20 AND 25.5") == [(2,)]
    assert rows(db, "SELECT u.id i FROM users u WHERE users.age IS NULL") == [(3,)]
    assert rows(db, "SELECT id FROM users WHERE name LIKE 'a!_%' ESCAPE '!'") == []


def test_distinct_groups_and_names(db):
    db.execute("INSERT INTO users VALUES (4, 'dan', 25)")
    assert sorted(rows(db, "SELECT DISTINCT age FROM users WHERE age IS NOT NULL")) == [(25,), (30,)]
    assert rows(db, "SELECT age, count(*) AS n FROM users GROUP BY age HAVING count(*) > 1") == [(25, 2)]
    assert db.sql("SELECT id + 1, name, 'x' FROM users").columns == ["col_0", "name", "col_2"]
    with pytest.raises(errors.Unsupported):
        db.sql("SELECT name, count(*) FROM users GROUP BY age")


def test_constraints(db):
    with pytest.raises(errors.ConstraintViolation):
        db.execute("INSERT INTO users VALUES (1, 'x', 1)")
    with pytest.raises(errors.ConstraintViolation):
        db.execute("INSERT INTO users VALUES (8, 'x', 1), (8, 'y', 1)")
    with pytest.raises(errors.ConstraintViolation):
        db.execute("UPDATE users SET id = 1")
    with pytest.raises(errors.NullViolation):
        db.execute("INSERT INTO users VALUES (9, NULL, 1)")
    with pytest.raises(errors.NullViolation):
        db.execute("UPDATE users SET name = NULL WHERE id = 1")
    with pytest.raises(errors.ColumnCountMismatch):
        db.execute("INSERT INTO users (id, name) VALUES (9, 'x')")
    with pytest.raises(errors.DimensionMismatch):
        db.execute("INSERT INTO items VALUES (9, [1.0])")
    assert rows(db, "SELECT count(*) FROM users") == [(3,)]


def test_counts_of_changes(db):
    assert db.execute("UPDATE users SET age = 25 WHERE id < 3").affected == 1
    assert db.execute("UPDATE users SET age = age + 1, name = name || '!' WHERE age IS NOT NULL").affected == 2
    assert db.execute("DELETE FROM users WHERE age > 0").affected == 2
    assert rows(db, "SELECT * FROM users") == [(3, "carol", None)]


def test_a_failing_script_changes_nothing(db):
    with pytest.raises(errors.ConstraintViolation):
        db.execute("DELETE FROM users WHERE id = 3; INSERT INTO users VALUES (1, 'x', 1)")
    assert len(rows(db, "SELECT id FROM users")) == 3


def test_vector_functions(db):
    assert rows(db, "SELECT vector_similarity([1,0],[0,1],'cosine'), vector_distance([1,0],[2,0],' L2 '), vector_similarity([1,0],[2,0],'INNER') FROM items LIMIT 1") == [(0.0, 1.0, 2.0)]
    found = rows(db, "SELECT id FROM items ORDER BY vector_similarity(v, [0.5, 0.0], 'l2') ASC LIMIT 2")
    assert {r[0] for r in found} == {1, 2}
    for bad, error in (("vector_similarity(v, [1], 'l2')", errors.DimensionMismatch), ("vector_similarity(v, v, 'dot')", errors.InvalidMetric), ("vector_similarity(v, v, NULL)", errors.InvalidMetric), ("vector_similarity(v, v)", errors.TypeMismatch), ("v = v", errors.InvalidOperator)):
        with pytest.raises(error):
            db.sql(f"SELECT {bad} FROM items")
    with pytest.raises(SparkRuntimeException):
        rows(db, "SELECT vector_similarity(v, [1, 0], 'cosine') FROM items")
    assert len(rows(db, "SELECT vector_similarity(v, [1, 0], 'cosine') FROM items WHERE id > 1")) == 2


def test_knn_pattern():
    of = lambda q: select.knn_of(parse(q)[0])
    assert of("SELECT id FROM t ORDER BY vector_similarity(v, [1, 0], 'cosine') DESC LIMIT 3").k == 3
    assert of("SELECT id FROM t WHERE a = 1 ORDER BY vector_distance([1, 0], v, 'l2') LIMIT 3").filtered
    assert of("SELECT id FROM t ORDER BY vector_similarity(v, [1, 0], 'l2') DESC LIMIT 3") is None
    assert of("SELECT id FROM t ORDER BY vector_similarity(v, [1, 0], 'inner') DESC LIMIT 3 OFFSET 1") is None


def test_top_k_plan_has_no_full_sort(db):
    text = db.explain("SELECT id FROM items ORDER BY vector_similarity(v, [1, 0], 'l2') LIMIT 2")
    assert "TakeOrderedAndProject" in text


def test_indexes(db):
    db.execute("CREATE INDEX h ON items (v) USING HNSW WITH (m = 8, ef_construction = 32)")
    assert db.catalog.list_indexes("items") == ["__pk_items", "h"]
    for bad in ("CREATE INDEX h ON items (v)", "CREATE INDEX g ON items (id) USING HNSW", "CREATE INDEX g ON items (v) USING HNSW WITH (m = 1)", "CREATE INDEX g ON items (v) USING HNSW WITH (m = 20, ef_construction = 10)", "CREATE INDEX g ON items (v) USING HNSW WITH (q = 1)", "CREATE INDEX __pk_x ON items (id)", "DROP INDEX nope", "CREATE TABLE users (a INT)", "CREATE TABLE x (a INT) WITH (storage = 'heap')", "CREATE TABLE x (a INT, a INT)", "DROP TABLE nope"):
        with pytest.raises(errors.LakevecError):
            db.execute(bad)
    db.execute("DROP INDEX IF EXISTS nope; DROP TABLE IF EXISTS nope; DROP TABLE items; CREATE TABLE IF NOT EXISTS users (q INT)")
    assert db.catalog.list_tables() == ["users"] and db.catalog.list_indexes() == ["__pk_users"]


def test_row_streams(db):
    assert [r.id for r in db.stream("SELECT id FROM users ORDER BY id")] == [1, 2, 3]
    assert db.with_rows("SELECT id FROM users", lambda it: sum(r.id for r in it)) == 6


def test_approximate_search_by_index(db):
    db.execute("CREATE INDEX h ON items (v) USING HNSW")
    near = Engine(db.spark, db.catalog.root, approximate=True)
    q = "SELECT id, vector_distance(v, [1.9, 0], 'l2') AS d FROM items ORDER BY vector_distance(v, [1.9, 0], 'l2') LIMIT 2"
    assert rows(near, q) == rows(db, q)
    assert [r.id for r in db.vector_search("items", "v", [1.9, 0], "L2", 2).collect()] == [3, 2]
    assert db.index_statistics("h")["node_count"] == 3
