import math

import pytest

from tessera.operators.tables import ConstraintError
from tessera.sources.tables import render
from tessera.sql import Session


@pytest.fixture
def s(spark):
    return Session(spark)


def got(df):
    return [tuple(r) for r in df.collect()]


def test_ddl_dml_and_constraints(s):
    s.execute("""
        CREATE TABLE dept (id INT PRIMARY KEY, name TEXT NOT NULL);
        CREATE TABLE emp (id INT PRIMARY KEY, name VARCHAR(20) UNIQUE, age INT CHECK (age > 0), dept_id INT REFERENCES dept(id), note TEXT DEFAULT 'new');
        INSERT INTO dept VALUES (1, 'Eng'), (2, 'Sales');
        INSERT INTO emp (id, name, age, dept_id) VALUES (1, 'Ann', 30, 1), (2, 'Bob', 40, 2), (3, NULL, 50, NULL), (4, NULL, NULL, 1)
    """)  # fmt: skip
    assert got(s.execute("SELECT count(*), min(note) FROM emp")) == [(4, "new")]
    for bad in ("INSERT INTO dept VALUES (1, 'x')", "INSERT INTO dept VALUES (3, NULL)", "INSERT INTO dept (id) VALUES (3)", "INSERT INTO emp (id, name) VALUES (9, 'Ann')", "INSERT INTO emp (id, age) VALUES (9, -5)", "INSERT INTO emp (id, dept_id) VALUES (9, 77)", "UPDATE dept SET name = NULL"):
        with pytest.raises(ConstraintError):
            s.execute(bad)
    s.execute("UPDATE emp SET name = 'Ann' WHERE id = 1; UPDATE emp SET age = age + 5, note = name || '!' WHERE age > 35")
    assert sorted(got(s.execute("SELECT id, age, note FROM emp WHERE age > 40"))) == [(2, 45, "Bob!"), (3, 55, None)]
    assert got(s.execute("DELETE FROM emp WHERE age > 50 RETURNING id, age")) == [(3, 55)]
    s.execute("ALTER TABLE emp ADD COLUMN x INT; ALTER TABLE emp RENAME COLUMN note TO remark; ALTER TABLE emp DROP COLUMN age; ALTER TABLE emp RENAME TO staff")
    assert s.execute("SELECT * FROM staff").columns == ["id", "name", "dept_id", "remark", "x"]
    with pytest.raises(ConstraintError):
        s.execute("ALTER TABLE staff DROP COLUMN id")
    assert [r[0] for r in got(s.execute("DESCRIBE dept"))] == ["id", "name"]
    assert got(s.execute("SHOW TABLES")) == [("dept",), ("staff",)]
    s.execute("TRUNCATE staff")
    assert got(s.execute("SELECT count(*) FROM staff")) == [(0,)]


def test_upsert_and_transactions(s):
    s.execute("CREATE TABLE t (id INT PRIMARY KEY, v INT); INSERT INTO t VALUES (1, 10), (2, 20)")
    s.execute("INSERT INTO t VALUES (2, 99), (3, 30) ON CONFLICT (id) DO NOTHING")
    s.execute("INSERT INTO t VALUES (1, 5), (4, 40) ON CONFLICT (id) DO UPDATE SET v = v + excluded.v")
    assert sorted(got(s.execute("SELECT * FROM t"))) == [(1, 15), (2, 20), (3, 30), (4, 40)]
    s.execute("INSERT INTO t VALUES (2, 7) ON DUPLICATE KEY UPDATE v = VALUES(v)")
    s.execute("BEGIN; DELETE FROM t WHERE v > 10; UPDATE t SET v = 0; ROLLBACK")
    assert sorted(got(s.execute("SELECT * FROM t"))) == [(1, 15), (2, 7), (3, 30), (4, 40)]
    s.execute("BEGIN; DELETE FROM t WHERE id = 4; COMMIT")
    assert got(s.execute("SELECT count(*) FROM t")) == [(3,)]
    s.execute("BEGIN")
    with pytest.raises(ValueError):
        s.execute("BEGIN")


def test_many_changes_cut_the_plan(s):
    s.execute("CREATE TABLE t (id INT PRIMARY KEY, v INT); INSERT INTO t VALUES (1, 0)")
    for _ in range(20):
        s.execute("UPDATE t SET v = v + 1")
    assert got(s.execute("SELECT v FROM t")) == [(20,)]
    assert len(s.db.table("t")._jdf.queryExecution().optimizedPlan().toString()) < 20_000


def test_order_nulls_distinct_on_views_sequences(s):
    s.execute("CREATE TABLE n (id INT PRIMARY KEY, val INT); INSERT INTO n VALUES (1, NULL), (2, 10), (3, 20), (4, 10)")
    assert [r[0] for r in got(s.execute("SELECT id FROM n ORDER BY val, id"))] == [2, 4, 3, 1]
    assert [r[0] for r in got(s.execute("SELECT id FROM n ORDER BY val DESC, id LIMIT 2"))] == [1, 3]
    assert sorted(got(s.execute("SELECT DISTINCT ON (val) id, val FROM n ORDER BY val, id DESC")), key=str) == sorted([(4, 10), (3, 20), (1, None)], key=str)
    s.execute("CREATE VIEW big AS SELECT id FROM n WHERE val > 15")
    assert got(s.execute("SELECT * FROM big")) == [(3,)]
    s.execute("CREATE SEQUENCE q START WITH 5")
    assert got(s.execute("SELECT nextval('q') AS a, nextval('q') AS b, currval('q') AS c")) == [(5, 6, 6)]
    s.execute("CREATE DATABASE other; USE other")
    assert got(s.execute("SHOW TABLES")) == []
    assert ("other",) in got(s.execute("SHOW DATABASES"))
    s.execute("USE main")
    assert got(s.execute("SELECT column_name FROM information_schema.columns WHERE table_name = 'n' ORDER BY ordinal_position")) == [("id",), ("val",)]
    assert "Scan" in str(got(s.execute("EXPLAIN SELECT * FROM n WHERE val > 3")))
    assert got(s.execute("SELECT id FROM n WHERE val = $2 AND id < $1 ORDER BY id", [4, 10])) == [(2,)]
    with pytest.raises(Exception, match="nowhere"):
        s.execute("SELECT * FROM nowhere").collect()


def test_vectors(s):
    s.execute("CREATE TABLE v (id INT PRIMARY KEY, e VECTOR(3)); INSERT INTO v VALUES (1, '[1,0,0]'), (2, '[0,1,0]'), (3, '[0,0,1]'), (4, '[0.5,0.5,0]')")
    q = "SELECT id, l2_distance(e, '{}'::vector) AS d FROM v ORDER BY d, id LIMIT {}"
    assert got(s.execute(q.format("[0.9,0.1,0]", 2)))[0][0] == 1
    assert got(s.execute(q.format("[0,0,0.95]", 1)))[0][0] == 3
    assert len(got(s.execute(q.format("[0,0,0]", 4)))) == 4
    r = got(s.execute("SELECT vector_distance('[1,0,0]'::vector, '[0,1,0]'::vector), vector_distance('[1,0]'::vector, '[0,1]'::vector, 'cosine'), vector_distance('[1,2,3]'::vector, '[4,5,6]'::vector, 'ip'), vector_dims('[1,2,3,4]'::vector), vector_norm('[3,4]'::vector), l2_distance(NULL, '[1]'::vector)"))[0]
    assert math.isclose(r[0], math.sqrt(2), abs_tol=1e-6) and r[1:] == (1.0, -32.0, 4, 5.0, None)
    for bad in ("SELECT l2_distance('[1]'::vector, '[1,2]'::vector)", "SELECT vector_distance('[1]'::vector, '[1]'::vector, 'x')"):
        with pytest.raises(Exception):
            s.execute(bad).collect()
    with pytest.raises(ConstraintError):
        s.execute("INSERT INTO v VALUES (9, '[1,2]')")


def test_dump_and_formats(s):
    s.execute("CREATE TABLE d (id INT PRIMARY KEY, name TEXT); INSERT INTO d VALUES (1, 'O''Neil'), (2, NULL)")
    text = "\n".join(s.dump())
    s.execute("DROP TABLE d")
    s.execute(text)
    df = s.execute("SELECT id, name FROM d ORDER BY id")
    assert got(df) == [(1, "O'Neil"), (2, None)]
    assert render(df, "csv") == "id,name\n1,O'Neil\n2,\n"
    assert render(df, "raw") == "1\tO'Neil\n2\tNULL"
    assert "(2 rows)" in render(df) and "RECORD 2" in render(df, "expanded") and '"id": 1' in render(df, "json")


def test_tokens_keep_strings_names_comments_and_hints_apart():
    from tessera.dialect import pieces, to_spark

    text = """SELECT 'a;b--c' AS "x;y" -- d; e
        , /* f; */ 1; SELECT /*+ MERGE(t) */ 2"""
    assert list(pieces(text, ";")) == ["""SELECT 'a;b--c' AS "x;y" , 1""", "SELECT /*+ MERGE(t) */ 2"]
    assert to_spark("SELECT v FROM (SELECT v FROM t ORDER BY v DESC LIMIT 1) x ORDER BY sum(v) OVER (ORDER BY v), 2 NULLS FIRST") == "SELECT v FROM(SELECT v FROM t ORDER BY v DESC NULLS FIRST LIMIT 1) x ORDER BY sum(v) OVER(ORDER BY v NULLS LAST ) NULLS LAST, 2 NULLS FIRST"
    with pytest.raises(ValueError):
        list(pieces("SELECT 'open", ";"))


def test_dialect_scalars(s):
    row = s.execute("""SELECT 7/2, -7/2, 7/2.0, (7/2)/2, concat('a', NULL, 'b', 3), substr('hello', -2), substr('hello', 0, 2), split_part('a,b', ',', 0), split_part('a,b', ',', 9),
        extract(dow FROM DATE '2026-11-25'), 'a\\b', '7' ~ '^\\d$', CAST(5 AS TEXT), 5::text, btrim(E'\\t x \\n'), string_agg(x, '-' ORDER BY x DESC) FROM VALUES ('p'), ('q') t(x)""").first()
    assert tuple(row) == (3, -3, 3.5, 1, "ab3", "", "he", "a", "", 3, "a\\b", True, "5", "5", "x", "q-p")
    for bad in ("SELECT sqrt(-1)", "SELECT 1/0", "SELECT nextval('nothing')"):
        with pytest.raises(Exception):
            s.execute(bad).collect()


def test_nulls_come_last_in_every_scope(s):
    s.execute("CREATE TABLE n (id INT PRIMARY KEY, v INT); INSERT INTO n VALUES (1, NULL), (2, 10), (3, 20)")
    assert got(s.execute("SELECT * FROM (SELECT v FROM n ORDER BY v LIMIT 1) x")) == [(10,)]
    assert sorted(got(s.execute("SELECT id, row_number() OVER (ORDER BY v) FROM n"))) == [(1, 3), (2, 1), (3, 2)]
    assert got(s.execute("SELECT v FROM n UNION ALL SELECT v FROM n WHERE id = 1 ORDER BY v DESC LIMIT 3")) == [(None,), (None,), (20,)]


def test_sequences_count_rows_and_ddl_rolls_back(s):
    s.execute("CREATE SEQUENCE q; CREATE TABLE a (id INT PRIMARY KEY DEFAULT nextval('q'), v INT); INSERT INTO a (v) VALUES (7), (8), (9); INSERT INTO a (v) VALUES (1)")
    assert sorted(r[0] for r in got(s.execute("SELECT id FROM a"))) == [1, 2, 3, 4] and got(s.execute("SELECT currval('q')")) == [(4,)]
    s.execute("INSERT INTO a VALUES (nextval('q'), 0), (nextval('q'), 0)")
    assert {r[0] for r in got(s.execute("SELECT id FROM a WHERE v = 0"))} == {5, 6}
    s.execute("BEGIN; ALTER TABLE a ADD COLUMN x INT; CREATE UNIQUE INDEX u ON a (x); ROLLBACK; INSERT INTO a (v) VALUES (3)")
    assert s.execute("SELECT * FROM a").columns == ["id", "v"] == s.db.meta["a"].schema.names and not s.db.meta["a"].unique


def test_vector_index_follows_changes_and_rollback(s):
    s.execute("CREATE TABLE v (id INT PRIMARY KEY, e VECTOR(3)); INSERT INTO v VALUES (1, '[1,0,0]'), (2, '[0,1,0]'), (3, '[0,0,1]'), (4, NULL)")
    s.execute("CREATE INDEX i ON v USING hnsw (e)")
    ids = lambda: [r[0] for r in got(s.nearest("i", [1.0, 0.1, 0.0], 10))]
    assert ids() == [1, 2, 3]
    s.execute("BEGIN; DELETE FROM v WHERE id = 2; INSERT INTO v VALUES (5, '[1,0.1,0]')")
    assert ids() == [5, 1, 3]
    s.execute("ROLLBACK; UPDATE v SET e = '[9,9,9]'::vector WHERE id = 1")
    assert ids() == [2, 3, 1]
    s.execute("TRUNCATE v")
    assert ids() == []
    s.execute("DROP INDEX i")
    with pytest.raises(KeyError):
        s.nearest("i", [1.0, 0.0, 0.0], 1)


def test_merge_hint_reaches_the_plan(spark, sf):
    from tessera.plans import catalogue

    plan = catalogue.queries()["merge_join_sort_aggregate"](spark, sf)._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "SortAggregate" in plan


def test_savepoints(s):
    s.execute("CREATE SEQUENCE sq; CREATE TABLE t (id INT PRIMARY KEY DEFAULT nextval('sq'), v INT); INSERT INTO t (v) VALUES (10)")
    s.execute("BEGIN; INSERT INTO t (v) VALUES (20); SAVEPOINT a; INSERT INTO t (v) VALUES (30); ALTER TABLE t ADD COLUMN w INT; SAVEPOINT b; DELETE FROM t; ROLLBACK TO SAVEPOINT a")
    assert sorted(got(s.execute("SELECT v FROM t"))) == [(10,), (20,)] and s.db.meta["t"].schema.names == ["id", "v"]
    with pytest.raises(KeyError):
        s.execute("ROLLBACK TO b")
    s.execute("UPDATE t SET v = 0; ROLLBACK TO a; RELEASE SAVEPOINT a")
    with pytest.raises(KeyError):
        s.execute("ROLLBACK TO a")
    s.execute("COMMIT")
    assert sorted(got(s.execute("SELECT v FROM t"))) == [(10,), (20,)]
    with pytest.raises(ValueError):
        s.execute("SAVEPOINT c")


def test_numbers_given_out_are_not_given_again_after_a_rollback(s):
    s.execute("CREATE SEQUENCE sq; CREATE TABLE t (id INT PRIMARY KEY DEFAULT nextval('sq'), v INT); INSERT INTO t (v) VALUES (1)")
    s.execute("BEGIN; INSERT INTO t (v) VALUES (2), (3); ROLLBACK; INSERT INTO t (v) VALUES (4)")
    assert sorted(got(s.execute("SELECT * FROM t"))) == [(1, 1), (4, 4)] and got(s.execute("SELECT nextval('sq')")) == [(5,)]


def test_added_columns_keep_their_rules(s):
    s.execute("CREATE TABLE t (id INT PRIMARY KEY); INSERT INTO t VALUES (1); ALTER TABLE t ADD COLUMN n INT NOT NULL DEFAULT 5; ALTER TABLE t ADD COLUMN v VECTOR(2)")
    assert got(s.execute("SELECT * FROM t")) == [(1, 5, None)]
    for bad in ("INSERT INTO t VALUES (2, NULL, NULL)", "INSERT INTO t (id, v) VALUES (2, '[1,2,3]')", "ALTER TABLE t ADD COLUMN m INT NOT NULL"):
        with pytest.raises(ConstraintError):
            s.execute(bad)
    with pytest.raises(ValueError):
        s.execute("ALTER TABLE t ADD COLUMN n INT")


def test_array_agg_in_order(s):
    s.execute("CREATE TABLE n (id INT PRIMARY KEY, g INT, v INT); INSERT INTO n VALUES (1, 1, NULL), (2, 1, 20), (3, 1, 10), (4, 1, 10), (5, 2, NULL)")
    row = "SELECT g, array_agg(id ORDER BY v DESC, id DESC) AS a, array_agg(id ORDER BY v, id) AS b, array_agg(id ORDER BY v NULLS FIRST, id) AS c, array_agg(DISTINCT v ORDER BY v DESC) AS d, array_agg(v * 7 / 2 ORDER BY v) AS e FROM n GROUP BY g ORDER BY g"
    assert got(s.execute(row)) == [(1, [1, 2, 4, 3], [3, 4, 2, 1], [1, 3, 4, 2], [20, 10], [35, 35, 70]), (2, [5], [5], [5], [], [])]


def test_statements_from_clauses(s):
    from tessera.builder import Statement as S

    s.execute("CREATE TABLE t (id INT PRIMARY KEY, name TEXT, x DOUBLE, v VECTOR(2)); CREATE TABLE u (tid INT, k INT); INSERT INTO u VALUES (1, 7), (1, 8), (3, 9)")
    S.insert("t", "id", "name", "x", "v").values(1, "O'Neil; -- \\ ?", 0.5, [1.0, 2.0]).values(2, None, -1.5, None).values(3, "$1", 2.0, None).run(s)
    assert got(S.select("id", "name", "x", "v").of("t").order("id").run(s)) == [(1, "O'Neil; -- \\ ?", 0.5, [1.0, 2.0]), (2, None, -1.5, None), (3, "$1", 2.0, None)]
    base = S.select("id", "count(k) AS n").of("t").group("id").order("id")
    assert got(base.join("u", "id = tid", how="left").run(s)) == [(1, 2), (2, 0), (3, 1)]
    assert got(base.having("count(k) >= ?", 2).join("u", "id = tid AND k > ?", 6).where("x > ?", 0).run(s)) == [(1, 2)]
    assert got(base.join("u", "id = tid", how="right").limit(1).offset(1).run(s)) == [(3, 1)]
    assert got(S.select().of("u").equal("k", 9).run(s)) == [(3, 9)] and got(S.select("id").of("t").equal("name", None).run(s)) == [(2,)]
    assert got(S.select("id").of("t").where("name LIKE '%?'").where("x < ?", 1).run(s)) == [(1,)]
    S.update("t").set("name", "a = 'b', c").set_to("x", "x * ?", 2).where("id >= ?", 2).run(s)
    assert got(S.select("name", "x").of("t").where("id <> ?", 1).order("id DESC").run(s)) == [("a = 'b', c", 4.0), ("a = 'b', c", -3.0)]
    assert got(S.delete("t").equal("id", 3).returning("id", "x").run(s)) == [(3, 4.0)]
    with pytest.raises(ValueError):
        S.select().of("t").where("id = ?")
