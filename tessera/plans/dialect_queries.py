"""Statements of the dialect through Session.execute, over whole tables."""

import json

from pyspark.sql import DataFrame

from tessera.builder import Statement
from tessera.operators.tables import ConstraintError
from tessera.plans.catalogue import query
from tessera.plans.vector_queries import PROBE, SQL_PROBE
from tessera.sources.tables import Tables, register
from tessera.sql import Session


def _session(t: Tables, *names: str) -> Session:
    register(t.spark, t._folder, names)
    return Session(t.spark)


def _loaded(t: Tables) -> Session:
    """A table c of all customers."""
    s = _session(t, "customer", "supplier")
    s.execute("""
        CREATE TABLE c (id BIGINT PRIMARY KEY, name TEXT NOT NULL, nation INT, balance DOUBLE);
        INSERT INTO c SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer""")
    return s


@query("""
    SELECT o_orderkey, CAST(trunc(o_orderkey / 7) AS BIGINT) AS q, CAST(trunc(trunc((o_orderkey + o_custkey) / 2) / 3) AS BIGINT) AS r,
      CAST(trunc(-o_orderkey / 2) AS BIGINT) AS n, o_totalprice / 2 AS h, CAST(3 AS BIGINT) AS three
    FROM orders WHERE CAST(trunc(o_custkey / 2) AS BIGINT) <> 5""")
def sql_integer_division(t: Tables) -> DataFrame:
    s = _session(t, "orders")
    return s.execute("SELECT o_orderkey, o_orderkey / 7 AS q, (o_orderkey + o_custkey) / 2 / 3 AS r, -o_orderkey / 2 AS n, o_totalprice / 2 AS h, 7/2 AS three FROM orders WHERE o_custkey / 2 <> 5")


@query("""
    SELECT c_custkey, concat(c_name, '-', nullif(c_mktsegment, 'BUILDING')) AS joined, '' AS tail, substring(c_name, 1, 3) AS head, substring(c_name, 4, 2) AS middle,
      split_part(c_name, '#', 1) AS first_part, trim(c_name) AS bare, c_name || '/' || c_mktsegment AS piped
    FROM customer""")
def sql_strings(t: Tables) -> DataFrame:
    s = _session(t, "customer")
    return s.execute("""
        SELECT c_custkey, concat(c_name, NULL, '-', nullif(c_mktsegment, 'BUILDING')) AS joined, substr(c_name, -2) AS tail, substr(c_name, 0, 3) AS head,
          substring(c_name from 4 for 2) AS middle, split_part(c_name, '#', 0) AS first_part, trim(E'\\t ' || c_name || E' \\n') AS bare, c_name || '/' || c_mktsegment AS piped
        FROM customer""")


_KEY = "nullif(o_custkey % 7, 3)"


@query(f"""
    SELECT * FROM (SELECT o_orderkey, {_KEY} AS v, 'up' AS kind FROM orders ORDER BY v ASC NULLS LAST, o_orderkey LIMIT 50)
    UNION ALL SELECT * FROM (SELECT o_orderkey, {_KEY} AS v, 'down' AS kind FROM orders ORDER BY v DESC NULLS FIRST, o_orderkey LIMIT 50)
    UNION ALL SELECT * FROM (SELECT o_orderkey, {_KEY} AS v, 'said' AS kind FROM orders ORDER BY v NULLS FIRST, o_orderkey LIMIT 50)""")
def sql_null_order_nested(t: Tables) -> DataFrame:
    s = _session(t, "orders")
    return s.execute(f"""
        SELECT * FROM (SELECT o_orderkey, {_KEY} AS v, 'up' AS kind FROM orders ORDER BY v, o_orderkey LIMIT 50) a
        UNION ALL SELECT * FROM (SELECT o_orderkey, {_KEY} AS v, 'down' AS kind FROM orders ORDER BY v DESC, o_orderkey LIMIT 50) b
        UNION ALL (SELECT o_orderkey, {_KEY} AS v, 'said' AS kind FROM orders ORDER BY v NULLS FIRST, o_orderkey LIMIT 50)""")


@query(f"""
    SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_KEY} DESC NULLS FIRST, o_orderkey) AS down,
      rank() OVER w AS up FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY {_KEY} ASC NULLS LAST)""")
def sql_null_order_window(t: Tables) -> DataFrame:
    s = _session(t, "orders")
    return s.execute(f"""
        SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_KEY} DESC, o_orderkey) AS BIGINT) AS down,
          CAST(rank() OVER w AS BIGINT) AS up FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY {_KEY})""")


@query("""SELECT c_custkey, 'a--b; c' AS dashes, 'it''s /* no */ comment' AS quoted, 'x WHERE y = 1' AS clause FROM customer WHERE c_mktsegment <> 'ORDER BY;'""")
def sql_literals_and_comments(t: Tables) -> DataFrame:
    s = _session(t, "customer")
    return s.execute("""
        -- first; a comment
        CREATE TABLE lits (id BIGINT PRIMARY KEY, dashes TEXT, quoted TEXT, clause TEXT DEFAULT 'x; y'); /* another;
        one */
        INSERT INTO lits (id, dashes, quoted) SELECT c_custkey, 'a--b; c', 'it''s /* no */ comment' FROM customer WHERE c_mktsegment <> 'ORDER BY;'; -- done
        UPDATE lits SET clause = 'x WHERE y = 1' WHERE quoted = 'it''s /* no */ comment' AND clause = 'x; y';
        SELECT id AS c_custkey, dashes, quoted, clause FROM lits;""")


@query("""
    SELECT o_orderkey, dayofweek(o_orderdate) AS dow, dayofyear(o_orderdate) AS doy, CAST(epoch(o_orderdate) AS BIGINT) AS secs, year(o_orderdate) AS y, quarter(o_orderdate) AS q
    FROM orders""")
def sql_extract(t: Tables) -> DataFrame:
    s = _session(t, "orders")
    return s.execute("""
        SELECT o_orderkey, extract(dow FROM o_orderdate) AS dow, CAST(extract(doy FROM o_orderdate) AS BIGINT) AS doy, extract(epoch FROM o_orderdate) AS secs,
          CAST(extract(year FROM o_orderdate) AS BIGINT) AS y, CAST(extract(quarter FROM o_orderdate) AS BIGINT) AS q FROM orders""")


@query(r"SELECT c_custkey FROM customer WHERE regexp_matches(c_name, '\d+1$') AND NOT regexp_matches(c_mktsegment, '(?i)^build')")
def sql_regex(t: Tables) -> DataFrame:
    return _session(t, "customer").execute(r"SELECT c_custkey FROM customer WHERE c_name ~ '\d+1$' AND c_mktsegment !~* '^build'")


@query("SELECT row_number() OVER (ORDER BY o_orderkey) + 99 AS id, o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey) + 499 AS other FROM orders")
def sql_nextval(t: Tables) -> DataFrame:
    """A sequence as DEFAULT and in a SELECT: a value for each row."""
    s = _session(t, "orders")
    return s.execute("""
        CREATE SEQUENCE ids START WITH 100; CREATE SEQUENCE others START WITH 500;
        CREATE TABLE numbered (id BIGINT PRIMARY KEY DEFAULT nextval('ids'), k BIGINT UNIQUE, other BIGINT);
        INSERT INTO numbered (k, other) SELECT o_orderkey, nextval('others') AS n FROM orders;
        SELECT * FROM numbered""")


@query("SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation, c_acctbal AS balance FROM customer UNION ALL SELECT s_suppkey + 1000000000, 'new', 1, NULL FROM supplier")
def sql_ddl_rollback(t: Tables) -> DataFrame:
    return _loaded(t).execute("""
        BEGIN; ALTER TABLE c ADD COLUMN extra INT DEFAULT 5; ALTER TABLE c RENAME COLUMN name TO label; DELETE FROM c WHERE balance < 0; DROP TABLE IF EXISTS nothing; ROLLBACK;
        INSERT INTO c (id, name, nation) SELECT s_suppkey + 1000000000, 'new', 1 FROM supplier;
        SELECT * FROM c""")


@query("SELECT c_custkey AS id, c_name AS label, c_nationkey // 2 AS half, 'none' AS note FROM customer WHERE c_acctbal >= 0")
def sql_alter(t: Tables) -> DataFrame:
    return _loaded(t).execute("""
        DELETE FROM c WHERE balance < 0; ALTER TABLE c RENAME COLUMN name TO label; ALTER TABLE c ADD COLUMN note TEXT DEFAULT 'none';
        UPDATE c SET nation = nation / 2; ALTER TABLE c RENAME COLUMN nation TO half; ALTER TABLE c DROP COLUMN balance; ALTER TABLE c RENAME TO moved;
        SELECT id, label, half, note FROM moved""")


@query("VALUES ('check'), ('dimension'), ('duplicate'), ('foreign'), ('null'), ('null key'), ('unique'), ('update')", )
def sql_constraints(t: Tables) -> DataFrame:
    """The names of statements over all customers that a constraint refuses; those that it allows are left out."""
    s = _loaded(t)
    s.execute("""
        CREATE TABLE d (id BIGINT PRIMARY KEY, owner BIGINT REFERENCES c(id), code BIGINT UNIQUE, age INT CHECK (age > 0), v VECTOR(2));
        INSERT INTO d SELECT id, id, id, 1, NULL FROM c""")
    tries = {
        "duplicate": "INSERT INTO c SELECT id, name, nation, balance FROM c", "null": "INSERT INTO c (id, nation) SELECT id + 1000000000, 1 FROM c",
        "null key": "INSERT INTO c (name) SELECT name FROM c", "foreign": "INSERT INTO d (id, owner) SELECT id + 1000000000, id + 1000000000 FROM c",
        "unique": "INSERT INTO d (id, code) SELECT id + 1000000000, 7 FROM c", "check": "INSERT INTO d (id, age) SELECT id + 1000000000, 0 FROM c",
        "update": "UPDATE d SET code = 7", "dimension": "INSERT INTO d (id, v) SELECT id + 1000000000, '[1,2,3]' FROM c",
        "nulls are unique": "INSERT INTO d (id) SELECT id + 1000000000 FROM c", "check of null": "INSERT INTO d (id, age) SELECT id + 2000000000, NULL FROM c",
        "own value": "UPDATE d SET code = code",
    }
    refused = []
    for name, text in tries.items():
        try:
            s.execute(text)
        except ConstraintError:
            refused.append((name,))
    return t.spark.createDataFrame(refused, "col0 string")


@query("SELECT c_custkey AS id, coalesce(s_acctbal / 2, c_acctbal) AS balance, CASE WHEN s_suppkey IS NULL THEN c_name ELSE 'excluded.name = ' || c_name END AS name FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def sql_upsert(t: Tables) -> DataFrame:
    return _loaded(t).execute("""
        INSERT INTO c (id, name, nation, balance) SELECT s_suppkey, 'new', 0, s_acctbal FROM supplier
        ON CONFLICT (id) DO UPDATE SET balance = excluded.balance / 2, name = 'excluded.name = ' || name;
        SELECT c.id, balance, name FROM c JOIN customer ON c.id = c_custkey""")


@query("SELECT n_nationkey AS id, n_name || '''s' AS name FROM nation")
def sql_dump(t: Tables) -> DataFrame:
    """A table dumped as SQL text and read back."""
    s = _session(t, "nation")
    s.execute("CREATE TABLE dumped (id INT PRIMARY KEY, name TEXT); INSERT INTO dumped SELECT n_nationkey, n_name || '''s' FROM nation")
    text = "\n".join(s.dump())
    return s.execute(f"DROP TABLE dumped; {text} SELECT * FROM dumped")


@query("SELECT 'one' AS base, c_custkey AS id FROM customer WHERE c_acctbal > 0 UNION ALL SELECT 'two', c_custkey FROM customer WHERE c_nationkey = 3")
def sql_databases_and_views(t: Tables) -> DataFrame:
    s = _session(t, "customer")
    s.execute("CREATE TABLE rich (id BIGINT); INSERT INTO rich SELECT c_custkey FROM customer WHERE c_acctbal > 0; CREATE VIEW first_base AS SELECT 'one' AS base, id FROM rich")
    s.execute("CREATE DATABASE two; USE two; CREATE TABLE rich (id BIGINT); INSERT INTO rich SELECT c_custkey FROM customer WHERE c_nationkey = 3")
    return s.execute("SELECT * FROM first_base UNION ALL SELECT 'two', id FROM rich")


@query("SELECT count(*) AS result_rows, true AS counted, true AS warned, true AS suggested FROM customer JOIN nation ON c_custkey > n_nationkey")
def sql_explain_json(t: Tables) -> DataFrame:
    """EXPLAIN (ANALYZE, FORMAT JSON) of a join without equal keys."""
    s = _session(t, "customer", "nation")
    plan = json.loads(s.execute("EXPLAIN (ANALYZE, FORMAT JSON) SELECT c_custkey, n_nationkey FROM customer JOIN nation ON c_custkey > n_nationkey").first().plan)

    def counts(node: dict) -> list[int]:
        return [node["rows"]] * ("rows" in node) + [x for c in node["children"] for x in counts(c)]

    row = (plan["rows"], plan["rows"] in counts(plan["plan"]), any("every pair" in w for w in plan["warnings"]), bool(plan["suggestions"]))
    return t.spark.createDataFrame([row], "result_rows long, counted boolean, warned boolean, suggested boolean")


@query(f"SELECT vec_id, round(list_distance(embedding::DOUBLE[], {SQL_PROBE}), 6) AS distance FROM embeddings WHERE vec_id % 3 <> 0 ORDER BY list_distance(embedding::DOUBLE[], {SQL_PROBE}), vec_id LIMIT 10")
def sql_vector_index(t: Tables) -> DataFrame:
    """CREATE INDEX on a vector column, rows deleted, inserted and updated afterwards, then a search of the index."""
    s = _session(t, "embeddings")
    s.execute("""
        CREATE TABLE e (id BIGINT PRIMARY KEY, v VECTOR(64), w BIGINT); INSERT INTO e SELECT vec_id, embedding, 0 FROM embeddings WHERE vec_id % 5 <> 0;
        CREATE INDEX near ON e USING hnsw (v) WITH (lists = 16);
        INSERT INTO e SELECT vec_id, embedding, 1 FROM embeddings WHERE vec_id % 5 = 0;
        UPDATE e SET w = w + 1 WHERE id % 2 = 0; DELETE FROM e WHERE id % 3 = 0""")
    return s.nearest("near", PROBE, 10).selectExpr("vec_id", "round(distance, 6) AS distance")


@query("""
    SELECT c_nationkey, c_mktsegment, count(*) AS n, sum(CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END) AS rich FROM customer
    GROUP BY GROUPING SETS ((c_nationkey, c_mktsegment), (c_nationkey), ())""")
def sql_grouping_sets(t: Tables) -> DataFrame:
    return _session(t, "customer").execute("SELECT c_nationkey, c_mktsegment, count(*) AS n, sum(CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END) AS rich FROM customer GROUP BY GROUPING SETS ((c_nationkey, c_mktsegment), (c_nationkey), ())")


@query("""
    SELECT c_custkey, c_nationkey IS DISTINCT FROM s_nationkey AS differs, (c_acctbal > 0) IS TRUE AS rich, (c_nationkey, c_custkey) = (s_nationkey, s_suppkey) AS same,
      DATE '2020-02-29' + INTERVAL 1 DAY = DATE '2020-03-01' AS leap
    FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey""")
def sql_predicates(t: Tables) -> DataFrame:
    return _session(t, "customer", "supplier").execute("""
        SELECT c_custkey, c_nationkey IS DISTINCT FROM s_nationkey AS differs, (c_acctbal > 0) IS TRUE AS rich, (c_nationkey, c_custkey) = (s_nationkey, s_suppkey) AS same,
          DATE '2020-02-29' + INTERVAL 1 DAY = DATE '2020-03-01' AS leap
        FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey""")


@query("SELECT o_orderstatus, count(*) AS n, min(c_name) AS first_name, max(c_name) AS last_name FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_orderstatus")
def merge_join_sort_aggregate(t: Tables) -> DataFrame:
    """A sort-merge join by hint, and an aggregate of strings, which runs over sorted rows."""
    return _session(t, "orders", "customer").execute("SELECT /*+ MERGE(customer) */ o_orderstatus, count(*) AS n, min(c_name) AS first_name, max(c_name) AS last_name FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_orderstatus")


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey BETWEEN 20 AND 60 AND c_nationkey <> 3 UNION ALL SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey = 7")
def sql_parameters(t: Tables) -> DataFrame:
    s = _session(t, "customer")
    return s.execute("SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey BETWEEN $2 / 2 AND $1 AND c_nationkey <> $3 UNION ALL SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey = $4", [60, 40, 3, 7])


@query("SELECT c_custkey AS id, c_name AS name, c_nationkey + 1 AS nation, c_acctbal AS balance FROM customer WHERE c_acctbal >= 0")
def sql_savepoint(t: Tables) -> DataFrame:
    return _loaded(t).execute("""
        BEGIN; DELETE FROM c WHERE balance < 0; SAVEPOINT poor; UPDATE c SET balance = 0; ALTER TABLE c DROP COLUMN name; ROLLBACK TO SAVEPOINT poor;
        UPDATE c SET nation = nation + 1; COMMIT; SELECT * FROM c""")


@query("""
    SELECT o_custkey, array_to_string(list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey), ',') AS dearest, array_to_string(list(DISTINCT o_orderstatus ORDER BY o_orderstatus), ',') AS states
    FROM orders GROUP BY o_custkey""")
def sql_array_agg_order(t: Tables) -> DataFrame:
    return _session(t, "orders").execute("""
        SELECT o_custkey, array_join(array_agg(CAST(o_orderkey AS TEXT) ORDER BY o_totalprice DESC, o_orderkey), ',') AS dearest, array_join(array_agg(DISTINCT o_orderstatus ORDER BY o_orderstatus), ',') AS states
        FROM orders GROUP BY o_custkey""")


@query("SELECT n_name, count(c_custkey) AS n, min(c_name) AS first_name FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 10.5 WHERE n_name <> 'CHINA' GROUP BY n_name HAVING count(c_custkey) >= 2")
def built_select(t: Tables) -> DataFrame:
    """A statement built from clauses, with bound values."""
    counted = Statement.select("n_name", "count(c_custkey) AS n", "min(c_name) AS first_name").of("nation").group("n_name").having("count(c_custkey) >= ?", 2)
    return counted.join("customer", "c_nationkey = n_nationkey AND c_acctbal > ?", 10.5, how="left").where("n_name <> ?", "CHINA").run(_session(t, "nation", "customer"))


@query("SELECT c_custkey AS id, 'it''s ?; --' AS name, c_nationkey AS nation, c_acctbal * 2 AS balance FROM customer WHERE c_acctbal >= 100 UNION ALL SELECT -1, 'added', NULL, NULL")
def built_changes(t: Tables) -> DataFrame:
    s = _loaded(t)
    Statement.delete("c").where("balance < ?", 100).run(s)
    Statement.update("c").set("name", "it's ?; --").set_to("balance", "balance * ?", 2).run(s)
    Statement.insert("c", "id", "name").values(-1, "added").run(s)
    return Statement.select().of("c").run(s)
