"""The door for SQL: what names mean, what policies hide, and which files a query reads."""

import pytest

from tessera.engine import Engine
from tessera.operators.policy import Mask, Policy
from tessera.session import Refused


@pytest.fixture
def door(spark, small):
    e = Engine(spark)
    for t in ("nation", "region"):
        e.add(t, spark.read.parquet(f"{small}/{t}.parquet"))
    e.policy("nation", Policy(rows="n_regionkey = 2", masks={"n_name": Mask("partial", keep=1)}))
    spark.read.parquet(f"{small}/nation.parquet").createOrReplaceTempView("nation")
    yield e
    spark.catalog.dropTempView("nation")


@pytest.mark.parametrize("relation,rows", [("nation", 5), ("(nation)", 5), ("`nation`", 5), ("NATION", 5), ("region, nation", 25), ("nation AS x", 5), ("(SELECT * FROM nation)", 5), ("region r JOIN nation ON true", 25), ("region, LATERAL (SELECT * FROM nation)", 25), ("(TABLE nation)", 5), ("nation /* all */ -- of it", 5)])
def test_policies_hold_for_every_spelling(door, relation, rows):
    assert door.scalar(f"SELECT count(*) FROM {relation}") == rows


@pytest.mark.parametrize("query", ["SELECT (SELECT count(*) FROM nation)", "SELECT count(*) FROM region WHERE EXISTS (SELECT 1 FROM nation) HAVING count(*) > 0", "WITH a AS (SELECT * FROM nation) SELECT count(*) FROM a", "WITH a AS (WITH b AS (SELECT * FROM nation) SELECT * FROM b) SELECT count(*) FROM a", "SELECT count(*) FROM (FROM nation SELECT n_name)"])
def test_policies_hold_in_subqueries(door, query):
    assert door.scalar(query) == 5


def test_masks_hold_in_filters(door):
    assert door.scalar("SELECT count(*) FROM nation WHERE n_name = 'CHINA'") == 0
    assert all(r[0].startswith("*") for r in door.rows("SELECT nation.n_name FROM nation"))


@pytest.mark.parametrize(
    "query",
    ["SELECT * FROM parquet.`{small}/nation.parquet`", "SELECT * FROM csv.`/etc/passwd`", "SELECT (SELECT count(*) FROM parquet.`{small}/nation.parquet`)", "WITH a AS (SELECT * FROM parquet.`{small}/nation.parquet`) SELECT * FROM a", "SELECT * FROM IDENTIFIER('na' || 'tion')", "SELECT * FROM global_temp.nation", "SELECT * FROM nation VERSION AS OF 1",
     "SELECT * FROM nation TABLESAMPLE (3 ROWS)", "SELECT reflect('java.lang.System', 'getProperty', 'user.home')", "SELECT * FROM ${{spark.app.name}}", "SELECT * FROM nowhere", "DESCRIBE nation", "SHOW TABLES", "CACHE TABLE nation", "FROM nation INSERT INTO region SELECT *", "SELECT * FROM a.b.nation"],
)
def test_no_other_way_in(door, small, query):
    """Paths, views of the session, and statements: nothing is read but known tables."""
    with pytest.raises((Refused, Exception)) as e:
        door.sql(query.format(small=small)).collect()
    assert isinstance(e.value, Refused) or "PARSE" in str(e.value) or "UNSUPPORTED" in str(e.value)


def test_names_are_what_the_parser_says(door):
    assert door.scalar("SELECT 'read from nation today'") == "read from nation today"
    assert door.scalar("SELECT '-- no /* comment */ 😀' FROM nation LIMIT 1") == "-- no /* comment */ 😀"
    assert door.rows("WITH nation AS (SELECT 1 AS x) SELECT * FROM nation") == [(1,)]
    assert door.rows("WITH nation AS (SELECT 1 AS x) SELECT * FROM (SELECT * FROM NATION)") == [(1,)]
    assert door.scalar("WITH a AS (SELECT count(*) AS n FROM nation), nation AS (SELECT n FROM a) SELECT n FROM nation") == 5
    assert door.scalar("WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 4) SELECT max(n) FROM r") == 4
    assert door.scalar("SELECT 'cubes()' AS cubes") == "cubes()" and door.sql("SELECT * FROM cubes()").count() == 0
    assert door.scalar("SELECT count(*) AS nation FROM nation n JOIN region ON n.n_regionkey = region.r_regionkey") == 5
    assert door.scalar("SELECT max(nation) FROM (SELECT n_nationkey AS nation FROM nation)") is not None


def test_explain_and_row_limit(door):
    assert "Filter" in door.scalar("EXPLAIN SELECT * FROM nation") and "Physical Plan" in door.scalar("EXPLAIN FORMATTED SELECT * FROM nation")
    with pytest.raises(Refused):
        door.sql("EXPLAIN SELECT * FROM parquet.`/x`")
    door.max_rows = 5
    assert door.sql("SELECT * FROM nation").count() == 5
    door.max_rows = 4
    with pytest.raises(Refused):
        door.sql("SELECT * FROM nation")


@pytest.fixture
def shop(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "wh"))
    for part in range(5):
        df = spark.range(part * 100, part * 100 + 100).selectExpr("id AS k", "cast(id % 7 AS string) AS v", f"date'2024-01-01' + {part} AS day", "if(id % 10 = 0, null, id * 1.5) AS x")
        e.warehouse.publish("shop.t", df.coalesce(1))
    e.warehouse.publish("other.t2", spark.range(3).withColumnRenamed("id", "k"))
    return e


def read(df) -> int:
    """Files that the query's scans hold."""
    return len(df.inputFiles())


@pytest.mark.parametrize(
    "query,files,rows",
    [
        ("SELECT * FROM shop.t WHERE k = 250", 1, 1), ("SELECT * FROM shop.t WHERE 250 = k", 1, 1), ("SELECT * FROM t WHERE k >= 150 AND k < 250 AND v = '3'", 2, 15), ("SELECT * FROM t WHERE k BETWEEN 10 AND 20", 1, 11), ("SELECT * FROM t WHERE 300 > k", 3, 300), ("SELECT * FROM t WHERE k IN (5, 110)", 2, 2), ("SELECT * FROM t WHERE day = date'2024-01-03'", 1, 100),
        ("SELECT * FROM (SELECT k + 0 AS q, k FROM t) WHERE k = 499", 1, 1), ("WITH a AS (SELECT * FROM t) SELECT * FROM a WHERE k < 50", 1, 50), ("SELECT * FROM t a JOIN t b ON a.k = b.k WHERE a.k < 10", 1, 10), ("SELECT * FROM t WHERE k < 0", 0, 0), ("SELECT * FROM t WHERE k = 5 OR k = 450", 5, 2),
        ("WITH a AS (SELECT * FROM t) SELECT k FROM a WHERE k = 5 UNION ALL SELECT k FROM a WHERE k = 450", 5, 2), ("SELECT * FROM t WHERE x IS NULL AND k > 420", 1, 7), ("SELECT * FROM t WHERE k = (SELECT max(k) FROM other.t2)", 5, 1), ("SELECT (SELECT count(*) FROM shop.t WHERE k = 7) AS n FROM other.t2", None, 3),
    ],
)
def test_conditions_skip_files(shop, query, files, rows):
    """Conditions are lifted out of the query, wherever Catalyst carries them; the rows are those of all files."""
    df = shop.sql(query)
    assert df.count() == rows
    if files is not None:
        assert read(df) <= files + ("other" in query)


def test_policy_conditions_skip_files_too(shop):
    shop.policy("shop.t", Policy(rows="k >= 400"))
    df = shop.sql("SELECT * FROM T")
    assert df.count() == 100 and read(df) == 1
    assert shop.scalar("SELECT count(*) FROM shop.t WHERE k < 400") == 0


def test_policy_by_a_bare_name(shop):
    shop.policy("T2", Policy(rows="k > 1"))
    assert shop.scalar("SELECT count(*) FROM other.t2") == 1 and shop.scalar("SELECT count(*) FROM t2") == 1 and shop.table("other.t2").count() == 1


def test_qualified_names(shop, spark):
    assert shop.scalar("SELECT count(shop.t.k) FROM shop.t WHERE shop.t.k < 10 AND t.k > 1") == 8
    assert shop.scalar("SELECT count(*) FROM `shop`.`t` JOIN other.t2 ON shop.t.k = other.t2.k") == 3
    shop.warehouse.publish("other.t", spark.range(2))
    with pytest.raises(Refused, match="other.t"):
        shop.sql("SELECT * FROM t")
    assert shop.scalar("SELECT count(*) FROM OTHER.T") == 2


def test_keyed_tables_skip_by_key_only(spark, tmp_path):
    """A condition on another column must not hide a newer row."""
    e = Engine(spark, str(tmp_path / "wh"))
    rows = "k long, v string, commit_pos long, op string"
    e.warehouse.publish("s.c", spark.createDataFrame([(1, "a", 1, "I"), (2, "b", 2, "I")], rows).coalesce(1), key=["k"])
    e.warehouse.publish("s.c", spark.createDataFrame([(1, "z", 3, "U")], rows).coalesce(1), key=["k"])
    assert e.sql("SELECT * FROM s.c WHERE v = 'a'").count() == 0
    assert e.rows("SELECT k FROM s.c WHERE v = 'z'") == [(1,)] and e.rows("SELECT v FROM s.c WHERE k = 2") == [("b",)]
