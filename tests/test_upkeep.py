"""Cubes that follow their tables, supplied aggregations as rules, feeds with states, first loads, repair, bundles and fences."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.engine import Engine
from tessera.functions import bundles
from tessera.operators import exact
from tessera.operators.policy import Policy
from tessera.session import Refused
from tessera.sources.warehouse import Warehouse
from tessera.streaming import feeds


def facts(spark, n: int):
    return spark.createDataFrame([("n", "x", 1.0 * n), ("s", "x", 2.0 * n), ("s", "y", 4.0 * n)], "region string, kind string, amount double")


CUBE = "CREATE CUBE c FROM shop.f DIMENSION region DIMENSION kind MEASURE amount (SUM ALONG region, SUM ALONG kind)"
ASK = "SELECT value, snapshot, materialised, from_cuboid FROM cube_rollup('c', 'amount', 'by=region') WHERE region = 's'"


@pytest.fixture
def shop(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "wh"), allow_aggregations=True)
    e.warehouse.publish("shop.f", facts(spark, 1))
    return e


def test_cubes_follow_their_table(shop, spark):
    shop.sql(CUBE)
    assert shop.rows(ASK) == [(6.0, "0", False, None)]
    shop.warehouse.publish("shop.f", facts(spark, 10))
    assert shop.rows(ASK) == [(66.0, "1", False, None)]


def test_maintained_and_pinned(shop, spark):
    """Within its versions a maintained cube answers from what it keeps; behind them everything it keeps is made anew."""
    shop.sql(CUBE + " MAINTAINED WITHIN 1 VERSIONS PINNED (region)")
    assert shop.rows(ASK) == [(6.0, "0", True, "region")]
    shop.warehouse.publish("shop.f", facts(spark, 10))
    assert shop.rows(ASK) == [(6.0, "0", True, "region")]
    shop.warehouse.publish("shop.f", facts(spark, 100))
    assert shop.rows(ASK) == [(666.0, "2", True, "region")]
    assert shop.cubes["c"].refresh() == 0
    for wrong in (CUBE.replace("CUBE c", "CUBE d") + " PINNED (colour)", "CREATE CUBE d FROM (SELECT * FROM shop.f) DIMENSION region DIMENSION kind MEASURE amount (SUM ALONG region, SUM ALONG kind) MAINTAINED WITHIN 2 VERSIONS"):
        with pytest.raises(Refused):
            shop.sql(wrong)


def test_aggregation_as_a_rule(shop):
    """Its states merge over the facts themselves; finished values are never merged."""
    shop.sql("CREATE AGGREGATION spread LANGUAGE PYTHON AS $$\ndef start(): return (1e300, -1e300)\ndef accumulate(s, x): return (min(s[0], x), max(s[1], x))\ndef merge(a, b): return (min(a[0], b[0]), max(a[1], b[1]))\ndef finish(s): return s[1] - s[0]\n$$")
    shop.sql("CREATE CUBE c FROM shop.f DIMENSION region DIMENSION kind MEASURE amount (AGGREGATION spread ALONG region, AGGREGATION spread ALONG kind)")
    rows = shop.sql("SELECT region, value FROM cube_rollup('c', 'amount', 'by=region')").collect()
    assert {r["region"]: r["value"] for r in rows} == {"n": 0.0, "s": 2.0}
    assert shop.scalar("SELECT value FROM cube_rollup('c', 'amount')") == 3.0
    assert shop.scalar("SELECT value FROM cube_rollup('c', 'amount', 'where=kind:x')") == 1.0
    for wrong in ("AGGREGATION ALONG region, SUM ALONG kind", "AGGREGATION none ALONG region, AGGREGATION none ALONG kind"):
        with pytest.raises(Refused, match="aggregation"):
            shop.sql(f"CREATE CUBE d FROM shop.f DIMENSION region DIMENSION kind MEASURE amount ({wrong})")
    shop.sql("CREATE CUBE m FROM shop.f DIMENSION region DIMENSION kind MEASURE amount (AGGREGATION spread ALONG region, SUM ALONG kind)")
    with pytest.raises(Refused, match="mix"):
        shop.sql("SELECT * FROM cube_rollup('m', 'amount')")


@pytest.mark.parametrize("code", ["import os", "from os import path", "x = ().__class__", "open('/etc/passwd')", "eval('1')", "getattr(1, 'real')", "def start():\n while True: pass", "x = '{0.__class__}'.format(1)", "class A: pass"])
def test_fence_around_supplied_code(code):
    with pytest.raises((Refused, NameError)):
        exact.supplied("bad", code + "\ndef start(): return 0\ndef accumulate(s, x): return s + x\ndef merge(a, b): return a + b\ndef finish(s): return s")


def test_feeds_have_states(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "wh"))
    at = tmp_path / "in"
    at.mkdir()
    good = '{"id": %d}\n'
    feed = feeds.Feed("f", (feeds.FeedColumn("id", "bigint", False),))
    e.feeds.declare(feed, str(at), "web.f")
    with pytest.raises(Refused):
        e.feeds.declare(feed, str(at), "web.f")
    shown = lambda: [tuple(r) for r in e.sql("SHOW FEEDS").collect()]
    assert shown() == [("f", "declared", None, "web.f", 0, 0)]
    (at / "1.json").write_text("".join(good % i for i in range(5)) + "bad\n")
    assert e.feeds.run("f") == "done" and shown() == [("f", "done", None, "web.f", 5, 1)]
    (at / "2.json").write_text("bad\n" * 3 + good % 9)
    assert e.feeds.run("f") == "stopped"
    assert shown()[0][1] == "stopped" and "3 of 4" in shown()[0][2] and shown()[0][4] == 5
    with pytest.raises(Refused, match="stopped"):
        e.feeds.run("f")
    again = Engine(spark, str(tmp_path / "wh"))  # the state outlives the session
    assert again.sql("RESUME FEED f").first()[0] == "done"
    assert shown() == [("f", "done", None, "web.f", 6, 4)]
    (at / "3.json").write_text("bad\n" * 2)
    assert e.feeds.run("f") == "stopped"
    for wrong in ("RESUME FEED none",):
        with pytest.raises(Refused):
            e.sql(wrong)
    with pytest.raises(Refused, match="warehouse"):
        Engine(spark).sql("SHOW FEEDS")


def test_first_load_and_stream_cover_exactly(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path / "wh"))
    rows = "k long, v string, commit_pos long, op string"
    feeds.first_load(spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), w, "s.t", ["k"], 10)
    with pytest.raises(Refused):
        feeds.first_load(spark.createDataFrame([(1, "a")], "k long, v string"), w, "s.t", ["k"], 10)
    at = str(tmp_path / "changes")
    spark.createDataFrame([(1, "old", 9, "U"), (2, "b", 10, "I"), (1, "new", 11, "U"), (3, "c", 12, "I"), (2, None, 13, "D")], rows).write.parquet(at)
    stream = lambda: spark.readStream.schema(rows).parquet(at)
    with pytest.raises(Refused, match="11 to 11"):
        feeds.apply_changes(stream(), w, "s.t", ["k"], str(tmp_path / "cp"), kept_from=12)
    feeds.apply_changes(stream(), w, "s.t", ["k"], str(tmp_path / "cp"), kept_from=11).awaitTermination()
    assert {r["k"]: r["v"] for r in w.table("s.t").collect()} == {1: "new", 3: "c"}
    assert w.table("s.t", resolved=False).where("commit_pos < 10 or op = 'I' and k = 2 and commit_pos > 10").count() == 0
    q = feeds.apply_changes(stream(), w, "s.t", ["k"], str(tmp_path / "cp2"), kept_from=11, every="1 second")
    q.processAllAvailable()
    q.stop()
    assert {r["k"]: r["v"] for r in w.table("s.t").collect()} == {1: "new", 3: "c"}


def test_repair_derives_and_never_guesses(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path / "wh"))
    w.publish("s.t", spark.range(10).coalesce(1))
    w.publish("s.t", spark.range(10, 20).coalesce(1))
    paths = sorted(w.state("s.t")["files"], key=lambda p: w.state("s.t")["files"][p]["stats"]["id"][0])
    lied = [f | {"rows": 99, "stats": {"id": ["500", "600", 0]}} for p, f in w.state("s.t")["files"].items() if p == paths[0]]
    w._commit("s.t", lambda _: {"what": "append", "add": lied, "remove": [paths[0]], "schema": None, "data_change": True})
    assert w.verify("s.t") and w.table("s.t", where=[("id", "<", 5)]).count() == 0
    assert w.repair("s.t") == [] and w.verify("s.t") == []
    assert w.table("s.t", where=[("id", "<", 5)]).count() == 5 and w.table("s.t").count() == 20
    v = w.version("s.t")
    assert w.repair("s.t") == [] and w.version("s.t") == v
    w.store.delete(paths[1])
    assert w.repair("s.t") == [f"missing: {paths[1]}"]


FLEET = {"pack": "fleet", "functions": [{"name": "fleet_cost", "takes": [["km", "double"], ["rate", "double"]], "gives": "double", "is": "km * rate", "refuses": [["km < 0", "a distance isn't negative"]], "examples": [[[2, 3], 6], [[None, 3], None]]}, {"name": "fleet_label", "takes": [["s", "string"]], "gives": "string", "is": "upper(concat(s, '!'))", "examples": [[["it's"], "IT'S!"]]}]}


def test_bundles(spark):
    assert bundles.load(spark, json.dumps(FLEET)) == ["fleet_cost", "fleet_label"]
    assert spark.sql("SELECT fleet_cost(2D, 5D) AS c").first()["c"] == 10.0
    with pytest.raises(Exception, match="negative"):
        spark.sql("SELECT fleet_cost(-1D, 5D)").collect()


@pytest.mark.parametrize("change", [{"is": "(SELECT 1)"}, {"is": "km * rand()"}, {"is": "reflect('java.lang.System', 'exit')"}, {"is": "km *"}, {"is": "nope(km)"}, {"name": "cost"}, {"gives": "blob"}, {"takes": [["km", "double"], ["km", "double"]]}, {"examples": [[[2, 3], 7]]}, {"is": "sum(km)"}])
def test_bundles_are_taken_whole_or_not(spark, change):
    made = json.loads(json.dumps(FLEET).replace("fleet", "ferry"))
    made["functions"][0] |= change
    with pytest.raises(Refused):
        bundles.load(spark, json.dumps(made))
    with pytest.raises(Exception, match="ferry_label"):
        spark.sql("SELECT ferry_label('x')").collect()


def test_information_schema(shop, spark):
    shop.add("seen", spark.range(1))
    shop.policy("shop.f", Policy(hidden=("amount",)))
    assert shop.rows("SELECT table_schema, table_name, table_type FROM information_schema.tables ORDER BY 2") == [("shop", "f", "BASE TABLE"), ("main", "seen", "VIEW")]
    assert shop.rows("SELECT column_name FROM information_schema.columns WHERE table_name = 'f' ORDER BY ordinal_position") == [("region",), ("kind",)]
    assert shop.sql("SELECT * FROM information_schema.schemata").count() == 2
    with pytest.raises(Refused):
        shop.sql("SELECT * FROM information_schema.routines")


def test_lower_quantiles_of_large_and_odd_groups(spark):
    """One group with most rows, ties, a null group and nulls; the same as by sorting, however many parts there are."""
    r = random.Random(2)
    rows = [("hot", float(r.randrange(300))) for _ in range(2000)] + [(g, float(r.randrange(9))) for g in ("a", "b", None) for _ in range(11)] + [("one", 5.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(7)
    for q in (0, 0.37, 0.5, 1):
        found = {x["g"]: x["v"] for x in exact.lower_quantile(df, ["g"], "x", q, "v").collect()}
        expected = {g: sorted(v for h, v in rows if h == g and v is not None) for g in ("hot", "a", "b", None, "one")}
        assert found == {g: v[int(q * (len(v) - 1))] for g, v in expected.items()}
    everything = sorted(v for _, v in rows if v is not None)
    assert exact.lower_quantile(df, [], "x", 0.37, "v").first()["v"] == everything[int(0.37 * (len(everything) - 1))]
    assert df.where(F.col("x").isNotNull()).count() == len(everything)
