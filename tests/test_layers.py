"""Cubes, graphs, versioned tables, policies, exactness, feeds and the SQL door: refusals and small cases."""

import heapq
import json
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.engine import Engine
from tessera.operators import exact
from tessera.operators.cube import Cube, Definition, Dimension, Measure
from tessera.operators.graph import Budget, Graph
from tessera.operators.policy import Mask, Policy
from tessera.plans import layers
from tessera.session import Refused, check, within
from tessera.sources.warehouse import Warehouse, latest_per_key, splice
from tessera.streaming import feeds


# Cubes
def cube(spark, rules=None, rows=None, **more):
    facts = spark.createDataFrame(rows or [("n", "q1", 1.0), ("n", "q2", 2.0), ("s", "q1", 4.0), (None, "q1", 8.0), ("s", "q2", None)], "region string, period string, amount double")
    d = Definition("c", (Dimension("region"), Dimension("period")), (Measure("amount", "amount", rules or {"region": "sum", "period": "sum"}),))
    return Cube(d, facts, **more)


def test_completeness_is_counted_and_demanded(spark):
    c = cube(spark)
    r = c.rollup("amount", []).first()
    assert (r["value"], r["withheld"], r["completeness"]) == (7.0, 2, 0.6)
    with pytest.raises(Refused):
        c.rollup("amount", [], min_completeness=0.7)


def test_rules_that_do_not_compose_are_refused(spark):
    for rule in ("mean", "none"):
        with pytest.raises(Refused):
            cube(spark, {"region": rule, "period": "sum"}).rollup("amount", ["period"])
    with pytest.raises(Refused):
        cube(spark, {"region": "sum", "period": "last"}).rollup("amount", ["region"])
    c = cube(spark, {"region": "sum", "period": "last"})
    assert {r["region"]: r["value"] for r in c.rollup("amount", ["region"], order={"period": ["q1", "q2"]}).collect()} == {"n": 2.0, "s": 4.0}
    with pytest.raises(Exception, match="lacks member"):
        c.rollup("amount", ["region"], order={"period": ["q1"]}).collect()


def test_all_that_is_wrong_is_named():
    d = Definition("c", (Dimension("a"), Dimension("a"), Dimension(" ")), (Measure("m", "x", {"z": "sum", "a": "most"}),))
    said = "; ".join(d.rejections(["a"]))
    for part in ("twice", "blank", "no rule", "no dimension", "unknown", "no column"):
        assert part in said


def test_hierarchies(spark):
    up = lambda *e: {"region": spark.createDataFrame(list(e), "child string, parent string")}
    c = cube(spark, hierarchies=up(("n", "w"), ("s", "w")))
    assert {(r["region"], r["period"]): r["value"] for r in c.consolidate("amount", "region").collect()} == {("w", "q1"): 5.0, ("w", "q2"): 2.0}
    with pytest.raises(Refused, match="cycle"):
        cube(spark, hierarchies=up(("n", "w"), ("w", "n")))
    with pytest.raises(Refused, match="two parents"):
        cube(spark, hierarchies=up(("n", "w"), ("n", "x"), ("s", "w"))).consolidate("amount", "region")
    with pytest.raises(Refused, match="not in its hierarchy"):
        cube(spark, hierarchies=up(("n", "w"))).consolidate("amount", "region")
    both = cube(spark, hierarchies=up(("n", "w"), ("n", "x"), ("s", "w"), ("w", "all"), ("x", "all")))
    assert sum(r["value"] for r in both.consolidate("amount", "region", "all").collect()) == 7.0


def test_slices_overlays_and_cuboids(spark):
    c = cube(spark)
    with pytest.raises(Refused):
        c.slice("amount", ("planet", "x"))
    with pytest.raises(Refused):
        c.add_overlay("o", spark.createDataFrame([("n", "set", 1.0)], "region string, op string, amount double"))
    with pytest.raises(Refused):
        c.rollup("amount", [], overlay="none")
    grains = c.choose_grains("amount", 100)
    assert ("region",) in grains or ("period",) in grains
    c.materialise("amount", [["region"]])
    r = c.rollup("amount", []).first()
    assert r["from_cuboid"] == "region" and r["value"] == 7.0
    c.retire()
    assert c.rollup("amount", []).first()["materialised"] is False


# Graphs
def graph(spark, edges, **more):
    return Graph(spark.createDataFrame(edges, "src string, dst string, w double, a long, b long"), weight="w", valid_from="a", valid_until="b", **more)


E1 = [("a", "b", 1.0, 1, 9), ("b", "c", 2.0, 3, 9), ("c", "d", 1.0, 2, 9), ("b", "e", 5.0, 4, 4), ("d", "b", 1.0, 5, 9), ("a", "a", 1.0, 1, 9), ("a", "c", 9.0, 7, None)]


def test_reachable(spark):
    g = graph(spark, E1)
    assert {r["vertex"]: (r["depth"], r["via"]) for r in g.reachable(["a"]).collect()} == {"a": (0, None), "b": (1, "a"), "c": (1, "a"), "d": (2, "c"), "e": (2, "b")}
    assert {r["vertex"] for r in g.reachable(["a"], max_depth=1).collect()} == {"a", "b", "c"}
    assert g.reachable(["a"], max_depth=1).first()["truncated"]
    assert not g.reachable(["a"]).first()["truncated"]
    assert {r["vertex"] for r in g.reachable(["d"], direction="in").collect()} == {"a", "b", "c", "d"}
    assert {r["vertex"] for r in graph(spark, E1, budget=Budget(degree=1)).reachable(["a"]).collect()} == {"a"}
    with pytest.raises(Refused):
        g.reachable(["nobody"])
    with pytest.raises(Refused):
        g.reachable(["a"], types=["none"])


def test_paths(spark):
    g = graph(spark, E1)
    steps = lambda df: [[r["vertex"] for r in df.where(f"path_id = {i}").orderBy("position").collect()] for i in range(df.agg(F.max("path_id")).first()[0] + 1)]
    assert steps(g.shortest_path("a", "d", 3)) == [["a", "b", "c", "d"], ["a", "c", "d"]]
    with pytest.raises(Refused):
        graph(spark, [("a", "b", -1.0, 0, 1)]).shortest_path("a", "b")
    assert sorted(tuple(r["vertex"] for r in sorted(rows, key=lambda r: r["position"])) for rows in by(g.cycles(["a", "b"]).collect(), "cycle_id")) == [("a", "a"), ("b", "c", "d", "b")]


def test_what_the_budget_cuts_is_refused(spark):
    """A vertex of more neighbours than the budget's degree, or a way longer than its depth, refuses what it could change."""
    hot = graph(spark, [("a", "h", 1.0, 1, 9), ("h", "x", 1.0, 2, 9), ("h", "y", 1.0, 2, 9), ("x", "a", 1.0, 3, 9), ("a", "z", 9.0, 1, 9), ("z", "x", 9.0, 4, 9)], budget=Budget(degree=2))
    assert hot.shortest_path("a", "x").first()["path_cost"] == 2.0
    hot.budget = Budget(degree=1)
    for asked in (lambda: hot.shortest_path("a", "x"), lambda: hot.cycles(["a"]), lambda: hot.time_respecting(["a"])):
        with pytest.raises(Refused):
            asked()
    edges = [(f"v{i}", f"v{i + 1}", 1.0, i, 99) for i in range(8)]
    far = graph(spark, [*edges, ("v8", "v0", 1.0, 50, 99)])
    for asked in (lambda: far.shortest_path("v0", "v8"), lambda: far.shortest_path("v0", "v2"), lambda: far.time_respecting(["v0"])):
        with pytest.raises(Refused):
            asked()
    far.budget = Budget(depth=9)
    assert far.shortest_path("v0", "v8").count() == 9 and far.time_respecting(["v0"]).count() == 9
    assert graph(spark, edges, budget=Budget(depth=3)).cycles(["v0"]).count() == 0


def by(rows, key):
    out: dict = {}
    for r in rows:
        out.setdefault(r[key], []).append(r)
    return out.values()


def test_time_respecting(spark):
    """Against all paths, on random graphs without waiting limits (then one label a vertex is enough)."""
    r = random.Random(1)
    for _ in range(3):
        edges = [(str(r.randrange(8)), str(r.randrange(8)), 1.0, t := r.randrange(20), t + r.choice([0, 5])) for _ in range(25)]
        edges.append(("0", "1", 1.0, 0, 1))
        best = {"0": 0}
        for _ in range(8):
            for s, d, _, a, b in sorted(edges, key=lambda e: e[3]):
                if b > a and s in best and a >= best[s] and a < best.get(d, 99):
                    best[d] = a
        found = graph(spark, edges, budget=Budget(depth=20)).time_respecting(["0"])
        assert {x["vertex"]: x["arrival"] for x in found.collect()} == best


def test_measures_of_graphs(spark):
    g = graph(spark, [("a", "b", 0.5, 0, 1), ("b", "c", 0.5, 0, 1), ("a", "c", 0.5, 0, 1), ("x", "y", 1.0, 0, 1)])
    assert {r["vertex"]: r["influence"] for r in g.influence(["a"]).collect()} == {"b": 0.5, "c": 0.75}
    assert {r["vertex"]: r["component"] for r in g.connected_components().collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    assert sum(r["rank"] for r in g.rank(10).collect()) == pytest.approx(1.0)
    assert {r["vertex"]: r["betweenness"] for r in graph(spark, [("a", "b", 1.0, 0, 1), ("b", "c", 1.0, 0, 1)]).betweenness().collect() if r["betweenness"]} == {"b": 1.0}
    two = graph(spark, [(p + s, p + d, 1.0, 0, 1) for p in "kl" for s, d in ("ab", "bc", "ca")] + [("ka", "la", 1.0, 0, 1)])
    found = two.communities()
    assert {r["community"] for r in found.collect()} == {"ka", "la"}
    assert two.modularity(found) == pytest.approx(6 / 7 - 0.5)


# Versioned tables
@pytest.fixture
def shop(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path / "wh"))
    w.publish("shop.t", spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"))
    w.publish("shop.t", spark.createDataFrame([(3, "c")], "k long, v string"))
    return w


def keys(df):
    return sorted(r["k"] for r in df.collect())


def test_versions_and_history(shop, spark):
    assert keys(shop.table("shop.t", 0)) == [1, 2] and keys(shop.table("t")) == [1, 2, 3]
    shop.publish("shop.t", spark.createDataFrame([(9, "z")], "k long, v string"), mode="overwrite")
    assert keys(shop.table("t")) == [9] and keys(shop.table("t", 1)) == [1, 2, 3]
    assert shop.changes("shop.t", 0, 2) == {"commits": 2, "rows_added": 2, "rows_removed": 3, "files_added": 2, "files_removed": len(shop.state("shop.t", 1)["files"]), "compactions": 0}
    for bad in (7, -1):
        with pytest.raises(Refused):
            shop.table("shop.t", bad)
    with pytest.raises(Refused):
        shop.table("nothing")


def test_schema_evolution_is_said(shop, spark):
    with pytest.raises(Refused, match="new"):
        shop.publish("shop.t", spark.createDataFrame([(4, "d", 1)], "k long, v string, n int"))
    with pytest.raises(Refused, match="not string"):
        shop.publish("shop.t", spark.createDataFrame([("4", "d")], "k string, v string"))
    shop.publish("shop.t", spark.createDataFrame([(4, "d", 1)], "k long, v string, n int"), evolve=True)
    assert {r["k"]: r["n"] for r in shop.table("t").collect()} == {1: None, 2: None, 3: None, 4: 1}


def test_of_two_writers_both_commit(shop, spark):
    """A commit that comes first makes the other try again on top."""
    real, raced = shop.store.create, []

    def create(path, text):
        if "_log/" in path and not raced:
            raced.append(path)
            real(path, json.dumps({"what": "append", "add": [], "remove": [], "schema": None, "data_change": True, "at": 0}))
        return real(path, text)

    shop.store.create = create
    assert shop.publish("shop.t", spark.createDataFrame([(4, "d")], "k long, v string")) == 3
    assert keys(shop.table("t")) == [1, 2, 3, 4]


def test_repeated_batches_change_nothing(shop, spark):
    df = spark.createDataFrame([(4, "d")], "k long, v string")
    assert shop.publish("shop.t", df, txn=("feed", 5)) == shop.publish("shop.t", df, txn=("feed", 5))
    assert keys(shop.table("t")) == [1, 2, 3, 4]


def test_clones_snapshots_and_drops(shop, spark):
    shop.create_snapshot("s", 1)
    shop.clone("shop.copy", "shop.t", 0)
    assert keys(shop.table("shop.copy")) == [1, 2] and shop.lineage("shop.copy")[0][1:3] == ("shop.t", 0)
    with pytest.raises(Refused, match="read by"):
        shop.drop("shop.t")
    with pytest.raises(Refused):
        shop.clone("other.copy", "shop.t")
    shop.set_snapshot("s")
    with pytest.raises(Refused, match="not in the snapshot"):
        shop.table("shop.copy")
    shop.set_snapshot(None)
    with pytest.raises(Refused):
        shop.set_snapshot("nothing")
    shop.set_version("shop.t", 0)
    assert keys(shop.table("t")) == [1, 2]
    shop.set_version("shop.t", None)


def test_files_are_skipped_compacted_and_verified(shop):
    assert len(shop.files("shop.t", None, [("k", ">", 2)])) < len(shop.files("shop.t"))
    assert keys(shop.table("t", where=[("k", ">=", 2), ("v", "<", "c")])) == [2]
    before = shop.version("shop.t")
    shop.compact("shop.t", ["k"])
    assert keys(shop.table("t")) == [1, 2, 3] and shop.changes("shop.t", before, before + 1)["compactions"] == 1
    assert shop.verify("shop.t") == []
    assert keys(shop.table("t", before)) == [1, 2, 3]


def test_latest_per_key(spark):
    rows = [(1, "a", 1, "I"), (1, "b", 3, "U"), (1, "c", 2, "U"), (2, "x", 1, "I"), (2, None, 2, "D"), (3, "y", 1, "I"), (3, None, 2, "D"), (3, "z", 3, "I")]
    df = spark.createDataFrame(rows, "k long, v string, commit_pos long, op string").repartition(3)
    assert {r["k"]: r["v"] for r in latest_per_key(df, ["k"]).collect()} == {1: "b", 3: "z"}


def test_splice_refuses_gaps(spark):
    df = spark.range(10).selectExpr("id AS commit_pos")
    early = df.where("commit_pos <= 5")
    assert splice(early, df, 5, 3, 9, 7).count() == 8 and splice(early, df, 5, 3, 9, 4).count() == 5
    for args in ((5, 6, 9, 7), (5, 3, 9, 10)):
        with pytest.raises(Refused):
            splice(df, df, *args)


# Policies, exactness, the SQL door
def test_masks(spark):
    df = spark.createDataFrame([("abcdef", 1), ("ab", 2), (None, 3)], "s string, n int")
    got = Policy("n < 3", {"s": Mask("partial", 3)}, ("n",)).secure(df)
    assert [r["s"] for r in got.collect()] == ["***def", "**"] and got.columns == ["s"]
    with pytest.raises(Refused):
        Policy(masks={"n": Mask("partial")}).secure(df)
    with pytest.raises(Refused):
        Policy(masks={"x": Mask("null")}).secure(df)


def test_sums_do_not_depend_on_order(spark):
    values = [1e16, 1.0, -1e16, 1e-3] * 50
    totals = set()
    for n in (1, 3, 7):
        random.Random(n).shuffle(values)
        df = spark.createDataFrame([("k", v) for v in values], "k string, v double").repartition(n)
        totals.add(exact.deterministic_sum(df, ["k"], "v").first()["total"])
    assert totals == {50.05}


def test_aggregations_that_depend_on_grouping_are_refused():
    with pytest.raises(Refused):
        exact.user_aggregation("bad", lambda s, x: s / 2 + x, lambda a, b: a + b, lambda s: s, lambda: 0.0)


def test_guards(spark):
    spark.range(5).createOrReplaceTempView("five")
    with pytest.raises(Refused, match="approx_count_distinct"):
        exact.require_exact(spark.sql("SELECT (SELECT approx_count_distinct(id) FROM five) AS n"))
    exact.require_exact(spark.sql("SELECT 'approx_count_distinct' AS n, count(*) FROM five"))
    with pytest.raises(Refused):
        exact.require_stable(spark.sql("SELECT rand() AS r"))


@pytest.fixture
def door(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "wh"))
    e.warehouse.publish("shop.t", spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"))
    return e


def test_statements(door):
    door.sql("CREATE SNAPSHOT s EXPIRE AFTER 2 DAYS")
    door.sql("CREATE TABLE shop.c CLONE shop.t AT VERSION 0;")
    assert door.scalar("SELECT count(*) FROM shop.c /* all */ -- of it") == 2
    assert door.rows("SELECT x.k FROM t x JOIN shop.c ON x.k = c.k WHERE x.v = 'a'") == [(1,)]
    assert door.sql("SHOW LINEAGE OF shop.c").first()["origin"] == "shop.t"
    assert {r["relation"] for r in door.sql("SHOW DEPENDENTS OF shop.t").collect()} == {"clone", "snapshot"}
    assert door.sql("SHOW HISTORY OF t").first()["what"] == "append"
    door.sql("SET VERSION OF shop.t = 0")
    door.sql("RESET VERSION OF shop.t")
    assert door.sql("SHOW SNAPSHOTS").count() == 1
    door.sql("SET SNAPSHOT s")
    door.sql("RESET SNAPSHOT")
    door.sql("DROP TABLE shop.c")
    door.sql("DROP SNAPSHOT s")
    assert door.sql("SELECT * FROM functions()").count() == 157


@pytest.mark.parametrize("text", ["DROP TABLE nothing", "INSERT INTO shop.t VALUES (1, 'x')", "CREATE TABLE x (a INT)", "SELECT * FROM shop.t TABLESAMPLE (10 PERCENT)", "SELECT approx_count_distinct(k) FROM shop.t", "SELECT * FROM cube_rollup('none', 'm')", "CREATE DERIVED d FROM (shop.t)", "CREATE DERIVED d FROM (SELECT rand() AS r FROM shop.t)", "RESUME FEED none"])
def test_door_refuses(door, text):
    with pytest.raises(Refused):
        door.sql(text)


def test_row_limit_and_graphs_by_sql(door, spark):
    door.max_rows = 1
    with pytest.raises(Refused, match="more than"):
        door.sql("SELECT * FROM shop.t")
    door.max_rows = None
    door.graphs["g"] = graph(spark, E1)
    assert {r["vertex"] for r in door.sql("SELECT vertex FROM graph_reachable('g', 'a', 'max_depth=1')").collect()} == {"a", "b", "c"}
    with pytest.raises(Refused, match="unknown"):
        door.sql("SELECT * FROM graph_reachable('g', 'a', 'depth=1')")
    door.sql("CREATE DERIVED many FROM (SELECT k, count(*) AS n FROM shop.t GROUP BY k)")
    assert door.scalar("SELECT sum(n) FROM many") == 2


def test_verbs_without_sql(door, spark):
    assert door.schemas() == ["shop"] and door.columns("t") == [("k", "bigint"), ("v", "string")]
    door.clone("shop.c", "t")
    assert door.lineage("shop.c").count() == 1 and door.functions().count() == 157 and door.snapshots().count() == 0
    assert door.one("SELECT max(k) FROM t") == (2,)
    with pytest.raises(Refused):
        door.one("SELECT k FROM t")
    door.graphs["g"] = graph(spark, E1)
    assert door.reachable("g", ["a"], max_depth=1).count() == 3 and door.shortest_path("g", "a", "b").count() == 2


def test_supplied_aggregations(door):
    code = "CREATE AGGREGATION {n} LANGUAGE PYTHON AS $$ def start(): return 0.0\ndef accumulate(s, x): return {a}\ndef merge(a, b): return a + b\ndef finish(s): return s\n$$"
    with pytest.raises(Refused, match="allow"):
        door.sql(code.format(n="total", a="s + x"))
    door.allow_aggregations = True
    with pytest.raises(Refused, match="depends"):
        door.sql(code.format(n="total", a="s / 2 + x"))
    with pytest.raises(Refused, match="define"):
        door.sql("CREATE AGGREGATION total LANGUAGE PYTHON AS $$ x = 1 $$")
    door.sql(code.format(n="total", a="s + x"))
    assert door.scalar("SELECT total(k) FROM t") == 3.0 and door.sql("SHOW AGGREGATIONS").count() == 1
    door.sql("DROP AGGREGATION total")


def test_deadline(spark):
    with pytest.raises(Refused, match="seconds"):
        within(spark, 1.0, lambda: spark.range(10**12).selectExpr("sum(sqrt(id))").first())
    assert within(spark, 60, lambda: spark.range(5).count()) == 5


def test_overflow_risk():
    assert exact.overflow_risk(10, 0, 2**62) and exact.overflow_risk(3, -(2**62), 0) and not exact.overflow_risk(1000, -(10**9), 10**9)


# Feeds
FEED = feeds.Feed("f", (feeds.FeedColumn("id", "bigint", False), feeds.FeedColumn("price", "decimal(9,2)"), feeds.FeedColumn("day", "date"), feeds.FeedColumn("note", "string", key="text")))
LINES = {
    '{"id": 1, "price": "1.50", "day": "2024-02-29", "text": "ok"}': None, '{"id": null, "price": null, "day": null, "text": null}': "null_value", '{"id": 2, "price": "1", "day": null}': "missing_key", '{"id": 3, "price": null, "day": null, "text": null, "more": 1}': "unknown_key",
    '{"id": "4", "price": null, "day": null, "text": null}': "wrong_type", '{"id": 5, "price": 1.5, "day": null, "text": null}': "wrong_type", '{"id": 6, "price": null, "day": "02/03/2024", "text": null}': "wrong_type", '{"id": 7, "price": null, "day": "2024-02-30", "text": null}': "out_of_range",
    '{"id": 99999999999999999999, "price": null, "day": null, "text": null}': "out_of_range", "[1]": "not_an_object", "nonsense": "not_an_object", '{"id": 8.5, "price": null, "day": null, "text": null}': "wrong_type",
}


def test_bind(spark):
    bound = feeds.bind(FEED, spark.createDataFrame([(x,) for x in LINES], "value string")).collect()
    assert {r["payload"]: r["reason_code"] for r in bound} == LINES
    ok = next(r for r in bound if r["reason_code"] is None)
    assert (ok["id"], str(ok["price"]), str(ok["day"]), ok["note"]) == (1, "1.50", "2024-02-29", "ok")


def test_feed_resumes_and_stops(spark, tmp_path):
    w, at = Warehouse(spark, str(tmp_path / "wh")), tmp_path / "in"
    at.mkdir()
    good = '{"id": %d, "price": null, "day": null, "text": "x"}\n'
    (at / "1.json").write_text("".join(good % i for i in range(5)) + "bad\n")
    go = lambda: feeds.run(spark, FEED, str(at), w, "web.f", str(tmp_path / "cp")).awaitTermination()
    go()
    assert w.table("web.f").count() == 5 and w.table("sys.quarantine").count() == 1
    go()
    assert w.table("web.f").count() == 5
    (at / "2.json").write_text("bad\n" * 3 + good % 9)
    with pytest.raises(Exception, match="stopped"):
        go()
    with pytest.raises(Refused):
        feeds.Feed("g", (feeds.FeedColumn("a", "blob"),))


def test_digest_ignores_order(spark):
    df = spark.createDataFrame([(i, str(i)) for i in range(50)], "a int, b string")
    assert feeds.digest(df).first() == feeds.digest(df.orderBy(F.desc("a")).select("b", "a").repartition(5)).first()
    assert feeds.digest(df).first() != feeds.digest(df.where("a <> 3")).first()


def test_settings(spark):
    assert check(spark) == []


def test_paths_answer_over_more_edges_than_the_default_budget(spark):
    """At sf0.1 150,000 edges lie within reach of customer 1: the cheapest path by plain Dijkstra, arrivals each by an edge."""
    sf = "/root/testdata/sf0.1"
    edges = [tuple(r) for r in layers.graph(spark, sf).edges.select("src", "dst", "weight", "valid_from").collect()]
    assert len(edges) > Budget().visits
    out = defaultdict(list)
    for s, d, w, _ in edges:
        out[s].append((d, w))
    cost, heap = {}, [(0.0, "1")]
    while heap:
        c, v = heapq.heappop(heap)
        if v not in cost:
            cost[v] = c
            for d, w in out[v]:
                heapq.heappush(heap, (c + w, d))
    path = sorted(layers.graph_shortest_path(spark, sf).collect())
    assert [path[0]["vertex"], path[-1]["vertex"]] == ["1", "2"] and path[0]["path_cost"] == pytest.approx(cost["2"], abs=1e-4)
    arrivals = {r["vertex"]: r for r in layers.graph_time_respecting(spark, sf).collect()}
    since = {(s, d, a) for s, d, _, a in edges}
    assert len(arrivals) > 1 and arrivals["1"]["hops"] == 0
    for v, r in arrivals.items():
        if r["via"] is not None:
            wait = r["arrival"] - arrivals[r["via"]]["arrival"]
            assert (r["via"], v, r["arrival"]) in since and wait >= 1 and (r["hops"] == 1 or wait <= 400)
