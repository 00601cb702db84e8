"""Queries over the layers above plain SQL: exact aggregates, cubes, graphs, versioned tables, policies, feeds and event time.

Each has, where SQL can say it, the same rows by SQL for a second engine over the same tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.engine import Engine
from tessera.operators import exact
from tessera.operators.cube import Cube, Definition, Dimension, Measure
from tessera.operators.graph import GENEROUS, Budget, Graph
from tessera.operators.policy import Mask, Policy
from tessera.session import local_folder, shared_cut
from tessera.sources.warehouse import Store, Warehouse, splice
from tessera.streaming import feeds

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = _swept(f)
        if oracle is not None:
            ORACLE[f.__name__] = oracle
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, *names: str):
    found = [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]
    return found[0] if len(found) == 1 else found


_SCRATCH: list[str] = []


def scratch(spark: SparkSession) -> str:
    """A folder of this query's own in the place all executors share; it is deleted when the query's rows are there."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or local_folder(spark.sparkContext)
    _SCRATCH.append(f"{at}/scratch-{uuid.uuid4().hex}")
    return _SCRATCH[-1]


def _swept(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A query that reads tables of its own: its rows are kept, then its folders go."""

    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        held = len(_SCRATCH)
        try:
            df = f(spark, sf_dir)
            return shared_cut(df) if len(_SCRATCH) > held else df
        finally:
            for at in _SCRATCH[held:]:
                Store(spark).delete(at)
            del _SCRATCH[held:]

    return run


# Exact aggregates
@query("SELECT o_orderpriority, round(fsum(o_totalprice), 6) AS total FROM orders GROUP BY o_orderpriority")
def exact_sum(spark, sf_dir):
    return exact.deterministic_sum(read(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice").select("o_orderpriority", F.round("total", 6).alias("total"))


@query("SELECT o_orderpriority, quantile_disc(o_totalprice, 0.37) AS q FROM orders GROUP BY o_orderpriority")
def quantile_nearest_rank(spark, sf_dir):
    return read(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(exact.quantile("o_totalprice", 0.37, "nearest").alias("q"))


@query("SELECT o_orderpriority, list_sort(list(o_totalprice))[CAST(floor(0.37 * (count(*) - 1)) AS BIGINT) + 1] AS q FROM orders GROUP BY o_orderpriority")
def quantile_lower(spark, sf_dir):
    return exact.lower_quantile(read(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice", 0.37, "q")


@query("SELECT round(quantile_cont(t, 0.25), 6) AS q FROM (SELECT i, sum(x) AS t FROM (SELECT CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) e GROUP BY i) s")
def quantile_of_vector_sum(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings").select(F.col("embedding").cast("array<double>").alias("v"))
    return spark.createDataFrame([(round(exact.quantile_of_sum(v, "v", 0.25), 6),)], "q double")


@query("SELECT c_mktsegment, max(c_acctbal) - min(c_acctbal) AS spread FROM customer GROUP BY c_mktsegment")
def user_aggregation(spark, sf_dir):
    """A supplied aggregation: accumulate, merge, finish."""
    spread = exact.user_aggregation("spread", lambda s, x: (min(s[0], x), max(s[1], x)), lambda a, b: (min(a[0], b[0]), max(a[1], b[1])), lambda s: s[1] - s[0], lambda: (float("inf"), float("-inf")))
    return spread(read(spark, sf_dir, "customer"), ["c_mktsegment"], "c_acctbal")


@query("SELECT c_mktsegment, round(sqrt(avg(c_acctbal * c_acctbal)), 4) AS rms FROM customer GROUP BY c_mktsegment")
def user_aggregation_by_sql(spark, sf_dir):
    """Declared by a statement, asked in a query."""
    e = Engine(spark, allow_aggregations=True)
    e.add("customer", read(spark, sf_dir, "customer"))
    e.sql("""CREATE AGGREGATION rms LANGUAGE PYTHON AS $$
        def start():
            return (0.0, 0)
        def accumulate(s, x):
            return (s[0] + x * x, s[1] + 1)
        def merge(a, b):
            return (a[0] + b[0], a[1] + b[1])
        def finish(s):
            return (s[0] / s[1]) ** 0.5
    $$""")
    return e.sql("SELECT c_mktsegment, round(rms(c_acctbal), 4) AS rms FROM customer GROUP BY c_mktsegment")


# Cubes: orders by region, segment and year; urgent orders have no region, so they are withheld.
FACTS = """SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE r_name END AS region, c_mktsegment AS segment, n_name AS nation, CAST(year(o_orderdate) AS {text}) AS year, o_totalprice AS amount
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
KNOWN = f"WITH f AS ({FACTS.format(text='VARCHAR')}), k AS (SELECT * FROM f WHERE region IS NOT NULL), b AS (SELECT region, segment, year, sum(amount) AS value FROM k GROUP BY ALL), c AS (SELECT count(region) / count(*) AS completeness, count(*) - count(region) AS withheld FROM f)"
YEARS = [str(y) for y in range(1992, 2012)]


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    for t in ("orders", "customer", "nation", "region"):
        read(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(FACTS.format(text="STRING"))


def sales(spark: SparkSession, sf_dir: str) -> Cube:
    names = ("region", "segment", "year")
    measures = (
        Measure("amount", "amount", dict.fromkeys(names, "sum")),
        Measure("stock", "amount", {"region": "sum", "segment": "max", "year": "last"}),
        Measure("price", "amount", dict.fromkeys(names, "mean")),
    )
    return Cube(Definition("sales", tuple(map(Dimension, names)), measures), facts(spark, sf_dir))


def by_nation(spark: SparkSession, sf_dir: str) -> Cube:
    nation, region = read(spark, sf_dir, "nation", "region")
    up = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("child"), F.col("r_name").alias("parent")).union(region.select("r_name", F.lit("WORLD")))
    return Cube(Definition("nations", (Dimension("nation", ("region",)), Dimension("year")), (Measure("amount", "amount", {"nation": "sum", "year": "sum"}),)), facts(spark, sf_dir), {"nation": up})


def value(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns, F.round("value", 2).alias("value"))


@query(f"{KNOWN} SELECT region, round(sum(value), 2) AS value, any_value(completeness) AS completeness, any_value(withheld) AS withheld FROM b, c GROUP BY region")
def cube_rollup_sum(spark, sf_dir):
    return value(sales(spark, sf_dir).rollup("amount", ["region"]), "region", "completeness", "withheld")


@query(f"{KNOWN}, s AS (SELECT segment, year, sum(value) AS v FROM b GROUP BY ALL) SELECT segment, round(arg_max(v, year), 2) AS value FROM s GROUP BY segment")
def cube_rollup_mixed(spark, sf_dir):
    """Summed along regions, then the last year's."""
    return value(sales(spark, sf_dir).rollup("stock", ["segment"], order={"year": YEARS}), "segment")


@query(f"{KNOWN}, s AS (SELECT segment, year, sum(value) AS v FROM b GROUP BY ALL), m AS (SELECT year, max(v) AS v FROM s GROUP BY year) SELECT year, round(v, 2) AS value FROM m")
def cube_rollup_two_rules(spark, sf_dir):
    """Summed along regions, then the largest segment of each year."""
    return value(sales(spark, sf_dir).rollup("stock", ["year"]), "year")


@query(f"{KNOWN} SELECT region, segment, year, round(avg(amount), 2) AS value FROM k GROUP BY ALL")
def cube_mean_base(spark, sf_dir):
    return value(sales(spark, sf_dir).rollup("price", ["region", "segment", "year"]), "region", "segment", "year")


@query(f"{KNOWN} SELECT segment, year, round(value, 2) AS value FROM b WHERE region = 'ASIA'")
def cube_slice(spark, sf_dir):
    return value(sales(spark, sf_dir).slice("amount", ("region", "ASIA")), "segment", "year")


@query(f"{KNOWN} SELECT segment, round(sum(value), 2) AS value FROM b WHERE region IN ('ASIA', 'EUROPE') AND year = '1997' GROUP BY segment")
def cube_dice(spark, sf_dir):
    return value(sales(spark, sf_dir).rollup("amount", ["segment"], where={"region": ["ASIA", "EUROPE"], "year": ["1997"]}), "segment")


NATIONS = f"WITH f AS ({FACTS.format(text='VARCHAR')}), b AS (SELECT nation, year, sum(amount) AS value FROM f GROUP BY ALL), up AS (SELECT n_name AS child, r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey)"


@query(f"{NATIONS} SELECT parent AS nation, year, round(sum(value), 2) AS value FROM b JOIN up ON nation = child GROUP BY ALL")
def cube_consolidate_step(spark, sf_dir):
    return value(by_nation(spark, sf_dir).consolidate("amount", "nation"), "nation", "year")


@query(f"{NATIONS} SELECT CASE WHEN parent = 'ASIA' THEN 'ASIA' ELSE nation END AS nation, year, round(sum(value), 2) AS value FROM b JOIN up ON nation = child GROUP BY ALL")
def cube_consolidate_to(spark, sf_dir):
    return value(by_nation(spark, sf_dir).consolidate("amount", "nation", "ASIA"), "nation", "year")


@query(f"{KNOWN}, t AS (SELECT *, sum(value) OVER (PARTITION BY region, year) AS total FROM b) SELECT year, round(sum(value + CASE WHEN region = 'ASIA' AND year = '1997' THEN 1000000 * value / total ELSE 0 END), 2) AS value FROM t GROUP BY year")
def cube_overlay(spark, sf_dir):
    """A change above the base grain, spread in proportion."""
    cube = sales(spark, sf_dir)
    cube.add_overlay("more", spark.createDataFrame([("ASIA", "1997", "delta", 1e6)], "region string, year string, op string, amount double"), "pro_rata")
    return value(cube.rollup("amount", ["year"], overlay="more"), "year")


@query(f"{KNOWN} SELECT segment, round(sum(value), 2) AS value, 'segment|year' AS from_cuboid FROM b GROUP BY segment")
def cube_from_cuboid(spark, sf_dir):
    """The same roll-up from a materialised ancestor."""
    cube = sales(spark, sf_dir)
    cube.materialise("amount", [["segment", "year"]])
    return value(cube.rollup("amount", ["segment"]), "segment", "from_cuboid")


@query(f"{KNOWN} SELECT segment, round(sum(value) FILTER (WHERE region = 'ASIA'), 2) AS \"ASIA\", round(sum(value) FILTER (WHERE region = 'EUROPE'), 2) AS \"EUROPE\" FROM b GROUP BY segment")
def cube_pivot(spark, sf_dir):
    return sales(spark, sf_dir).pivot("amount", ["segment"], "region").select("segment", F.round("ASIA", 2).alias("ASIA"), F.round("EUROPE", 2).alias("EUROPE"))


@query("SELECT * FROM (VALUES ('sales', 'amount', 'region', 'sum', TRUE), ('sales', 'amount', 'segment', 'sum', TRUE), ('sales', 'amount', 'year', 'sum', TRUE), ('sales', 'stock', 'region', 'sum', TRUE), ('sales', 'stock', 'segment', 'max', TRUE), ('sales', 'stock', 'year', 'last', TRUE), ('sales', 'price', 'region', 'mean', FALSE), ('sales', 'price', 'segment', 'mean', FALSE), ('sales', 'price', 'year', 'mean', FALSE)) t(cube, measure, dimension, rule, composes)")
def cube_measures(spark, sf_dir):
    return sales(spark, sf_dir).describe_measures(spark)


@query(f"{KNOWN} SELECT segment, round(sum(value), 2) AS value FROM b GROUP BY segment")
def cube_by_sql(spark, sf_dir):
    """Declared and asked by SQL statements."""
    engine = Engine(spark)
    engine.add("facts", facts(spark, sf_dir))
    engine.sql("CREATE CUBE sales FROM facts DIMENSION region DIMENSION segment DIMENSION year MEASURE amount (SUM ALONG region, SUM ALONG segment, SUM ALONG year)")
    return value(engine.sql("SELECT * FROM cube_rollup('sales', 'amount', 'by=segment')"), "segment")


# Graphs: each order leads from its customer to another one, at a price, valid for 30 days.
EDGES = "SELECT CAST(o_custkey AS {text}) AS src, CAST(o_orderkey * 7 % (SELECT count(*) FROM customer) + 1 AS {text}) AS dst, o_totalprice / 1000 AS weight, o_totalprice / 1000000 AS share, CAST({day} AS BIGINT) AS since FROM orders"
EDGES_2 = "e AS (" + EDGES.format(text="VARCHAR", day="datediff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE))") + ")"


def graph(spark: SparkSession, sf_dir: str, weight: str = "weight", budget: Budget = Budget()) -> Graph:  # noqa: B008
    for t in ("orders", "customer"):
        read(spark, sf_dir, t).createOrReplaceTempView(t)
    edges = spark.sql(EDGES.format(text="STRING", day="datediff(o_orderdate, DATE '1995-01-01')")).withColumn("until", F.col("since") + 30)
    return Graph(shared_cut(edges), weight=weight, valid_from="since", valid_until="until", budget=budget)


@query(f"""WITH RECURSIVE {EDGES_2}, r(v, d) USING KEY (v) AS (SELECT * FROM (VALUES ('1', 0), ('2', 0)) s(v, d) UNION SELECT dst, min(r.d) + 1 FROM r JOIN e ON r.v = src LEFT JOIN recurring.r x ON x.v = dst WHERE r.d < 3 AND x.v IS NULL GROUP BY dst)
  SELECT r.v AS vertex, r.d AS depth, min(p.v) AS via FROM r LEFT JOIN (SELECT r.v, r.d, dst FROM r JOIN e ON r.v = src) p ON p.dst = r.v AND p.d = r.d - 1 GROUP BY r.v, r.d""")
def graph_reachable(spark, sf_dir):
    return graph(spark, sf_dir, budget=GENEROUS).reachable([1, 2], max_depth=3).select("vertex", "depth", "via")


@query(f"""WITH RECURSIVE {EDGES_2}, r(v, d, p) USING KEY (v) AS (SELECT '1', CAST(0 AS DOUBLE), ['1'] UNION SELECT dst, min(r.d + weight), arg_min(list_append(r.p, dst), r.d + weight) FROM r JOIN e ON r.v = src LEFT JOIN recurring.r x ON x.v = dst WHERE x.v IS NULL OR r.d + weight < x.d GROUP BY dst)
  SELECT CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS position, unnest(p) AS vertex, round(d, 4) AS path_cost, CAST(len(p) - 1 AS INTEGER) AS path_hops FROM r WHERE v = '2'""")
def graph_shortest_path(spark, sf_dir):
    return graph(spark, sf_dir, budget=GENEROUS).shortest_path(1, 2).select("position", "vertex", F.round("path_cost", 4).alias("path_cost"), "path_hops")


@query(f"""WITH {EDGES_2}, c AS (SELECT src || '>' || src AS cycle FROM e WHERE src = dst UNION SELECT a.src || '>' || a.dst || '>' || a.src FROM e a JOIN e b ON a.dst = b.src AND b.dst = a.src WHERE a.dst > a.src
  UNION SELECT a.src || '>' || a.dst || '>' || b.dst || '>' || a.src FROM e a JOIN e b ON a.dst = b.src JOIN e c ON b.dst = c.src AND c.dst = a.src WHERE a.dst > a.src AND b.dst > a.src AND a.dst <> b.dst)
  SELECT cycle FROM c WHERE split_part(cycle, '>', 1) IN ('1', '10', '100')""")
def graph_cycles(spark, sf_dir):
    """Circuits of up to three steps through three customers."""
    found = graph(spark, sf_dir, budget=Budget(depth=3)).cycles([1, 10, 100])
    return found.groupBy("cycle_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "vertex"))), lambda s: s["vertex"]), ">").alias("cycle")).select("cycle")


@query(f"""WITH RECURSIVE {EDGES_2}, w(v, p, n) AS (SELECT '1', CAST(1 AS DOUBLE), 0 UNION ALL SELECT dst, p * share * 0.5, n + 1 FROM w JOIN e ON v = src WHERE p * share * 0.5 >= 0.0001 AND n < 6) SELECT v AS vertex, round(sum(p), 6) AS influence FROM w WHERE n > 0 GROUP BY v""")
def graph_influence(spark, sf_dir):
    return graph(spark, sf_dir, "share").influence([1], damping=0.5).select("vertex", F.round("influence", 6).alias("influence"))


@query(f"WITH {EDGES_2} SELECT v AS vertex, count(*) AS degree FROM (SELECT src AS v FROM e UNION ALL SELECT dst FROM e) u GROUP BY v")
def graph_degree(spark, sf_dir):
    return graph(spark, sf_dir).degree()


@query(f"WITH RECURSIVE {EDGES_2}, b AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), r(v, c) USING KEY (v) AS (SELECT DISTINCT a, a FROM b UNION SELECT b.b, min(r.c) FROM r JOIN b ON r.v = b.a JOIN recurring.r x ON x.v = b.b WHERE r.c < x.c GROUP BY b.b) SELECT v AS vertex, c AS component FROM r")
def graph_components(spark, sf_dir):
    return graph(spark, sf_dir).connected_components()


_STEP = "r{n} AS (SELECT v.v, 0.15 / n.n + 0.85 * (coalesce(g.g, 0) + (SELECT coalesce(sum(rank), 0) FROM r{m} JOIN v d ON r{m}.v = d.v WHERE d.k = 0) / n.n) AS rank FROM v CROSS JOIN n LEFT JOIN (SELECT e.dst, sum(rank / o.k) AS g FROM e JOIN r{m} ON e.src = r{m}.v JOIN v o ON o.v = e.src GROUP BY e.dst) g ON g.dst = v.v)"


@query(f"WITH {EDGES_2}, v AS (SELECT u.v, count(e.src) AS k FROM (SELECT src AS v FROM e UNION SELECT dst FROM e) u LEFT JOIN e ON e.src = u.v GROUP BY u.v), n AS (SELECT count(*) AS n FROM v), r0 AS (SELECT v, 1.0::DOUBLE / n AS rank FROM v, n), {', '.join(_STEP.format(n=i, m=i - 1) for i in (1, 2, 3))} SELECT v AS vertex, round(rank, 9) AS rank FROM r3")
def graph_rank(spark, sf_dir):
    return graph(spark, sf_dir).rank(3).select("vertex", F.round("rank", 9).alias("rank"))


@query(f"WITH RECURSIVE {EDGES_2}, d AS (SELECT DISTINCT src, dst FROM e), r(a, b) AS (SELECT v, v FROM (SELECT src AS v FROM d UNION SELECT dst FROM d) u UNION SELECT a, dst FROM r JOIN d ON b = src) SELECT x.a AS vertex, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a")
def graph_strong_components(spark, sf_dir):
    return graph(spark, sf_dir).strong_components()


@query(f"WITH RECURSIVE {EDGES_2}, r(v, t) USING KEY (v) AS (SELECT '1', CAST(0 AS BIGINT) UNION SELECT dst, min(since) FROM r JOIN e ON r.v = src LEFT JOIN recurring.r x ON x.v = dst WHERE since >= r.t + 1 AND (x.v IS NULL OR since < x.t) GROUP BY dst) SELECT v AS vertex, t AS arrival FROM r")
def graph_earliest_arrival(spark, sf_dir):
    """Earliest arrivals without a limit to waiting: then each label is the earliest of all journeys."""
    return graph(spark, sf_dir, budget=GENEROUS).time_respecting([1], at=0, min_dwell=1).select("vertex", "arrival")


@query()
def graph_time_respecting(spark, sf_dir):
    return graph(spark, sf_dir, budget=GENEROUS).time_respecting([1], at=0, min_dwell=1, max_dwell=400)


@query()
def graph_betweenness(spark, sf_dir):
    return graph(spark, sf_dir).betweenness(16).select("vertex", F.round("betweenness", 4).alias("betweenness"))


@query()
def graph_communities(spark, sf_dir):
    return graph(spark, sf_dir).communities(4)


# Versioned tables: orders that are filled come first, then the others.
ORDER = "o_orderkey, o_custkey, o_orderstatus, o_totalprice"


def versions(spark: SparkSession, sf_dir: str) -> Warehouse:
    w, orders = Warehouse(spark, scratch(spark)), read(spark, sf_dir, "orders").select(*ORDER.split(", "))
    w.publish("shop.orders", orders.where("o_orderstatus = 'F'"), cluster_by=["o_totalprice"])
    w.publish("shop.orders", orders.where("o_orderstatus <> 'F'"), cluster_by=["o_totalprice"])
    return w


@query(f"SELECT {ORDER} FROM orders WHERE o_orderstatus = 'F'")
def time_travel(spark, sf_dir):
    return versions(spark, sf_dir).table("shop.orders", version=0)


@query(f"SELECT {ORDER} FROM orders")
def compacted_read(spark, sf_dir):
    w = versions(spark, sf_dir)
    w.compact("shop.orders", ["o_custkey"])
    return w.table("shop.orders")


@query(f"SELECT {ORDER} FROM orders WHERE o_totalprice > 250000")
def file_skipping_read(spark, sf_dir):
    return versions(spark, sf_dir).table("shop.orders", where=[("o_totalprice", ">", 250000.0)])


@query(f"SELECT {ORDER} FROM orders WHERE o_orderstatus = 'F'")
def expired_read(spark, sf_dir):
    """Files of other states leave the newest version."""
    w, orders = Warehouse(spark, scratch(spark)), read(spark, sf_dir, "orders").select(*ORDER.split(", "))
    w.publish("shop.orders", orders.where("o_orderstatus <> 'F'").withColumn("day", F.lit("2001-01-01").cast("date")))
    w.publish("shop.orders", orders.where("o_orderstatus = 'F'").withColumn("day", F.lit("2002-01-01").cast("date")))
    w.expire("shop.orders", "day", "2001-06-01")
    return w.table("shop.orders").drop("day")


@query(f"SELECT {ORDER} FROM orders WHERE o_orderstatus = 'F'")
def snapshot_read(spark, sf_dir):
    """A snapshot is taken between the two commits."""
    w, orders = Warehouse(spark, scratch(spark)), read(spark, sf_dir, "orders").select(*ORDER.split(", "))
    w.publish("shop.orders", orders.where("o_orderstatus = 'F'"))
    w.create_snapshot("before", 1)
    w.publish("shop.orders", orders.where("o_orderstatus <> 'F'"))
    w.set_snapshot("before")
    return w.table("shop.orders")


@query(f"SELECT {ORDER} FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT {ORDER} FROM orders WHERE o_orderstatus = 'P'")
def clone_read(spark, sf_dir):
    """A clone of the first version with rows of its own."""
    w = versions(spark, sf_dir)
    w.clone("shop.copy", "shop.orders", 0)
    w.publish("shop.copy", read(spark, sf_dir, "orders").select(*ORDER.split(", ")).where("o_orderstatus = 'P'"))
    return w.table("shop.copy")


@query("SELECT CAST(2 AS INTEGER) AS commits, count(*) FILTER (WHERE o_orderstatus <> 'F') AS rows_added, CAST(0 AS BIGINT) AS rows_removed, CAST(1 AS INTEGER) AS compactions FROM orders")
def changes_between(spark, sf_dir):
    w = versions(spark, sf_dir)
    w.compact("shop.orders")
    c = w.changes("shop.orders", 0, 2)
    return spark.createDataFrame([(c["commits"], c["rows_added"], c["rows_removed"], c["compactions"])], "commits int, rows_added long, rows_removed long, compactions int")


@query("SELECT * FROM (VALUES (CAST(0 AS BIGINT), 'append', TRUE), (CAST(1 AS BIGINT), 'append', TRUE)) t(version, what, changed_data)")
def table_history(spark, sf_dir):
    return versions(spark, sf_dir).history("shop.orders").select("version", "what", "changed_data")


CHANGED = "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN round(o_totalprice * 2, 2) ELSE o_totalprice END AS price FROM orders WHERE NOT (o_orderstatus = 'O' AND o_orderpriority = '1-URGENT')"


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as change rows: all inserted, pending ones updated, open urgent ones deleted."""
    o = read(spark, sf_dir, "orders")
    row = lambda d, price, at, op: d.select("o_orderkey", price.alias("price"), (F.col("o_orderkey") + at).alias("commit_pos"), F.lit(op).alias("op"))
    new = row(o, F.col("o_totalprice"), 0, "I")
    changed = row(o.where("o_orderstatus = 'P'"), F.round(F.col("o_totalprice") * 2, 2), 10**10, "U")
    gone = row(o.where("o_orderstatus = 'O' and o_orderpriority = '1-URGENT'"), F.lit(None).cast("double"), 10**11, "D")
    return new.unionByName(changed).unionByName(gone)


@query(CHANGED)
def merge_on_read(spark, sf_dir):
    w = Warehouse(spark, scratch(spark))
    w.publish("shop.prices", changes(spark, sf_dir), key=["o_orderkey"])
    return w.table("shop.prices").select("o_orderkey", "price")


@query("SELECT o_orderkey, o_totalprice AS price FROM orders")
def tier_splice(spark, sf_dir):
    """Published and arrived rows up to a position before any update."""
    c = changes(spark, sf_dir)
    return splice(c.where("commit_pos <= 100"), c.where("commit_pos > 50"), 100, 50, 10**12, 10**10 - 1).select("o_orderkey", "price")


@query("SELECT o_custkey AS xid, o_orderkey AS seq, max(o_orderkey) OVER (PARTITION BY o_custkey) + 1000000000 AS commit_pos, 'I' AS op FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) < 8)")
def transaction_batches(spark, sf_dir):
    """Each customer's orders are a transaction; those of few orders are aborted."""
    o = read(spark, sf_dir, "orders")
    rows = o.select(F.col("o_custkey").alias("xid"), F.col("o_orderkey").alias("commit_pos"), F.lit("I").alias("op"))
    ends = o.groupBy(F.col("o_custkey").alias("xid")).agg((F.max("o_orderkey") + 1_000_000_000).alias("commit_pos"), F.when(F.count("*") < 8, "ABORT").otherwise("COMMIT").alias("op"))
    return feeds.sealed(rows.unionByName(ends)).select("xid", "seq", "commit_pos", "op")


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice AS price FROM orders UNION ALL SELECT o_orderkey, o_custkey, 'X', o_totalprice FROM orders")
def fill_unchanged(spark, sf_dir):
    """Updates that carry the status alone take the rest from the row before."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").alias("price"))
    new = o.withColumns({"commit_pos": F.lit(1), "op": F.lit("I")})
    changed = o.select("o_orderkey", F.lit(None).cast("long").alias("o_custkey"), F.lit("X").alias("o_orderstatus"), F.lit(None).cast("double").alias("price"), F.lit(2).alias("commit_pos"), F.lit("U").alias("op"))
    return feeds.fill_unchanged(new.unionByName(changed), ["o_orderkey"], ["o_custkey", "o_orderstatus", "price"]).drop("commit_pos", "op")


@query("SELECT count(*) AS n, TRUE AS same, FALSE AS same_without_one FROM orders")
def reconcile_digest(spark, sf_dir):
    """The digest of a copy in two versions against its origin's, and against the origin's less a row."""
    copy, origin = versions(spark, sf_dir).table("shop.orders"), read(spark, sf_dir, "orders").select(*ORDER.split(", "))
    less = origin.where(F.col("o_orderkey") != origin.agg(F.max("o_orderkey")).first()[0])
    a, b, c = (feeds.digest(df).select(F.struct("xor", "total").alias(k), F.col("n").alias(f"n_{k}")) for df, k in ((copy, "a"), (origin, "b"), (less, "c")))
    return a.crossJoin(b).crossJoin(c).select(F.col("n_a").alias("n"), (F.col("a") == F.col("b")).alias("same"), (F.col("a") == F.col("c")).alias("same_without_one"))


# Policies and derived queries, through the SQL door
@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
def row_policy(spark, sf_dir):
    e = Engine(spark)
    e.add("nation", read(spark, sf_dir, "nation"))
    e.policy("nation", Policy(rows="n_regionkey = 2"))
    return e.sql("SELECT n_nationkey, n_name FROM nation")


@query("SELECT c_custkey, repeat('*', length(c_name) - 3) || right(c_name, 3) AS c_name, 0.0::DOUBLE AS c_acctbal, CAST(NULL AS VARCHAR) AS c_mktsegment FROM customer WHERE c_acctbal > 0")
def column_masks(spark, sf_dir):
    """The row filter sees true balances, the query sees masks."""
    e = Engine(spark)
    e.add("customer", read(spark, sf_dir, "customer"))
    e.policy("customer", Policy("c_acctbal > 0", {"c_name": Mask("partial", 3), "c_acctbal": Mask("constant", value=0.0), "c_mktsegment": Mask("null")}))
    return e.sql("SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer WHERE c_acctbal = 0")


@query("SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 5000 GROUP BY c_mktsegment")
def derived_query(spark, sf_dir):
    e = Engine(spark)
    e.add("customer", read(spark, sf_dir, "customer"))
    e.sql("CREATE DERIVED rich FROM (SELECT c_mktsegment, c_custkey FROM customer WHERE c_acctbal > 5000)")
    return e.sql("SELECT c_mktsegment, count(*) AS n FROM rich GROUP BY c_mktsegment")


# Feeds: events as JSON lines, of which those with a large value are written as text and so are refused.
FEED = feeds.Feed("clicks", (feeds.FeedColumn("event_id", "bigint", False), feeds.FeedColumn("kind", "string", key="event_type"), feeds.FeedColumn("value", "double")))


def feed(spark: SparkSession, sf_dir: str) -> Warehouse:
    at = scratch(spark)
    shown = F.when(F.col("value") > 100, F.concat(F.lit('"'), F.col("value").cast("string"), F.lit('"'))).otherwise(F.col("value").cast("string"))
    lines = read(spark, sf_dir, "events").select(F.concat(F.lit('{"event_id":'), F.col("event_id").cast("string"), F.lit(',"event_type":"'), F.col("event_type"), F.lit('","value":'), shown, F.lit("}")).alias("value"))
    lines.write.text(f"{at}/in")
    w = Warehouse(spark, f"{at}/warehouse")
    feeds.run(spark, FEED, f"{at}/in", w, "web.clicks", f"{at}/position").awaitTermination()
    return w


@query("SELECT event_id, event_type AS kind, value FROM events WHERE NOT value > 100")
def feed_ingest(spark, sf_dir):
    return feed(spark, sf_dir).table("web.clicks")


@query("SELECT 'wrong_type' AS reason_code, count(*) AS n FROM events WHERE value > 100 HAVING count(*) > 0")
def feed_quarantine(spark, sf_dir):
    return feed(spark, sf_dir).table("sys.quarantine").groupBy("reason_code").agg(F.count("*").alias("n"))


@query(CHANGED)
def change_stream(spark, sf_dir):
    """Change rows as a stream into a keyed table."""
    at = scratch(spark)
    rows = changes(spark, sf_dir)
    rows.write.parquet(f"{at}/in")
    w = Warehouse(spark, f"{at}/warehouse")
    feeds.apply_changes(spark.readStream.schema(rows.schema).parquet(f"{at}/in"), w, "shop.prices", ["o_orderkey"], f"{at}/position").awaitTermination()
    return w.table("shop.prices").select("o_orderkey", "price")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_tumbling(spark, sf_dir):
    return feeds.windowed(events(spark, sf_dir), "1 hour", "10 minutes", ["event_type"]).withColumn("total", F.round("total", 4))


@query("SELECT time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') - to_hours(k) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, (SELECT CAST(unnest([0, 1, 2]) AS INTEGER) AS k) w GROUP BY ALL")
def event_sliding(spark, sf_dir):
    return feeds.windowed(events(spark, sf_dir), "3 hours", "10 minutes", ["event_type"], "1 hour").withColumn("total", F.round("total", 4))


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '6 hours' THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT min(ts) AS session_start, max(ts) + INTERVAL '6 hours' AS session_end, user_id, count(*) AS n FROM s GROUP BY user_id, k")
def event_sessions(spark, sf_dir):
    return feeds.sessions(events(spark, sf_dir), "6 hours", "10 minutes", ["user_id"])


@query("SELECT time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01') AS window_start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_stream_windows(spark, sf_dir):
    """The same windows as a stream: whole output after all that is there has been read."""
    at = scratch(spark)
    source = spark.readStream.schema(read(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = feeds.windowed(source, "1 day", "1 hour", [])

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{at}/out-{number}")
        df.sparkSession.createDataFrame([(number,)], "n long").write.mode("overwrite").parquet(f"{at}/last")

    rows.writeStream.outputMode("complete").foreachBatch(batch).option("checkpointLocation", f"{at}/position").trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(f"{at}/last").first()[0]
    return spark.read.parquet(f"{at}/out-{last}").withColumn("total", F.round("total", 4))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)
