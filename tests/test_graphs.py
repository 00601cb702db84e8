"""Graph searches as rounds of joins against plain Python, graphs declared by statements, and where results come from."""

import heapq
import itertools
import random
from collections import defaultdict

import pyarrow as pa
import pytest

from tessera import session
from tessera.engine import Engine
from tessera.operators import graph as operators
from tessera.operators.graph import GENEROUS, Budget, Graph
from tessera.session import Refused

SCHEMA = "src string, dst string, w double, a long, b long"


def graph(spark, edges, **more):
    return Graph(spark.createDataFrame(edges, SCHEMA), weight="w", valid_from="a", valid_until="b", **more)


def some(seed: int, vertices: int = 9, edges: int = 24) -> list[tuple]:
    r = random.Random(seed)
    v = lambda: f"v{r.randrange(vertices)}"
    return [("v0", "v1", 2.0, 0, 9)] + [(v(), v(), float(r.randint(0, 6)), t := r.randint(0, 15), r.choice([None, t + 3, t])) for _ in range(edges)]


def loopless(edges, source, target):
    """All loopless paths with their costs."""
    out = defaultdict(dict)
    for s, d, w, *_ in edges:
        out[s][d] = min(w, out[s].get(d, 1e9))
    stack, found = [(source, [source], 0.0)], []
    while stack:
        v, path, cost = stack.pop()
        if v == target:
            found.append((cost, path))
            continue
        stack += [(d, [*path, d], cost + w) for d, w in out[v].items() if d not in path]
    return sorted(found)


@pytest.mark.parametrize("seed", [1, 2])
def test_cheapest_paths(spark, seed):
    edges = some(seed)
    target = next(d for _, d, *_ in reversed(edges) if d != "v0")
    expected = loopless(edges, "v0", target)
    rows = graph(spark, edges, budget=GENEROUS).shortest_path("v0", target, 4).collect()
    got = [[r for r in sorted(rows, key=lambda r: r["position"]) if r["path_id"] == i] for i in range(len({r["path_id"] for r in rows}))]
    assert [p[0]["path_cost"] for p in got] == [c for c, _ in expected[:4]]
    assert all((p[0]["path_cost"], [r["vertex"] for r in p]) in expected and p[0]["path_hops"] == len(p) - 1 for p in got)
    assert len({tuple(r["vertex"] for r in p) for p in got}) == len(got)


def test_no_path_and_own_vertex(spark):
    g = graph(spark, [("a", "b", 1.0, 0, 1), ("c", "a", 1.0, 0, 1)])
    assert g.shortest_path("a", "c").count() == 0
    assert [tuple(r) for r in g.shortest_path("a", "a").collect()] == [(0, 0, "a", 0.0, 0)]


@pytest.mark.parametrize("seed", [3, 4])
def test_circuits(spark, seed):
    edges = some(seed, 6, 14)
    out = defaultdict(set)
    for s, d, *_ in edges:
        out[s].add(d)
    expected = set()
    for n in range(1, 5):
        for p in itertools.permutations(sorted(out), n):
            if p[0] == min(p) and p[0] in ("v0", "v1") and all(b in out[a] for a, b in zip(p, [*p[1:], p[0]], strict=True)):
                expected.add((*p, p[0]))
    rows = graph(spark, edges, budget=Budget(depth=4)).cycles(["v0", "v1"]).collect()
    got = {tuple(r["vertex"] for r in sorted(rows, key=lambda r: r["position"]) if r["cycle_id"] == i) for i in {r["cycle_id"] for r in rows}}
    assert got == expected


def labels(edges, seeds, at, least, most, kept):
    """Labels set in the order of (arrival, hops, via, weight), one for each vertex."""
    out = defaultdict(list)
    for s, d, w, a, b in edges:
        if b is None or b > a:
            out[s].append((a, d, w))
    best, heap = {}, [(at, 0, "", s, None) for s in seeds]
    while heap:
        t, hops, via, v, w = heapq.heappop(heap)
        if v in best:
            continue
        best[v] = (t, hops, via or None)
        for a, d, x in out[v]:
            if a - t >= least and (most is None or hops == 0 or a - t <= most) and (w is None or x >= w * kept):
                heapq.heappush(heap, (a, hops + 1, v, d, x))
    return best


@pytest.mark.parametrize("seed,least,most,kept", [(5, 0, None, 0.0), (6, 1, 3, 0.0), (7, 0, 2, 0.8), (8, 1, None, 1.0), (9, 0, 4, 0.5)])
def test_time_respecting_labels(spark, seed, least, most, kept):
    edges = some(seed, 8, 40)
    found = graph(spark, edges, budget=GENEROUS).time_respecting(["v0"], 1, least, most, kept).collect()
    assert {r["vertex"]: (r["arrival"], r["hops"], r["via"]) for r in found} == labels(edges, ["v0"], 1, least, most, kept)


@pytest.mark.parametrize("seed", [10, 11])
def test_betweenness_of_all_sources(spark, seed):
    """Counted from all shortest paths between all pairs."""
    edges = some(seed, 8, 18)
    out = defaultdict(set)
    for s, d, *_ in edges:
        out[s].add(d)
    vertices = sorted({v for e in edges for v in e[:2]})
    expected = dict.fromkeys(vertices, 0.0)
    for s in vertices:
        depth, order = {s: 0}, [s]
        for v in order:
            for d in out[v]:
                if d not in depth:
                    depth[d] = depth[v] + 1
                    order.append(d)
        for t in vertices:
            if t == s or t not in depth:
                continue
            paths, stack = [], [[s]]
            while stack:
                p = stack.pop()
                if p[-1] == t:
                    paths.append(p)
                elif len(p) <= depth[t]:
                    stack += [[*p, d] for d in out[p[-1]] if depth[d] == len(p)]
            for p in paths:
                for v in p[1:-1]:
                    expected[v] += 1 / len(paths)
    found = {r["vertex"]: r["betweenness"] for r in graph(spark, edges).betweenness(100).collect()}
    for v in vertices:
        assert found.get(v, 0.0) == pytest.approx(expected[v])


def test_communities_by_component(spark):
    """The same moves as over the whole graph at once."""
    edges = [(p + s, p + d, 1.0, 0, 1) for p in "kl" for s, d in ("ab", "bc", "ca", "cd", "de", "ef", "fd")] + [("ka", "la", 0.5, 0, 1)] + [("x", "y", 3.0, 0, 1), ("s", "s", 9.0, 0, 1)]
    near = defaultdict(lambda: defaultdict(float))
    for s, d, w, *_ in edges:
        if s != d:
            near[s][d] += w
            near[d][s] += w
    ends = {v: sum(x.values()) for v, x in near.items()}
    two_m, of = sum(ends.values()), {v: v for v in near}
    for _ in range(10):
        before = dict(of)
        for v in sorted(near):
            others = defaultdict(float)
            for u in near:
                if u != v:
                    others[of[u]] += ends[u]
            pull = defaultdict(float)
            for u, w in near[v].items():
                pull[of[u]] += w
            of[v] = max(sorted({*pull, of[v]}), key=lambda c: (pull.get(c, 0) - others[c] * ends[v] / two_m, c == of[v]))
        if of == before:
            break
    least = {c: min(v for v in of if of[v] == c) for c in set(of.values())}
    g = graph(spark, edges)
    found = g.communities()
    assert {r["vertex"]: r["community"] for r in found.collect()} == {v: least[c] for v, c in of.items()}
    assert g.modularity(found) > 0.3
    with pytest.raises(Refused):
        g.communities(most=5)


@pytest.mark.parametrize("small", [False, True])
def test_communities_of_a_component_in_files(monkeypatch, small):
    """Neighbours in files, several rows a vertex and several blocks a pass: the moves are those of dictionaries."""
    r = random.Random(12)
    n, k = (60, 400) if small else (300, 30_000)
    if small:
        monkeypatch.setattr(operators, "EACH", 3)
        monkeypatch.setattr(operators, "BLOCK", 7)
    edges = sorted((s, d, r.randint(1, 900) / 7) for s, d in ((r.randrange(n), r.randrange(n)) for _ in range(k)) if s != d)
    near = defaultdict(lambda: defaultdict(float))
    for s, d, w in edges:
        near[s][d] += w
        near[d][s] += w
    ends = {v: sum(x.values()) for v, x in near.items()}
    two_m, of, total = sum(ends.values()), {v: v for v in near}, dict(ends)
    for _ in range(4):
        for v in sorted(near):
            total[of[v]] -= ends[v]
            links = defaultdict(float)
            for u, w in near[v].items():
                links[of[u]] += w
            of[v] = max(sorted({*links, of[v]}), key=lambda c: (links.get(c, 0.0) - total[c] * ends[v] / two_m, c == of[v]))
            total[of[v]] += ends[v]
    rows = sorted([(10 * v, s, d, w, 10 * u) for s, d, w in edges for v, u in ((s, d), (d, s))])
    met = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*((0, v, u, w) for v, _, _, w, u in rows), strict=True)], names=["c", "v", "u", "weight"])
    gathered = list(operators._neighbours(iter([met.slice(0, 11), met.slice(11)])))
    found = dict(x for b in operators._moved(iter(gathered), two_m, 4) for x in zip(*(c.to_pylist() for c in b.columns), strict=True))
    least = {c: min(v for v in of if of[v] == c) for c in set(of.values())}
    assert found == {10 * v: 10 * least[c] for v, c in of.items()}


@pytest.mark.parametrize("search", [lambda g: g.shortest_path("v0", "v1"), lambda g: g.strong_components(), lambda g: g.time_respecting(["v0"])], ids=["path", "strong", "arrivals"])
def test_rounds_do_not_shuffle_edges(spark, monkeypatch, search):
    """A round that joins edges with what stands at their ends sends the outcome, and neither the edges nor the labels: of the plans
    that are cut, those with a join have one exchange, but for the few that deal edges."""
    joins = []

    def cut(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        if "Join" in plan:
            joins.append(plan.count("Exchange hashpartitioning"))
        return session.shared_cut(df)

    monkeypatch.setattr(operators, "shared_cut", cut)
    settings = [spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")]
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    g = graph(spark, [(f"v{i}", f"v{i + 1}", 1.0, i, None) for i in range(5)] + [("v5", "v0", 1.0, 5, None)] + some(13, 6, 40_000), budget=GENEROUS)
    try:
        assert search(g).count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert sum(n > 1 for n in joins) <= 2 and len(joins) > 3, str(joins)
    assert settings == [spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")]


def test_influence_between_and_epochs(spark):
    g = graph(spark, [("a", "b", 0.5, 0, 1), ("b", "c", 0.5, 0, 1), ("a", "c", 0.5, 0, 1)])
    assert g.influence_between("a", "c") == 0.75 and g.influence_between("c", "a") == 0.0
    more = g.with_edges(g.edges.where("dst = 'b'").selectExpr("'c' AS src", "'d' AS dst", "weight", "type", "valid_from", "valid_until"))
    assert more.influence_between("a", "d") == 0.375 and (g.epoch, more.epoch) == (1, 2)
    with pytest.raises(Refused):
        g.influence_between("a", "nobody")


def test_graphs_by_statement(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "wh"))
    e.warehouse.publish("net.edges", spark.createDataFrame([("a", "b", 1.0, 1, 9), ("b", "c", 2.0, 3, 9), ("a", "c", 9.0, 1, 9)], SCHEMA))
    e.sql("CREATE GRAPH g FROM net.edges (SOURCE src, TARGET dst, WEIGHT w, VALID FROM a, VALID UNTIL b)")
    row = e.sql("SELECT * FROM graph_shortest_path('g', 'a', 'c') WHERE position = 2").first()
    assert (row["vertex"], row["path_cost"], row["epoch"], row["snapshot"], row["truncated"], row["truncation_reason"]) == ("c", 3.0, 1, "0", False, None)
    cut = e.sql("SELECT DISTINCT truncated, truncation_reason FROM graph_reachable('g', 'a', 'max_depth=0')").collect()
    assert [tuple(r) for r in cut] == [(True, "depth")]
    for f in ("graph_cycles('g', 'a')", "graph_influence('g', 'a')", "graph_time_respecting('g', 'a')"):
        assert {"epoch", "snapshot", "truncated", "truncation_reason"} <= set(e.sql(f"SELECT * FROM {f}").columns)
    for wrong in ("CREATE GRAPH g FROM net.edges (SOURCE src, TARGET dst)", "CREATE GRAPH h FROM net.edges (SOURCE src)", "CREATE GRAPH h FROM net.edges (SOURCE src, TARGET none)", "CREATE GRAPH h FROM net.edges (SOURCE src, TARGET dst, COLOUR w)", "DROP GRAPH h", "SELECT * FROM graph_reachable(src, 'a')"):
        with pytest.raises(Refused):
            e.sql(wrong)
    e.sql("DROP GRAPH g")
    e.sql("DROP GRAPH IF EXISTS g")
