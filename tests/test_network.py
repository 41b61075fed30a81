import heapq
import random

from pyspark.sql import functions as F

from kerbline.operators import components, network, routing, scenario, stats
from kerbline.operators.quality import ExpectationError, expect, expect_unique
from kerbline.params import Params

PARTS = "array<array<struct<x:double,y:double>>>"


def seg(a, b):
    return [[{"x": float(a[0]), "y": float(a[1])}, {"x": float(b[0]), "y": float(b[1])}]]


def edges_of(spark, rows):
    """rows: (id, name, lts, miles, parts)"""
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], f"id long, name string, lts int, miles double, parts {PARTS}, row_pos long")
    return network.build_graph(df)


def test_graph_numbers_nodes_by_first_appearance(spark):
    loop = [[{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 1.0}, {"x": 0.0, "y": 0.000001}]]
    nodes, edges = edges_of(spark, [(1, "A", 1, 1.0, seg((5, 5), (1, 1))), (2, "A", 1, 1.0, seg((1.000001, 1), (0, 0))), (3, "L", 1, 1.0, loop), (4, "M", 1, 1.0, seg((0, 0), (1, 1)) * 2)])
    assert [(r["node_id"], r["x"]) for r in nodes.orderBy("node_id").collect()] == [(0, 5.0), (1, 1.0), (2, 0.0)]
    assert {r["id"]: (r["u"], r["v"]) for r in edges.collect()} == {1: (0, 1), 2: (1, 2), 3: (None, None), 4: (None, None)}


def chain(start, n, y, lts=1, name="A", miles=1.0):
    return [(start + i, name, lts, miles, seg((i, y), (i + 1, y))) for i in range(n)]


def test_islands_rank_by_miles_then_segments(spark):
    _, e = edges_of(spark, chain(1, 5, 0, miles=0.5) + chain(10, 2, 9, miles=4.0) + chain(20, 1, 20, lts=4))
    found, member = network.islands(e, F.col("lts").between(1, 2), "miles", 3)
    assert [(r["island"], r["segments"], r["miles"], r["major"]) for r in found.orderBy("island").collect()] == [(0, 2, 8.0, False), (1, 5, 2.5, True)]
    assert member.count() == 9


def test_parallel_edges_overwrite(spark):
    _, e = edges_of(spark, [(1, "A", 1, 1.0, seg((0, 0), (1, 0))), (2, "B", 1, 7.0, seg((1, 0), (0, 0)))])
    low = F.col("lts") == 1
    assert network.islands(e, low, "miles", 1)[0].first()["miles"] == 7.0
    assert network.islands(e, low, "miles", 1, parallel="all")[0].first()["miles"] == 8.0


def test_barriers(spark):
    rows = chain(1, 3, 0) + chain(11, 3, 1) + [(21, "Main", 4, 0.5, seg((0, 0), (0, 1))), (22, "Main", 3, 0.25, seg((1, 0), (1, 1))), (23, "Oak", 4, 3.0, seg((2, 0), (2, 1))), (24, None, 0, 0.1, seg((3, 0), (3, 1)))]
    _, e = edges_of(spark, rows)
    low = F.coalesce(F.col("lts").between(1, 2), F.lit(False))
    found, member = network.islands(e, low, "miles", 3)
    got = network.barriers(e, found, member, low, "miles", 3).orderBy("rank").collect()
    assert [(r["name"], r["score"], r["current_lts"], list(r["segment_ids"]), r["best_for_pair"], r["alternatives"]) for r in got] == [(None, 30.0, 0, [24], True, 2), ("Main", 4.0, 4, [21, 22], False, 2), ("Oak", 1.0, 4, [23], False, 2)]
    assert network.barriers(e, found, member, low, "miles", 3, prohibited=False).count() == 2
    assert network.barriers(e, found, member, low, "miles", 4).count() == 0


def test_components_match_union_find(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 3)]
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in root}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_seed_expansion(spark):
    ways = spark.createDataFrame([(1, [1, 2]), (2, [2, 3]), (3, [3, 4]), (4, [9, 10])], "id long, nodes array<long>")
    assert sorted(r["id"] for r in components.expand(ways, spark.createDataFrame([(1,)], "id long")).collect()) == [1, 2, 3]


def dijkstra(edges, start, cost):
    out, heap = {}, [(0.0, start)]
    while heap:
        d, n = heapq.heappop(heap)
        if n in out:
            continue
        out[n] = d
        for i, u, v, m, lvl in edges:
            for a, b in ((u, v), (v, u)):
                if a == n and cost(m, lvl) is not None:
                    heapq.heappush(heap, (d + cost(m, lvl), b))
    return out


def test_routes_match_dijkstra(spark):
    rng = random.Random(7)
    edges = [(i, rng.randrange(20), rng.randrange(20), rng.uniform(0.1, 2), rng.randrange(5)) for i in range(60)]
    edges = [e for e in edges if e[1] != e[2]]
    df = spark.createDataFrame(edges, "id long, u long, v long, miles double, lts int")
    pen = {1: 1.0, 2: 1.05, 3: 1.4, 4: 3.5}
    state = routing.distances(df, spark.createDataFrame([(0, 0, 0.0)], "source long, node long, start double"), routing.edge_cost("balanced"))
    want = dijkstra(edges, 0, lambda m, n: m * pen[n] if n in pen else None)
    got = {r["node"]: r["cost"] for r in state.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    far = max(want, key=want.get)
    path = routing.path_edges(state, df, spark.createDataFrame([(0, far)], "source long, node long")).join(df, "id").collect()
    assert abs(sum(r["miles"] * pen[r["lts"]] for r in path) - want[far]) < 1e-9


def test_snapped_routes(spark):
    df = spark.createDataFrame([(1, 0, 1, 1.0, 1), (2, 1, 2, 1.0, 1), (3, 2, 3, 1.0, 1), (4, 5, 6, 1.0, 0), (5, 7, 8, 1.0, 1)], "id long, u long, v long, miles double, lts int")
    trips = spark.createDataFrame([(1, 1, 0.5, 3, 0.5), (2, 2, 0.25, 2, 0.75), (3, 4, 0.1, 1, 0.5), (4, 4, 0.1, 4, 0.5), (5, 1, 0.5, 5, 0.5)], "trip long, edge_a long, frac_a double, edge_b long, frac_b double")
    assert {r["trip"]: r["cost"] for r in routing.snapped_route(df, trips, "shortest").collect()} == {1: 2.0, 2: 0.5, 3: None, 4: None, 5: None}


def test_scenarios_and_gates(spark):
    e = spark.createDataFrame([(1, 3), (2, 1), (3, 4)], "id long, lts int")
    s = spark.createDataFrame([(1, 1), (2, 3), (9, 1)], "id long, lts int")
    assert [tuple(r) for r in scenario.upgrades(e, s).collect()] == [(1, 3, 1)]
    golden = spark.createDataFrame([(1, 3), (2, 2), (7, 1), (3, None)], "id long, expected_lts int")
    assert {r["id"]: r["verdict"] for r in scenario.golden(e, golden).collect()} == {1: "passed", 2: "failed", 7: "missing"}
    assert scenario.drift({"total_miles": 103.0}, {"total_miles": 100.0}) and not scenario.drift({"total_miles": 101.0}, {"total_miles": 100.0})

    def run(values):
        if values.get("bad"):
            raise ExpectationError("refused")
        return spark.createDataFrame([(1, values.get("x", 3)), (2, 1)], "id long, lts int")

    rows, moved = scenario.sweep(run, [{"name": "a", "set": {"x": 2}}, {"name": "b", "set": {"bad": 1}}], lambda df: {"n": df.count()})
    assert [r.get("changed") for r in rows] == [0, 1, None] and [r["id"] for r in moved.collect()] == [1] and "refused" in scenario.markdown(rows)


def test_expectations(spark):
    import pytest

    df = spark.createDataFrame([(1,), (1,), (None,)], "id long")
    with pytest.raises(ExpectationError):
        expect_unique(df, "id")
    with pytest.raises(ExpectationError, match="low"):
        expect(df, "id", low=F.col("id") < 5)


def test_statistics(spark):
    e = spark.createDataFrame([("lane", 1, 2.0, "A"), ("none", 4, 6.0, "B"), ("connector", 1, 50.0, None), ("none", 2, 2.0, "B")], "fac string, lts int, miles double, name string")
    low = F.col("lts").between(1, Params()["lts.low_stress_max"])
    assert tuple(stats.summary(e, low).first()) == (10.0, 4.0, 4.0, 3)
    rows = e.withColumn("layer", stats.layer(F.col("fac"), low))
    assert {r["layer"]: dict(r["by_lts"]) for r in stats.layer_levels(rows).collect()} == {"network": {"1": 52.0}, "context": {"4": 6.0}, "residential": {"2": 2.0}}
    assert [tuple(r) for r in stats.street_index(e).orderBy("name").collect()] == [("A", 1, 2.0, 1, 1), ("B", 2, 8.0, 2, 4)]
    hits, more = stats.search(stats.street_index(e), "B", most=1)
    assert hits.count() == 1 and more == 0
