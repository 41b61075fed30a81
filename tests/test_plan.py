import json

import pytest

from kerbline import sinks, sources
from kerbline.operators import impute, model
from kerbline.operators.quality import ExpectationError
from kerbline.params import Params
from kerbline.plans import build as plan

P = Params()
LON, LAT, D = -84.50, 38.04, 0.001


def feature(props, coords, kind="LineString"):
    return {"type": "Feature", "properties": props, "geometry": {"type": kind, "coordinates": coords}}


def street(i, a, b, cls=6, speed=25, name="MAIN  ST", **more):
    at = lambda p: [LON + p[0] * D, LAT + p[1] * D]
    return feature({"SCLINK": i, "RDCLASS": cls, "SPEED": speed, "CartoClass": 1, "ROADNAME": name, "MAINTENANCE": " ", "ONEWAY": "B", "KYDOT": None} | more, [at(a), at(b)])


@pytest.fixture
def folder(tmp_path):
    rows = [street(i, (i, 0), (i + 1, 0)) for i in range(4)] + [street(10 + i, (i, 1), (i + 1, 1), name="OAK") for i in range(4)] + [street(20, (2, 0), (2, 1), cls=3, speed=45, name="BIG", KYDOT="P74"), street(21, (4, 0), (4, 1), cls="69", speed=None)]
    (tmp_path / "streets.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": rows}))
    at = lambda x, y: [LON + x * D, LAT + y * D]
    facs = [
        feature({"objectid": 1, "type_facility": "Bicycle Lane", "STATUS": "Existing", "type_road": "On Road", "name_facility": "OAK", "name_network": "N"}, [at(0, 1.00002), at(4, 1.00002)]),
        feature({"objectid": 2, "type_facility": "Shared Use Path", "STATUS": None, "type_road": "Off Road", "name_facility": "EXISITNG Trail", "name_network": "T"}, [at(0, -0.1), at(2, -0.1), at(4, -0.1)]),
        feature({"objectid": 3, "type_facility": "Buffered Bicycle Lane", "STATUS": None, "type_road": "On Road", "name_facility": "FUNDED BIG", "name_network": "BIG"}, [at(2, 0), at(2, 1)]),
    ]
    (tmp_path / "facilities.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": facs}))
    (tmp_path / "counts.csv").write_text("Details,Sta ID,Route,BEGIN_MP,END_MP,County,AADT,Year,Map,\n,034P74 ,R 1,0,1,X,8000,2020,,\n,105P74,R 2,0,1,X,9000,2022,,\n,034A01,R 3,0,1,X,,2021,,\n")
    zone = feature({"DISTRICT": "1", "REP": " ", "EMAIL": "a", "TELEPHONE": "b", "URL": "c"}, [[at(-1, -1), at(9, -1), at(9, 9), at(-1, 9), at(-1, -1)]], "Polygon")
    (tmp_path / "districts.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [zone]}))
    return tmp_path


def test_scans(spark, folder):
    s = sources.streets(spark, str(folder / "streets.geojson"), P)
    got = {r["id"]: r for r in s.collect()}
    assert got[21]["rdclass"] == 6 and got[21]["speed_mph"] is None and got[0]["name"] == "MAIN ST" and got[0]["maintenance"] is None and not got[0]["directional"]
    f = {r["id"]: (r["fac"], r["status"], r["on_road"], r["name"]) for r in sources.facilities(spark, str(folder / "facilities.geojson"), P).collect()}
    assert f == {1: ("lane", "Existing", True, "OAK"), 2: ("path", "Existing", False, "T"), 3: ("buffered", "Funded", True, "BIG")}
    c = sources.counts(spark, str(folder / "counts.csv"))
    assert [tuple(r) for r in sources.stations(c, P).collect()] == [("P74", 8500.0)] and [tuple(r) for r in sources.routes(c, P).collect()] == [("P74", "R 1")]
    assert tuple(sources.count_years(c).first()) == (2020, 2022, 2021) and sources.counts(spark, str(folder / "none.csv")).count() == 0
    assert sources.districts(spark, str(folder / "none.geojson")).count() == 0
    with pytest.raises(ExpectationError):
        sources.streets(spark, str(folder / "facilities.geojson"), P)


def test_ways_fetch_and_queries(spark, tmp_path):
    el = [{"type": "way", "id": 5, "nodes": [1, 2], "tags": {"highway": "cycleway", "ref": "R5"}, "geometry": [{"lon": 1, "lat": 2}, {"lon": 2, "lat": 2}]}, {"type": "way", "id": 6, "nodes": [1], "tags": {"highway": "cycleway"}, "geometry": [{"lon": 1, "lat": 2}]}, {"type": "node", "id": 7}]
    calls = []

    def get():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("busy")
        return json.dumps({"elements": el}).encode()

    waits = []
    path = sources.fetch_json("http://nowhere.example", str(tmp_path / "c/ways.json"), get=get, sleep=waits.append)
    assert waits == [2, 4] and sources.fetch_json("http://nowhere.example", path, get=None) == path
    got = sources.ways(spark, path, []).collect()
    assert [(r["osm_id"], r["role"], r["name"], r["label"]) for r in got] == [(5, "path", "R5", "Cycleway")]
    assert [r["id"] for r in sources.ways_as_facilities(sources.ways(spark, path, [])).collect()] == [600_000_000]
    assert sources.query_polygon([[1, 2], [3, 4], [5, 6]]) == "2 1 4 3 6 5" and sources.query_string('a"b\\') == '"a\\"b\\\\"'
    with pytest.raises(OSError):
        sources.fetch_json("http://nowhere.example", str(tmp_path / "d.json"), get=lambda: b"not json", sleep=waits.append)


def test_build_and_publish(spark, folder, tmp_path):
    b = plan.from_files(spark, str(folder), P)
    e = {r["id"]: r for r in b.edges.collect()}
    assert e[10]["fac"] == "lane" and e[10]["lts"] == 1 and e[20]["lts"] == 4 and e[20]["aadt"] == 8500.0 and e[20]["aadt_src"] == 0 and e[20]["cf"] == 0
    assert any(r["fac"] == "path" for r in e.values()) and any(r["fac"] == "connector" for r in e.values()) and {r["zone"] for r in e.values()} == {"1"}
    assert [tuple(r) for r in b.funded.collect()] == [(20, 4, 3)]
    head = plan.publish(b, str(tmp_path / "out"), P, "v1")
    made = json.loads((tmp_path / "out/network.geojson").read_text())
    assert head["islands"] >= 1 and "ad" not in next(f for f in made["features"] if f["properties"]["fac"] == 6)["properties"]
    graph = json.loads((tmp_path / "out/graph.json").read_text())
    assert all(u != v and m >= 0 for u, v, _, m, _, _ in graph["edges"]) and max(max(x[:2]) for x in graph["edges"]) < len(graph["nodes"])
    assert sum(json.loads((tmp_path / "out/manifest.json").read_text())["counts"].values()) == b.edges.count()
    assert sinks.over_budget({"graph": str(tmp_path / "out/graph.json")}, {"graph": 0.0001})


def test_imputation(spark):
    rows = [(1, "a", "x", 10.0), (2, "a", "x", None), (3, "a", "y", None), (4, "b", None, 7.0), (5, "b", None, None), (6, "c", "z", None)]
    df = spark.createDataFrame(rows, "id int, a string, b string, m double")
    got = {r["id"]: (r["aadt"], r["aadt_src"]) for r in impute.cascade(df, "m", [["a", "b", "gone"], ["a", "b"], ["a"]], 500).collect()}
    assert got == {1: (10.0, 0), 2: (10.0, 2), 3: (10.0, 2), 4: (7.0, 0), 5: (7.0, 2), 6: (500.0, 2)}


def test_booster_learns_a_quantile(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.uniform(0, 10, (600, 2))
    y = np.exp(5 + 0.3 * x[:, 0] + rng.normal(0, 0.4, 600))
    rows = [(i, float(a), "k" + str(int(b) % 3), float(v), 1.0, i % 40) for i, ((a, b), v) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id int, n double, c string, t double, w double, route int")
    got = model.cross_validate(df, ["n"], ["c"], "t", "w", "route", P.with_values({"aadt.model.max_iter": 60})).join(df, "id").toPandas()
    assert len(got) == 600 and 0.65 < (got["t"] <= got["predicted"]).mean() < 0.85
    err = lambda p: np.sqrt(((np.log1p(p) - np.log1p(got["t"])) ** 2).mean())
    assert err(got["predicted"]) < 0.8 * err(np.full(600, got["t"].median()))
    assert model.predict(df, df, ["n"], ["c"], "t", "w", P.with_values({"aadt.model.max_iter": 5})).count() == 600


def test_streaming_rerates(spark, tmp_path):
    from kerbline import streaming

    spark.createDataFrame([(1, "2024-01-01 10:00:00", 45.0, 9000.0), (1, "2024-01-05 10:00:00", 20.0, 100.0)], "id int, ts string, speed_mph double, aadt double").selectExpr("id", "cast(ts as timestamp) ts", "speed_mph", "aadt").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, ts timestamp, speed_mph double, aadt double").parquet(str(tmp_path / "in"))
    static = spark.createDataFrame([(1, "none", 6, 2)], "id int, fac string, rdclass int, lanes int")
    q = streaming.rerate(stream, static, P).writeStream.outputMode("append").format("memory").queryName("rated").start()
    q.processAllAvailable()
    q.stop()
    assert [r["lts"] for r in spark.table("rated").collect()] == [4]


def test_queries_have_sql():
    import __spark_entry__ as entry
    from kerbline.queries import QUERIES, SQL

    assert set(SQL) == set(QUERIES) and set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
