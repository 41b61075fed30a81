import pytest
from pyspark.sql import functions as F

from kerbline.functions import rules, text
from kerbline.params import Params, ParamsError, literal, load

P = Params()
KIND = "fac string, rdclass int, lanes int, speed double, aadt double"


def rated(spark, rows):
    df = spark.createDataFrame(rows, KIND)
    return [r[0] for r in df.select(rules.lts("fac", "rdclass", "lanes", "speed", "aadt", P)).collect()]


def test_mixed_traffic_table(spark):
    rows = [("none", 6, 2, 25.0, 750.0), ("none", 6, 3, 25.0, 750.0), ("none", 6, 2, 25.0, 3001.0), ("none", 5, 2, 30.0, 3000.0), ("none", 5, 2, 30.0, 3001.0), ("none", 4, 2, 35.0, 1.0), ("none", 4, 2, 40.0, 1.0), ("none", 3, 4, 30.0, 1.0), ("none", 3, 5, 35.0, 1.0), ("none", 3, 6, 20.0, 1.0), ("none", 1, 2, 25.0, 1.0)]
    assert rated(spark, rows) == [1, 2, 3, 2, 3, 3, 4, 3, 4, 4, 0]


def test_facilities_and_missing_data(spark):
    rows = [("path", 6, 1, None, None), ("path", 2, 1, None, None), ("buffered", 4, 2, 30.0, 9000.0), ("buffered", 4, 3, 30.0, 9000.0), ("lane", 4, 4, 35.0, 9000.0), ("lane", 4, 2, 45.0, 9000.0), ("shoulder", 4, 2, 35.0, 9e4), ("sharrow", 6, 2, 25.0, 700.0), ("none", 6, 2, None, None), ("none", 6, 2, float("nan"), float("nan")), ("moat", 6, 2, 25.0, 1.0), ("lane", 6, 2, 25.0, 500.0)]
    assert rated(spark, rows) == [1, 0, 1, 2, 4, 4, 3, 1, 2, 2, None, 1]


def test_better_facility_is_never_worse(spark):
    grid = [(f, 4, n, float(s), float(a)) for n in (1, 2, 3, 4, 6) for s in (20, 25, 30, 35, 40, 55) for a in (100, 1000, 5000) for f in ("none", "lane", "buffered", "path")]
    got = rated(spark, grid)
    for i in range(0, len(got), 4):
        assert got[i] >= got[i + 1] >= got[i + 2] >= got[i + 3]
    assert set(got) <= {1, 2, 3, 4}


def test_speed_snaps_to_the_lower_tie(spark):
    df = spark.createDataFrame([(x,) for x in (12.5, 27.4, 62.5, 62.6, 0.0, -3.0, None, float("nan"))], "s double")
    assert [r[0] for r in df.select(rules.snap_speed("s")).collect()] == [10, 25, 55, 70, None, None, None, None]


def test_lane_rules_take_the_first_fit(spark):
    df = spark.createDataFrame([(3, True, 1), (3, False, 2), (3, False, 9), (4, False, None), (6, True, None), (None, None, None)], "r int, d boolean, c int")
    assert [r[0] for r in df.select(rules.lanes("r", "d", "c", P)).collect()] == [3, 5, 3, 3, 1, 2]


def test_strongest_facility(spark):
    df = spark.createDataFrame([(["lane", "path", "none"],), ([],), (["lane", "moat"],)], "f array<string>")
    assert [r[0] for r in df.select(rules.strongest("f", P)).collect()] == ["path", "none", None]


def test_roles(spark):
    tags = [{"highway": "cycleway"}, {"highway": "footway"}, {"highway": "footway", "bicycle": "designated"}, {"highway": "service", "bicycle": "yes"}, {"highway": "service", "bicycle": "yes", "name": "North Parking"}, {"highway": "service", "bicycle": "yes", "oneway": "yes"}, {"highway": "residential", "name": "Elm"}, {"highway": "residential", "name": "Elm", "access": "private"}]
    df = spark.createDataFrame([(t,) for t in tags], "t map<string,string>")
    assert [r[0] for r in df.select(rules.osm_role(F.col("t"), ["Elm"], F.lit(False))).collect()] == ["path", None, "path", "access", None, None, "reviewed_street", None]
    assert df.limit(2).select(rules.osm_role(F.col("t"), [], F.lit(True))).collect()[1][0] == "campus_path"


def test_titles_and_display(spark):
    df = spark.createDataFrame([("MILL  of THE  us ROAD",), ("of nw",), (None,)], "s string")
    assert [r[0] for r in df.select(text.title_case("s")).collect()] == ["Mill of the US Road", "Of NW", None]
    d = spark.createDataFrame([(0.05, 12345.0, 0), (1.26, 1234.0, 1), (0.0, 70.0, 2), (2.0, None, 0)], "m double, a double, s int")
    rows = d.select(text.show_miles("m"), text.show_traffic("a", "s"), text.show_minutes("m")).collect()
    assert [tuple(r) for r in rows] == [("264 ft", "12,000 vehicles/day (counted)", 1), ("1.3 mi", "1,200 vehicles/day (estimated)", 8), ("0 ft", "50 vehicles/day (estimated)", 1), ("2.0 mi", "Not on record", 12)]


def test_params(tmp_path):
    p = load(None, ["lts.mixed.35=2", "conflation.buffer_m = 8.0"])
    assert p["lts.mixed.35"] == 2 and p["conflation.buffer_m"] == 8.0 and p.digest() != P.digest() and len(P.digest()) == 12
    for bad in (["nope=1"], ["lts.mixed=1"], ["lts"]):
        with pytest.raises(ParamsError):
            load(None, bad)
    assert literal("true") is True and literal("abc") == "abc"
    for run in P["sensitivity.runs"]:
        P.with_values(run["set"])
    (tmp_path / "p.toml").write_text("[a]\nb = 1\n")
    assert load(str(tmp_path / "p.toml"), ["a.b=2"])["a.b"] == 2
