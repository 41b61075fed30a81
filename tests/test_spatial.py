import math
import random

import pytest
from pyspark.sql import functions as F

from kerbline.functions import geo
from kerbline.operators import conflate, spatial
from kerbline.params import Params

PARTS = "array<array<struct<x:double,y:double>>>"
P = Params()


def line(*pts):
    return [[{"x": float(x), "y": float(y)} for x, y in pts]]


def test_projection_closes(spark):
    df = spark.createDataFrame([(-84.5, 38.04)], "a double, b double")
    x, y = df.select(*geo.utm(F.col("a"), F.col("b"))).first()
    assert abs(x - 719390.957) < 0.01 and abs(y - 4213203.590) < 0.01
    e, n = geo.utm(F.col("a"), F.col("b"))
    lon, lat = df.select(*geo.lonlat(e, n)).first()
    assert abs(lon + 84.5) < 1e-8 and abs(lat - 38.04) < 1e-8


def test_stretch_within_matches_sampling(spark):
    rng = random.Random(4)
    rows = [tuple(rng.uniform(-10, 10) for _ in range(8)) + (rng.uniform(0.5, 6),) for _ in range(60)] + [(0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 2.0, 3.0), (0.0, 0.0, 4.0, 0.0, 2.0, 0.0, 2.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "a double,b double,c double,d double,e double,f double,g double,h double,r double")
    got = [r[0] for r in df.select(geo.within(*(F.col(c) for c in "abcdefghr"))).collect()]
    for (ax, ay, bx, by, cx, cy, dx, dy, r), s in zip(rows, got):

        def gap(t, ax=ax, ay=ay, bx=bx, by=by, cx=cx, cy=cy, dx=dx, dy=dy):
            px, py, vx, vy = ax + t * (bx - ax), ay + t * (by - ay), dx - cx, dy - cy
            n = vx * vx + vy * vy
            u = max(0, min(1, ((px - cx) * vx + (py - cy) * vy) / n)) if n else 0
            return math.hypot(px - cx - u * vx, py - cy - u * vy)

        inside = [t / 2000 for t in range(2001) if gap(t / 2000) <= r]
        assert (s is None) == (not inside) or (s is not None and s["hi"] - s["lo"] < 1e-3)
        if inside and s is not None:
            assert abs(s["lo"] - inside[0]) < 1e-3 and abs(s["hi"] - inside[-1]) < 1e-3


def test_coverage_counts_overlaps_once(spark):
    rows = [(1, 0, 0, 0.0, 0.5, 10.0), (1, 0, 0, 0.25, 0.75, 10.0), (1, 0, 0, 0.3, 0.4, 10.0), (1, 0, 1, 0.0, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "id int, part int, idx int, lo double, hi double, len double")
    assert spatial.covered(df, ["id"]).collect()[0]["covered"] == pytest.approx(9.5)


def test_near_pairs_match_brute_force(spark):
    rng = random.Random(1)
    pts = [(i, rng.uniform(0, 30), rng.uniform(0, 30)) for i in range(150)]
    df = spark.createDataFrame(pts, "id int, x double, y double")
    spots = df.select("id", F.lit(0).alias("part"), F.lit(0).alias("idx"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    gap = geo.distance(F.col("x1"), F.col("y1"), F.col("r_x1"), F.col("r_y1"))
    got = [tuple(r) for r in spatial.near_segments(spots, spots, 1.5).where((F.col("id") < F.col("r_id")) & (gap <= 1.5)).select("id", "r_id").collect()]
    want = {(a[0], b[0]) for a in pts for b in pts if a[0] < b[0] and math.hypot(a[1] - b[1], a[2] - b[2]) <= 1.5}
    assert len(got) == len(set(got)) and set(got) == want


def test_cut_simplify_clip_and_inside(spark):
    df = spark.createDataFrame([(1, line((0, 0), (10, 0), (10, 10)), [5.0, 5.0, 10.0, 25.0])], f"id int, parts {PARTS}, cuts array<double>")
    pieces = spatial.cut_line(df).orderBy("piece").collect()
    ends = [(p["parts"][0][0].asDict(), p["parts"][0][-1].asDict()) for p in pieces]
    assert len(pieces) == 3 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
    assert sum(r[0] for r in spatial.cut_line(df).select(spatial.line_length(F.col("parts"))).collect()) == pytest.approx(20)
    wavy = spark.createDataFrame([(1, line((0, 0), (5, 0.01), (10, 0)))], f"id int, parts {PARTS}")
    assert len(spatial.simplify(wavy, 0.1).collect()[0]["parts"][0]) == 2 and len(spatial.simplify(wavy, 0.001).collect()[0]["parts"][0]) == 3
    cut = spatial.clip(spark.createDataFrame([(1, line((-5, 5), (15, 5))), (2, line((20, 20), (30, 30)))], f"id int, parts {PARTS}"), [(0, 0), (10, 0), (10, 10), (0, 10)]).collect()
    assert [r["id"] for r in cut] == [1] and [p["x"] for p in cut[0]["parts"][0]] == [0.0, 10.0]
    zones = spark.createDataFrame([("a", line((0, 0), (10, 0), (10, 10), (0, 10), (0, 0))), ("b", line((10, 0), (20, 0), (20, 10), (10, 10), (10, 0)))], f"zone string, parts {PARTS}")
    pts = spark.createDataFrame([(1, 5.0, 5.0), (2, 15.0, 5.0), (3, 25.0, 5.0)], "id int, x double, y double")
    assert {r["id"]: r["zone"] for r in spatial.inside(pts, zones, 3.0).collect()} == {1: "a", 2: "b", 3: None}


def streets_and(spark, streets, facs):
    s = spark.createDataFrame(streets, f"id int, name string, rdclass int, parts {PARTS}")
    f = spark.createDataFrame(facs, f"id int, name string, fac string, source_id long, parts {PARTS}")
    return {r["id"]: (r["fac"], list(r["fac_source_ids"])) for r in conflate.on_road(s, f, P).collect()}


def test_conflation(spark):
    got = streets_and(
        spark,
        [(1, "MAIN ST", 4, line((0, 5), (100, 5))), (2, "MAIN ST", 4, line((0, 15), (100, 15))), (3, "OAK ST", 4, line((0, -15), (100, -15))), (4, "X", 4, line((50, -60), (50, 60))), (5, "MAIN ST", 1, line((0, 4), (100, 4))), (6, "Y", 4, line((0, 5), (300, 5)))],
        [(1, "main  st", "lane", 71, line((0, 0), (100, 0)))],
    )
    assert got == {1: ("lane", [71]), 2: ("lane", [71]), 3: ("none", []), 4: ("none", []), 5: ("none", []), 6: ("none", [])}


def test_stronger_category_needs_its_share(spark):
    got = streets_and(spark, [(1, "A", 4, line((0, 0), (100, 0)))], [(1, "a", "lane", 1, line((0, 2), (100, 2))), (2, "b", "buffered", 2, line((0, 3), (10, 3)))])
    assert got[1][0] == "lane"
    got = streets_and(spark, [(1, "A", 4, line((0, 0), (100, 0)))], [(1, "a", "lane", 1, line((0, 2), (100, 2))), (2, "b", "buffered", 2, line((0, 3), (60, 3)))])
    assert got[1] == ("buffered", [2])


def test_gate_dedupe_and_campus(spark):
    s = spark.createDataFrame([(1, "lane", line((0, 0), (100, 0)))], f"id int, fac string, parts {PARTS}")
    f = spark.createDataFrame([(1, "lane", line((0, 5), (200, 5)))], f"id int, fac string, parts {PARTS}")
    recall, inflation = conflate.coverage_quality(s, f, 12)
    assert recall == pytest.approx((100 + math.sqrt(144 - 25)) / 200) and inflation == pytest.approx(0.5)
    ways = spark.createDataFrame([(1, line((0, 5), (100, 5))), (2, line((0, 50), (100, 50)))], f"id int, parts {PARTS}")
    assert [r["id"] for r in conflate.overlapping(ways, s, 15, 0.5).collect()] == [2]
    paths = spark.createDataFrame([(1, line((0, 20), (100, 20))), (2, line((50, -40), (50, 40))), (3, line((0, 60), (100, 60)))], f"id int, parts {PARTS}")
    assert [r["id"] for r in conflate.alongside(paths, s, P).collect()] == [1]


def test_attachments_connectors_and_split(spark):
    paths = spark.createDataFrame([(1, line((0, 0), (100, 0), (200, 0), (400, 0)))], f"id int, parts {PARTS}")
    streets = spark.createDataFrame([(10, line((0, 10), (0, 50))), (11, line((90, 20), (110, 20))), (12, line((400, 12), (400, 90))), (13, line((200, 24), (220, 24)))], f"id int, parts {PARTS}")
    found = conflate.attachments(paths, streets, P)
    assert sorted(r["target"] for r in found.collect()) == [10, 12, 13]  # 11 lies within the spacing of the end
    links = conflate.connectors(found).orderBy("id").collect()
    assert [r["id"] - 900_000_000 for r in links] == [0, 1, 2] and [r["split_street_id"] for r in links] == [10, 13, 12]
    whole = spark.createDataFrame([(1, "A", line((0, 0), (10, 0))), (2, "B", line((0, 5), (10, 5)))], f"id long, name string, parts {PARTS}")
    cut = conflate.split_at(whole, spark.createDataFrame([(1, 4.0, 0.0), (1, 4.0, 0.0), (1, 0.0, 0.0)], "id long, x double, y double"))
    assert sorted((r["id"], r["name"], len(r["parts"][0])) for r in cut.collect()) == [(1, "A", 2), (2, "B", 2), (700_000_000, "A", 2)]
    assert sorted(r["at"] for r in conflate.gap_cuts(spark.createDataFrame([(1, 2000.0, 300.0)], "id int, length double, at double"), "length", 800.0).collect()) == pytest.approx([300, 300 + 1700 / 3, 300 + 3400 / 3])
