"""Spatial joins and linear referencing on arrays of points.

Geometry is `parts array<array<struct<x, y>>>`. Near joins put segments into the cells of a grid, join on
the cell and then test exactly; no pair of far features ever meets.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.functions import geo


def project(parts: Column, meridian: float = -87.0, inverse: bool = False) -> Column:
    """Parts in metres from degrees, or back."""

    def point(p: Column) -> Column:
        x, y = geo.lonlat(p["x"], p["y"], meridian) if inverse else geo.utm(p["x"], p["y"], meridian)
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(parts, lambda part: F.transform(part, point))


def line_length(parts: Column) -> Column:
    """Summed length of all parts."""

    def of(part: Column) -> Column:
        steps = F.when(F.size(part) > 1, F.zip_with(F.slice(part, 1, F.size(part) - 1), F.slice(part, 2, F.size(part) - 1), lambda a, b: geo.distance(a["x"], a["y"], b["x"], b["y"])))
        return F.aggregate(F.coalesce(steps, F.array().cast("array<double>")), F.lit(0.0), lambda s, d: s + d)

    return F.aggregate(F.transform(parts, of), F.lit(0.0), lambda s, d: s + d)


def segments(df: DataFrame, id_col: str = "id", parts: str = "parts", *keep: str) -> DataFrame:
    """(id, part, idx, x1, y1, x2, y2, len, at) for each pair of neighbouring vertices; at: length before it along the part."""
    part = df.select(F.col(id_col).alias("id"), *keep, F.posexplode(parts).alias("part", "p"))
    pairs = F.when(F.size("p") > 1, F.zip_with(F.slice("p", 1, F.size("p") - 1), F.slice("p", 2, F.size("p") - 1), lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2"), geo.distance(a["x"], a["y"], b["x"], b["y"]).alias("len"))))
    empty = F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double,len:double>>")
    start = F.struct(F.lit(0.0).alias("d"), F.array().cast("array<double>").alias("out"))
    before = F.aggregate("s", start, lambda acc, s: F.struct((acc["d"] + s["len"]).alias("d"), F.concat(acc["out"], F.array(acc["d"])).alias("out")))["out"]
    rows = part.withColumn("s", F.coalesce(pairs, empty)).withColumn("z", F.arrays_zip("s", before.alias("at")))
    return rows.select("id", *keep, "part", F.posexplode("z").alias("idx", "z")).select("id", *keep, "part", "idx", "z.s.*", F.col("z.at").alias("at"))


def _cells(x1: Column, y1: Column, x2: Column, y2: Column, pad: Column | float, size: float) -> Column:
    """Cells of the box around a segment, padded."""
    lo = lambda a, b: F.floor((F.least(a, b) - pad) / size)
    hi = lambda a, b: F.floor((F.greatest(a, b) + pad) / size)
    return F.flatten(F.transform(F.sequence(lo(x1, x2), hi(x1, x2)), lambda i: F.transform(F.sequence(lo(y1, y2), hi(y1, y2)), lambda j: F.struct(i.alias("i"), j.alias("j")))))


def near_segments(left: DataFrame, right: DataFrame, radius: float, cell: float | None = None) -> DataFrame:
    """Pairs of segments whose padded boxes share a cell: left columns as they are, right ones with r_ before.

    Each pair is found once, in the first cell that both have: the box corners' later minimum.
    """
    size = cell or max(4 * radius, 1e-9)
    a = left.withColumn("_c", F.explode(_cells(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), radius, size)))
    b = right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns))
    b = b.withColumn("_c", F.explode(_cells(F.col("r_x1"), F.col("r_y1"), F.col("r_x2"), F.col("r_y2"), 0.0, size)))
    first_i = F.greatest(F.floor((F.least("x1", "x2") - radius) / size), F.floor(F.least("r_x1", "r_x2") / size))
    first_j = F.greatest(F.floor((F.least("y1", "y2") - radius) / size), F.floor(F.least("r_y1", "r_y2") / size))
    return a.join(b, "_c").where((F.col("_c.i") == first_i) & (F.col("_c.j") == first_j)).drop("_c")


def stretches(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """For each near pair the stretch [lo, hi] of the left segment within radius of the right one."""
    pairs = near_segments(left, right, radius)
    c = F.col
    span = geo.within(c("x1"), c("y1"), c("x2"), c("y2"), c("r_x1"), c("r_y1"), c("r_x2"), c("r_y2"), F.lit(float(radius)))
    return pairs.withColumn("_s", span).where("_s IS NOT NULL").withColumns({"lo": F.col("_s.lo"), "hi": F.col("_s.hi")}).drop("_s")


def covered(spans: DataFrame, by: list[str], lo: str = "lo", hi: str = "hi", length: str = "len") -> DataFrame:
    """(by, covered): length of the union of intervals, which overlap freely within a segment of `by[0]`.

    spans need the columns part and idx; each row's interval counts only beyond what rows before it cover.
    """
    w = Window.partitionBy(*by, "part", "idx").orderBy(lo, hi).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.max(hi).over(w), F.lit(float("-inf")))
    own = F.greatest(F.lit(0.0), F.col(hi) - F.greatest(F.col(lo), before)) * F.col(length)
    return spans.withColumn("_o", own).groupBy(*by).agg(F.sum("_o").alias("covered"))


def local_bearing(spans: DataFrame, by: list[str], out: str) -> DataFrame:
    """(by, out): mean direction of the stretches, weighted by their length."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    s, c = geo.doubled_bearing(dx, dy, F.col("len"))
    part = F.col("hi") - F.col("lo")
    sums = spans.groupBy(*by).agg(F.sum(s * part).alias("_s"), F.sum(c * part).alias("_c"))
    return sums.select(*by, geo.mean_bearing(F.col("_s"), F.col("_c")).alias(out))


def nearest(points: DataFrame, targets: DataFrame, most: float, id_col: str = "id") -> DataFrame:
    """(id, target, gap, t): the nearest segment within `most` of each point (id, x, y), ties to the least target.

    targets: of segments(); a grid join, so only targets in reach are measured.
    """
    own = points.select(F.col(id_col).alias("id"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    pairs = near_segments(own, targets, most)
    args = [F.col(c) for c in ("x1", "y1", "r_x1", "r_y1", "r_x2", "r_y2")]
    pairs = pairs.withColumns({"gap": geo.point_distance(*args), "t": geo.along(*args)}).where(F.col("gap") <= most)
    best = pairs.groupBy("id").agg(F.min(F.struct("gap", "r_id", "r_part", "r_idx", "t")).alias("b"))
    return best.select("id", F.col("b.r_id").alias("target"), F.col("b.r_part").alias("part"), F.col("b.r_idx").alias("idx"), "b.gap", "b.t")


def nearest_growing(points: DataFrame, targets: DataFrame, start: float, rings: int = 6, id_col: str = "id") -> DataFrame:
    """nearest() with a reach that doubles until a point is answered, `rings` times at most."""
    out, left, reach = None, points, start
    for _ in range(rings):
        found = nearest(left, targets, reach, id_col)
        out = found if out is None else out.unionByName(found)
        left = left.join(found.select(F.col("id").alias(id_col)), id_col, "left_anti")
        reach *= 2
    return out


def inside(points: DataFrame, polygons: DataFrame, cell: float, id_col: str = "id", zone: str = "zone") -> DataFrame:
    """(id, zone): the least zone that strictly contains each point, null if none does.

    polygons (zone, parts) are rings; a point is inside by the even-odd rule over all its zone's edges. Rings'
    edges are put into rows of the grid, so a point meets only edges at its own height.
    """
    edges = segments(polygons, zone, "parts")
    rows = edges.withColumn("row", F.explode(F.sequence(F.floor(F.least("y1", "y2") / cell), F.floor(F.greatest("y1", "y2") / cell))))
    at = points.select(F.col(id_col).alias("pid"), F.col("x").alias("px"), F.col("y").alias("py"), F.floor(F.col("y") / cell).alias("row"))
    crosses = ((F.col("y1") > F.col("py")) != (F.col("y2") > F.col("py"))) & (F.col("px") < (F.col("x2") - F.col("x1")) * (F.col("py") - F.col("y1")) / F.when(F.col("y2") != F.col("y1"), F.col("y2") - F.col("y1")) + F.col("x1"))
    odd = at.join(rows, "row").groupBy("pid", F.col("id").alias("z")).agg(F.sum(F.when(crosses, 1).otherwise(0)).alias("n")).where("n % 2 = 1")
    best = odd.groupBy("pid").agg(F.min("z").alias(zone))
    return points.select(F.col(id_col)).join(best, F.col(id_col) == F.col("pid"), "left").drop("pid")


def representative(parts: Column) -> Column:
    """A vertex to stand for a line: the inner vertex nearest its length-weighted centroid, else the nearer end."""
    p = F.element_at(parts, 1)
    n = F.size(p)
    steps = F.zip_with(F.slice(p, 1, n - 1), F.slice(p, 2, n - 1), lambda a, b: F.struct(((a["x"] + b["x"]) / 2).alias("x"), ((a["y"] + b["y"]) / 2).alias("y"), geo.distance(a["x"], a["y"], b["x"], b["y"]).alias("w")))
    total = F.aggregate(steps, F.lit(0.0), lambda s, q: s + q["w"])
    cx = F.aggregate(steps, F.lit(0.0), lambda s, q: s + q["x"] * q["w"]) / F.when(total > 0, total)
    cy = F.aggregate(steps, F.lit(0.0), lambda s, q: s + q["y"] * q["w"]) / F.when(total > 0, total)
    pool = F.when(n > 2, F.slice(p, 2, n - 2)).otherwise(p)
    far = F.transform(pool, lambda q: F.struct(geo.distance(q["x"], q["y"], cx, cy).alias("d"), q.alias("q")))
    return F.when(total > 0, F.array_min(far)["q"]).otherwise(F.element_at(p, 1))


def clip(lines: DataFrame, ring: list[tuple[float, float]], id_col: str = "id", parts: str = "parts") -> DataFrame:
    """(id, parts): the stretches of each line inside a simple polygon, by the even-odd rule; lines outside go."""
    closed = ring if ring[0] == ring[-1] else [*ring, ring[0]]
    edges = [(x1, y1, x2 - x1, y2 - y1) for (x1, y1), (x2, y2) in zip(closed, closed[1:])]

    def cut(pieces) -> list:
        out: list[list[tuple[float, float]]] = []
        for piece in pieces:
            run: list[tuple[float, float]] = []
            for a, b in zip(piece, piece[1:]):
                (ax, ay), (bx, by) = (a["x"], a["y"]), (b["x"], b["y"])
                dx, dy, ts = bx - ax, by - ay, [0.0, 1.0]
                for ex, ey, ux, uy in edges:
                    cross = dx * uy - dy * ux
                    if abs(cross) > 1e-18:
                        t, s = ((ex - ax) * uy - (ey - ay) * ux) / cross, ((ex - ax) * dy - (ey - ay) * dx) / cross
                        if 0 < t < 1 and 0 <= s <= 1:
                            ts.append(t)
                ts.sort()
                for t, u in zip(ts, ts[1:]):
                    mx, my = ax + dx * (t + u) / 2, ay + dy * (t + u) / 2
                    odd = sum((ey > my) != (ey + uy > my) and mx < ux * (my - ey) / uy + ex for ex, ey, ux, uy in edges) % 2
                    p, q = (ax + dx * t, ay + dy * t), (ax + dx * u, ay + dy * u)
                    if odd and u - t > 1e-12:
                        run = run if run else [p]
                        run.append(q)
                    elif run:
                        out.append(run)
                        run = []
            if len(run) > 1:
                out.append(run)
        return [[{"x": x, "y": y} for x, y in r] for r in out]

    return _per_line(lines, cut, id_col, parts).where(F.size("parts") > 0)


def cut_line(lines: DataFrame, id_col: str = "id", parts: str = "parts", at: str = "cuts") -> DataFrame:
    """(id, piece, parts): single-part lines cut at distances along them; neighbours share the cut's coordinates.

    Distances outside the line, repeated ones and pieces of no length are left out.
    """
    kind = lines.schema[id_col].dataType.simpleString()

    def work(frames):
        for frame in frames:
            rows = []
            for key, line, cuts in zip(frame["id"], frame["parts"], frame["cuts"]):
                p = np.array([(v["x"], v["y"]) for v in line[0]])
                d = np.concatenate([[0], np.cumsum(np.hypot(*np.diff(p, axis=0).T))])
                stops = [0.0, *sorted({float(c) for c in (cuts if cuts is not None else []) if 1e-6 < c < d[-1] - 1e-6}), d[-1]]
                piece = 0
                for a, b in zip(stops, stops[1:]):
                    if b - a <= 1e-9:
                        continue
                    inner = p[(d > a + 1e-9) & (d < b - 1e-9)]
                    end = lambda t: np.array([np.interp(t, d, p[:, 0]), np.interp(t, d, p[:, 1])])
                    points = [p[0] if a == 0 else end(a), *inner, p[-1] if b == d[-1] else end(b)]
                    rows.append((key, piece, [[{"x": float(x), "y": float(y)} for x, y in points]]))
                    piece += 1
            yield pd.DataFrame(rows, columns=["id", "piece", "parts"])

    rows = lines.select(F.col(id_col).alias("id"), F.col(parts).alias("parts"), F.col(at).alias("cuts"))
    return rows.mapInPandas(work, f"id {kind}, piece int, parts array<array<struct<x:double,y:double>>>").withColumnRenamed("id", id_col)


def simplify(lines: DataFrame, tolerance: float, id_col: str = "id", parts: str = "parts") -> DataFrame:
    """(id, parts): fewer vertices by Douglas and Peucker's rule; ends stay, and closed rings keep four points."""

    def thin(part) -> list:
        p = np.array([(v["x"], v["y"]) for v in part])
        keep, stack = {0, len(p) - 1}, [(0, len(p) - 1)]
        while stack:
            a, b = stack.pop()
            if b - a < 2:
                continue
            d, q = p[b] - p[a], p[a + 1 : b] - p[a]
            n = np.hypot(*d)
            far = np.abs(d[0] * q[:, 1] - d[1] * q[:, 0]) / n if n > 0 else np.hypot(q[:, 0], q[:, 1])
            i = int(far.argmax())
            if far[i] > tolerance:
                keep.add(a + 1 + i)
                stack += [(a, a + 1 + i), (a + 1 + i, b)]
        closed = len(p) > 3 and (p[0] == p[-1]).all()
        at = sorted(keep) if not closed or len(keep) >= 4 else range(len(p))
        return [{"x": float(p[i, 0]), "y": float(p[i, 1])} for i in at]

    return _per_line(lines, lambda pieces: [thin(x) for x in pieces], id_col, parts)


def _per_line(lines: DataFrame, of, id_col: str, parts: str) -> DataFrame:
    kind = lines.schema[id_col].dataType.simpleString()

    def work(frames):
        for frame in frames:
            yield pd.DataFrame({"id": frame["id"], "parts": [of(x) if x is not None else None for x in frame["parts"]]})

    rows = lines.select(F.col(id_col).alias("id"), F.col(parts).alias("parts"))
    return rows.mapInPandas(work, f"id {kind}, parts array<array<struct<x:double,y:double>>>").withColumnRenamed("id", id_col)
