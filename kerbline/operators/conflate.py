"""Attaching facilities to streets, and paths to the network."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.functions import geo, rules
from kerbline.functions.text import name_key
from kerbline.operators import spatial
from kerbline.params import Params
from kerbline.storage import saved


def _candidates(streets: DataFrame, facilities: DataFrame, radius: float, turn: float) -> DataFrame:
    """Stretches of streets within radius of a facility whose local direction agrees; an undefined one does."""
    s, f = spatial.segments(streets), spatial.segments(facilities)
    spans = saved(spatial.stretches(s, f, radius).select("id", "part", "idx", "x1", "y1", "x2", "y2", "len", "lo", "hi", F.col("r_id").alias("fid")), "spans")
    back = spatial.stretches(f, s, radius).select("id", "x1", "y1", "x2", "y2", "len", "lo", "hi", F.col("r_id").alias("sid"))
    own = spatial.local_bearing(spans, ["id", "fid"], "a")
    other = spatial.local_bearing(back, ["sid", "id"], "b").select(F.col("sid").alias("id"), F.col("id").alias("fid"), "b")
    ok = own.join(other, ["id", "fid"], "left").where(F.coalesce(geo.bearing_delta(F.col("a"), F.col("b")) <= turn, F.lit(True)))
    return spans.join(ok.select("id", "fid"), ["id", "fid"], "left_semi")


def on_road(streets: DataFrame, facilities: DataFrame, p: Params) -> DataFrame:
    """streets (id, name, rdclass, parts in metres) with fac, fac_source_ids and coverage.

    facilities (id, name, fac, source_id, parts). Facilities within the buffer and of like direction must
    cover enough of a street; failing that, those of the same name may lie in a wider buffer (never a narrower
    one), which then replaces theirs. Of the categories with a sufficient share of the covered length the most protective wins.
    """
    c = p["conflation"]
    open_ = streets.where(~F.coalesce(F.col("rdclass").isin(c["exclude_rdclass"]), F.lit(False)))
    used = facilities.where("fac <> 'none'")
    length = open_.select("id", spatial.line_length(F.col("parts")).alias("total")).where("total > 0")
    plain = saved(_candidates(open_, used, c["buffer_m"], c["max_bearing_delta"]), "standard")
    wide = _candidates(open_, used, max(c["buffer_m"], c["named_buffer_m"]), c["max_bearing_delta"])
    keys = open_.select("id", name_key("name").alias("k")).join(used.select(F.col("id").alias("fid"), name_key("name").alias("k")), "k").where("k <> ''")
    named = saved(wide.join(keys.select("id", "fid"), ["id", "fid"], "left_semi"), "named")
    enough = lambda spans: spatial.covered(spans, ["id"]).join(length, "id").where(F.col("covered") >= c["min_coverage"] * F.col("total"))
    first = saved(enough(plain), "covered")
    rest = plain.join(named.select("id", "fid").distinct(), ["id", "fid"], "left_anti").unionByName(named).join(first, "id", "left_anti")
    second = saved(enough(rest), "covered")
    spans = plain.join(first, "id", "left_semi").unionByName(rest.join(second, "id", "left_semi"))
    cover = first.unionByName(second)
    facs = used.select(F.col("id").alias("fid"), "fac", "source_id")
    each = spatial.covered(spans, ["id", "fid"]).join(facs, "fid")
    share = each.groupBy("id", "fac").agg(F.sum("covered").alias("part"), F.array_sort(F.collect_set("source_id")).alias("ids"))
    share = share.join(cover, "id").withColumn("ok", F.col("part") >= c["min_category_share"] * F.col("covered"))
    # an eligible one by rank; without any, the single largest
    order = F.struct("ok", F.when(F.col("ok"), rules.facility_rank("fac", p).cast("double")).otherwise(F.col("part")))
    best = share.groupBy("id").agg(F.max_by(F.struct("fac", "ids", (F.col("covered") / F.col("total")).alias("coverage")), order).alias("b"))
    out = streets.join(best, "id", "left")
    return out.select(*streets.columns, F.coalesce("b.fac", F.lit("none")).alias("fac"), F.coalesce("b.ids", F.array().cast("array<bigint>")).alias("fac_source_ids"), F.coalesce("b.coverage", F.lit(0.0)).alias("coverage"))


def coverage_quality(streets: DataFrame, facilities: DataFrame, radius: float) -> tuple[float, float]:
    """(recall, inflation): share of facility length near credited streets, and credited length over facility length."""
    credited = streets.where("fac <> 'none'")
    used = facilities.where("fac <> 'none'")
    total = used.agg(F.sum(spatial.line_length(F.col("parts")))).first()[0] or 0.0
    mine = credited.agg(F.sum(spatial.line_length(F.col("parts")))).first()[0] or 0.0
    near = spatial.covered(spatial.stretches(spatial.segments(used), spatial.segments(credited), radius), ["id"]).agg(F.sum("covered")).first()[0] or 0.0
    return (near / total, mine / total) if total else (0.0, float("inf"))


def overlapping(ways: DataFrame, reference: DataFrame, radius: float, most: float) -> DataFrame:
    """ways of which less than `most` of the length lies within radius of the reference: an anti-join by coverage."""
    spans = spatial.stretches(spatial.segments(ways), spatial.segments(reference), radius)
    near = spatial.covered(spans, ["id"])
    total = ways.select("id", spatial.line_length(F.col("parts")).alias("total"))
    twice = near.join(total, "id").where(F.col("covered") >= most * F.col("total")).select("id")
    return ways.join(twice, "id", "left_anti")


def alongside(paths: DataFrame, streets: DataFrame, p: Params) -> DataFrame:
    """(id) of paths that run beside a street with a bicycle facility; an undefined direction doesn't."""
    r = p["routing"]
    a, b = spatial.segments(paths), spatial.segments(streets)
    spans = saved(spatial.stretches(a, b, r["campus_bike_near_m"]).select("id", "part", "idx", "x1", "y1", "x2", "y2", "len", "lo", "hi", F.col("r_id").alias("sid")), "beside")
    back = spatial.stretches(b, a, r["campus_bike_near_m"]).select("id", "x1", "y1", "x2", "y2", "len", "lo", "hi", F.col("r_id").alias("pid"))
    own = spatial.local_bearing(spans, ["id", "sid"], "a")
    other = spatial.local_bearing(back, ["pid", "id"], "b").select(F.col("pid").alias("id"), F.col("id").alias("sid"), "b")
    share = spatial.covered(spans, ["id", "sid"]).join(paths.select("id", spatial.line_length(F.col("parts")).alias("total")), "id")
    ok = share.join(own.join(other, ["id", "sid"]), ["id", "sid"]).where((F.col("covered") >= r["campus_bike_min_share"] * F.col("total")) & (geo.bearing_delta(F.col("a"), F.col("b")) <= r["campus_bike_parallel_degrees"]))
    return ok.select("id").distinct()


def thin_attachments(found: pd.DataFrame, length: float, max_m: float, merge_m: float, spacing_m: float) -> pd.DataFrame:
    """Attachments of one path part, thinned in order along it.

    found: (target, gap, along, end, x, y, sx, sy), end: whether the vertex ends the part. The best of a
    target counts its gap, less max_m at an end. Neighbours whose both points coincide with the last kept
    one's are merged; each end keeps its smallest gap only; others stand spacing_m apart.
    """
    if found.empty:
        return found
    found = found.assign(score=found["gap"] - max_m * found["end"]).sort_values(["target", "score", "along"], kind="stable").drop_duplicates("target").sort_values(["along", "target"], kind="stable")
    kept: list = []
    for row in found.itertuples():
        if kept and np.hypot(row.x - kept[-1].x, row.y - kept[-1].y) <= merge_m and np.hypot(row.sx - kept[-1].sx, row.sy - kept[-1].sy) <= merge_m:
            continue
        kept.append(row)
    best = {}
    for row in kept:
        if row.end:
            side = row.along > length / 2
            best[side] = row if side not in best or row.gap < best[side].gap else best[side]
    chosen, last = [], None
    for row in kept:
        if row.end:
            if row not in best.values():
                continue
        elif last is not None and row.along - last < spacing_m:
            continue
        chosen.append(row.Index)
        last = row.along
    return found.loc[chosen]


def attachments(paths: DataFrame, streets: DataFrame, p: Params, ends_only: str | None = None) -> DataFrame:
    """(path, target, gap, along, x, y, sx, sy): where path vertices attach to streets in reach.

    paths, streets: (id, parts in metres); ends_only names a boolean column of paths whose true rows attach
    by their ends alone. Candidates come from a grid join; a path part's own few are thinned together.
    """
    c = p["conflation"]
    most = c["connector_max_m"]
    seg = spatial.segments(streets.where(~F.coalesce(F.col("rdclass").isin(c["exclude_rdclass"]), F.lit(False))) if "rdclass" in streets.columns else streets)
    only = F.col(ends_only) if ends_only else F.lit(False)
    v = paths.select(F.col("id").alias("path"), only.alias("only"), F.posexplode("parts").alias("part", "p")).where(F.size("p") > 1)
    start = F.struct(F.lit(0.0).alias("d"), F.element_at("p", 1).alias("q"), F.array().cast("array<double>").alias("o"))
    walked = F.aggregate("p", start, lambda a, q: F.struct((a["d"] + geo.distance(a["q"]["x"], a["q"]["y"], q["x"], q["y"])).alias("d"), q.alias("q"), F.concat(a["o"], F.array(a["d"] + geo.distance(a["q"]["x"], a["q"]["y"], q["x"], q["y"]))).alias("o")))["o"]
    v = v.select("path", "only", "part", F.size("p").alias("n"), F.posexplode(F.arrays_zip("p", walked.alias("d"))).alias("k", "z"), F.element_at(walked, -1).alias("length"))
    v = v.select("path", "part", "only", "length", F.col("z.d").alias("along"), ((F.col("k") == 0) | (F.col("k") == F.col("n") - 1)).alias("end"), F.col("z.p.x").alias("x"), F.col("z.p.y").alias("y")).where(F.col("end") | ~F.col("only"))
    own = v.select("*", F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    pairs = spatial.near_segments(own, seg, most)
    args = [F.col(n) for n in ("x", "y", "r_x1", "r_y1", "r_x2", "r_y2")]
    pairs = pairs.withColumns({"gap": geo.point_distance(*args), "t": geo.along(*args)}).where(F.col("gap") <= most)
    pairs = pairs.select("path", "part", "length", F.col("r_id").alias("target"), "gap", "along", "end", "x", "y", (F.col("r_x1") + F.col("t") * (F.col("r_x2") - F.col("r_x1"))).alias("sx"), (F.col("r_y1") + F.col("t") * (F.col("r_y2") - F.col("r_y1"))).alias("sy"))
    schema = "path {0}, part int, length double, target {1}, gap double, along double, end boolean, x double, y double, sx double, sy double".format(paths.schema["id"].dataType.simpleString(), streets.schema["id"].dataType.simpleString())

    def thin(frame):
        return thin_attachments(frame, float(frame["length"].iloc[0]), most, c["attach_merge_m"], c["attach_spacing_m"])[[x.split()[0] for x in schema.split(", ")]]

    return pairs.groupBy("path", "part").applyInPandas(thin, schema)


def connectors(found: DataFrame, first_id: int = 900_000_000) -> DataFrame:
    """Two-point connectors of the attachments that leave a gap, one for each unordered pair of ends (to the millimetre)."""
    from kerbline.operators.network import dedupe_pairs, dense_ids

    rows = dense_ids(found.where("gap >= 1e-9"), "path", "along", "target", out="seq")
    a, b = F.struct("x", "y"), F.struct(F.col("sx").alias("x"), F.col("sy").alias("y"))
    kept = dedupe_pairs(rows, a, b, "seq")
    out = dense_ids(kept, "seq", out="id", start=first_id)
    return out.select("id", "path", F.col("target").alias("split_street_id"), F.array(F.array(a, b)).alias("parts"), "gap")


def gap_cuts(cuts: DataFrame, length: str, most: float, by: str = "id", at: str = "at") -> DataFrame:
    """(by, at): the cuts and equal ones between them, so that no piece is longer than most."""
    from pyspark.sql import Window

    marks = cuts.select(by, length, at).unionByName(cuts.select(by, length, F.lit(0.0).alias(at)).distinct()).unionByName(cuts.select(by, length, F.col(length).alias(at)).distinct()).where(F.col(at).isNotNull()).distinct()
    gap = F.lead(at).over(Window.partitionBy(by).orderBy(at)) - F.col(at)
    rows = marks.withColumn("gap", gap).withColumn("n", F.floor(F.col("gap") / most)).where("gap IS NOT NULL")
    n = F.coalesce(F.col("n"), F.lit(0))
    return rows.select(by, length, F.explode(F.sequence(F.lit(0), n.cast("int"))).alias("k"), at, "gap", "n").select(by, (F.col(at) + F.col("gap") * F.col("k") / (F.col("n") + 1)).alias(at), length).where((F.col(at) > 0) & (F.col(at) < F.col(length))).select(by, at).distinct()


def split_at(streets: DataFrame, points: DataFrame, first_id: int = 700_000_000) -> DataFrame:
    """streets cut where connectors meet them: points (id, x, y). The first piece keeps its id, later ones get new ids."""
    from kerbline.operators.network import dense_ids

    seg = spatial.segments(streets.join(points.select("id").distinct(), "id", "left_semi"))
    near = points.select(F.col("id").alias("sid"), "x", "y").join(seg, F.col("sid") == seg["id"])
    args = [F.col(n) for n in ("x", "y", "x1", "y1", "x2", "y2")]
    near = near.withColumns({"gap": geo.point_distance(*args), "at": F.col("at") + geo.along(*args) * F.col("len")})
    cuts = near.groupBy("sid", "x", "y").agg(F.min_by("at", "gap").alias("at")).groupBy("sid").agg(F.collect_set("at").alias("cuts"))
    hit = streets.join(cuts, streets["id"] == cuts["sid"])
    pieces = spatial.cut_line(hit.where(F.size("parts") == 1).select("id", "parts", "cuts"))
    rows = pieces.join(streets.drop("parts"), "id").select(*streets.columns, "piece")
    head = rows.where("piece = 0").drop("piece")
    tail = dense_ids(rows.where("piece > 0"), "id", "piece", out="_new", start=first_id).withColumn("id", F.col("_new")).drop("_new", "piece")
    rest = streets.join(pieces.select("id").distinct(), "id", "left_anti")
    return rest.select(streets.columns).unionByName(head.select(streets.columns)).unionByName(tail.select(streets.columns))
