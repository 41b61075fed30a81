"""The traffic-stress rule tables as column expressions, built from parameters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from kerbline.functions.text import col
from kerbline.params import Params

# Posted speeds, codes of facilities and kinds, route penalties by level.
POSTED = (10, 15, 20, 25, 30, 35, 40, 45, 50, 55, 70)
FACILITY_CODES = {"none": 0, "sharrow": 1, "shoulder": 2, "lane": 3, "buffered": 4, "protected": 5, "path": 6, "connector": 7}
KIND_CODES = {"street": 0, "facility": 1, "connector": 2}
STATION, NARROW, COARSE, MODEL = 0, 1, 2, 3
PENALTIES = {
    "direct": {1: 1.0, 2: 1.0, 3: 1.15, 4: 1.4},
    "balanced": {1: 1.0, 2: 1.05, 3: 1.4, 4: 3.5},
    "quiet": {1: 1.0, 2: 1.05, 3: 2.6, 4: 6.0},
    "only": {1: 1.0, 2: 1.0},
    "shortest": {1: 1.0, 2: 1.0, 3: 1.0, 4: 1.0},
}


def known(c: Column) -> Column:
    """NaN as null."""
    return F.when(~F.isnan(c.cast("double")), c)


def snap_speed(speed: Column | str) -> Column:
    """The nearest posted speed, the lower one on ties; zero, negative and unknown speeds are null."""
    s = known(col(speed)).cast("double")
    nearest = F.array_min(F.array(*(F.struct(F.abs(s - v).alias("d"), F.lit(v).alias("v")) for v in POSTED)))
    return F.when(s > 0, nearest["v"])


def lanes(rdclass: Column | str, directional: Column | str, cartoclass: Column | str, p: Params) -> Column:
    """Through lanes by the first rule that fits."""
    out = F.lit(int(p["lanes.default"]))
    for rule in reversed(p["lanes.rules"]):
        fits = col(rdclass).isin(rule["rdclass"]) & (F.coalesce(col(directional), F.lit(False)) == rule["directional"])
        if "cartoclass" in rule:
            fits &= F.coalesce(col(cartoclass).isin(rule["cartoclass"]), F.lit(False))
        out = F.when(fits, rule["lanes"]).otherwise(out)
    return out


def mixed(lane: Column, speed: Column, aadt: Column, p: Params) -> Column:
    """Stress of riding in mixed traffic."""
    t, low, mid = p["lts.mixed"], p["lts.aadt_break_low"], p["lts.aadt_break_mid"]
    return (
        F.when(lane >= 6, t["wide"])
        .when(lane >= 4, F.when(speed <= 30, t["multi_30"]).otherwise(t["multi"]))
        .when(speed <= 25, F.when((aadt <= low) & (lane <= 2), t["25_quiet"]).when(aadt <= mid, t["25_mid"]).otherwise(t["25_busy"]))
        .when(speed <= 30, F.when(aadt <= mid, t["30_mid"]).otherwise(t["30_busy"]))
        .when(speed <= 35, t["35"])
        .otherwise(t["40"])
    )


def lts(fac: Column | str, rdclass: Column | str, lane: Column | str, speed: Column | str, aadt: Column | str, p: Params) -> Column:
    """Level of traffic stress, 0 to 4. Unknown speed and volume take their defaults; an unknown facility is null.

    0 where bicycles are prohibited; fixed off the street; a facility never rates worse than mixed traffic.
    """
    f, n = col(fac), col(lane)
    s = F.coalesce(known(col(speed)), F.lit(p["lts.speed_default"]))
    a = F.coalesce(known(col(aadt)), F.lit(p["lts.aadt_break_mid"]))
    plain = mixed(n, s, a, p)
    b, ln, sh = p["lts.buffered"], p["lts.lane"], p["lts.shoulder"]
    buffered = F.when((s <= 30) & (n <= b["narrow_lanes"]), b["30_narrow"]).when(s <= 35, b["35"]).otherwise(b["else"])
    lane_ = F.when(s <= 30, ln["30"]).when(s <= 35, ln["35"]).otherwise(ln["else"])
    lane_ = F.least(F.lit(4), lane_ + F.when(n >= ln["multi_lanes"], ln["penalty"]).otherwise(0))
    shoulder = F.when(s <= 35, sh["35"]).otherwise(sh["else"])
    out = F.when(F.coalesce(col(rdclass).isin(p["rdclass.prohibited"]), F.lit(False)), 0)
    for name, level in p["lts.fixed"].items():
        out = out.when(f == name, level)
    out = out.when(f.isin("none", "sharrow"), plain)
    for name, table in (("buffered", buffered), ("lane", lane_), ("shoulder", shoulder)):
        out = out.when(f == name, F.least(table, plain))
    return out.cast("int")


def is_low_stress(level: Column | str, p: Params) -> Column:
    return col(level).between(1, p["lts.low_stress_max"])


def code(c: Column | str, codes: dict[str, int]) -> Column:
    return F.create_map(*(F.lit(x) for kv in codes.items() for x in kv))[col(c)]


def facility_rank(fac: Column | str, p: Params) -> Column:
    return code(fac, p["facility.rank"])


def facility_type(kind: Column | str, p: Params) -> Column:
    """Facility of a source's type; null if the type is unknown."""
    return code(kind, p["facility.type_map"])


def strongest(facs: Column | str, p: Params) -> Column:
    """The most protective facility of an array; none for an empty one, null if one isn't ranked."""
    a = col(facs)
    ranked = F.transform(a, lambda f: F.struct(facility_rank(f, p).alias("r"), f.alias("f")))
    bad = F.exists(ranked, lambda x: x["r"].isNull())
    return F.when(F.size(a) == 0, "none").when(~bad, F.array_max(ranked)["f"])


def off_stream(fac: Column | str) -> Column:
    return col(fac).isin("path", "protected", "connector")


def basis(fac: Column | str, src: Column | str) -> Column:
    """0 the facility decides, 2 the volume was counted, 1 otherwise."""
    return F.when(off_stream(fac), 0).when(F.coalesce(col(src), F.lit(COARSE)) == STATION, 2).otherwise(1)


def confidence(fac: Column | str, rdclass: Column | str, src: Column | str, flipped: Column | None, p: Params) -> Column:
    """0 low, 1 medium, 2 high; low wherever a sensitivity variant changes the rating."""
    s = F.coalesce(col(src), F.lit(COARSE))
    local = F.coalesce(col(rdclass) == 6, F.lit(False))
    out = F.when(off_stream(fac) | ((s == STATION) & ((col(fac) != "none") | local)), 2).when(s.isin(NARROW, MODEL), 1).otherwise(0)
    if flipped is not None and p["confidence.sensitivity_flip_forces_low"]:
        out = F.when(flipped, 0).otherwise(out)
    return out


def osm_role(tags: Column, reviewed: list[str], campus: Column) -> Column:
    """reviewed_street, path, campus_path, access or null, from a way's tags (a map)."""
    tag = lambda k: F.coalesce(tags[k], F.lit(""))
    name, highway, bicycle = F.trim(tag("name")), tag("highway"), tag("bicycle")
    open_, aisle = ~tag("access").isin("private", "no"), tag("service") == "parking_aisle"
    usable = (highway == "service") & bicycle.isin("yes", "designated", "permissive") & ~F.lower(name).contains("parking")
    return (
        F.when(name.isin(reviewed) & highway.isin("residential", "unclassified", "service") & open_ & ~aisle if reviewed else F.lit(False), "reviewed_street")
        .when((highway == "cycleway") | (highway.isin("path", "footway") & (bicycle == "designated")), "path")
        .when(campus & highway.isin("path", "footway", "pedestrian") & (bicycle != "no") & open_, "campus_path")
        .when(usable & ~aisle & open_ & ~tag("oneway").isin("yes", "1", "-1"), "access")
    )


def penalty(level: Column | str, mode: str) -> Column:
    """Detour multiplier of a level; null where the mode refuses it."""
    return reduce(lambda c, kv: F.when(col(level) == kv[0], float(kv[1])).otherwise(c), PENALTIES[mode].items(), F.lit(None).cast("double"))


def preset(slider: Column | str) -> Column:
    return F.when(col(slider) < 34, "quiet").when(col(slider) < 70, "balanced").otherwise("shortest")
