"""Validated scans: GeoJSON, CSV, way payloads, districts, earlier outputs."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.functions import rules
from kerbline.functions.text import clean, first_text, norm_text
from kerbline.operators.impute import first_by_key, station_medians
from kerbline.operators.quality import ExpectationError, expect, expect_required, expect_unique
from kerbline.params import Params

_POINTS = "array<struct<x:double,y:double>>"


def features(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A GeoJSON file's features: the named properties as strings, matched without regard to case, and parts.

    Lines have one part, multi-lines several, polygons one for each ring. pos is the feature's place in the file.
    """
    raw = spark.read.schema("features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>").option("multiLine", True).json(path)
    rows = raw.select(F.posexplode("features").alias("pos", "f")).select("pos", "f.properties", "f.geometry")
    low = F.transform_keys("properties", lambda k, v: F.lower(k))
    at = lambda a: F.transform(a, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    line = at(F.from_json("geometry.coordinates", "array<array<double>>"))
    many = F.transform(F.from_json("geometry.coordinates", "array<array<array<double>>>"), at)
    parts = F.when(F.col("geometry.type") == "LineString", F.array(line)).when(F.col("geometry.type").isin("MultiLineString", "Polygon"), many)
    rows = rows.withColumn("_low", low)
    present = rows.select(F.explode(F.map_keys("_low")).alias("k")).distinct()
    missing = sorted(set(map(str.lower, columns)) - {r["k"] for r in present.where(F.col("k").isin([c.lower() for c in columns])).collect()})
    if missing:
        raise ExpectationError(f"missing columns: {missing}")
    return rows.select("pos", *(F.col("_low")[c.lower()].alias(c) for c in columns), parts.alias("parts"))


def number(c: Column | str) -> Column:
    """A number, or null for what isn't one, NaN included."""
    v = F.try_cast(c, "double") if hasattr(F, "try_cast") else (F.col(c) if isinstance(c, str) else c).try_cast("double")
    return F.when(~F.isnan(v), v)


def streets(spark: SparkSession, path: str, p: Params) -> DataFrame:
    """Street centrelines with repaired classes; ids are unique, classes belong to the closed set."""
    raw = features(spark, path, ["SCLINK", "RDCLASS", "SPEED", "CartoClass", "ROADNAME", "MAINTENANCE", "ONEWAY", "KYDOT"])
    cls = number("RDCLASS").cast("int")
    for wrong, right in p["rdclass.typo_fixes"].items():
        cls = F.when(cls == int(wrong), right).otherwise(cls)
    out = raw.select(
        number("SCLINK").cast("long").alias("id"), F.col("RDCLASS").alias("raw_rdclass"), F.col("CartoClass").alias("raw_cartoclass"), F.col("MAINTENANCE").alias("raw_maintenance"), "KYDOT", cls.alias("rdclass"), number("SPEED").alias("speed_mph"), number("CartoClass").cast("int").alias("cartoclass"),
        norm_text("ROADNAME").alias("name"), clean("MAINTENANCE").alias("maintenance"), (F.coalesce(F.trim("ONEWAY"), F.lit("B")) != "B").alias("directional"), "parts", F.col("pos").alias("row_pos"),
    )
    known = [int(k) for k in p["rdclass.labels"]]
    expect_unique(out, "id")
    return expect(out, "id", unknown_rdclass=~F.coalesce(F.col("rdclass").isin(known), F.lit(False)))


# Beginnings of names that stand for a status.
_STATUS_NAMES = r"(?i)^(EXISTING|EXISITNG|FUNDED)\b"


def facilities(spark: SparkSession, path: str, p: Params) -> DataFrame:
    """Bicycle facilities with type, status and corridor name repaired; one existing row at least."""
    raw = features(spark, path, ["OBJECTID", "Type_Facility", "Status", "Type_Road", "Name_Facility", "Name_Network"])
    name, status = norm_text("Name_Facility"), clean("Status")
    inferred = F.when(F.col("Name_Facility").startswith("EXISTING") | F.col("Name_Facility").startswith("EXISITNG"), p["scenario.existing_status"]).when(F.col("Name_Facility").startswith("FUNDED"), p["scenario.funded_status"])
    on_road = F.trim("Type_Road") == "On Road"
    corridor = F.when(F.coalesce(on_road & name.isNotNull() & (name != "") & ~name.rlike(_STATUS_NAMES), F.lit(False)), name).otherwise(norm_text("Name_Network"))
    out = raw.select(F.coalesce(number("OBJECTID").cast("long"), F.col("pos").cast("long")).alias("id"), rules.facility_type(F.trim("Type_Facility"), p).alias("fac"), F.col("Type_Facility").alias("type"), F.coalesce(status, inferred).alias("status"), F.coalesce(on_road, F.lit(False)).alias("on_road"), corridor.alias("name"), name.alias("facility_name"), "parts")
    out = out.withColumn("source_id", F.col("id"))
    expect(out, "id", unknown_type=F.col("fac").isNull(), unknown_status=F.col("status").isNull() | ~F.col("status").isin(p["scenario.existing_status"], p["scenario.funded_status"]))
    if out.where(F.col("status") == p["scenario.existing_status"]).isEmpty():
        raise ExpectationError("no existing facility")
    return out


def status_conflicts(df: DataFrame, p: Params) -> int:
    """Rows whose name says another status than their status column."""
    says = F.when(F.col("facility_name").rlike(r"(?i)^(EXISTING|EXISITNG)\b"), p["scenario.existing_status"]).when(F.col("facility_name").rlike(r"(?i)^FUNDED\b"), p["scenario.funded_status"])
    return df.agg(F.count(F.when(says.isNotNull() & (says != F.col("status")), 1))).first()[0]


def counts(spark: SparkSession, path: str) -> DataFrame:
    """Traffic counts as strings with their place in the file; a missing file is an empty table."""
    kind = "`Sta ID` string, Route string, AADT string, Year string"
    if "://" not in path and not Path(path).exists():
        return spark.createDataFrame([], kind + ", pos long")
    df = expect_required(spark.read.option("header", True).csv(path), ["Sta ID", "Route", "AADT", "Year"])
    return df.select("Sta ID", "Route", "AADT", "Year").withColumn("pos", F.monotonically_increasing_id())


def stations(df: DataFrame, p: Params) -> DataFrame:
    """(key, value): median count of each station key."""
    return station_medians(df.withColumn("AADT", number("AADT")), "Sta ID", "AADT", p["aadt.station_key_chars"])


def routes(df: DataFrame, p: Params) -> DataFrame:
    """(key, Route): route of each key's first counted row in the file."""
    rows = df.where(number("AADT").isNotNull()).withColumn("key", F.right(F.trim("Sta ID"), F.lit(p["aadt.station_key_chars"])))
    return first_by_key(rows, "key", "pos", "Route")


def count_years(df: DataFrame) -> DataFrame:
    y = number("Year").cast("int")
    return df.agg(F.min(y).alias("first"), F.max(y).alias("last"), F.median(y).cast("int").alias("median"))


def fetch_json(url: str, cache: str, query: str | None = None, attempts: int = 3, timeout: float = 150, use_cache: bool = True, get: Callable | None = None, sleep: Callable = time.sleep) -> str:
    """Path of a cached JSON answer; asks up to `attempts` times, waiting two seconds longer each time. Raises OSError at last."""
    path = Path(cache)
    if use_cache and path.exists():
        return str(path)

    def ask() -> bytes:
        with urllib.request.urlopen(urllib.request.Request(url, data=query.encode() if query else None), timeout=timeout) as f:
            return f.read()

    for attempt in range(1, attempts + 1):
        try:
            body = (get or ask)()
            json.loads(body)
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_bytes(body if isinstance(body, bytes) else body.encode())
            return str(path)
        except (OSError, ValueError) as e:
            fault = e
            if attempt < attempts:
                sleep(2 * attempt)
    raise OSError(f"{url}: {fault}")


def query_string(text: str) -> str:
    """A text as a quoted literal of the way query language."""
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"'


def query_polygon(ring: list[list[float]]) -> str:
    """A polygon (lon, lat) as 'lat lon lat lon ...'; three points at least."""
    if len(ring) < 3:
        raise ValueError("a polygon needs three points")
    return " ".join(f"{lat} {lon}" for lon, lat in ring)


def ways(spark: SparkSession, path: str, reviewed: list[str], campus: Column | None = None) -> DataFrame:
    """(osm_id, nodes, tags, role, label, name, parts) of a way payload; ways without two points or a role are left out."""
    kind = "elements array<struct<type:string,id:bigint,nodes:array<bigint>,tags:map<string,string>,geometry:array<struct<lon:double,lat:double>>>>"
    rows = spark.read.schema(kind).option("multiLine", True).json(path).select(F.explode("elements").alias("e")).select("e.*").where("type = 'way'")
    parts = F.array(F.transform("geometry", lambda g: F.struct(g["lon"].alias("x"), g["lat"].alias("y"))))
    rows = rows.withColumn("tags", F.coalesce("tags", F.create_map().cast("map<string,string>")))
    rows = rows.select(F.col("id").alias("osm_id"), "nodes", "tags", rules.osm_role(F.col("tags"), reviewed, campus if campus is not None else F.lit(False)).alias("role"), F.coalesce(first_text(F.col("tags")["name"], F.col("tags")["ref"]), F.lit("")).alias("name"), F.initcap(F.regexp_replace(F.coalesce(F.col("tags")["highway"], F.lit("")), "_", " ")).alias("label"), parts.alias("parts"), F.size("geometry").alias("_n"))
    return rows.where("_n >= 2 AND role IS NOT NULL").drop("_n")


def ways_as_facilities(df: DataFrame, first_id: int = 600_000_000) -> DataFrame:
    """Ways shaped as off-road facilities with ids of their own range."""
    from kerbline.operators.network import dense_ids

    out = dense_ids(df, "osm_id", out="id", start=first_id)
    return out.select("id", F.when(F.col("role").isin("path", "campus_path"), "path").otherwise("none").alias("fac"), F.lit(False).alias("on_road"), F.lit("Existing").alias("status"), "name", "role", F.col("osm_id").alias("source_id"), "parts")


def districts(spark: SparkSession, path: str | None) -> DataFrame:
    """(zone, rep, email, telephone, url, parts); empty where the source is missing, unreadable or without a DISTRICT column."""
    empty = spark.createDataFrame([], f"zone string, rep string, email string, telephone string, url string, parts array<{_POINTS}>")
    if path is None:
        return empty
    try:
        raw = features(spark, path, ["DISTRICT", "REP", "EMAIL", "TELEPHONE", "URL"])
    except Exception as e:  # an optional source: whatever is wrong with it, the build goes on
        print(f"districts are left out: {e}")
        return empty
    return raw.select(clean("DISTRICT").alias("zone"), *(clean(c).alias(c.lower()) for c in ("REP", "EMAIL", "TELEPHONE", "URL")), "parts").where("zone IS NOT NULL")


def flipped_ids(spark: SparkSession, path: str | None) -> DataFrame:
    """(id) of a JSON list; empty without a file."""
    ids = json.loads(Path(path).read_text()) if path and Path(path).exists() else []
    return spark.createDataFrame([(int(i),) for i in ids], "id long")


def golden_rows(spark: SparkSession, path: str) -> DataFrame:
    """Labelled corridors (id, name, expected_lts); an empty label is null."""
    df = expect_required(spark.read.option("header", True).csv(path), ["sclink", "road_name", "expected_lts"])
    return df.select(number("sclink").cast("long").alias("id"), F.col("road_name").alias("name"), number("expected_lts").cast("int").alias("expected_lts"))


class Registry:
    """Named tables made at first use and then kept; a driver-side catalogue of lazy frames."""

    def __init__(self, **makers: Callable[[], DataFrame]):
        self._makers, self._made = makers, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def __contains__(self, name: str) -> bool:
        return name in self._makers
