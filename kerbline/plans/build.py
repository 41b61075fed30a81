"""The build: conflate, impute, rate, node, rank, publish."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline import sinks, sources
from kerbline.functions import geo, rules
from kerbline.operators import conflate, impute, network, scenario, spatial, stats
from kerbline.operators.quality import coverage_gate, expect_unique
from kerbline.params import Params
from kerbline.storage import saved


@dataclass
class Build:
    edges: DataFrame
    nodes: DataFrame
    islands: DataFrame
    barriers: DataFrame
    funded: DataFrame


def rate(edges: DataFrame, p: Params) -> DataFrame:
    """edges with snapped speed, lanes and level of stress."""
    rows = edges.withColumn("speed_mph", rules.snap_speed("speed_mph"))
    surrogate = rules.lanes("rdclass", "directional", "cartoclass", p)
    rows = rows.withColumn("lanes", F.coalesce("lanes", surrogate) if "lanes" in rows.columns else surrogate)
    return rows.withColumn("lts", rules.lts("fac", "rdclass", "lanes", "speed_mph", "aadt", p))


def with_traffic(streets: DataFrame, stations: DataFrame, p: Params, model: DataFrame | None = None) -> DataFrame:
    """streets with aadt and aadt_src: counted by station key, modelled, or imputed."""
    at = streets.join(stations.select(F.col("key").alias("KYDOT"), F.col("value").alias("_m")), "KYDOT", "left")
    guess = None
    if model is not None:
        at = at.join(model.select("id", "predicted"), "id", "left")
        guess = F.col("predicted")
    return impute.cascade(at, "_m", p["aadt.impute_groups"], p["aadt.impute_floor"], "aadt", guess).drop("_m", "predicted")


def assemble(streets: DataFrame, paths: DataFrame, links: DataFrame, p: Params) -> DataFrame:
    """Streets, off-road pieces and connectors as one edge table; ids are unique across all three."""
    fixed = lambda df, kind, fac: df.withColumns({"kind": F.lit(kind), "fac": F.lit(fac), "rdclass": F.lit(6), "lanes": F.lit(1), "aadt_src": F.lit(rules.COARSE)})
    role = F.col("role") if "role" in paths.columns else F.lit("path")
    off = fixed(paths, "facility", "path").withColumns({"kind": F.when(role.isin("access", "reviewed_street"), "street").otherwise("facility"), "fac": F.when(role.isin("access", "reviewed_street"), "none").otherwise("path"), "fixed_lts": F.when(role == "access", p["osm.access_lts"]).when(role == "reviewed_street", p["osm.reviewed_street_lts"])})
    short = fixed(links.where(~network.collapsed("lonlat")) if "lonlat" in links.columns else links, "connector", "connector")
    base = streets.withColumns({"kind": F.lit("street")})
    rows = base.unionByName(off, allowMissingColumns=True).unionByName(short, allowMissingColumns=True)
    return expect_unique(rows, "id")


def single_parts(paths: DataFrame) -> DataFrame:
    """(id, of, name, role, parts, ends_only): each part of a path as a line of its own, with a new id; of is the path's."""
    lines = paths.select(F.col("id").alias("of"), "name", "role", F.posexplode("parts").alias("part", "line")).where(F.size("line") > 1)
    lines = network.dense_ids(lines, "of", "part", out="id")
    return lines.select("id", "of", "name", "role", F.array("line").alias("parts"), (F.col("role") == "campus_path").alias("ends_only"))


def path_cuts(paths: DataFrame, found: DataFrame, most: float) -> DataFrame:
    """(id, cuts) of single-part paths: at their attachments, at half a closed path, and so that no piece is longer than most."""
    line = F.element_at("parts", 1)
    marks = paths.select("id", spatial.line_length(F.col("parts")).alias("length"), (F.element_at(line, 1) == F.element_at(line, -1)).alias("closed"))
    at = marks.join(found.select(F.col("path").alias("id"), F.col("along").alias("at")), "id", "left").select("id", "length", "at")
    half = marks.where("closed").select("id", "length", (F.col("length") / 2).alias("at"))
    return conflate.gap_cuts(at.unionByName(half), "length", most).groupBy("id").agg(F.collect_set("at").alias("cuts"))


def build(spark: SparkSession, streets: DataFrame, facilities: DataFrame, stations: DataFrame, p: Params, ways: DataFrame | None = None, districts: DataFrame | None = None, flipped: DataFrame | None = None, check: bool = True) -> Build:
    """streets and facilities in degrees (see sources); everything between is in metres."""
    metres = lambda df: df.withColumn("parts", spatial.project(F.col("parts")))
    existing = metres(facilities.where(F.col("status") == p["scenario.existing_status"]))
    funded = metres(facilities.where(F.col("status") == p["scenario.funded_status"]))
    base = saved(with_traffic(metres(streets), stations, p), "streets")
    on_road = existing.where("on_road")
    rated = saved(conflate.on_road(base, on_road, p), "conflated")
    if check:
        recall, inflation = conflate.coverage_quality(rated, on_road, p["conflation.buffer_m"])
        coverage_gate(recall, inflation, p["conflation.min_recall"], p["conflation.max_inflation"])
    off = existing.where("NOT on_road").select("id", "name", "parts", F.lit("path").alias("role"))
    if ways is not None:
        new = conflate.overlapping(metres(ways), off, p["osm.dedupe_buffer_m"], p["osm.dedupe_max_overlap"])
        off = off.unionByName(new.select("id", "name", "parts", "role"))
    off = saved(single_parts(off), "paths")
    found = saved(conflate.attachments(off, rated, p, "ends_only"), "attachments")
    links = saved(conflate.connectors(found), "connectors")
    cut = conflate.split_at(rated, found.select(F.col("target").alias("id"), F.col("sx").alias("x"), F.col("sy").alias("y")))
    cut = saved(cut, "split")
    cuts = path_cuts(off, found, p["conflation.max_path_edge_m"])
    parts = spatial.cut_line(off.join(cuts, "id", "left").select("id", "parts", "cuts")).join(off.drop("parts", "ends_only"), "id")
    paths = network.dense_ids(parts, "id", "piece", out="_new", start=800_000_000).withColumn("id", F.col("_new")).drop("_new", "piece")
    edges = assemble(cut, paths, links, p)
    degrees = edges.withColumn("_degrees", spatial.project(F.col("parts"), inverse=True))
    whole = (F.col("kind") == "street") | ~network.collapsed("_degrees", p["meta.coord_decimals"])
    edges = network.dense_ids(degrees.where(whole).drop("row_pos", "_degrees"), "id", out="row_pos")
    edges = rate(edges.withColumn("miles", spatial.line_length(F.col("parts")) / geo.METRES_PER_MILE), p)
    edges = saved(edges.withColumn("lts", F.coalesce("fixed_lts", "lts")), "rated")
    quiet = edges.where("role = 'campus_path'").select("id", "parts")
    bike = edges.where("kind = 'street' AND fac <> 'none'").select("id", "parts")
    beside = saved(conflate.alongside(quiet, bike, p), "beside")
    edges = edges.join(beside.withColumn("campus", F.lit(True)), "id", "left").withColumn("campus", F.coalesce("campus", F.lit(False)))
    edges = edges.withColumn("parts", spatial.project(F.col("parts"), inverse=True))
    nodes, edges = network.build_graph(saved(edges, "edges"), decimals=p["meta.coord_decimals"])
    edges = saved(edges, "noded")
    low = rules.is_low_stress("lts", p)
    islands, member = network.islands(edges, low, "miles", p["network.min_cluster_segments"])
    islands, member = saved(islands, "islands"), saved(member, "members")
    barriers = network.barriers(edges, islands, member, low, "miles", p["network.barrier_min_island_segments"])
    edges = edges.join(member.withColumnRenamed("node", "u"), "u", "left").withColumn("island", F.when(low, F.col("island")))
    flip = F.lit(False)
    if flipped is not None:
        edges = edges.join(flipped.select("id").distinct().withColumn("_f", F.lit(True)), "id", "left")
        flip = F.coalesce("_f", F.lit(False))
    edges = edges.withColumns({"basis": rules.basis("fac", "aadt_src"), "cf": rules.confidence("fac", "rdclass", "aadt_src", flip, p), "layer": stats.layer(F.col("fac"), low)}).drop("_f")
    points = edges.select("id", spatial.representative(F.col("parts")).alias("q")).select("id", "q.x", "q.y")
    zones = spatial.inside(points, districts.select("zone", "parts"), 0.01) if districts is not None else points.select("id", F.lit(None).cast("string").alias("zone"))
    edges = saved(edges.join(zones, "id"), "edges")
    # streets as they were cut, so that every piece finds its funded facility
    plan = conflate.on_road(cut.drop("fac", "fac_source_ids", "coverage"), funded.where("on_road"), p)
    better = scenario.upgrades(edges, rate(plan.where("fac <> 'none'"), p).select("id", "lts"))
    return Build(edges, nodes, islands, saved(barriers, "barriers"), better)


def publish(b: Build, out: str, p: Params, version: str, enforce: bool = False) -> dict:
    """Write Parquet tables and the published JSON files; returns the statistics. Raises ValueError over budget if enforce."""
    low = rules.is_low_stress("lts", p)
    b.edges.write.mode("overwrite").partitionBy("layer").parquet(f"{out}/edges.parquet")
    files = {}
    for name in ("network", "context", "residential"):
        files[name] = f"{out}/{name}.geojson"
        sinks.write_features(b.edges.where(F.col("layer") == name), files[name], p["meta.coord_decimals"], as_lines=False)
    files["graph"] = f"{out}/graph.json"
    sinks.write_json(sinks.graph_json(b.nodes, b.edges, p["routing.campus_factor"]), files["graph"])
    sinks.write_json(sinks.rows_json(b.islands, "island"), f"{out}/islands.json")
    gaps = sinks.rows_json(b.barriers, "rank")
    if gaps:
        sinks.write_json(gaps, f"{out}/gaps.json")
    sinks.write_json({"projects": sinks.rows_json(b.funded, "id")}, f"{out}/planned.json")
    head = stats.summary(b.edges, low).first().asDict()
    major = b.islands.where("major").orderBy("island").first()
    head |= {"islands": b.islands.count(), "largest_island_miles": major["miles"] if major else 0.0}
    levels = {str(r["lts"]): {"segments": r["segments"], "miles": round(r["miles"], 1)} for r in stats.by_level(b.edges.where("fac <> 'connector'")).collect()}
    sources_ = {str(r["aadt_src"]): r["pct"] for r in stats.source_shares(b.edges).collect()}
    sinks.write_json(head | {"by_lts": levels, "aadt_sources_pct": sources_}, f"{out}/stats.json")
    sinks.write_json({"params": p.tree, "digest": p.digest()}, f"{out}/methodology.json")
    box = stats.bounds(b.nodes).first()
    sinks.write_json(sinks.manifest(files, {r["layer"]: r["count"] for r in b.edges.groupBy("layer").count().collect()}, box, version), f"{out}/manifest.json")
    over = sinks.over_budget(files, p["export.budgets_kb"])
    if over and enforce:
        raise ValueError("; ".join(over))
    return head


def from_files(spark: SparkSession, folder: str, p: Params) -> Build:
    """A build of a folder's streets.geojson, facilities.geojson, counts.csv and, if there, districts.geojson and flipped_ids.json."""
    at = lambda n: f"{folder}/{n}"
    counted = sources.stations(sources.counts(spark, at("counts.csv")), p)
    zones = sources.districts(spark, at("districts.geojson") if Path(at("districts.geojson")).exists() else None)
    return build(spark, sources.streets(spark, at("streets.geojson"), p), sources.facilities(spark, at("facilities.geojson"), p), counted, p, districts=zones, flipped=sources.flipped_ids(spark, at("flipped_ids.json")))
