"""Sinks: feature and graph JSON, statistics, manifest, size budgets. Parquet is the primary sink."""

from __future__ import annotations

import gzip
import json
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.functions import rules
from kerbline.functions.text import title_case


def feature(decimals: int = 5) -> Column:
    """A GeoJSON feature as text: short keys, whole numbers truncated; what is unknown has no key."""
    c = F.col
    whole = lambda n: F.when(~F.isnan(c(n).cast("double")), c(n).cast("double").cast("int"))
    props = F.struct(
        c("lts").cast("int").alias("lts"), rules.code("fac", rules.FACILITY_CODES).alias("fac"), rules.code("kind", rules.KIND_CODES).alias("kind"), F.round("miles", 4).alias("mi"), c("u"), c("v"), whole("speed_mph").alias("sp"), whole("aadt").alias("ad"), whole("lanes").alias("ln"),
        whole("rdclass").alias("rc"), c("basis").cast("int").alias("basis"), c("cf").cast("int").alias("cf"), c("zone").alias("cd"), F.when(c("name") != "", title_case("name")).alias("nm"), F.when(c("island") >= 0, c("island")).alias("isl"),
    )
    xy = lambda part: F.transform(part, lambda p: F.array(F.round(p["x"], decimals), F.round(p["y"], decimals)))
    one = F.to_json(F.struct(F.lit("LineString").alias("type"), xy(F.element_at("parts", 1)).alias("coordinates")))
    many = F.to_json(F.struct(F.lit("MultiLineString").alias("type"), F.transform("parts", xy).alias("coordinates")))
    shape = F.when(F.size("parts") == 1, one).otherwise(many)
    return F.concat(F.lit('{"type":"Feature","id":'), c("id").cast("string"), F.lit(',"properties":'), F.to_json(props), F.lit(',"geometry":'), shape, F.lit("}"))


def write_features(df: DataFrame, path: str, decimals: int = 5, as_lines: bool = True) -> None:
    """One feature a line, written by all tasks; as_lines=False: one FeatureCollection, for tables of a published map's size."""
    lines = df.orderBy("row_pos").select(feature(decimals).alias("value"))
    if as_lines:
        lines.write.mode("overwrite").text(path)
        return
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write('{"type":"FeatureCollection","features":[')
        for i, row in enumerate(lines.toLocalIterator()):
            f.write("," * bool(i) + row["value"])
        f.write("]}")


def write_json(value, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(value, default=str, separators=(",", ":")), encoding="utf-8")


def graph_json(nodes: DataFrame, edges: DataFrame, factor: float) -> dict:
    """Nodes in the order of their ids and edges [u, v, id, miles, lts, campus], as the router reads them."""
    n = [[r["x"], r["y"]] for r in nodes.orderBy("node_id").toLocalIterator()]
    rows = edges.where("u IS NOT NULL").orderBy("row_pos").select("u", "v", "id", F.round("miles", 6).alias("mi"), "lts", F.coalesce("campus", F.lit(False)).cast("int").alias("campus"))
    fields = ["u", "v", "id", "miles", "lts", "campus"]
    return {"nodes": n, "edges": [list(r) for r in rows.toLocalIterator()], "edge_fields": fields, "campus_parallel_bike_factor": factor}


def rows_json(df: DataFrame, *order: str) -> list[dict]:
    """A small result as dictionaries without null values, in order."""
    return [{k: v for k, v in r.asDict(True).items() if v is not None} for r in df.orderBy(*order).toLocalIterator()]


def manifest(files: dict[str, str], counts: dict[str, int], box, version: str) -> dict:
    """box: a row of stats.bounds()."""
    return {"version": version, "files": files, "counts": counts, "bbox": [box["min_x"], box["min_y"], box["max_x"], box["max_y"]], "center": [(box["min_x"] + box["max_x"]) / 2, (box["min_y"] + box["max_y"]) / 2]}


def over_budget(files: dict[str, str], budgets_kb: dict[str, float]) -> list[str]:
    """Files whose gzipped size (level 6) exceeds their budget, as messages."""
    out = []
    for name, limit in budgets_kb.items():
        if name in files and Path(files[name]).exists():
            kb = len(gzip.compress(Path(files[name]).read_bytes(), 6, mtime=0)) / 1024
            if kb > limit:
                out.append(f"{name}: {kb:.0f} KB, budget {limit:g} KB")
    return out
