"""Mileage statistics, street index, gazetteer search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_level(edges: DataFrame, level: str = "lts", miles: str = "miles") -> DataFrame:
    """(level, segments, miles, pct): pct of all miles; the total is one row, broadcast."""
    per = edges.groupBy(level).agg(F.count("*").alias("segments"), F.sum(miles).alias("miles"))
    total = per.agg(F.sum("miles").alias("_t"))
    return per.crossJoin(F.broadcast(total)).select(level, "segments", "miles", (F.col("miles") / F.when(F.col("_t") != 0, F.col("_t")) * 100).alias("pct"))


def layer(fac: Column, low: Column) -> Column:
    """network with a facility, else residential if of low stress, else context."""
    return F.when(fac != "none", "network").when(F.coalesce(low, F.lit(False)), "residential").otherwise("context")


def summary(edges: DataFrame, low: Column, level: str = "lts", miles: str = "miles", fac: str = "fac") -> DataFrame:
    """One row of headline sums over all but connectors."""
    rows = edges.where(F.col(fac) != "connector")
    m = F.col(miles)
    return rows.agg(
        F.sum(m).alias("total_miles"), F.sum(F.when(low, m).otherwise(0.0)).alias("low_stress_miles"), F.sum(F.when(F.col(level).between(1, 3), m).otherwise(0.0)).alias("ridable_lts3_miles"), F.count("*").alias("segments")
    )


def confidence_shares(edges: DataFrame, low: Column, cf: str = "cf", miles: str = "miles") -> DataFrame:
    """Per confidence: its share in percent of low-stress miles."""
    rows = edges.where(low)
    total = rows.agg(F.sum(miles).alias("_t"))
    return rows.groupBy(cf).agg(F.sum(miles).alias("m")).crossJoin(F.broadcast(total)).select(cf, (F.col("m") / F.col("_t") * 100).alias("pct"))


def source_shares(edges: DataFrame, src: str = "aadt_src") -> DataFrame:
    """(source, segments, pct) over all edges."""
    total = edges.agg(F.count("*").alias("_t"))
    return edges.groupBy(src).agg(F.count("*").alias("segments")).crossJoin(F.broadcast(total)).select(src, "segments", (F.col("segments") / F.col("_t") * 100).alias("pct"))


def layer_levels(edges: DataFrame, layer_col: str = "layer", level: str = "lts", miles: str = "miles") -> DataFrame:
    """(layer, features, miles, by_lts map): two small aggregates, the second over layers and levels alone."""
    per = edges.groupBy(layer_col, F.col(level).cast("string").alias("l")).agg(F.count("*").alias("n"), F.sum(miles).alias("m"))
    return per.groupBy(layer_col).agg(F.sum("n").alias("features"), F.sum("m").alias("miles"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("l", "m")))).alias("by_lts"))


def bounds(points: DataFrame) -> DataFrame:
    return points.agg(F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y"))


def street_index(edges: DataFrame, name: str = "name", level: str = "lts", miles: str = "miles") -> DataFrame:
    """(name, segments, miles, best, worst): of each named street, levels above 0."""
    ridable = F.when(F.col(level) > 0, F.col(level))
    return edges.where(F.col(name).isNotNull() & (F.col(name) != "")).groupBy(name).agg(F.count("*").alias("segments"), F.sum(miles).alias("miles"), F.min(ridable).alias("best"), F.max(ridable).alias("worst"))


def search(index: DataFrame, text: str, name: str = "name", most: int = 120) -> tuple[DataFrame, int]:
    """The first `most` names that contain text, without regard to case, and how many more there are."""
    hits = index.where(F.lower(name).contains(text.lower()))
    return hits.orderBy(name).limit(most), max(0, hits.count() - most)


def gazetteer(places: DataFrame, text: str, bbox: tuple[float, float, float, float], most: int = 5) -> DataFrame:
    """Places (name, x, y) in a box that contain the text with its white space collapsed; nothing for under three letters."""
    wanted = " ".join(text.split()).lower()
    rows = places.where(F.lit(len(wanted) >= 3) & F.lower("name").contains(wanted) & F.col("x").between(bbox[0], bbox[2]) & F.col("y").between(bbox[1], bbox[3]))
    return rows.orderBy("name", "x", "y").limit(most)
