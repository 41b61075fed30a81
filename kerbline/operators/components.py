"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.storage import discard, release, saved


def _to_minimum(directed: DataFrame) -> DataFrame:
    """(u, v, m) of each edge, m the least of u and its neighbours: a pre-aggregated minimum and a join."""
    least = directed.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return directed.join(least, "u")


def components(links: DataFrame, a: str = "u", b: str = "v") -> DataFrame:
    """(id, component): the least id reachable, for every id in some link.

    Large-star and small-star steps (Kiveris et al. 2014) on an edge table in shared storage; no neighbour list is
    gathered in a task, and a round's table goes once the next is written. Self links and nulls are ignored,
    repeated links count once; no links give an empty table.
    """
    pairs = links.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    edges, state = saved(pairs.where("u <> v").distinct(), "cc"), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_minimum(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        star = _to_minimum(large)
        small = star.select(F.col("v").alias("u"), F.col("m").alias("v")).union(star.select("u", F.col("m").alias("v")))
        after = saved(small.where("u <> v").distinct(), "cc")
        discard(edges)
        edges = after
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    release(links.sparkSession, native=False)
    found = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return found.union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def components_below(edges: DataFrame, level: str, most: int, a: str = "u", b: str = "v") -> DataFrame:
    """Components of the edges whose level is from 1 to most."""
    return components(edges.where(F.col(level).between(1, most)), a, b)


def expand(ways: DataFrame, seeds: DataFrame, id_col: str = "id", nodes_col: str = "nodes") -> DataFrame:
    """(id) of all ways that share a node with a seed, directly or through other ways; seeds (id) included."""
    at = ways.select(F.col(id_col).alias("id"), F.explode(nodes_col).alias("node"))
    near = at.groupBy("node").agg(F.min("id").alias("hub")).join(at, "node").select(F.col("hub").alias("u"), F.col("id").alias("v"))
    comp = components(near)
    wanted = comp.join(seeds.select(F.col(id_col).alias("id")), "id", "left_semi").select("component").distinct()
    grown = comp.join(wanted, "component", "left_semi").select("id")
    return grown.union(seeds.select(F.col(id_col).alias("id"))).distinct()
