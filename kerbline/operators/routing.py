"""Stress-weighted shortest paths, reachability and route summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.functions import rules
from kerbline.storage import saved


def edge_cost(mode: str, miles: str = "miles", level: str = "lts", campus: str | None = None, factor: float = 1.5) -> Column:
    """Cost of an edge in a mode; null where it can't be ridden. The campus factor doesn't hold for shortest."""
    cost = F.col(miles) * rules.penalty(level, mode)
    if campus and mode != "shortest":
        cost = cost * F.when(F.coalesce(F.col(campus), F.lit(False)), factor).otherwise(1.0)
    return cost


def distances(edges: DataFrame, sources: DataFrame, cost: Column, most: float | None = None) -> DataFrame:
    """(source, node, cost, via): least cost from each source to each node, and the edge before it.

    sources: (source, node, start) with the cost already spent. Frontier relaxation: a round joins the
    nodes improved in the round before with the edges, so work follows the frontier; it ends when no
    node improves. most bounds the costs reported.
    """
    e = edges.where("u IS NOT NULL AND v IS NOT NULL").select("id", "u", "v", cost.alias("c")).where("c IS NOT NULL")
    both = saved(e.union(e.select("id", F.col("v"), F.col("u"), "c")).toDF("id", "u", "v", "c"), "arcs")
    state = saved(sources.groupBy("source", "node").agg(F.min("start").cast("double").alias("cost")).withColumn("via", F.lit(None).cast(e.schema["id"].dataType)).withColumn("new", F.lit(True)), "route")
    while True:
        step = state.where("new").join(both, state["node"] == both["u"]).select("source", F.col("v").alias("node"), (F.col("cost") + F.col("c")).alias("cost"), F.col("id").alias("via"))
        if most is not None:
            step = step.where(F.col("cost") <= most)
        all_ = state.select("source", "node", "cost", "via", F.lit(True).alias("old")).unionByName(step.withColumn("old", F.lit(False)))
        best = all_.groupBy("source", "node").agg(F.min(F.struct("cost", ~F.col("old"), "via", "old")).alias("b"))
        state = saved(best.select("source", "node", "b.cost", "b.via", (~F.col("b.old")).alias("new")), "route")
        if state.where("new").isEmpty():
            return state.drop("new")


def path_edges(state: DataFrame, edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target, step, id): edges of the routes to targets (source, node), step counting back from the target."""
    e = edges.select("id", "u", "v")
    at = targets.select("source", F.col("node").alias("target"), "node")
    out, step = None, 0
    prior = state.select("source", "node", "via")
    while True:
        hop = saved(at.join(prior, ["source", "node"]).where("via IS NOT NULL").join(e, F.col("via") == e["id"]).select("source", "target", F.lit(step).alias("step"), "id", F.when(F.col("node") == F.col("u"), F.col("v")).otherwise(F.col("u")).alias("node")), "hop")
        out = hop.drop("node") if out is None else out.unionByName(hop.drop("node"))
        if hop.isEmpty():
            return out
        at, step = hop.select("source", "target", "node"), step + 1


def snapped_route(edges: DataFrame, trips: DataFrame, mode: str, campus: str | None = None) -> DataFrame:
    """(trip, cost) between points on edges: trips (trip, edge_a, frac_a, edge_b, frac_b), fractions from u.

    The cheapest of the four pairings of ends; on one edge the stretch between both points; null where
    there is no way.
    """
    cost = edge_cost(mode, campus=campus)
    e = edges.select("id", "u", "v", "miles", cost.alias("c"))
    side = lambda s: e.select(*(F.col(x).alias(f"{x}_{s}") for x in ("id", "u", "v", "c", "miles")))
    t = trips.join(side("a"), F.col("edge_a") == F.col("id_a")).join(side("b"), F.col("edge_b") == F.col("id_b"))
    same = t.where("edge_a = edge_b").select("trip", F.when(F.col("c_a").isNotNull(), F.abs(F.col("frac_a") - F.col("frac_b")) * F.col("miles_a")).alias("cost"))
    two = saved(t.where("edge_a <> edge_b AND c_a IS NOT NULL AND c_b IS NOT NULL"), "trips")
    starts = two.select(F.col("trip").alias("source"), F.explode(F.array(F.struct(F.col("u_a").alias("node"), (F.col("frac_a") * F.col("c_a")).alias("start")), F.struct(F.col("v_a").alias("node"), ((1 - F.col("frac_a")) * F.col("c_a")).alias("start")))).alias("s")).select("source", "s.node", "s.start")
    state = distances(edges, starts, cost)
    goals = two.select(F.col("trip").alias("source"), F.explode(F.array(F.struct(F.col("u_b").alias("node"), (F.col("frac_b") * F.col("c_b")).alias("rest")), F.struct(F.col("v_b").alias("node"), ((1 - F.col("frac_b")) * F.col("c_b")).alias("rest")))).alias("s")).select("source", "s.node", "s.rest")
    found = state.join(goals, ["source", "node"]).groupBy(F.col("source").alias("trip")).agg(F.min(F.col("cost") + F.col("rest")).alias("cost"))
    return trips.select("trip").join(found.unionByName(same), "trip", "left")


def candidates(edges: DataFrame, trips: DataFrame, modes: tuple[str, ...] = ("quiet", "balanced", "shortest")) -> DataFrame:
    """(trip, mode, cost): the routes of several modes side by side."""
    out = [snapped_route(edges, trips, m).withColumn("mode", F.lit(m)) for m in modes]
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    return out[0]


def extra_minutes(routes: DataFrame) -> DataFrame:
    """routes (trip, mode, miles) with minutes and those beyond the trip's fastest."""
    minutes = F.greatest(F.lit(1), F.floor(F.col("miles") / 10 * 60 + 0.5)).cast("long")
    return routes.withColumn("minutes", minutes).withColumn("extra_minutes", F.col("minutes") - F.min("minutes").over(Window.partitionBy("trip")))


def route_totals(path: DataFrame, by: list[str], miles: str = "miles", level: str = "lts") -> DataFrame:
    """Miles, miles above level 2 and at level 4, and the worst level."""
    m, n = F.col(miles), F.col(level)
    return path.groupBy(*by).agg(F.sum(m).alias("miles"), F.sum(F.when(n > 2, m).otherwise(0.0)).alias("stress_miles"), F.sum(F.when(n == 4, m).otherwise(0.0)).alias("severe_miles"), F.max(n).alias("worst_lts"))


def legs(path: DataFrame, by: list[str], order: list[str], same: list[str], miles: str = "miles") -> DataFrame:
    """Adjacent edges with equal values of `same` as one leg, numbered from 0 (gaps and islands)."""
    w = Window.partitionBy(*by).orderBy(*order)
    key = F.struct(*same)
    changed = (~F.lag(key).over(w).eqNullSafe(key)).cast("int")
    rows = path.withColumn("_c", F.when(F.row_number().over(w) == 1, 0).otherwise(changed)).withColumn("leg", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*by, "leg", *same).agg(F.sum(miles).alias("miles"), F.count("*").alias("edges"))
