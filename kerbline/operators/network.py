"""The street graph: noded edges, islands of low stress, and the barriers between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.operators.components import components
from kerbline.storage import saved

POINT = "struct<x:double,y:double>"


def dense_ids(df: DataFrame, *order: str | Column, out: str = "rank", start: int = 0) -> DataFrame:
    """df with consecutive numbers in a global order: sizes of sorted parts are summed, then rows numbered within parts.

    The sorted rows are stored with their part, which two plans, or a stage's second run, might number otherwise.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    rows = saved(rows, "sorted")
    rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy("_p").orderBy("_i")))
    sizes = rows.groupBy("_p").agg(F.count("*").alias("_n"))
    # a row for each partition
    base = sizes.withColumn("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows.join(F.broadcast(base.select("_p", "_b")), "_p").withColumn(out, F.col("_b") + F.col("_k") - 1 + start).drop("_p", "_i", "_k", "_b")


def ends(geom: Column, decimals: int = 5) -> tuple[Column, Column]:
    """Rounded end points of a part: the identity of graph nodes."""
    at = lambda p: F.struct(F.round(p["x"], decimals).alias("x"), F.round(p["y"], decimals).alias("y"))
    return at(F.element_at(geom, 1)), at(F.element_at(geom, -1))


def build_graph(edges: DataFrame, parts: str = "parts", order: str = "row_pos", decimals: int = 5) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): nodes (node_id, x, y) numbered by first appearance, edges with u and v.

    Multipart, short and closed edges have null u and v: they cannot be routed.
    """
    one = F.when((F.size(parts) == 1) & (F.size(F.element_at(parts, 1)) >= 2), F.element_at(parts, 1))
    a, b = ends(one, decimals)
    rows = edges.withColumns({"_a": F.when(one.isNotNull(), a), "_b": F.when(one.isNotNull(), b)})
    usable = F.coalesce(F.col("_a") != F.col("_b"), F.lit(False))
    seen = rows.where(usable).select(F.explode(F.array(F.struct(F.col(order).alias("r"), F.lit(0).alias("s"), F.col("_a").alias("p")), F.struct(F.col(order).alias("r"), F.lit(1).alias("s"), F.col("_b").alias("p")))).alias("e"))
    first = seen.groupBy(F.col("e.p").alias("p")).agg(F.min(F.struct("e.r", "e.s")).alias("first"))
    nodes = dense_ids(first, "first", out="node_id")
    as_ = lambda n, p: nodes.select(F.col("node_id").alias(n), F.col("p").alias(p))
    out = rows.withColumns({"_a": F.when(usable, F.col("_a")), "_b": F.when(usable, F.col("_b"))})
    out = out.join(as_("u", "_a"), "_a", "left").join(as_("v", "_b"), "_b", "left").drop("_a", "_b")
    return nodes.select("node_id", F.col("p.x").alias("x"), F.col("p.y").alias("y")), out


def surviving(edges: DataFrame, order: str = "row_pos") -> DataFrame:
    """The simple graph: of edges between the same two nodes the last one stands."""
    ok = edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    keys = [F.least("u", "v").alias("_lo"), F.greatest("u", "v").alias("_hi")]
    last = ok.groupBy(*keys).agg(F.max(order).alias(order)).select(order)
    return ok.join(last, order, "left_semi")


def islands(edges: DataFrame, low: Column, length: str, least: int = 3, order: str = "row_pos", parallel: str = "last") -> tuple[DataFrame, DataFrame]:
    """(islands, membership): components of the low-stress edges, numbered by miles, then segments, then first edge.

    islands: (island, segments, miles, major); membership: (node, island). parallel 'last': parallel edges
    overwrite each other and take their length with them; 'all': every edge counts.
    """
    simple = surviving(edges, order) if parallel == "last" else edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    kept = simple.where(low)
    comp = components(kept, "u", "v")
    per = kept.join(comp, kept["u"] == comp["id"]).groupBy("component").agg(F.sum(length).alias("miles"), F.count("*").alias("segments"), F.min(order).alias("first"))
    ranked = dense_ids(per.withColumns({"_m": -F.col("miles"), "_s": -F.col("segments")}), "_m", "_s", "first", out="island")
    found = ranked.select("island", "segments", "miles", (F.col("segments") >= least).alias("major"))
    member = comp.join(ranked.select("component", "island"), "component").select(F.col("id").alias("node"), "island")
    return found, member


def barriers(edges: DataFrame, found: DataFrame, member: DataFrame, low: Column, length: str, least: int = 3, name: str = "name", level: str = "lts", order: str = "row_pos", prohibited: bool = True) -> DataFrame:
    """Crossings that would join two islands, ranked by the smaller island's miles for each mile of crossing.

    Candidates are routable edges that aren't of low stress, between different islands of `least` segments
    or more; they are dissolved by name and pair of islands. prohibited: whether level 0 counts, too.
    """
    big = found.where(F.col("segments") >= least).select("island", F.round("miles", 3).alias("miles"))
    side = member.join(big, "island")
    a = side.select(F.col("node").alias("u"), F.col("island").alias("ia"), F.col("miles").alias("ma"))
    b = side.select(F.col("node").alias("v"), F.col("island").alias("ib"), F.col("miles").alias("mb"))
    rows = edges.where(~F.coalesce(low, F.lit(False)) & F.col("u").isNotNull() & F.col("v").isNotNull())
    rows = rows if prohibited else rows.where(F.col(level) > 0)
    met = rows.join(a, "u").join(b, "v").where("ia <> ib")
    first = F.col("ia") < F.col("ib")
    met = met.select(
        F.col(name).alias("name"), F.least("ia", "ib").alias("island_a"), F.greatest("ia", "ib").alias("island_b"), F.when(first, F.col("ma")).otherwise(F.col("mb")).alias("island_a_miles"),
        F.when(first, F.col("mb")).otherwise(F.col("ma")).alias("island_b_miles"), F.col(length).alias("_len"), F.col(level).alias("_lvl"), F.col("id"), F.col(order).alias("_ord"),
    )
    out = met.groupBy("name", "island_a", "island_b", "island_a_miles", "island_b_miles").agg(
        F.sum("_len").alias("crossing_miles"), F.max("_lvl").alias("current_lts"), F.array_sort(F.collect_list("id")).alias("segment_ids"), F.min("_ord").alias("first_row")
    )
    unlocked = F.least("island_a_miles", "island_b_miles")
    out = out.withColumns({"miles_unlocked": unlocked, "score": F.round(unlocked / F.greatest("crossing_miles", F.lit(0.02)), 2)})
    out = dense_ids(out.withColumns({"_s": -F.col("score"), "_n": F.col("name").isNull()}), "_s", "_n", "name", "island_a", "island_b", out="rank", start=1).drop("_s", "_n")
    pair = out.groupBy("island_a", "island_b").agg(F.min("rank").alias("best"), (F.count("*") - 1).alias("alternatives"))
    out = out.join(pair, ["island_a", "island_b"])
    return out.withColumn("best_for_pair", F.col("rank") == F.col("best")).drop("best")


def collapsed(parts: str = "parts", decimals: int = 5) -> Column:
    """Whether a single-part line's rounded ends are one point."""
    a, b = ends(F.element_at(parts, 1), decimals)
    return F.coalesce((F.size(parts) == 1) & (a == b), F.lit(False))


def dedupe_pairs(df: DataFrame, a: Column, b: Column, order: str, decimals: int = 3) -> DataFrame:
    """The first row, by order, of each unordered pair of rounded end points (structs x, y)."""
    at = lambda p: F.struct(F.round(p["x"], decimals).alias("x"), F.round(p["y"], decimals).alias("y"))
    rows = df.withColumns({"_lo": F.least(at(a), at(b)), "_hi": F.greatest(at(a), at(b))})
    first = rows.groupBy("_lo", "_hi").agg(F.min(order).alias(order)).select(order)
    return df.join(first, order, "left_semi")
