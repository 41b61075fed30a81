"""Linking the members of buckets without listing all pairs of a bucket.

Rows (bucket, node, size, rank, pos) say that nodes of a bucket may be similar. Each bucket's members first meet
its pivot alone, the member of least rank, of those the largest. What is linked then shares a component, and only
members whose component differs from the pivot's meet the rest of the bucket. So a bucket of m copies costs m
comparisons, and no pair of nodes in different components that share a bucket is left out.

A node may stand for a group whose members have the same size and the same rows: pairs of groups are filtered
first, and only then expanded to their members.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.llm.common import broadcast_if_small, saved
from kerbline.operators.components import components

#: Words of 64 bits of the maps that bound what two sets share before the sets meet.
WORDS = 8


def shared_cores(sets: DataFrame, open_: DataFrame) -> DataFrame:
    """(node, core) of the open nodes (node, component), core struct<all, map>; sets: (id, s array<long>) of them.

    A core is what a node's set shares with nodes of other components: its size, and a bit map of its
    hashes. Nodes that share nothing are left out, for they have no link to find.
    """
    have = saved(sets.join(open_, F.col("id") == F.col("node")).select("node", "component", F.explode("s").alias("token")), "tokens")
    across = have.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col("token"), F.lit(64)).cast("int"))
    word = F.pmod(F.shiftright("token", 6), F.lit(WORDS))
    maps = F.struct(*(F.bit_or(F.when(word == k, bit).otherwise(F.lit(0).cast("long"))).alias(f"w{k}") for k in range(WORDS)))
    cores = have.join(across, "token", "left_semi").groupBy("node")
    return cores.agg(F.struct(F.count("*").alias("all"), maps.alias("map")).alias("core"))


def may_reach(percent: int) -> Callable[[str, str], Column]:
    """The condition of link() for a Jaccard similarity of percent / 100, over columns of two prefixes.

    By sizes; by the places (from 0) of the bucket's element in both sets, which share no more than the
    lesser place before it and the lesser rest behind it; and by shared_cores() once they are known.
    """

    def most(x: Column, y: Column) -> Column:
        # each bit of a core that the other map lacks is one element less
        return x["all"] - sum((F.bit_count(x["map"][f"w{k}"].bitwiseAND(F.bitwise_not(y["map"][f"w{k}"]))) for k in range(WORDS)), F.lit(0))

    def may(one: str, two: str, cores: bool = False) -> Column:
        a, b, i, j = F.col(f"{one}size"), F.col(f"{two}size"), F.col(f"{one}pos"), F.col(f"{two}pos")
        needed = (a + b) * percent  # a link needs t / (1 + t) of both sizes in common
        common = F.least(i, j) + 1 + F.least(a - i - 1, b - j - 1)
        fits = (F.least(a, b) * 100 >= F.greatest(a, b) * percent) & (common * (100 + percent) >= needed)
        if not cores:
            return fits
        x, y = F.col(f"{one}core"), F.col(f"{two}core")
        fits = fits & (F.least(x["all"], y["all"]) * (100 + percent) >= needed)
        return fits & (F.least(most(x, y), most(y, x)) * (100 + percent) >= needed)

    return may


#: Elements of all sets together, 8 bytes each, up to which sets are broadcast to the pairs that they verify.
BROADCAST_ELEMENTS = 1_000_000


def similar(pairs: DataFrame, sets: DataFrame, key: str, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of percent / 100 or more; sets: (key, s array<long>), stored.

    Sets come to the pairs in a broadcast where they are few, counted by element; else pairs are shuffled to the sets.
    """
    few = (sets.agg(F.sum(F.size("s"))).first()[0] or 0) <= BROADCAST_ELEMENTS
    one, two = (sets.select(F.col(key).alias(c), F.col("s").alias(v)) for c, v in (("a", "x"), ("b", "y")))
    met = pairs.join(F.broadcast(one) if few else one, "a").join(F.broadcast(two) if few else two, "b")
    both = F.size(F.array_intersect("x", "y"))
    return met.where(both * 100 >= (F.size("x") + F.size("y") - both) * percent).select("a", "b")


def _first() -> Column:
    return F.min(F.struct("rank", (-F.col("size")).alias("s"), "node", "size", "pos")).alias("p")


def crowded(rows: DataFrame) -> DataFrame:
    """(bucket, node, size, pos, rank, pivot, pivot_size, pivot_pos) of buckets that hold two nodes or more; stored.

    rows: (bucket, node, size, rank, pos), one for each bucket and node. Pivots are pre-aggregated, and rows
    meet them in a join whose skewed keys Spark splits, so a bucket may hold any share of all rows.
    """
    pivots = rows.groupBy("bucket").agg(_first(), F.count("*").alias("m")).where("m > 1")
    met = rows.join(pivots, "bucket")
    pivot = (F.col(f"p.{c}").alias(f"pivot_{c}") for c in ("size", "pos"))
    return saved(met.select("bucket", "node", "size", "pos", "rank", F.col("p.node").alias("pivot"), *pivot), "buckets")


def _pairs(rows: DataFrame, other: str) -> DataFrame:
    return rows.select(F.least("node", other).alias("a"), F.greatest("node", other).alias("b")).distinct()


def _widen(rows: DataFrame, members: DataFrame | None) -> DataFrame:
    """rows with each group in `node` replaced by its members."""
    if members is None:
        return rows
    own = members.select(F.col("lead").alias("node"), F.col("node").alias("_member"))
    return rows.join(own, "node", "left").withColumn("node", F.coalesce("_member", "node")).drop("_member")


def _open(buckets: DataFrame, comp: DataFrame, members: DataFrame | None) -> DataFrame:
    """(bucket, node, size, pos, rank, of, of_pivot) of the buckets whose nodes lie in several components; stored.

    comp: (node, component). Groups are expanded only in those buckets; each group is a bucket of its own, too.
    """
    spans = comp.select("node", F.col("component").alias("lo"), F.col("component").alias("hi"))
    if members is not None:
        inside = F.coalesce("component", "node")
        of_group = members.join(comp, "node", "left").groupBy("lead").agg(F.min(inside).alias("lo"), F.max(inside).alias("hi"))
        of_group = of_group.withColumnRenamed("lead", "node")
        spans = spans.join(of_group.select("node"), "node", "left_anti").unionByName(of_group)
    wide = buckets.join(spans, "node", "left").groupBy("bucket")
    wide = wide.agg(F.min(F.coalesce("lo", "node")).alias("lo"), F.max(F.coalesce("hi", "node")).alias("hi")).where("lo <> hi")
    wide = saved(wide.select("bucket"), "open")
    rows = _widen(buckets.join(broadcast_if_small(wide), "bucket", "left_semi").drop("pivot_size", "pivot_pos"), members)
    if members is not None:
        whole = members.withColumns({"bucket": F.xxhash64("lead"), "rank": F.lit(0.0), "pos": F.lit(0)}).withColumnRenamed("lead", "pivot")
        rows = rows.unionByName(whole.select(rows.columns))
    rows = rows.join(comp, "node", "left").withColumn("of", F.coalesce("component", "node")).drop("component")
    rows = rows.join(comp.select(F.col("node").alias("pivot"), "component"), "pivot", "left")
    return saved(rows.select("bucket", "node", "size", "pos", "rank", "of", F.coalesce("component", "pivot").alias("of_pivot")), "outside")


def link(
    buckets: DataFrame, may: Callable, verify: Callable[[DataFrame], DataFrame], cores: Callable[[DataFrame], DataFrame] | None = None,
    members: DataFrame | None = None, rounds: int = 2, once: bool = False,
) -> DataFrame:
    """(a, b) links, a < b, that connect whatever verified pairs within buckets connect.

    buckets: of crowded(). members (lead, node, size): all members of each group of several nodes, the lead, which
    stands for the group in buckets, included. may(one, two, cores): a Column over the columns size, pos and core
    with these prefixes, false where a link is impossible. cores(nodes) returns (node, core) for nodes (node,
    component): what is known of a node's elements that some node of another component has. verify keeps the
    linked ones of (a, b) pairs of nodes. Pairs of a group and its pivot group are filtered, then each member
    meets the pivot. In later rounds members outside their pivot's component meet a pivot of their own; the last
    one compares those that are left with all members of their bucket in other components, so no result depends
    on the number of rounds. once: whether a pair of that last round is made in the first of its common buckets
    alone, which takes an array of all a node's buckets; for nodes of few buckets.
    """
    groups = buckets.where("node <> pivot").where(may("", "pivot_")).select("node", "pivot").distinct()
    if members is not None:
        groups = _widen(saved(groups, "group-pairs"), members)
        groups = groups.unionByName(members.where("node <> lead").select("node", F.col("lead").alias("pivot")))
    tried = saved(_pairs(groups, "pivot"), "pairs")
    links = saved(verify(tried), "links")
    for step in range(rounds):
        comp = saved(components(links, "a", "b").select(F.col("id").alias("node"), "component"), "components")
        rows = _open(buckets, comp, members)
        left = rows.where("of <> of_pivot").drop("of_pivot")
        if step < rounds - 1:
            lead = left.groupBy("bucket").agg(_first()).select("bucket", *(F.col(f"p.{c}").alias(f"to_{c}") for c in ("node", "size", "pos")))
            met = left.join(lead, "bucket").where("node <> to_node").where(may("", "to_"))
        else:
            rest = rows.drop("of_pivot", "rank")
            if cores is not None:
                core = saved(cores(rest.select("node", F.col("of").alias("component")).distinct()), "cores")
                rest, left = rest.join(core, "node"), left.join(core, "node")
            if once:
                known = rows.groupBy("node").agg(F.collect_set("bucket").alias("known"))
                rest, left = rest.join(known, "node"), left.join(known, "node")
            rest = rest.withColumnsRenamed({c: f"to_{c}" for c in rest.columns if c != "bucket"})
            met = left.join(rest, "bucket").where("of <> to_of").where(may("", "to_", cores is not None))
            if once:
                met = met.where(F.array_min(F.array_intersect("known", "to_known")) == F.col("bucket"))
        new = saved(_pairs(met, "to_node").join(tried, ["a", "b"], "left_anti"), "pairs")
        if new.isEmpty():
            continue
        tried = tried.unionByName(new)
        links = saved(links.unionByName(verify(new)), "links")
    return links
