"""Driver queries: the operators on the star-schema tables, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kerbline.functions import geo, rules, text
from kerbline.operators import components as comps
from kerbline.operators import impute, network, routing, scenario, spatial, stats
from kerbline.params import Params

P = Params()
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# lineitem as street segments: class, lanes, speed, volume, facility and miles
_CLASS = "CAST(l_suppkey % 8 AS INT) + 1"
_FAC = "CASE l_orderkey % 6 WHEN 0 THEN 'none' WHEN 1 THEN 'sharrow' WHEN 2 THEN 'shoulder' WHEN 3 THEN 'lane' WHEN 4 THEN 'buffered' ELSE 'path' END"
_SEG = f"""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {_CLASS} AS rdclass, {_FAC} AS fac, CAST(l_linenumber AS INT) AS lanes,
CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_quantity + 5 END AS speed, CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_extendedprice / 10 END AS aadt, l_extendedprice / 1000 AS miles FROM lineitem"""
_MIXED = """CASE WHEN lanes >= 6 THEN 4 WHEN lanes >= 4 THEN CASE WHEN s <= 30 THEN 3 ELSE 4 END
WHEN s <= 25 THEN CASE WHEN a <= 750 AND lanes <= 2 THEN 1 WHEN a <= {mid} THEN 2 ELSE 3 END WHEN s <= 30 THEN CASE WHEN a <= {mid} THEN 2 ELSE 3 END WHEN s <= 35 THEN {at35} ELSE 4 END"""


def _rated_sql(mid: int = 3000, at35: int = 3) -> str:
    mixed = _MIXED.format(mid=mid, at35=at35)
    return f"""SELECT *, CASE WHEN rdclass IN (1, 2) THEN 0 WHEN fac = 'path' THEN 1 WHEN fac IN ('none', 'sharrow') THEN m
WHEN fac = 'buffered' THEN LEAST(m, CASE WHEN s <= 30 AND lanes <= 2 THEN 1 WHEN s <= 35 THEN 2 ELSE 3 END)
WHEN fac = 'lane' THEN LEAST(m, LEAST(4, CASE WHEN s <= 30 THEN 2 WHEN s <= 35 THEN 3 ELSE 4 END + CASE WHEN lanes >= 4 THEN 1 ELSE 0 END))
WHEN fac = 'shoulder' THEN LEAST(m, CASE WHEN s <= 35 THEN 3 ELSE 4 END) END AS lts
FROM (SELECT *, {mixed} AS m FROM (SELECT *, COALESCE(speed, 25) AS s, COALESCE(aadt, {mid}) AS a FROM ({_SEG})))"""


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("l_orderkey") % 6
    fac = F.when(key == 0, "none").when(key == 1, "sharrow").when(key == 2, "shoulder").when(key == 3, "lane").when(key == 4, "buffered").otherwise("path")
    return t(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", ((F.col("l_suppkey") % 8).cast("int") + 1).alias("rdclass"), fac.alias("fac"), F.col("l_linenumber").alias("lanes"),
        F.when(F.col("l_partkey") % 7 != 0, F.col("l_quantity") + 5).alias("speed"), F.when(F.col("l_partkey") % 5 != 0, F.col("l_extendedprice") / 10).alias("aadt"), (F.col("l_extendedprice") / 1000).alias("miles"),
    )


def _rated(spark: SparkSession, sf_dir: str, p: Params = P) -> DataFrame:
    return _segments(spark, sf_dir).withColumn("lts", rules.lts("fac", "rdclass", "lanes", "speed", "aadt", p))


@query(f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, miles, fac, lts FROM ({_rated_sql()})")
def q_classify_rules(spark, sf_dir):
    return _rated(spark, sf_dir).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "miles", "fac", "lts")


@query(f"""WITH r AS ({_rated_sql()}), g AS (SELECT lts, count(*) AS segments, sum(miles) AS m FROM r GROUP BY lts)
SELECT lts, segments, round(m, 3) AS miles, round(m / (SELECT sum(m) FROM g) * 100, 4) AS pct FROM g""")
def q_level_mileage(spark, sf_dir):
    out = stats.by_level(_rated(spark, sf_dir))
    return out.select("lts", "segments", F.round("miles", 3).alias("miles"), F.round("pct", 4).alias("pct"))


@query(f"""SELECT round(sum(miles), 3) AS total_miles, round(sum(CASE WHEN lts BETWEEN 1 AND 2 THEN miles ELSE 0 END), 3) AS low_stress_miles,
round(sum(CASE WHEN lts BETWEEN 1 AND 3 THEN miles ELSE 0 END), 3) AS ridable_lts3_miles, count(*) AS segments FROM ({_rated_sql()})""")
def q_headline_stats(spark, sf_dir):
    out = stats.summary(_rated(spark, sf_dir), rules.is_low_stress("lts", P))
    return out.select(*(F.round(c, 3).alias(c) for c in ("total_miles", "low_stress_miles", "ridable_lts3_miles")), "segments")


@query("""WITH c AS (SELECT unnest([10,15,20,25,30,35,40,45,50,55,70]) AS v),
s AS (SELECT l_quantity, CASE WHEN l_quantity > 45 THEN 0 ELSE l_quantity * 1.7 END AS x FROM (SELECT DISTINCT l_quantity FROM lineitem))
SELECT l_quantity, CASE WHEN x > 0 THEN (SELECT arg_min(v, abs(x - v) * 1000 + v / 1000.0) FROM c) END AS posted FROM s""")
def q_snap_speed(spark, sf_dir):
    s = t(spark, sf_dir, "lineitem").select("l_quantity").distinct()
    return s.select("l_quantity", rules.snap_speed(F.when(F.col("l_quantity") > 45, 0).otherwise(F.col("l_quantity") * 1.7)).alias("posted"))


@query(f"""SELECT rdclass, directional, cartoclass, CASE WHEN rdclass = 3 AND directional THEN 3 WHEN rdclass = 3 AND cartoclass IN (1, 2) THEN 5 WHEN rdclass = 3 THEN 3
WHEN rdclass = 4 AND directional THEN 2 WHEN rdclass = 4 THEN 3 WHEN rdclass BETWEEN 5 AND 8 AND directional THEN 1 ELSE 2 END AS lanes, count(*) AS n
FROM (SELECT {_CLASS} AS rdclass, l_returnflag = 'R' AS directional, CASE WHEN l_linenumber > 5 THEN NULL ELSE l_linenumber END AS cartoclass FROM lineitem) GROUP BY ALL""")
def q_lane_rules(spark, sf_dir):
    rows = t(spark, sf_dir, "lineitem").select(((F.col("l_suppkey") % 8).cast("int") + 1).alias("rdclass"), (F.col("l_returnflag") == "R").alias("directional"), F.when(F.col("l_linenumber") <= 5, F.col("l_linenumber")).alias("cartoclass"))
    return rows.withColumn("lanes", rules.lanes("rdclass", "directional", "cartoclass", P)).groupBy("rdclass", "directional", "cartoclass", "lanes").agg(F.count("*").alias("n"))


@query("""SELECT s_suppkey, CASE WHEN len(f) = 0 THEN 'none' ELSE (SELECT arg_max(x, CASE x WHEN 'none' THEN 0 WHEN 'sharrow' THEN 1 WHEN 'shoulder' THEN 2 WHEN 'lane' THEN 3 WHEN 'buffered' THEN 4 WHEN 'protected' THEN 5 WHEN 'path' THEN 6 ELSE 7 END) FROM unnest(f) AS u(x)) END AS fac
FROM (SELECT s_suppkey, list_filter(['none', CASE WHEN s_suppkey % 2 = 0 THEN 'lane' END, CASE WHEN s_suppkey % 3 = 0 THEN 'shoulder' END, CASE WHEN s_suppkey % 5 = 0 THEN 'path' END], lambda x: x IS NOT NULL) AS f FROM supplier)""")
def q_resolve_facility(spark, sf_dir):
    s = F.col("s_suppkey")
    f = F.array_compact(F.array(F.lit("none"), F.when(s % 2 == 0, "lane"), F.when(s % 3 == 0, "shoulder"), F.when(s % 5 == 0, "path")))
    return t(spark, sf_dir, "supplier").select("s_suppkey", rules.strongest(f, P).alias("fac"))


@query("""SELECT right(trim(CAST(p_partkey AS VARCHAR)), 3) AS key, median(p_retailprice) AS value FROM part WHERE p_retailprice IS NOT NULL AND p_size % 9 <> 0 GROUP BY 1""")
def q_median_station(spark, sf_dir):
    part = t(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("sta"), F.when(F.col("p_size") % 9 != 0, F.col("p_retailprice")).alias("v"))
    return impute.station_medians(part, "sta", "v", 3)


@query("""SELECT c_nationkey, c_name AS first_name, c_acctbal AS first_balance FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) = 1""")
def q_first_per_key(spark, sf_dir):
    c = t(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.col("c_name").alias("first_name"), F.col("c_acctbal").alias("first_balance"))
    return impute.first_by_key(c, "c_nationkey", "c_custkey", "first_name", "first_balance")


_ORD = """SELECT o_orderkey, o_orderstatus AS a, CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS b, o_custkey % 40 AS c, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS m FROM orders"""


@query(f"""WITH o AS ({_ORD}), g1 AS (SELECT a, b, c, median(m) AS v FROM o WHERE m IS NOT NULL GROUP BY ALL), g2 AS (SELECT a, b, median(m) AS v FROM o WHERE m IS NOT NULL GROUP BY ALL), g3 AS (SELECT a, median(m) AS v FROM o WHERE m IS NOT NULL GROUP BY ALL)
SELECT o_orderkey, COALESCE(m, g1.v, g2.v, g3.v, 500) AS aadt, CASE WHEN m IS NOT NULL THEN 0 WHEN g1.v IS NOT NULL THEN 1 ELSE 2 END AS aadt_src
FROM o LEFT JOIN g1 ON o.a IS NOT DISTINCT FROM g1.a AND o.b IS NOT DISTINCT FROM g1.b AND o.c IS NOT DISTINCT FROM g1.c LEFT JOIN g2 ON o.a IS NOT DISTINCT FROM g2.a AND o.b IS NOT DISTINCT FROM g2.b LEFT JOIN g3 ON o.a IS NOT DISTINCT FROM g3.a""")
def q_impute_cascade(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("a"), F.when(F.col("o_custkey") % 11 != 0, F.col("o_orderpriority")).alias("b"), (F.col("o_custkey") % 40).alias("c"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice")).alias("m"))
    return impute.cascade(o, "m", [["a", "b", "c"], ["a", "b"], ["a"]], 500).select("o_orderkey", "aadt", "aadt_src")


@query("SELECT o_orderkey, round(1.0 / count(*) OVER (PARTITION BY o_custkey), 6) AS weight FROM orders")
def q_weights(spark, sf_dir):
    return impute.sample_weights(t(spark, sf_dir, "orders"), "o_custkey").select("o_orderkey", F.round("weight", 6).alias("weight"))


@query("""WITH n AS (SELECT p_brand, count(DISTINCT p_size) AS k FROM part GROUP BY 1), m AS (SELECT p_type, count(DISTINCT p_size) AS k FROM part GROUP BY 1)
SELECT p_partkey, p_size <= 25 AND n.k >= 4 AND m.k >= 4 AS supported FROM part JOIN n USING (p_brand) JOIN m USING (p_type)""")
def q_support_mask(spark, sf_dir):
    return impute.support_mask(t(spark, sf_dir, "part"), "p_size", ["p_brand", "p_type"], 4, F.col("p_size") <= 25).select("p_partkey", "supported")


@query("""SELECT p_partkey, regexp_replace(trim(regexp_replace('  ' || p_name || chr(9) || ' x ', '\\s+', ' ', 'g')), '^ | $', '', 'g') AS norm, lower(regexp_replace(trim(p_name), '\\s+', ' ', 'g')) AS key FROM part""")
def q_norm_text(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", text.norm_text(F.concat(F.lit("  "), F.col("p_name"), F.lit("\t x "))).alias("norm"), text.name_key("p_name").alias("key"))


@query("""SELECT p_partkey, array_to_string(list_transform(string_split('THE ' || upper(p_name) || ' OF us nw road', ' '), lambda w, i: CASE WHEN upper(w) IN ('NW','NE','SW','SE','US','KY','I') THEN upper(w) WHEN i > 1 AND lower(w) IN ('of','the','and','at','on') THEN lower(w) ELSE upper(w[1:1]) || lower(w[2:]) END), ' ') AS title
FROM (SELECT p_partkey, regexp_replace(trim(p_name), '\\s+', ' ', 'g') AS p_name FROM part)""")
def q_title_case(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", text.title_case(F.concat(F.lit("THE "), F.upper("p_name"), F.lit(" OF us nw road"))).alias("title"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN m < 0.1 THEN CAST(CAST(floor(m * 5280 + 0.5) AS BIGINT) AS VARCHAR) || ' ft' ELSE printf('%.1f mi', m) END AS shown, CAST(greatest(1, floor(m / 10 * 60 + 0.5)) AS BIGINT) AS minutes
FROM (SELECT *, l_quantity / 40 + 0.001 AS m FROM lineitem)""")
def q_display(spark, sf_dir):
    rows = t(spark, sf_dir, "lineitem").withColumn("m", F.col("l_quantity") / 40 + 0.001)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.show_miles("m").alias("shown"), text.show_minutes("m").alias("minutes"))


_TAGS = """SELECT event_id, CASE event_type WHEN 'click' THEN 'cycleway' WHEN 'view' THEN 'service' WHEN 'purchase' THEN 'footway' ELSE 'residential' END AS highway, CASE user_id % 4 WHEN 0 THEN 'designated' WHEN 1 THEN 'yes' WHEN 2 THEN 'no' ELSE '' END AS bicycle,
CASE user_id % 5 WHEN 0 THEN 'private' ELSE '' END AS access, CASE user_id % 7 WHEN 0 THEN 'Mall Parking' WHEN 1 THEN 'Elm Drive' ELSE '' END AS name, event_id % 2 = 0 AS campus FROM events"""


@query(f"""SELECT event_id, CASE WHEN name IN ('Elm Drive') AND highway IN ('residential', 'unclassified', 'service') AND access NOT IN ('private', 'no') THEN 'reviewed_street'
WHEN highway = 'cycleway' OR (highway IN ('path', 'footway') AND bicycle = 'designated') THEN 'path' WHEN campus AND highway IN ('path', 'footway', 'pedestrian') AND bicycle <> 'no' AND access NOT IN ('private', 'no') THEN 'campus_path'
WHEN highway = 'service' AND bicycle IN ('yes', 'designated', 'permissive') AND NOT contains(lower(name), 'parking') AND access NOT IN ('private', 'no') THEN 'access' END AS role FROM ({_TAGS})""")
def q_role_policy(spark, sf_dir):
    u = F.col("user_id")
    highway = F.when(F.col("event_type") == "click", "cycleway").when(F.col("event_type") == "view", "service").when(F.col("event_type") == "purchase", "footway").otherwise("residential")
    tags = F.create_map(
        F.lit("highway"), highway, F.lit("bicycle"), F.when(u % 4 == 0, "designated").when(u % 4 == 1, "yes").when(u % 4 == 2, "no").otherwise(""), F.lit("access"), F.when(u % 5 == 0, "private").otherwise(""), F.lit("name"), F.when(u % 7 == 0, "Mall Parking").when(u % 7 == 1, "Elm Drive").otherwise("")
    )
    return t(spark, sf_dir, "events").select("event_id", rules.osm_role(tags, ["Elm Drive"], F.col("event_id") % 2 == 0).alias("role"))


@query("""SELECT l_suppkey AS a, l_partkey AS b, min(l_orderkey * 10 + l_linenumber) AS seq FROM lineitem GROUP BY l_suppkey, l_partkey
QUALIFY row_number() OVER (PARTITION BY least(a, b), greatest(a, b) ORDER BY seq, a, b) = 1""")
def q_dedupe_pairs(spark, sf_dir):
    rows = t(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")).agg(F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    point = lambda c: F.struct(F.col(c).cast("double").alias("x"), F.lit(0.0).alias("y"))
    rows = rows.withColumn("k", F.struct("seq", "a", "b"))
    return network.dedupe_pairs(rows, point("a"), point("b"), "k").drop("k")


# every line of lineitem is an edge of a graph: 16 orders, some 64 lines, make a district of 64 + 64 nodes
_EDGE = """SELECT *, u * 1000 + v % 1000 AS id FROM (SELECT l_quantity, l_orderkey // 16 * 1000 + l_partkey % 64 AS u,
l_orderkey // 16 * 1000 + 100 + (l_suppkey * 5 + l_linenumber * 11) % 64 AS v FROM lineitem)"""


def _reach_sql(lines: str = "true") -> str:
    """Edges e (u, v) of the lines that meet a condition, and their components c (id, component)."""
    return f"""e AS (SELECT DISTINCT u, v FROM ({_EDGE}) WHERE {lines}), b AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
r(id, seen) AS (SELECT DISTINCT u, u FROM b UNION SELECT r.id, b.v FROM r JOIN b ON r.seen = b.u), c AS (SELECT id, min(seen) AS component FROM r GROUP BY id)"""


def _edge_lines(spark, sf_dir):
    """(u, v, id, l_quantity) of every line; id follows from u and v."""
    rows = t(spark, sf_dir, "lineitem").withColumn("d", F.expr("l_orderkey div 16 * 1000"))
    u, v = F.col("d") + F.col("l_partkey") % 64, F.col("d") + 100 + (F.col("l_suppkey") * 5 + F.col("l_linenumber") * 11) % 64
    return rows.select(u.alias("u"), v.alias("v"), "l_quantity").withColumn("id", F.col("u") * 1000 + F.col("v") % 1000)


@query(f"WITH RECURSIVE {_reach_sql()} SELECT id, component FROM c")
def q_components(spark, sf_dir):
    return comps.components(_edge_lines(spark, sf_dir))


@query(f"""WITH RECURSIVE {_reach_sql()}, s AS (SELECT component, count(*) AS segments, sum(u % 13 + 1) AS miles FROM e JOIN c ON e.u = c.id GROUP BY 1)
SELECT row_number() OVER (ORDER BY miles DESC, segments DESC, component) - 1 AS island, segments, CAST(miles AS DOUBLE) AS miles, segments >= 3 AS major FROM s""")
def q_islands_rank(spark, sf_dir):
    e = _edge_lines(spark, sf_dir).select("u", "v", F.col("id").alias("row_pos")).distinct().withColumn("miles", (F.col("u") % 13 + 1).cast("double"))
    found, _ = network.islands(e, F.lit(True), "miles", 3, parallel="all")
    return found


_BAR = f"""s AS (SELECT component, count(*) AS segments, sum(u % 13 + 1) AS miles FROM e JOIN c ON e.u = c.id GROUP BY 1),
i AS (SELECT component, row_number() OVER (ORDER BY miles DESC, segments DESC, component) - 1 AS island, segments, round(CAST(miles AS DOUBLE), 3) AS miles FROM s),
m AS (SELECT c.id, i.island, i.miles FROM c JOIN i USING (component) WHERE segments >= 3), h AS (SELECT DISTINCT u, v FROM ({_EDGE}) WHERE l_quantity > 40),
x AS (SELECT 'n' || (h.u % 3) AS name, least(a.island, b.island) AS island_a, greatest(a.island, b.island) AS island_b, least(a.miles, b.miles) AS unlocked, 0.5 AS len
FROM h JOIN m a ON h.u = a.id JOIN m b ON h.v = b.id WHERE a.island <> b.island),
g AS (SELECT name, island_a, island_b, min(unlocked) AS miles_unlocked, sum(len) AS crossing_miles, count(*) AS n_segments FROM x GROUP BY ALL),
k AS (SELECT *, round(miles_unlocked / greatest(crossing_miles, 0.02), 2) AS score FROM g),
z AS (SELECT *, row_number() OVER (ORDER BY score DESC, name, island_a, island_b) AS rank FROM k)"""


@query(f"""WITH RECURSIVE {_reach_sql("l_quantity <= 40")}, {_BAR} SELECT rank, name, island_a, island_b, miles_unlocked, CAST(crossing_miles AS DOUBLE) AS crossing_miles, n_segments, score,
rank = min(rank) OVER (PARTITION BY island_a, island_b) AS best_for_pair, count(*) OVER (PARTITION BY island_a, island_b) - 1 AS alternatives FROM z""")
def q_barriers(spark, sf_dir):
    is_low = F.col("lts") == 1
    e = _edge_lines(spark, sf_dir).select("u", "v", "id", F.when(F.col("l_quantity") <= 40, 1).otherwise(4).alias("lts")).distinct()
    e = e.withColumns({"miles": F.when(is_low, F.col("u") % 13 + 1.0).otherwise(0.5), "row_pos": F.col("id"), "name": F.concat(F.lit("n"), F.col("u") % 3)})
    found, member = network.islands(e, is_low, "miles", 3, parallel="all")
    out = network.barriers(e, found, member, is_low, "miles", 3)
    segments = F.size("segment_ids").cast("long").alias("n_segments")
    return out.select(F.col("rank").cast("long").alias("rank"), "name", "island_a", "island_b", "miles_unlocked", "crossing_miles", segments, "score", "best_for_pair", "alternatives")


def _ways(spark, sf_dir):
    """All edges as rideable streets (id, u, v, miles, lts), and a source in each district: its first node."""
    e = _edge_lines(spark, sf_dir).select("id", "u", "v").distinct().withColumns({"miles": F.col("u") % 4 + 1.0, "lts": (F.col("v") % 4 + 1).cast("int")})
    first = e.groupBy(F.expr("u div 1000").alias("d")).agg(F.min("u").alias("node"))
    return e, first.select(F.col("node").alias("source"), "node", F.lit(0.0).alias("start"))


def _distances_sql(most: float | None = None) -> str:
    """Least costs over all paths that visit no node twice."""
    within = "" if most is None else f" AND r.cost + b.c <= {most}"
    return f"""WITH RECURSIVE e AS (SELECT DISTINCT u, v, (u % 4 + 1) * CASE v % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 1.05 WHEN 2 THEN 1.4 ELSE 3.5 END AS c FROM ({_EDGE})), b AS (SELECT u, v, c FROM e UNION ALL SELECT v, u, c FROM e),
r(source, node, cost, path) AS (SELECT min(u), min(u), 0.0::DOUBLE, [min(u)] FROM e GROUP BY u // 1000 UNION ALL
SELECT r.source, b.v, r.cost + b.c, list_append(r.path, b.v) FROM r JOIN b ON r.node = b.u WHERE NOT list_contains(r.path, b.v){within}) SELECT source, node, round(min(cost), 4) AS cost FROM r GROUP BY source, node"""


@query(_distances_sql())
def q_shortest_path(spark, sf_dir):
    e, sources = _ways(spark, sf_dir)
    return routing.distances(e, sources, routing.edge_cost("balanced")).select("source", "node", F.round("cost", 4).alias("cost"))


@query(_distances_sql(6.03))
def q_reachable(spark, sf_dir):
    e, sources = _ways(spark, sf_dir)
    return routing.distances(e, sources, routing.edge_cost("balanced"), 6.03).select("source", "node", F.round("cost", 4).alias("cost"))


@query("""WITH w AS (SELECT *, CASE WHEN row_number() OVER o = 1 THEN 0 WHEN event_type IS DISTINCT FROM lag(event_type) OVER o THEN 1 ELSE 0 END AS c FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)),
l AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS leg FROM w) SELECT user_id, CAST(leg AS BIGINT) AS leg, event_type, round(sum(value), 4) AS miles, count(*) AS edges FROM l GROUP BY ALL""")
def q_route_legs(spark, sf_dir):
    out = routing.legs(t(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], ["event_type"], "value")
    return out.select("user_id", "leg", "event_type", F.round("miles", 4).alias("miles"), "edges")


@query(f"""SELECT l_suppkey AS route, round(sum(miles), 3) AS miles, round(sum(CASE WHEN lts > 2 THEN miles ELSE 0 END), 3) AS stress_miles, round(sum(CASE WHEN lts = 4 THEN miles ELSE 0 END), 3) AS severe_miles, max(lts) AS worst_lts FROM ({_rated_sql()}) GROUP BY 1""")
def q_route_totals(spark, sf_dir):
    out = routing.route_totals(_rated(spark, sf_dir).withColumn("route", F.col("l_suppkey")), ["route"])
    return out.select("route", *(F.round(c, 3).alias(c) for c in ("miles", "stress_miles", "severe_miles")), "worst_lts")


_INTERVALS = "SELECT l_orderkey AS id, CAST(l_partkey % 1000 AS DOUBLE) / 1000 AS lo, LEAST(1.0, CAST(l_partkey % 1000 AS DOUBLE) / 1000 + l_quantity / 400) AS hi FROM lineitem"


@query(f"""WITH i AS ({_INTERVALS}), p AS (SELECT *, max(hi) OVER (PARTITION BY id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM i)
SELECT id, round(sum(greatest(0, hi - greatest(lo, COALESCE(b, -1)))) * 100, 5) AS covered FROM p GROUP BY id""")
def q_interval_coverage(spark, sf_dir):
    lo = (F.col("l_partkey") % 1000).cast("double") / 1000
    hi = F.least(F.lit(1.0), lo + F.col("l_quantity") / 400)
    rows = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), lo.alias("lo"), hi.alias("hi"), F.lit(0).alias("part"), F.lit(0).alias("idx"), F.lit(100.0).alias("len"))
    return spatial.covered(rows, ["id"]).select("id", F.round("covered", 5).alias("covered"))


_PTS = "SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) * 100 AS x, CAST(embedding[2] AS DOUBLE) * 100 AS y FROM embeddings"


def _points(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), (F.col("embedding")[0].cast("double") * 100).alias("x"), (F.col("embedding")[1].cast("double") * 100).alias("y"))


def _spots(points: DataFrame) -> DataFrame:
    return points.select("id", F.lit(0).alias("part"), F.lit(0).alias("idx"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("x").alias("x2"), F.col("y").alias("y2"))


@query(f"""WITH p AS ({_PTS}) SELECT a.id AS id, b.id AS other, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 5) AS gap FROM p a JOIN p b ON a.id < b.id AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 1.0""")
def q_grid_near_join(spark, sf_dir):
    p = _spots(_points(spark, sf_dir))
    gap = geo.distance(F.col("x1"), F.col("y1"), F.col("r_x1"), F.col("r_y1"))
    return spatial.near_segments(p, p, 1.0).withColumn("gap", gap).where("id < r_id AND gap <= 1.0").select("id", F.col("r_id").alias("other"), F.round("gap", 5).alias("gap"))


@query(f"""WITH p AS ({_PTS}), a AS (SELECT * FROM p WHERE id % 5 = 0), b AS (SELECT * FROM p WHERE id % 5 <> 0)
SELECT a.id AS id, arg_min(b.id, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS target, round(min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)), 5) AS gap FROM a JOIN b ON (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 16.0 GROUP BY a.id""")
def q_nearest(spark, sf_dir):
    p = _points(spark, sf_dir)
    return spatial.nearest(p.where("id % 5 = 0"), _spots(p.where("id % 5 <> 0")), 4.0).select("id", "target", F.round("gap", 5).alias("gap"))


@query(f"""SELECT id, CASE WHEN x > -10 AND x < 0 AND abs(y) < 10 THEN 1 WHEN x > 0 AND x < 10 AND abs(y) < 10 - x THEN 2 END AS zone FROM ({_PTS})""")
def q_pip(spark, sf_dir):
    ring = lambda *p: [[{"x": float(x), "y": float(y)} for x, y in (*p, p[0])]]
    zones = spark.createDataFrame([(1, ring((-10, -10), (0, -10), (0, 10), (-10, 10))), (2, ring((0, -10), (10, 0), (0, 10)))], "zone int, parts array<array<struct<x:double,y:double>>>")
    return spatial.inside(_points(spark, sf_dir), zones, 2.0)


@query("""WITH d AS (SELECT l_suppkey, l_quantity - 25 AS dx, l_discount * 100 - 5 AS dy FROM lineitem), s AS (SELECT l_suppkey, sum(CASE WHEN dx * dx + dy * dy > 0 THEN 2 * dx * dy / sqrt(dx * dx + dy * dy) ELSE 0 END) AS s2, sum(CASE WHEN dx * dx + dy * dy > 0 THEN (dx * dx - dy * dy) / sqrt(dx * dx + dy * dy) ELSE 0 END) AS c2 FROM d GROUP BY 1)
SELECT l_suppkey, round(CASE WHEN degrees(atan2(s2, c2)) / 2 < 0 THEN degrees(atan2(s2, c2)) / 2 + 180 ELSE degrees(atan2(s2, c2)) / 2 END, 3) AS bearing FROM s""")
def q_circular_mean(spark, sf_dir):
    dx, dy = F.col("l_quantity") - 25, F.col("l_discount") * 100 - 5
    s, c = geo.doubled_bearing(dx, dy, F.sqrt(dx * dx + dy * dy))
    sums = t(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum(s).alias("s"), F.sum(c).alias("c"))
    return sums.select("l_suppkey", F.round(geo.mean_bearing(F.col("s"), F.col("c")), 3).alias("bearing"))


def _utm_sql() -> str:
    a1, a2, a3 = geo._ALPHA
    s = 2 * geo._N**0.5 / (1 + geo._N)
    k = geo._K0 * geo._R
    return f"""WITH p AS (SELECT c_custkey, radians(-84.5 + c_nationkey / 100.0 + 87.0) AS lam, radians(38.0 + (c_custkey % 97) / 500.0) AS phi FROM customer), q AS (SELECT c_custkey, lam, sinh(atanh(sin(phi)) - {s!r} * atanh({s!r} * sin(phi))) AS t FROM p),
r AS (SELECT c_custkey, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM q)
SELECT c_custkey, round(500000 + {k!r} * (eta + {a1!r} * cos(2 * xi) * sinh(2 * eta) + {a2!r} * cos(4 * xi) * sinh(4 * eta) + {a3!r} * cos(6 * xi) * sinh(6 * eta)), 3) AS east, round({k!r} * (xi + {a1!r} * sin(2 * xi) * cosh(2 * eta) + {a2!r} * sin(4 * xi) * cosh(4 * eta) + {a3!r} * sin(6 * xi) * cosh(6 * eta)), 3) AS north FROM r"""


@query(_utm_sql())
def q_utm_forward(spark, sf_dir):
    c = t(spark, sf_dir, "customer")
    e, n = geo.utm(F.col("c_nationkey") / 100.0 - 84.5, (F.col("c_custkey") % 97) / 500.0 + 38.0)
    return c.select("c_custkey", F.round(e, 3).alias("east"), F.round(n, 3).alias("north"))


@query(f"""SELECT CASE WHEN fac <> 'none' THEN 'network' WHEN lts BETWEEN 1 AND 2 THEN 'residential' ELSE 'context' END AS layer, lts, count(*) AS features, round(sum(miles), 3) AS miles FROM ({_rated_sql()}) GROUP BY ALL""")
def q_layer_levels(spark, sf_dir):
    rows = _rated(spark, sf_dir).withColumn("layer", stats.layer(F.col("fac"), rules.is_low_stress("lts", P)))
    per = stats.layer_levels(rows)
    flat = per.select("layer", F.explode("by_lts").alias("lts", "m"))
    counts = rows.groupBy("layer", F.col("lts").cast("string").alias("lts")).agg(F.count("*").alias("features"))
    return flat.join(counts, ["layer", "lts"]).select("layer", F.col("lts").cast("int").alias("lts"), "features", F.round("m", 3).alias("miles"))


@query(f"""WITH e AS (SELECT *, CAST(l_partkey % 4 AS INT) AS src FROM ({_SEG})), f AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 49)
SELECT src, fac, basis, cf, count(*) AS n FROM (SELECT src, fac, CASE WHEN fac = 'path' THEN 0 WHEN src = 0 THEN 2 ELSE 1 END AS basis, CASE WHEN l_partkey IN (SELECT l_partkey FROM f) THEN 0 WHEN fac = 'path' OR (src = 0 AND (fac <> 'none' OR rdclass = 6)) THEN 2 WHEN src IN (1, 3) THEN 1 ELSE 0 END AS cf FROM e) GROUP BY ALL""")
def q_provenance(spark, sf_dir):
    rows = _segments(spark, sf_dir).withColumn("src", (F.col("l_partkey") % 4).cast("int"))
    flips = t(spark, sf_dir, "lineitem").where("l_quantity > 49").select("l_partkey").distinct().withColumn("flip", F.lit(True))
    rows = rows.join(flips, "l_partkey", "left")
    rows = rows.withColumns({"basis": rules.basis("fac", "src"), "cf": rules.confidence("fac", "rdclass", "src", F.coalesce("flip", F.lit(False)), P)})
    return rows.groupBy("src", "fac", "basis", "cf").agg(F.count("*").alias("n"))


@query(f"""WITH a AS ({_rated_sql()}), b AS ({_rated_sql(at35=2)}), c AS ({_rated_sql(mid=2000)}) SELECT 'mixed_35mph_as_lts2' AS variant, a.lts AS before, b.lts AS after, count(*) AS changed FROM a POSITIONAL JOIN b WHERE a.lts <> b.lts GROUP BY ALL
UNION ALL SELECT 'aadt_break_2000', a.lts, c.lts, count(*) FROM a POSITIONAL JOIN c WHERE a.lts <> c.lts GROUP BY ALL""")
def q_sweep_diff(spark, sf_dir):
    rows = _segments(spark, sf_dir).withColumn("before", rules.lts("fac", "rdclass", "lanes", "speed", "aadt", P))
    out = None
    for v in P["sensitivity.runs"][:2]:
        after = rules.lts("fac", "rdclass", "lanes", "speed", "aadt", P.with_values(v["set"]))
        one = rows.withColumn("after", after).where("before <> after").groupBy("before", "after").agg(F.count("*").alias("changed")).select(F.lit(v["name"]).alias("variant"), "before", "after", "changed")
        out = one if out is None else out.unionByName(one)
    return out


@query("""WITH e AS (SELECT o_orderkey AS id, CAST(o_custkey % 5 AS INT) AS lts FROM orders), s AS (SELECT o_orderkey AS id, CAST(o_orderkey % 4 AS INT) AS lts FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT -1, 0) SELECT id, e.lts AS before, s.lts AS after FROM e JOIN s USING (id) WHERE s.lts < e.lts""")
def q_scenario_upgrade(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    e = o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 5).cast("int").alias("lts"))
    s = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 4).cast("int").alias("lts"))
    return scenario.upgrades(e, s.unionByName(spark.createDataFrame([(-1, 0)], "id long, lts int")))


@query("""WITH w AS (SELECT p_partkey AS id, CASE WHEN p_size % 3 <> 0 THEN p_size % 5 END AS expected FROM part), e AS (SELECT p_partkey AS id, p_size % 4 AS got FROM part WHERE p_partkey % 6 <> 0)
SELECT id, expected, got, CASE WHEN got IS NULL THEN 'missing' WHEN got = expected THEN 'passed' ELSE 'failed' END AS verdict FROM w LEFT JOIN e USING (id) WHERE expected IS NOT NULL""")
def q_golden_diff(spark, sf_dir):
    p = t(spark, sf_dir, "part")
    w = p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 3 != 0, F.col("p_size") % 5).alias("expected_lts"))
    return scenario.golden(p.where("p_partkey % 6 <> 0").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 4).alias("lts")), w)


@query("""WITH s AS (SELECT l_suppkey, min(l_extendedprice) AS t, median(l_extendedprice * (1 - l_discount)) AS p FROM lineitem GROUP BY 1)
SELECT count(*) AS n, round(sqrt(avg((ln(1 + p) - ln(1 + t)) ** 2)), 6) AS rmsle, round(avg(abs(p - t)), 4) AS mae, round(median(abs(p - t) / t) * 100, 4) AS median_ape, round(avg(CASE WHEN (p > 20000)::INT + (p > 40000)::INT = (t > 20000)::INT + (t > 40000)::INT THEN 1.0 ELSE 0.0 END), 6) AS bin_accuracy FROM s""")
def q_metrics(spark, sf_dir):
    rows = t(spark, sf_dir, "lineitem").withColumn("p", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    out = impute.regression_metrics(rows, "l_suppkey", "l_extendedprice", "p", [20000, 40000])
    return out.select("n", F.round("rmsle", 6).alias("rmsle"), F.round("mae", 4).alias("mae"), F.round("median_ape", 4).alias("median_ape"), F.round("bin_accuracy", 6).alias("bin_accuracy"))


@query(f"""SELECT 's' || (l_suppkey % 300) AS name, count(*) AS segments, round(sum(miles), 3) AS miles, min(CASE WHEN lts > 0 THEN lts END) AS best, max(CASE WHEN lts > 0 THEN lts END) AS worst FROM ({_rated_sql()}) GROUP BY 1 HAVING contains(lower(name), '1') ORDER BY name LIMIT 120""")
def q_street_index(spark, sf_dir):
    rows = _rated(spark, sf_dir).withColumn("name", F.concat(F.lit("s"), F.col("l_suppkey") % 300))
    hits, _ = stats.search(stats.street_index(rows), "1")
    return hits.withColumn("miles", F.round("miles", 3))


@query("""SELECT 'customer' AS kind, c_custkey AS id, c_name AS name, c_nationkey AS zone, c_acctbal AS value FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier UNION ALL SELECT 'part', p_partkey, p_name, NULL, p_retailprice FROM part""")
def q_union_assemble(spark, sf_dir):
    a = t(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("zone"), F.col("c_acctbal").alias("value"))
    b = t(spark, sf_dir, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("zone"), F.col("s_acctbal").alias("value"))
    c = t(spark, sf_dir, "part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("value"))
    return a.unionByName(b).unionByName(c, allowMissingColumns=True)


@query("""SELECT o_orderkey, '{"id":' || o_orderkey || ',"lts":' || (o_custkey % 5) || CASE WHEN o_custkey % 3 = 0 THEN '' ELSE ',"nm":"' || o_orderpriority || '"' END || CASE WHEN o_custkey % 2 = 0 THEN '' ELSE ',"isl":' || (o_custkey % 7) END || '}' AS json FROM orders""")
def q_feature_json(spark, sf_dir):
    c = F.col("o_custkey")
    props = F.struct(F.col("o_orderkey").alias("id"), (c % 5).alias("lts"), F.when(c % 3 != 0, F.col("o_orderpriority")).alias("nm"), F.when(c % 2 != 0, c % 7).alias("isl"))
    return t(spark, sf_dir, "orders").select("o_orderkey", F.to_json(props).alias("json"))


@query("""WITH m AS (SELECT user_id, ts, event_id, lag(value) OVER w AS a, value AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, count(*) AS pairs, round(sum(abs(b - a)), 4) AS walked FROM m WHERE a IS NOT NULL GROUP BY 1""")
def q_vertex_pairs(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    m = t(spark, sf_dir, "events").select("user_id", F.lag("value").over(w).alias("a"), F.col("value").alias("b")).where("a IS NOT NULL")
    return m.groupBy("user_id").agg(F.count("*").alias("pairs"), F.round(F.sum(F.abs(F.col("b") - F.col("a"))), 4).alias("walked"))


@query("""SELECT CAST(l_partkey % 4 AS INT) AS aadt_src, count(*) AS segments, round(count(*) * 100.0 / (SELECT count(*) FROM lineitem), 4) AS pct FROM lineitem GROUP BY 1""")
def q_source_shares(spark, sf_dir):
    rows = t(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 4).cast("int").alias("aadt_src"))
    return stats.source_shares(rows).withColumn("pct", F.round("pct", 4))


@query("""SELECT trip, mode, miles, CAST(greatest(1, floor(miles / 10 * 60 + 0.5)) AS BIGINT) AS minutes, CAST(greatest(1, floor(miles / 10 * 60 + 0.5)) - min(greatest(1, floor(miles / 10 * 60 + 0.5))) OVER (PARTITION BY trip) AS BIGINT) AS extra_minutes
FROM (SELECT o_custkey AS trip, o_orderkey AS mode, o_totalprice / 100000 AS miles FROM orders)""")
def q_extra_minutes(spark, sf_dir):
    return routing.extra_minutes(t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("trip"), F.col("o_orderkey").alias("mode"), (F.col("o_totalprice") / 100000).alias("miles")))


@query(f"""WITH RECURSIVE w AS (SELECT DISTINCT id, u, v FROM ({_EDGE})), b AS (SELECT u, v FROM w UNION ALL SELECT v, u FROM w),
r(node) AS (SELECT u FROM ({_EDGE}) WHERE l_quantity = 50 UNION SELECT b.v FROM r JOIN b ON r.node = b.u) SELECT id FROM w WHERE u IN (SELECT node FROM r)""")
def q_seed_expansion(spark, sf_dir):
    """All ways that hang together with a line of quantity 50."""
    lines = _edge_lines(spark, sf_dir)
    return comps.expand(lines.select("id", F.array("u", "v").alias("nodes")).distinct(), lines.where("l_quantity = 50").select("id").distinct())
