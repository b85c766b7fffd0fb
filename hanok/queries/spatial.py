"""Walking network, snapping, shortest paths and stations on a street grid made of the customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from hanok.functions import geodesy as gd
from hanok.functions import places as pl
from hanok.operators import enrich as en
from hanok.operators import graph, spatial
from hanok.operators import stations as st
from hanok.plans import transport as tp
from hanok.registry import query
from hanok.starmap import COMPLEX

# Customers are street corners: 40 to a street, corners 60 m apart, streets 90 m apart; every eleventh corner has no
# way across. Suppliers are the complexes; the corners of machinery customers are stations.
CORNERS = """corner AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS seg, CAST(c_custkey % 40 * 60 AS DOUBLE) AS x, CAST(c_custkey // 40 * 90 AS DOUBLE) AS y FROM customer),
edge AS (SELECT a.id AS a, b.id AS b, a.x AS ax, a.y AS ay, b.x AS ex, b.y AS ey, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS length FROM corner a JOIN corner b ON b.id = a.id + 1 AND b.id % 40 <> 0
  UNION ALL SELECT a.id, b.id, a.x, a.y, b.x, b.y, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) FROM corner a JOIN corner b ON b.id = a.id + 40 WHERE a.id % 11 <> 0)"""
HOUSES = """house AS (SELECT s_suppkey AS complex_id, CAST(s_suppkey * 137 % 2400 AS DOUBLE) AS x, CAST(s_suppkey * 59 % 3000 + 7 AS DOUBLE) AS y FROM supplier)"""


def _corners(star):
    k = F.col("c_custkey")
    return star.table("customer").select(
        k.alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("seg"),
        (k % 40 * 60).cast("double").alias("x"), (F.floor(k / 40) * 90).cast("double").alias("y"),
    )


def _ways(star):
    """One way per street, one per step across."""
    c = _corners(star)
    node = F.struct("id", "x", "y")
    streets = c.groupBy(F.floor(F.col("id") / 40).alias("way_id")).agg(F.array_sort(F.collect_list(node)).alias("nodes"))
    up = c.select((F.col("id") + 40).alias("id"), F.struct("id", "x", "y").alias("below"))
    across = c.join(up, "id").filter(F.col("below.id") % 11 != 0).select((F.col("id") + 1_000_000).alias("way_id"), F.array(F.col("below"), node).alias("nodes"))
    return streets.unionByName(across)


def _houses(star):
    k = F.col("s_suppkey")
    return star.table("supplier").select(k.alias("complex_id"), (k * 137 % 2400).cast("double").alias("x"), (k * 59 % 3000 + 7).cast("double").alias("y"))


@query("walk_edges", "N1 W9", f"""WITH {CORNERS} SELECT a, b, length FROM edge""")
def walk_edges(star):
    return spatial.way_edges(_ways(star)).select("a", "b", "length")


@query("walkable_ways", "F10 F11 F12", """SELECT c_custkey, CAST(CASE WHEN c_mktsegment = 'BUILDING' THEN false WHEN c_mktsegment = 'MACHINERY' THEN c_nationkey % 2 = 0 WHEN c_mktsegment = 'HOUSEHOLD' THEN c_nationkey % 3 = 0 ELSE true END AS INT) AS walkable,
  CAST(126 + c_nationkey * 0.06 BETWEEN 126.65 AND 127.4 AS INT) AS inside, CAST(c_nationkey % 4 <> 0 AND c_mktsegment <> 'BUILDING' AS INT) AS live FROM customer""")
def walkable_ways(star):
    seg, n = F.col("c_mktsegment"), F.col("c_nationkey")
    tags = F.create_map(
        F.lit("highway"), F.when(seg == "BUILDING", "motorway").when(seg == "MACHINERY", "trunk").otherwise("footway"),
        F.lit("foot"), F.when((seg == "MACHINERY") & (n % 2 == 0), "yes").when((seg == "HOUSEHOLD") & (n % 3 != 0), "private").otherwise(""),
        F.lit("railway"), F.when(seg == "BUILDING", "platform").otherwise("station"), F.lit("name"), F.col("c_name"),
        F.lit("disused"), F.when(n % 4 == 0, "yes").otherwise("no"),
    )
    return star.table("customer").select(
        "c_custkey", pl.walkable(tags).cast("int").alias("walkable"), pl.inside_box(126 + n * F.lit(0.06), F.lit(37.2)).cast("int").alias("inside"),
        pl.live_station(tags).cast("int").alias("live"),
    )


@query("plane_points", "N2", """SELECT c_custkey, round((126.9 + (c_custkey % 100) / 1000.0 - 127.025) * (6371008.8 * pi() / 180 * cos(radians(37.34))), 3) AS x, round((37.3 + (c_custkey // 100) / 1000.0 - 37.34) * (6371008.8 * pi() / 180), 3) AS y FROM customer""")
def plane_points(star):
    k = F.col("c_custkey")
    df = star.table("customer").select("c_custkey", (F.lit(126.9) + (k % 100) / 1000.0).alias("lon"), (F.lit(37.3) + F.floor(k / 100) / 1000.0).alias("lat"))
    out = tp.with_plane(df, (127.025, 37.34))
    return out.select("c_custkey", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


def _terms(numbers, angle, fn, wide=None, wide_fn=None):
    parts = [f"{c!r} * {fn}({2 * (j + 1)} * {angle})" + (f" * {wide_fn}({2 * (j + 1)} * {wide})" if wide else "") for j, c in enumerate(numbers)]
    return " + ".join(parts)


_N, _E = gd.GRS80.n, gd.GRS80.e
_R = gd.NATIONAL_GRID.scale * gd.GRS80.rectifying_radius
GRID = f"""WITH p AS (SELECT c_custkey, 126.5 + c_custkey % 97 / 97.0 AS lon, 36.9 + c_custkey % 89 / 89.0 AS lat FROM customer),
c AS (SELECT *, radians(lon - 127.5) AS l, sinh(atanh(sin(radians(lat))) - {_E!r} * atanh({_E!r} * sin(radians(lat)))) AS t FROM p),
a AS (SELECT *, atan2(t, cos(l)) AS xi, atanh(sin(l) / sqrt(1 + t * t)) AS eta FROM c)
SELECT c_custkey, round(1000000.0 + {_R!r} * (eta + {_terms(gd._forward_terms(_N), 'xi', 'cos', 'eta', 'sinh')}), 4) AS x,
  round(2000000.0 + {_R!r} * (xi + {_terms(gd._forward_terms(_N), 'xi', 'sin', 'eta', 'cosh')} - {gd._origin(gd.NATIONAL_GRID)!r}), 4) AS y, round(lon, 8) AS lon, round(lat, 8) AS lat FROM a"""


@query("grid_points", "N2 J17", GRID)
def grid_points(star):
    """Into the national grid and back."""
    k = F.col("c_custkey")
    df = star.table("customer").select("c_custkey", (F.lit(126.5) + k % 97 / F.lit(97.0)).alias("lon"), (F.lit(36.9) + k % 89 / F.lit(89.0)).alias("lat"))
    there = df.select("c_custkey", gd.grid_point("lon", "lat").alias("p"))
    back = there.select("c_custkey", "p", gd.grid_lonlat(F.col("p.x"), F.col("p.y")).alias("q"))
    return back.select("c_custkey", *[F.round(f"p.{c}", 4).alias(c) for c in "xy"], *[F.round(f"q.{c}", 8).alias(c) for c in ("lon", "lat")])


SNAPPED = f"""{CORNERS}, {HOUSES}, pairs AS (SELECT complex_id, h.x, h.y, a, b, length, greatest(0.0, least(1.0, ((h.x - ax) * (ex - ax) + (h.y - ay) * (ey - ay)) / (length * length))) AS t, ax, ay, ex, ey FROM house h, edge),
near AS (SELECT complex_id, a, b, length, t, sqrt((x - (ax + t * (ex - ax))) ** 2 + (y - (ay + t * (ey - ay))) ** 2) AS connector FROM pairs),
snapped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY complex_id ORDER BY round(connector, 6), a, b) AS n FROM near WHERE connector <= 150) WHERE n = 1)"""


@query("snapped_houses", "J15 N3", f"""WITH {SNAPPED} SELECT complex_id, round(connector, 6) AS connector, round(connector + t * length, 6) AS to_a, round(connector + length - t * length, 6) AS to_b FROM snapped""")
def snapped_houses(star):
    out = spatial.snap(_houses(star), spatial.way_edges(_ways(star)), 150)
    return out.select("complex_id", F.round("connector", 6).alias("connector"), F.round("to_a", 6).alias("to_a"), F.round("to_b", 6).alias("to_b"))


def _paths(star, limit=1300):
    edges = spatial.way_edges(_ways(star))
    entry = spatial.starts(spatial.snap(_houses(star), edges, 150), "complex_id").select(F.col("complex_id").alias("source"), "node", "dist")
    return edges, graph.bounded_paths(entry, edges.select("a", "b", "length"), limit)


PATHS = SNAPPED.replace("corner AS", "RECURSIVE corner AS", 1) + """,
step AS (SELECT a AS node, b AS next, length FROM edge UNION ALL SELECT b, a, length FROM edge),
entry AS (SELECT source, node, min(dist) AS dist FROM (SELECT complex_id AS source, a AS node, connector + t * length AS dist FROM snapped UNION ALL SELECT complex_id, b, connector + length - t * length FROM snapped) GROUP BY 1, 2),
walk(source, node, dist) USING KEY (source, node) AS (SELECT source, node, dist FROM entry WHERE dist <= 1300
  UNION SELECT n.source, n.node, n.dist FROM (SELECT w.source, s.next AS node, min(w.dist + s.length) AS dist FROM walk w JOIN step s ON w.node = s.node WHERE w.dist + s.length <= 1300 GROUP BY 1, 2) n
    LEFT JOIN recurring.walk k ON k.source = n.source AND k.node = n.node WHERE k.dist IS NULL OR n.dist < k.dist - 1e-9)"""


@query("shortest_paths", "N4", f"""WITH {PATHS} SELECT source, node, round(dist, 4) AS dist FROM walk""")
def shortest_paths(star):
    return _paths(star)[1].select("source", "node", F.round("dist", 4).alias("dist"))


REACH = f"""{PATHS}, hit AS (SELECT source, c.id AS station, dist + 12.5 AS total FROM walk JOIN corner c ON c.id = node WHERE seg = 'MACHINERY' AND dist + 12.5 <= 1300)"""


def _reach(star):
    _, paths = _paths(star)
    ends = _corners(star).filter("seg = 'MACHINERY'").select(F.col("id").alias("station"), F.col("id").alias("endpoint"), F.col("id").alias("node"), F.lit(12.5).alias("dist"))
    return st.reach(paths, ends)


@query("station_reach", "N5 W7", f"""WITH {REACH} SELECT source, station, CAST(ceil(round(total, 6)) AS BIGINT) AS distance_m FROM hit WHERE ceil(round(total, 6)) <= 1300""")
def station_reach(star):
    return _reach(star).select("source", "station", "distance_m")


@query("station_routes", "N5", f"""WITH {REACH} SELECT source, station, round(total, 4) AS metres FROM hit WHERE ceil(round(total, 6)) <= 1300""")
def station_routes(star):
    """The length of every walk, measured again along the edges of its route."""
    edges, paths = _paths(star)
    ends = _corners(star).filter("seg = 'MACHINERY'").select(F.col("id").alias("station"), F.col("id").alias("endpoint"), F.col("id").alias("node"), F.lit(12.5).alias("dist"))
    goals = st.reach(paths, ends).select("source", F.col("station").alias("goal"), "node")
    routes = graph.routes(paths, goals).withColumn("first", F.get("nodes", F.lit(0)))
    n = F.col("nodes")
    steps = F.arrays_zip(F.slice(n, F.lit(1), F.size(n) - 1).alias("u"), F.slice(n, F.lit(2), F.size(n) - 1).alias("v"))
    walked = routes.filter(F.size(n) > 1).select("source", "goal", F.explode(steps).alias("s")).select(
        "source", "goal", F.least("s.u", "s.v").alias("a"), F.greatest("s.u", "s.v").alias("b")
    )
    along = walked.join(edges, ["a", "b"]).groupBy("source", "goal").agg(F.sum("length").alias("along"), F.count("*").alias("known"))
    entry = spatial.starts(spatial.snap(_houses(star), edges, 150), "complex_id").groupBy(F.col("complex_id").alias("source"), F.col("node").alias("first")).agg(F.min("dist").alias("dist"))
    whole = routes.join(entry, ["source", "first"]).join(along, ["source", "goal"], "left").filter(F.coalesce("known", F.lit(0)) == F.size(n) - 1)
    return whole.select("source", F.col("goal").alias("station"), F.round(F.col("dist") + F.coalesce("along", F.lit(0.0)) + 12.5, 4).alias("metres"))


@query("link_status", "C3 A16", f"""WITH {REACH} SELECT s_suppkey AS complex_id, CASE WHEN s_acctbal < 0 THEN 'coordinate_unconfirmed' WHEN s_suppkey NOT IN (SELECT complex_id FROM snapped) THEN 'walk_network_unconnected'
  WHEN s_suppkey NOT IN (SELECT source FROM hit WHERE ceil(round(total, 6)) <= 1300) THEN 'no_reachable_station_within_1300m' ELSE 'linked' END AS status FROM supplier""")
def link_status(star):
    located = star.table("supplier").select(F.col("s_suppkey").alias("complex_id"), F.when(F.col("s_acctbal") >= 0, "official").alias("coordinate_source"))
    snapped = spatial.snap(_houses(star), spatial.way_edges(_ways(star)), 150)
    walks = _reach(star).withColumnRenamed("source", "complex_id")
    return st.link_status(located, snapped, walks).select("complex_id", "status")


@query("coordinate_choice", "J17", f"""WITH {COMPLEX} SELECT complex_id, CAST(CASE WHEN far > 300 THEN 127.0 WHEN households > 400 THEN 126.8 END AS DOUBLE) AS lon, CASE WHEN far > 300 THEN 'official' WHEN households > 400 THEN 'existing' END AS coordinate_source FROM complex""")
def coordinate_choice(star):
    c = star.complexes.select("complex_id", F.when(F.col("households") > 400, 126.8).alias("lon"), F.when(F.col("households") > 400, 37.5).alias("lat"))
    official = star.complexes.filter("far is not null").select("complex_id", F.lit(127.0).alias("lon"), F.when(F.col("far") > 300, 37.5).otherwise(39.0).alias("lat"))
    return st.choose_coordinates(c, official).select("complex_id", "lon", "coordinate_source")


MERGED = """p AS (SELECT c_custkey AS id, '역' || c_nationkey AS name, CAST(c_custkey % 40 * 110 AS DOUBLE) AS x, CAST(c_custkey // 40 * 130 AS DOUBLE) AS y FROM customer),
near AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.name = b.name AND a.id <> b.id AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) < 600),
grp(id, head) USING KEY (id) AS (SELECT id, id FROM p UNION SELECT n.id, n.head FROM (SELECT near.b AS id, min(grp.head) AS head FROM grp JOIN near ON near.a = grp.id GROUP BY 1) n JOIN recurring.grp k ON k.id = n.id WHERE n.head < k.head)"""


@query("merged_stations", "J16", f"""WITH RECURSIVE {MERGED} SELECT id, head AS group_id FROM grp""")
def merged_stations(star):
    k = F.col("c_custkey")
    p = star.table("customer").select(
        k.alias("id"), F.concat(F.lit("역"), F.col("c_nationkey").cast("string")).alias("name"),
        (k % 40 * 110).cast("double").alias("x"), (F.floor(k / 40) * 130).cast("double").alias("y"),
    )
    return spatial.merge_same_name(p).select("id", "group_id")


IN_ORDER = """WITH RECURSIVE p AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY id) AS n, round(126.7001 + x / 88000.0, 2) AS bx, round(37.0001 + y / 111000.0, 2) AS by FROM
  (SELECT c_custkey AS id, '역' || c_nationkey AS name, CAST(c_custkey % 40 * 110 AS DOUBLE) AS x, CAST(c_custkey // 40 * 130 AS DOUBLE) AS y FROM customer)),
s(name, n, heads, id, group_id) AS (SELECT DISTINCT name, CAST(0 AS BIGINT), CAST([] AS STRUCT(id BIGINT, x DOUBLE, y DOUBLE, bx DOUBLE, "by" DOUBLE)[]), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM p
  UNION ALL SELECT name, n, CASE WHEN hit IS NULL THEN list_append(heads, {'id': CAST(id AS BIGINT), 'x': x, 'y': y, 'bx': bx, 'by': "by"}) ELSE heads END, CAST(id AS BIGINT), coalesce(hit, CAST(id AS BIGINT)) FROM (
    SELECT p.*, s.heads, coalesce(list_filter(s.heads, lambda h: sqrt((h.x - p.x) ** 2 + (h.y - p.y) ** 2) < 600)[1].id, list_filter(s.heads, lambda h: h.bx = p.bx AND h."by" = p."by")[1].id) AS hit
    FROM s JOIN p ON p.name = s.name AND p.n = s.n + 1))
SELECT id, group_id FROM s WHERE n > 0"""


@query("stations_in_order", "J16", IN_ORDER)
def stations_in_order(star):
    k = F.col("c_custkey")
    p = star.table("customer").select(
        k.cast("bigint").alias("id"), F.concat(F.lit("역"), F.col("c_nationkey").cast("string")).alias("name"),
        (k % 40 * 110).cast("double").alias("x"), (F.floor(k / 40) * 130).cast("double").alias("y"),
    )
    p = p.withColumn("lon", F.lit(126.7001) + F.col("x") / 88000.0).withColumn("lat", F.lit(37.0001) + F.col("y") / 111000.0)
    return spatial.merge_in_order(p).select("id", "group_id")


def _rail(star):
    """Station nodes, entrances and stop positions from customers; a route or a stop area from each of some orders."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    name = F.concat(F.lit("당산"), n.cast("string"), F.lit("역"))
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "station").when(F.col("c_mktsegment") == "MACHINERY", "subway_entrance").otherwise("")
    tags = F.create_map(
        F.lit("railway"), kind, F.lit("name"), F.when(kind == "subway_entrance", F.concat(name, F.lit(" 1번 출구"))).otherwise(name),
        F.lit("line"), F.when(F.col("c_acctbal") > 5000, F.concat(F.col("c_nationkey") % 9 + 1, F.lit("호선"))).otherwise(""),
    )
    nodes = star.table("customer").select(k.alias("id"), (F.lit(126.7) + (k % 40) / 1000.0).alias("lon"), (F.lit(37.0) + F.floor(k / 40) / 1000.0).alias("lat"), tags.alias("tags"))
    o, c = star.table("orders"), F.col("o_custkey")

    def members(*refs):
        return F.array(*[F.struct(F.lit("n").alias("type"), r.alias("ref"), F.lit("").alias("role")) for r in refs]).alias("members")

    routes = o.filter("o_orderpriority = '1-URGENT' and o_totalprice > 300000").select(
        F.col("o_orderkey").alias("id"), F.create_map(F.lit("route"), F.lit("subway"), F.lit("name"), F.lit("GTX-A 급행")).alias("tags"), members(c)
    )
    areas = o.filter("o_orderpriority = '2-HIGH' and o_totalprice > 400000").select(
        F.col("o_orderkey").alias("id"),
        F.create_map(F.lit("public_transport"), F.lit("stop_area"), F.lit("name"), F.concat(F.lit("당산"), (F.col("o_orderkey") % 200).cast("string"))).alias("tags"),
        members(c, c + 1, c + 2),
    )
    return nodes, routes.unionByName(areas)


RAIL = """node AS (SELECT c_custkey AS id, '당산' || c_nationkey AS name, c_mktsegment = 'BUILDING' AS station, c_mktsegment = 'MACHINERY' AS gate, CASE WHEN c_acctbal > 5000 THEN '' || (c_nationkey % 9 + 1) END AS line FROM customer),
route_member AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 300000),
area_member AS (SELECT DISTINCT o_orderkey AS area, o_custkey + i AS id FROM orders, (VALUES (0), (1), (2)) v(i) WHERE o_orderpriority = '2-HIGH' AND o_totalprice > 400000),
area_line AS (SELECT area, line FROM area_member JOIN node USING (id) WHERE line IS NOT NULL UNION SELECT area, 'GTX-A' FROM area_member JOIN route_member USING (id)),
in_area AS (SELECT id, area FROM node JOIN area_member USING (id) WHERE station UNION SELECT id, area FROM node JOIN (SELECT DISTINCT area FROM area_member) ON name = '당산' || (area % 200) WHERE station),
line AS (SELECT id, line FROM node WHERE station AND line IS NOT NULL UNION SELECT id, 'GTX-A' FROM node JOIN route_member USING (id) WHERE station UNION SELECT id, line FROM in_area JOIN area_line USING (area))"""


@query("station_lines", "J13 P4 F12", f"""WITH {RAIL} SELECT id, any_value(name) AS name, string_agg(line.line, ',' ORDER BY line.line) AS lines FROM line JOIN node USING (id) GROUP BY 1""")
def station_lines(star):
    nodes, relations = _rail(star)
    return st.station_lines(nodes, relations).select("id", "name", F.concat_ws(",", "lines").alias("lines"))


@query("station_entrances", "J14 N6", f"""WITH {RAIL}, grouped AS (SELECT id, name, min(id) OVER (PARTITION BY name) AS group_id FROM node WHERE station),
of_group AS (SELECT DISTINCT group_id, area FROM grouped JOIN area_member USING (id) UNION SELECT DISTINCT group_id, area FROM grouped JOIN (SELECT DISTINCT area FROM area_member) ON name = '당산' || (area % 200)),
by_area AS (SELECT DISTINCT group_id, g.id AS endpoint FROM of_group JOIN area_member USING (area) JOIN node g USING (id) WHERE g.gate),
by_name AS (SELECT DISTINCT group_id, g.id AS endpoint FROM grouped s JOIN node g ON contains(g.name || '역1번출구', s.name) WHERE g.gate AND group_id NOT IN (SELECT group_id FROM by_area))
SELECT group_id, endpoint, 'entrance' AS endpoint_type FROM by_area UNION ALL SELECT group_id, endpoint, 'entrance' FROM by_name
UNION ALL SELECT group_id, id, 'station_point' FROM grouped WHERE group_id NOT IN (SELECT group_id FROM by_area UNION SELECT group_id FROM by_name)""")
def station_entrances(star):
    nodes, relations = _rail(star)
    s = st.station_nodes(nodes)
    heads = s.groupBy("name").agg(F.min("id").alias("group_id"))
    grouped = s.join(heads, "name").select("id", "name", "group_id", "lon", "lat")
    gates = st.entrances(grouped.select("id", "name", "group_id"), nodes, relations)
    return st.endpoints(grouped, gates).select("group_id", "endpoint", "endpoint_type")


@query("transport_applied", "J12 W7 C3", f"""WITH {COMPLEX}, w AS (SELECT l_suppkey AS complex_id, l_linenumber || '역' AS station, min(CAST(floor(l_extendedprice / 90) + 1 AS BIGINT)) AS m FROM lineitem GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY complex_id ORDER BY m, station) AS r FROM w)
SELECT complex_id, '' || replace(station, '역', '') AS station, '2,9' || replace(station, '역', '') AS station_display, m / 1000 AS station_distance_km, (SELECT count(*) FROM w x WHERE x.complex_id = complex.complex_id) AS station_count
FROM complex JOIN n USING (complex_id) WHERE r = 1""")
def transport_applied(star):
    walks = star.table("lineitem").groupBy(F.col("l_suppkey").alias("complex_id"), F.concat(F.col("l_linenumber").cast("string"), F.lit("역")).alias("station")).agg(
        F.min((F.floor(F.col("l_extendedprice") / 90) + 1).cast("bigint")).alias("distance_m")
    )
    walks = walks.withColumn("lines", F.array(F.lit("2"), F.lit("9"))).withColumn("minutes", F.round(F.col("distance_m") / 65, 1))
    links = star.complexes.select("complex_id", F.lit("linked").alias("status"))
    out, _ = en.apply_transport(star.complexes, links, walks)
    return out.select("complex_id", "station", "station_display", "station_distance_km", "station_count")
