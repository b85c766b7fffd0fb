"""Walks from complexes to stations over the walking network."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hanok.functions import fixed_values as fv
from hanok.functions.geodesy import grid_point
from hanok.functions.places import inside_box, plane_x, plane_y, walkable
from hanok.operators import graph, guards, spatial
from hanok.operators import stations as st
from hanok.operators.enrich import apply_transport
from hanok.plans.official import Outcome
from hanok.session import cut

CENTRE = ((fv.NETWORK_BOX[0] + fv.NETWORK_BOX[2]) / 2, (fv.NETWORK_BOX[1] + fv.NETWORK_BOX[3]) / 2)


def with_plane(df: DataFrame, centre=None) -> DataFrame:
    """``x`` and ``y`` in metres: in the national grid, or around a ``centre`` (lon, lat) where one is given."""
    if centre:
        return df.withColumn("x", plane_x("lon", "lat", *centre)).withColumn("y", plane_y("lat", centre[1]))
    at = df.withColumn("_p", grid_point("lon", "lat"))
    return at.withColumn("x", F.col("_p.x")).withColumn("y", F.col("_p.y")).drop("_p")


def network(ways: DataFrame, box=fv.NETWORK_BOX) -> DataFrame:
    """Edges of the ways open on foot with at least one node in the box; ``ways(way_id, nodes<id,lon,lat>, tags)``."""
    inside = F.exists("nodes", lambda n: inside_box(n["lon"], n["lat"], box))
    at = F.transform("nodes", lambda n: F.struct(n["id"].alias("id"), grid_point(n["lon"], n["lat"]).alias("p")))
    plane = F.transform(at, lambda n: F.struct(n["id"].alias("id"), n["p"]["x"].alias("x"), n["p"]["y"].alias("y")))
    return spatial.way_edges(ways.filter(walkable("tags") & inside).select("way_id", plane.alias("nodes")))


def station_groups(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """Live stations with lines, same-name neighbours merged in the order of their ids; one row per node with its ``group_id``."""
    live = cut(with_plane(st.station_lines(nodes, relations)))
    groups = spatial.merge_in_order(live.select("id", "name", "x", "y", "lon", "lat"))
    return live.join(groups.select("id", "group_id"), "id").select("id", "name", "group_id", "lon", "lat", "x", "y", "lines")


def link_stations(complexes: DataFrame, official_points: DataFrame, nodes: DataFrame, ways: DataFrame, relations: DataFrame, prior_links: DataFrame | None = None) -> Outcome:
    """Every complex with the stations within walking reach.

    ``official_points`` has (complex_id, lon, lat), or (complex_id, x, y) in the grid of the register. ``walks`` carry the
    length of both connectors and the nodes of the route.
    """
    if "lon" not in official_points.columns:
        official_points = st.official_points(official_points)
    nodes = nodes.filter(inside_box("lon", "lat", fv.NETWORK_BOX))
    # the network, the stations and the walks are each used several times below: written once
    edges = cut(network(ways))
    grouped = cut(station_groups(nodes, relations))
    gates = st.entrances(grouped.select("id", "name", "group_id"), nodes, relations)
    ends = with_plane(st.endpoints(grouped, gates))
    snapped_ends = spatial.snap(ends, edges, fv.SNAP_ENDPOINT_M)
    tails = spatial.starts(snapped_ends.withColumn("key", F.struct("group_id", "endpoint")), "key").select(
        F.col("key.group_id").alias("station"), F.col("key.endpoint").alias("endpoint"), "node", "dist"
    )
    located = st.choose_coordinates(complexes, official_points)
    origins = with_plane(located.filter("coordinate_source is not null").select("complex_id", "lon", "lat"))
    snapped = cut(spatial.snap(origins, edges, fv.SNAP_ORIGIN_M))
    entry = spatial.starts(snapped, "complex_id").select(F.col("complex_id").alias("source"), "node", "dist")
    paths = graph.bounded_paths(entry, edges.select("a", "b", "length"), fv.WALK_LIMIT_M)
    walks = cut(st.reach(paths, tails))
    facts = grouped.select("group_id", "name", F.explode("lines").alias("line")).groupBy("group_id").agg(
        F.min("name").alias("name"), F.array_sort(F.collect_set("line")).alias("lines")
    )
    named = walks.join(facts, walks.station == facts.group_id).select(
        F.col("source").alias("complex_id"), F.concat("name", F.lit("역")).alias("station"), "lines", "distance_m", "minutes", "endpoint",
        "node", walks.station.alias("group_id"),
    )
    # stations of one name count once per complex, by the shortest walk
    facts_of_walk = F.struct("lines", "distance_m", "minutes", "endpoint", "node", "group_id")
    best = cut(named.groupBy("complex_id", "station").agg(F.min_by(facts_of_walk, F.struct("distance_m", "endpoint")).alias("w")).select("complex_id", "station", "w.*"))
    connectors = snapped_ends.select("group_id", "endpoint", F.round("connector", 1).alias("end_connector_m")).distinct()
    begins = snapped.select("complex_id", F.round("connector", 1).alias("start_connector_m"))
    goals = best.select(F.col("complex_id").alias("source"), F.col("station").alias("goal"), "node")
    followed = graph.routes(paths, goals).select(F.col("source").alias("complex_id"), F.col("goal").alias("station"), F.col("nodes").alias("route_nodes"))
    nearest = cut(
        best.join(connectors, ["group_id", "endpoint"]).join(begins, "complex_id").join(followed, ["complex_id", "station"])
        .select("complex_id", "station", "lines", "distance_m", "minutes", "endpoint", "start_connector_m", "end_connector_m", "route_nodes")
    )
    links = st.link_status(located, snapped, nearest)
    out, problems = apply_transport(complexes.drop("station", "station_display"), links, nearest)
    problems = [problems]
    if prior_links is not None:
        problems.append(guards.linked_share(prior_links, nearest, "complex_id"))
    return Outcome({"complexes": out, "walks": nearest, "links": links}, {"status": links.groupBy("status").agg(F.count("*").alias("n"))}, problems)
