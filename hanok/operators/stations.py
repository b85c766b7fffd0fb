"""Stations, their lines and entrances, and the walks from complexes to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hanok.functions import fixed_values as fv
from hanok.functions.geodesy import OFFICIAL_GRID, Grid, grid_lonlat
from hanok.functions.places import line_labels, live_station, tag_name


def station_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.filter(live_station("tags")).select("id", "lon", "lat", "tags", tag_name("tags").alias("name"))


def station_lines(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """Lines per station node: of its own tags, of the routes it is a member of, and of the stop areas that hold it
    (or carry its name): the lines of their members and of the routes through those. Nearness never gives a line.

    ``relations(id, tags, members ARRAY<STRUCT<type, ref, role>>)``. Members are exploded once and joined by id.
    """
    stations = station_nodes(nodes)
    own = stations.select("id", F.explode(line_labels("tags")).alias("line"))

    members = relations.select("id", "tags", F.explode("members").alias("m")).filter("m.type = 'n'").select(F.col("id").alias("relation"), F.col("m.ref").alias("ref"), "tags")
    is_route = F.coalesce(F.element_at("tags", F.lit("route")).isin(*fv.RAIL_ROUTES), F.lit(False))
    is_area = F.coalesce(F.element_at("tags", F.lit("public_transport")) == "stop_area", F.lit(False))
    route_members = members.filter(is_route).select("ref", F.explode(line_labels("tags")).alias("line")).distinct()
    by_route = stations.select("id").join(route_members.withColumnRenamed("ref", "id"), "id")

    area_members = members.filter(is_area).select(F.col("relation").alias("area"), "ref")
    member_tags = nodes.select(F.col("id").alias("ref"), F.explode(line_labels("tags")).alias("line"))
    area_lines = (
        area_members.join(member_tags, "ref").select("area", "line")
        .unionByName(area_members.join(route_members, "ref").select("area", "line"))
        .distinct()
    )
    held = stations.select("id").join(area_members.withColumnRenamed("ref", "id"), "id").select("id", "area").distinct()
    # a name may be that of many areas and of many stations: its lines are collected first, so that these never meet in pairs
    named = relations.filter(is_area).select(F.col("id").alias("area"), tag_name("tags").alias("name"))
    name_lines = named.join(area_lines, "area").select("name", "line").distinct()
    by_area = held.join(area_lines, "area").select("id", "line").unionByName(stations.join(name_lines, "name").select("id", "line"))
    lines = own.unionByName(by_route).unionByName(by_area).distinct().groupBy("id").agg(F.array_sort(F.collect_set("line")).alias("lines"))
    # a station without a recognised line, or without a Korean name, is not a commuter station
    return stations.join(lines, "id").filter(F.col("name").rlike("[가-힣]"))


def entrances(grouped: DataFrame, nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """Entrances (station, endpoint, lon, lat) of each station group.

    Members of a stop area that holds one of the group's nodes or carries its name; where there are none, entrances
    whose own name contains the station's. That second join meets on the first two characters of the station name.
    ``grouped(id, name, group_id)``.
    """
    gate = F.element_at("tags", F.lit("railway")) == "subway_entrance"
    gates = nodes.filter(gate).select(F.col("id").alias("endpoint"), "lon", "lat", tag_name("tags").alias("gate_name"))
    is_area = F.coalesce(F.element_at("tags", F.lit("public_transport")) == "stop_area", F.lit(False))
    areas = relations.filter(is_area).select(F.col("id").alias("area"), tag_name("tags").alias("name"), "members")
    refs = areas.select("area", F.explode("members").alias("m")).filter("m.type = 'n'").select("area", F.col("m.ref").alias("ref"))
    gates_of = refs.join(gates, F.col("ref") == F.col("endpoint")).select("area", "endpoint", "lon", "lat").distinct()
    held = grouped.join(refs.withColumnRenamed("ref", "id"), "id").select("group_id", "area").distinct().join(gates_of, "area")
    # areas and stations of one name never meet in pairs: the entrances of a name are collected first
    of_name = areas.select("area", "name").join(gates_of, "area").select("name", "endpoint", "lon", "lat").distinct()
    named = grouped.select("group_id", "name").distinct().join(of_name, "name")
    by_area = held.select("group_id", "endpoint", "lon", "lat").unionByName(named.select("group_id", "endpoint", "lon", "lat")).distinct()

    names = grouped.select("group_id", "name").distinct().join(by_area.select("group_id").distinct(), "group_id", "left_anti")

    def runs(text, n):
        last = F.length(text) - n
        grams = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.substr(text, i + 1, F.lit(n)))
        return F.when(last >= 0, grams).otherwise(F.array().cast("array<string>"))

    gate_runs = gates.withColumn("g", F.explode(F.array_distinct(F.concat(runs(F.col("gate_name"), 1), runs(F.col("gate_name"), 2)))))
    by_name = names.withColumn("g", F.substring("name", 1, 2)).join(gate_runs, "g").filter(F.contains("gate_name", F.col("name")))
    return by_area.withColumn("how", F.lit("area")).unionByName(
        by_name.select("group_id", "endpoint", "lon", "lat").distinct().withColumn("how", F.lit("name"))
    )


def endpoints(grouped: DataFrame, gates: DataFrame) -> DataFrame:
    """Where a walk may end: the entrances, or the station nodes themselves where no entrance is mapped.

    ``grouped(id, name, group_id, lon, lat)``.
    """
    with_gate = gates.select("group_id", "endpoint", "lon", "lat", F.lit("entrance").alias("endpoint_type"))
    bare = grouped.join(gates.select("group_id").distinct(), "group_id", "left_anti")
    return with_gate.unionByName(bare.select("group_id", F.col("id").alias("endpoint"), "lon", "lat", F.lit("station_point").alias("endpoint_type")))


def official_points(rows: DataFrame, grid: Grid = OFFICIAL_GRID) -> DataFrame:
    """(complex_id, lon, lat) of official points ``rows(complex_id, x, y)`` given in the grid of their register."""
    at = rows.select("complex_id", grid_lonlat(F.col("x").cast("double"), F.col("y").cast("double"), grid).alias("_p"))
    return at.select("complex_id", F.col("_p.lon").alias("lon"), F.col("_p.lat").alias("lat"))


def choose_coordinates(complexes: DataFrame, official: DataFrame, box=fv.COORDINATE_BOX) -> DataFrame:
    """Official point if it lies in the box, else the known one, else none: lon, lat and where they come from."""
    o = official.select("complex_id", F.col("lon").alias("_olon"), F.col("lat").alias("_olat"))
    joined = complexes.join(o, "complex_id", "left")
    inside = F.coalesce(
        (F.col("_olon") > box[0]) & (F.col("_olon") < box[2]) & (F.col("_olat") > box[1]) & (F.col("_olat") < box[3]), F.lit(False)
    )
    usable = F.coalesce((F.col("lon") != 0) & (F.col("lat") != 0), F.lit(False))
    source = F.when(inside, "official").when(usable, "existing")
    return joined.select(
        *[c for c in complexes.columns if c not in ("lon", "lat")],
        F.when(inside, F.col("_olon")).when(usable, F.col("lon")).alias("lon"),
        F.when(inside, F.col("_olat")).when(usable, F.col("lat")).alias("lat"),
        source.alias("coordinate_source"),
    )


def reach(paths: DataFrame, ends: DataFrame, limit: float = fv.WALK_LIMIT_M, speed: float = fv.WALK_SPEED) -> DataFrame:
    """Walk from each source to each station: shortest over its endpoints, whole metres up, still within the limit.

    ``paths(source, node, dist)`` and ``ends(station, endpoint, node, dist)``; the limit holds for path and last leg
    together, and again for the rounded-up distance. ``node`` is where the last leg leaves the network, ``exact_m`` the
    length before rounding.
    """
    tail = ends.select("station", "endpoint", "node", F.col("dist").alias("tail"))
    hits = paths.join(tail, "node").withColumn("total", F.col("dist") + F.col("tail")).filter(F.col("total") <= limit)
    best = hits.groupBy("source", "station").agg(F.min(F.struct("total", "endpoint", "node")).alias("m"))
    metres = F.ceil("m.total").cast("bigint")
    out = best.select(
        "source", "station", metres.alias("distance_m"),
        F.bround(F.col("m.total") / speed, 1).alias("minutes"), F.col("m.endpoint").alias("endpoint"),
        F.col("m.node").alias("node"), F.col("m.total").alias("exact_m"),
    )
    return out.filter(F.col("distance_m") <= limit)


def link_status(located: DataFrame, snapped: DataFrame, walks: DataFrame) -> DataFrame:
    """Status per complex: no coordinate, not on the network, nothing in reach, or linked."""
    on_net = snapped.select("complex_id", F.lit(True).alias("_snapped")).distinct()
    have = walks.select("complex_id", F.lit(True).alias("_walk")).distinct()
    status: Column = (
        F.when(F.col("coordinate_source").isNull(), "coordinate_unconfirmed")
        .when(F.col("_snapped").isNull(), "walk_network_unconnected")
        .when(F.col("_walk").isNull(), f"no_reachable_station_within_{fv.WALK_LIMIT_M}m")
        .otherwise("linked")
    )
    joined = located.join(on_net, "complex_id", "left").join(have, "complex_id", "left")
    return joined.select("complex_id", "coordinate_source", status.alias("status"))
