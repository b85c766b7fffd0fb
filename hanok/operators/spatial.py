"""Nearest segment within a limit, and merging of near points of the same name."""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hanok.functions import fixed_values as fv
from hanok.functions.places import along_segment, segment_distance
from hanok.operators.graph import connected_groups
from hanok.session import settled

#: Points of one name that a task walks through at once.
MERGE_BLOCK = 100_000


def cell(x, size: float) -> Column:
    return F.floor((F.col(x) if isinstance(x, str) else x) / size)


def way_edges(ways: DataFrame) -> DataFrame:
    """Undirected edges of the walking network with end coordinates and length.

    ``ways(way_id, nodes ARRAY<STRUCT<id, x, y>>)``: consecutive nodes of a way, lengths in (0, 5000] m, each pair of
    nodes once (the pair's own coordinates decide the length, so copies agree).
    """
    n = F.col("nodes")
    steps = F.arrays_zip(F.slice(n, F.lit(1), F.size(n) - 1).alias("a"), F.slice(n, F.lit(2), F.size(n) - 1).alias("b"))
    pairs = ways.filter(F.size("nodes") > 1).select(F.explode(steps).alias("s")).select("s.a", "s.b")
    forward = F.col("a.id") < F.col("b.id")
    lo = F.when(forward, F.col("a")).otherwise(F.col("b"))
    hi = F.when(forward, F.col("b")).otherwise(F.col("a"))
    ends = pairs.filter(F.col("a.id") != F.col("b.id")).select(lo.alias("lo"), hi.alias("hi"))
    dx, dy = F.col("lo.x") - F.col("hi.x"), F.col("lo.y") - F.col("hi.y")
    flat = ends.select(
        F.col("lo.id").alias("a"), F.col("hi.id").alias("b"), F.col("lo.x").alias("ax"), F.col("lo.y").alias("ay"),
        F.col("hi.x").alias("bx"), F.col("hi.y").alias("by"), F.sqrt(dx * dx + dy * dy).alias("length"),
    )
    kept = flat.filter((F.col("length") > 0) & (F.col("length") <= fv.EDGE_MAX_M))
    rest = F.struct("ax", "ay", "bx", "by", "length")
    return kept.groupBy("a", "b").agg(F.min(rest).alias("e")).select("a", "b", "e.*")


def snap(points: DataFrame, edges: DataFrame, limit: float) -> DataFrame:
    """Nearest edge of each point within ``limit``: connector length, and the ways to both ends.

    Edges are cut into pieces no longer than a cell (cell side = limit) and registered in the cells of each piece;
    a point looks into its own and the eight neighbouring cells. Points at the same place are looked up once. A pair
    meets only if edge and point lie within a cell of each other.
    """
    size = float(limit)
    pieces = F.greatest(F.ceil(F.col("length") / size), F.lit(1)).cast("int")
    cut = edges.select("*", pieces.alias("_n")).select("*", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_i"))

    def at(lo, hi, i):
        return F.col(lo) + (F.col(hi) - F.col(lo)) * (i / F.col("_n"))

    x0, x1 = at("ax", "bx", F.col("_i")), at("ax", "bx", F.col("_i") + 1)
    y0, y1 = at("ay", "by", F.col("_i")), at("ay", "by", F.col("_i") + 1)

    def span(lo, hi):
        return F.sequence(cell(F.least(lo, hi), size), cell(F.greatest(lo, hi), size))

    columns = ["a", "b", "ax", "ay", "bx", "by", "length"]
    registered = (
        cut.select(*columns, span(x0, x1).alias("xs"), span(y0, y1).alias("ys"))
        .select(*columns, F.explode("xs").alias("cx"), "ys")
        .select(*columns, "cx", F.explode("ys").alias("cy"))
        .distinct()
    )
    places = points.select("x", "y").distinct()
    around = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    probes = (
        places.select("x", "y", F.explode(F.transform(around, lambda d: cell("x", size) + d)).alias("cx"))
        .select("x", "y", "cx", F.explode(F.transform(around, lambda d: cell("y", size) + d)).alias("cy"))
    )
    distance = segment_distance("x", "y", "ax", "ay", "bx", "by")
    share = along_segment("x", "y", "ax", "ay", "bx", "by")
    near = (
        probes.join(registered, ["cx", "cy"])
        .withColumn("connector", distance)
        .filter(F.col("connector") <= limit)
        .withColumn("offset", share * F.col("length"))
        .groupBy("x", "y")
        .agg(F.min(F.struct("connector", "a", "b", "offset", "length")).alias("m"))
    )
    return points.join(near, ["x", "y"]).select(
        *points.columns, F.col("m.connector").alias("connector"), F.col("m.a").alias("a"), F.col("m.b").alias("b"),
        (F.col("m.connector") + F.col("m.offset")).alias("to_a"),
        (F.col("m.connector") + F.col("m.length") - F.col("m.offset")).alias("to_b"),
    )


def starts(snapped: DataFrame, key: str) -> DataFrame:
    """Two entry nodes per snapped point with the distance to each."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("to_a").alias("dist")), F.struct(F.col("b").alias("node"), F.col("to_b").alias("dist"))))
    return snapped.select(key, "connector", ends.alias("e")).select(key, "connector", "e.node", "e.dist")


def merge_same_name(points: DataFrame, limit: float = fv.MERGE_STATION_M) -> DataFrame:
    """Group points of one name that are less than ``limit`` apart, directly or through others of that name.

    ``points(id, name, x, y)`` gains ``group_id``, the smallest id of its group. A cell is small enough that all
    points in it belong together, so a cell is one member however many points it holds; points meet pairwise only
    across cells, and only the distinct places of a cell. Chains are joined as connected groups, which does not depend
    on the order of the points.
    """
    side = limit / 1.4143  # diagonal below the limit
    placed = points.withColumn("cx", cell("x", side)).withColumn("cy", cell("y", side))
    heads = placed.groupBy("name", "cx", "cy").agg(F.min("id").alias("head"))
    spots = placed.select("name", "cx", "cy", "x", "y").distinct()
    reach = F.array(*[F.lit(d) for d in range(-2, 3)])
    probe = (
        spots.select("name", "cx", "cy", "x", "y", F.explode(F.transform(reach, lambda d: F.col("cx") + d)).alias("ox"))
        .select("name", "cx", "cy", "x", "y", "ox", F.explode(F.transform(reach, lambda d: F.col("cy") + d)).alias("oy"))
        .filter((F.col("ox") > F.col("cx")) | ((F.col("ox") == F.col("cx")) & (F.col("oy") > F.col("cy"))))
    )
    other = spots.select("name", F.col("cx").alias("ox"), F.col("cy").alias("oy"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    dx, dy = F.col("x") - F.col("x2"), F.col("y") - F.col("y2")
    linked = probe.join(other, ["name", "ox", "oy"]).filter(F.sqrt(dx * dx + dy * dy) < limit).select("name", "cx", "cy", "ox", "oy").distinct()
    a = heads.select("name", "cx", "cy", F.col("head").alias("a"))
    b = heads.select("name", F.col("cx").alias("ox"), F.col("cy").alias("oy"), F.col("head").alias("b"))
    links = linked.join(a, ["name", "cx", "cy"]).join(b, ["name", "ox", "oy"]).select("a", "b")
    groups = connected_groups(heads.select(F.col("head").alias("id")), links)
    return (
        placed.join(heads, ["name", "cx", "cy"])
        .join(groups.select(F.col("id").alias("head"), "group_id"), "head")
        .select(*points.columns, "group_id")
    )


def _founders(limit: float) -> Callable[[pa.Table], pa.Table]:
    """Of one name's next points, none of them taken in by an earlier group: those that found one, met in their order."""

    def founders(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("n", "ascending")])
        fine: dict[tuple, tuple] = {}  # at most one founder per cell
        coarse: set[tuple] = set()
        new = []
        for i, (cx, cy, x, y, *place) in enumerate(zip(*[rows[c].to_pylist() for c in ("cx", "cy", "x", "y", "bx", "by")], strict=True)):
            if tuple(place) in coarse:
                continue
            around = (fine.get((cx + dx, cy + dy)) for dx in range(-2, 3) for dy in range(-2, 3))
            if not any(f and math.sqrt((x - f[0]) ** 2 + (y - f[1]) ** 2) < limit for f in around):
                fine[cx, cy] = x, y
                coarse.add(tuple(place))
                new.append(i)
        return rows.take(pa.array(new, pa.int64()))

    return founders


def merge_in_order(points: DataFrame, limit: float = fv.MERGE_STATION_M, order: str = "id", block: int = MERGE_BLOCK) -> DataFrame:
    """Merge points of one name as they come: a point joins the first group of its name founded less than ``limit`` from
    it, else the group that was founded in its 0.01 degree cell, else it founds a group.

    ``points(id, name, x, y, lon, lat)`` and the unique ``order`` gain ``group_id``, the id of the founder; distances are
    measured to founders only. Each name is cut into blocks of ``block`` points by their order. A round takes the next block
    of every name: joins drop the points that an earlier founder takes in, and one task a name walks through the rest,
    which needs no more memory than a block. So rounds follow the largest name's number of blocks, not the length of the
    chains of points that wait for each other. At most one founder lies in a cell (diagonal below ``limit``), and points
    meet founders only. Ties of the degree cell are rounded half to even on the written digits. Rows without a place are
    groups of their own.
    """
    side = limit / 1.4143
    fine, coarse = ["name", "cx", "cy"], ["name", "bx", "by"]
    placed = settled(points.select(
        F.col("id"), F.col(order).alias("at"), F.coalesce("name", F.lit("")).alias("name"), "x", "y", cell("x", side).alias("cx"), cell("y", side).alias("cy"),
        F.bround("lon", 2).alias("bx"), F.bround("lat", 2).alias("by"),
    ).filter("x is not null and y is not null and lon is not null and lat is not null"))
    reach = F.array(*[F.lit(d) for d in range(-2, 3)])

    def around(founders: DataFrame) -> DataFrame:
        """Every founder once for each cell around its own."""
        f = founders.select("name", F.col("cx").alias("ox"), F.col("cy").alias("oy"), *[F.col(c).alias(f"f_{c}") for c in ("id", "at", "x", "y")])
        wide = f.select("*", F.explode(F.transform(reach, lambda d: F.col("ox") + d)).alias("cx"))
        return wide.select("*", F.explode(F.transform(reach, lambda d: F.col("oy") + d)).alias("cy")).drop("ox", "oy")

    def near(x="f_x", y="f_y") -> Column:
        dx, dy = F.col("x") - F.col(x), F.col("y") - F.col(y)
        return F.sqrt(dx * dx + dy * dy) < limit

    everything = ["id", "at", *fine, "x", "y", "bx", "by", "n"]
    number = F.row_number().over(Window.partitionBy("name").orderBy("at", "id", "x", "y", "bx", "by")).cast("bigint") - 1
    numbered = settled(placed.withColumn("n", number))
    last = numbered.agg(F.max("n")).first()[0]
    if last is None:
        return points.withColumn("group_id", F.col("id"))
    found = None
    for start in range(0, last + 1, block):
        opened = numbered.filter(F.col("n").between(start, start + block - 1))
        if found is not None:
            closed = opened.join(around(found), fine).filter(near()).select("id").unionByName(opened.join(found.select(*coarse), coarse).select("id"))
            opened = opened.join(closed.distinct(), "id", "left_anti")
        opened = opened.select(*everything)
        new = settled(opened.groupBy("name").applyInArrow(_founders(limit), opened.schema))
        found = new if found is None else found.unionByName(new)
    found = settled(found)
    by_place = placed.join(around(found), fine).filter(near() & (F.col("f_at") <= F.col("at"))).groupBy("id").agg(F.min_by("f_id", "f_at").alias("_place"))
    by_cell = found.select(*coarse, F.col("id").alias("_cell"))
    groups = placed.select("id", *coarse).join(by_place, "id", "left").join(by_cell, coarse, "left")
    chosen = groups.select("id", F.coalesce("_place", "_cell").alias("_group"))
    return points.join(chosen, "id", "left").select(*points.columns, F.coalesce("_group", "id").alias("group_id"))
