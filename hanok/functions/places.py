"""Regions, tiers, rail lines and plane geometry."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hanok.functions import fixed_values as fv
from hanok.functions.months import col, let
from hanok.functions.text import drop_prefix, drop_suffix, station_name


def region_tags(region, district, dong) -> Column:
    """City, its district, and the two extra names used as filters."""
    r = col(region)
    tail = drop_prefix(drop_prefix(F.coalesce(col(district), F.lit("")), drop_suffix(r, "시")), F.lit("시"))
    return F.array_distinct(
        F.array_compact(
            F.array(
                r,
                F.when(tail.endswith("구"), tail),
                F.when(tail == "동탄구", "동탄시"),
                F.when(col(dong) == "평촌동", "평촌동"),
            )
        )
    )


def with_tier(df: DataFrame, region_tiers: DataFrame, dong_tiers: DataFrame) -> DataFrame:
    """Add ``tier``: the dong's own tier if it has one, else its region's, else null (unclassified).

    ``region_tiers(region, tier)`` and ``dong_tiers(region, legal_dong, tier)`` are small lookup tables.
    """
    by_dong = dong_tiers.select("region", "legal_dong", F.col("tier").alias("_dong_tier"))
    by_region = region_tiers.select("region", F.col("tier").alias("_region_tier"))
    return (
        df.join(by_dong, ["region", "legal_dong"], "left")
        .join(by_region, "region", "left")
        .withColumn("tier", F.coalesce("_dong_tier", "_region_tier"))
        .drop("_dong_tier", "_region_tier")
    )


def tag_name(tags) -> Column:
    t = col(tags)
    return station_name(F.coalesce(F.element_at(t, F.lit("name:ko")), F.element_at(t, F.lit("name"))))


NUMBERED_LINE = r"(?<![0-9])[1-9]\s*(?:호선|Line)|(?:Line|LINE)\s*[1-9](?![0-9])"


def line_labels(tags) -> Column:
    """Sorted line labels named in the tags of a station, stop area or route. A station name is not a line."""
    t = col(tags)

    def tag(key):
        return F.element_at(t, F.lit(key))

    keys = ("name:ko", "name", "ref", "line", "network", "operator", "route")
    text = F.concat_ws(" ", *[F.coalesce(tag(k), F.lit("")) for k in keys])
    bare_ref = F.when((tag("route") == "subway") & tag("ref").rlike("^[1-9]$"), tag("ref"))
    tokens = F.array(*[F.struct(F.lit(a).alias("token"), F.lit(b).alias("label")) for a, b in fv.LINE_TOKENS])

    def labels(s):
        numbered = F.regexp_extract_all(s, F.lit(NUMBERED_LINE), F.lit(0))
        digits = F.transform(numbered, lambda m: F.regexp_extract(m, "[1-9]", 0))
        named = F.transform(F.filter(tokens, lambda x: F.contains(s, x["token"])), lambda x: x["label"])
        return F.concat(digits, named)

    def checked(found, s):
        # "Shinbundang" holds the word "Bundang": drop the other line unless it is named by itself.
        only_new = F.array_contains(found, "신분당") & ~s.rlike(r"수인|(?<!신)분당|(?<!Shin)Bundang")
        return F.when(only_new, F.array_remove(found, "수인분당")).otherwise(found)

    found = let(text, lambda s: let(labels(s), lambda f: checked(f, s)))
    return F.array_sort(F.array_distinct(F.concat(found, F.array_compact(F.array(bare_ref)))))


EARTH_RADIUS_M = 6371008.8


def plane_x(lon, lat, lon0: float, lat0: float) -> Column:
    """Metres east of (lon0, lat0), local equirectangular; below 1 m off over 1.3 km within one degree of lat0."""
    return (col(lon) - F.lit(lon0)) * F.lit(EARTH_RADIUS_M * math.pi / 180.0 * math.cos(math.radians(lat0)))


def plane_y(lat, lat0: float) -> Column:
    return (col(lat) - F.lit(lat0)) * F.lit(EARTH_RADIUS_M * math.pi / 180.0)


def along_segment(px, py, ax, ay, bx, by) -> Column:
    """Share (0..1) of the way from a to b of the point of segment ab nearest to p."""
    px, py, ax, ay, bx, by = (col(c) for c in (px, py, ax, ay, bx, by))
    dx, dy = bx - ax, by - ay
    squared = dx * dx + dy * dy
    t = ((px - ax) * dx + (py - ay) * dy) / F.nullif(squared, F.lit(0.0))
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)), F.lit(0.0))


def segment_distance(px, py, ax, ay, bx, by) -> Column:
    t = along_segment(px, py, ax, ay, bx, by)
    px, py, ax, ay, bx, by = (col(c) for c in (px, py, ax, ay, bx, by))
    ex, ey = px - (ax + t * (bx - ax)), py - (ay + t * (by - ay))
    return F.sqrt(ex * ex + ey * ey)


def walkable(tags) -> Column:
    """Ways open to people on foot."""
    t = col(tags)
    highway = F.element_at(t, F.lit("highway"))
    foot = F.coalesce(F.element_at(t, F.lit("foot")), F.lit(""))
    access = F.coalesce(F.element_at(t, F.lit("access")), F.lit(""))
    closed = foot.isin(*fv.FOOT_DENIED) | (access.isin(*fv.FOOT_DENIED) & ~foot.isin(*fv.FOOT_ALLOWED))
    fast = highway.isin(*fv.FOOT_ONLY_IF_ALLOWED) & ~foot.isin("yes", "designated")
    return F.coalesce(highway.isin(*fv.WALK_HIGHWAYS) & ~closed & ~fast, F.lit(False))


def inside_box(lon, lat, box=fv.NETWORK_BOX) -> Column:
    return col(lon).between(box[0], box[2]) & col(lat).between(box[1], box[3])


def live_station(tags) -> Column:
    """A named station that is in use."""
    t = col(tags)
    gone = [F.coalesce(F.element_at(t, F.lit(k)).isin(*fv.NOT_LIVE_VALUES), F.lit(False)) for k in fv.NOT_LIVE_KEYS]
    out = F.element_at(t, F.lit("railway")).isin("station", "halt") & (tag_name(tags) != "")
    for g in gone:
        out = out & ~g
    return F.coalesce(out, F.lit(False))
