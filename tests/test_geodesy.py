import math

import pytest
from pyspark.sql import functions as F

from hanok.functions import geodesy as gd
from hanok.operators.stations import official_points

# Published examples: the British grid, and a point of the New York zone on the Clarke 1866 ellipsoid.
BRITISH = gd.Grid(gd.Ellipsoid(6377563.396, 299.32496), 49.0, -2.0, 0.9996012717, 400_000.0, -100_000.0)
CLARKE = gd.Grid(gd.Ellipsoid(6378206.4, 294.978698214), 0.0, -75.0, 0.9996, 0.0, 0.0)


def one(spark, column):
    return spark.range(1).select(column.alias("p")).first().p


@pytest.mark.parametrize("grid, lon, lat, x, y", [(BRITISH, 0.5, 50.5, 577274.99, 69740.50), (CLARKE, -73.5, 40.5, 127106.5, 4484124.4)])
def test_published_points(spark, grid, lon, lat, x, y):
    p = one(spark, gd.grid_point(F.lit(lon), F.lit(lat), grid))
    assert (p.x, p.y) == (pytest.approx(x, abs=0.06), pytest.approx(y, abs=0.06))
    back = one(spark, gd.grid_lonlat(F.lit(p.x), F.lit(p.y), grid))
    assert (back.lon, back.lat) == (pytest.approx(lon, abs=1e-9), pytest.approx(lat, abs=1e-9))


def test_published_shift(spark):
    at = F.struct(F.lit(3657660.66).alias("x"), F.lit(255768.55).alias("y"), F.lit(5201382.11).alias("z"))
    p = one(spark, gd.shifted(at, (0.0, 0.0, 4.5, 0.0, 0.0, 0.554, 0.219)))
    assert (p.x, p.y, p.z) == (pytest.approx(3657660.78, abs=0.01), pytest.approx(255778.43, abs=0.01), pytest.approx(5201387.75, abs=0.01))


def test_northing_is_the_length_of_the_meridian(spark):
    e2, a, steps = gd.GRS80.e**2, gd.GRS80.a, 20_000
    lo, hi = math.radians(38.0), math.radians(37.5)
    width = (hi - lo) / steps
    arc = sum(a * (1 - e2) / (1 - e2 * math.sin(lo + (i + 0.5) * width) ** 2) ** 1.5 * width for i in range(steps))
    p = one(spark, gd.grid_point(F.lit(127.5), F.lit(37.5)))
    assert p.x == pytest.approx(1_000_000.0, abs=1e-6) and p.y == pytest.approx(2_000_000.0 + 0.9996 * arc, abs=1e-3)


def test_official_points_reach_the_box(spark):
    rows = spark.createDataFrame([("A", 200_000.0, 450_000.0), ("B", None, 1.0)], "complex_id string, x double, y double")
    got = {r.complex_id: r for r in official_points(rows).collect()}
    assert (got["B"].lon, got["B"].lat) == (None, None)
    # the old datum lies some 300 m from WGS 84 here: the shift is applied, and in the right direction
    unshifted = one(spark, gd.grid_lonlat(F.lit(200_000.0), F.lit(450_000.0), gd.Grid(*[getattr(gd.OFFICIAL_GRID, f) for f in ("ellipsoid", "lat0", "lon0", "scale", "x0", "y0")])))
    east, north = (got["A"].lon - unshifted.lon) * 88_000, (got["A"].lat - unshifted.lat) * 111_000
    assert -260 < east < -120 and 250 < north < 360


def test_distances_in_the_national_grid(spark):
    a, b = (one(spark, gd.grid_point(F.lit(lon), F.lit(37.5))) for lon in (127.0, 127.01))
    normal = gd.GRS80.a / math.sqrt(1 - gd.GRS80.e**2 * math.sin(math.radians(37.5)) ** 2)
    along = normal * math.cos(math.radians(37.5)) * math.radians(0.01)
    factor = math.hypot(a.x - b.x, a.y - b.y) / along
    assert 0.9996 < factor < 0.99965
