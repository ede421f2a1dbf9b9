"""Geometry as Column arithmetic over doubles and arrays of structs x, y."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Radii in metres, metres in a degree, the city's bounds and centre.
EARTH_M = 6371008.8
MERCATOR_M = 6378137.0
LON_M, LAT_M = 111320.0, 110540.0
BOUNDS = {"west": -79.8, "east": -79.0, "south": 43.4, "north": 43.9}
DOWNTOWN_BOUNDS = {"west": -79.41, "east": -79.36, "south": 43.63, "north": 43.68}
CENTRE = (43.6532, -79.3832)
# GRS80 and UTM zone 17.
SEMI_MAJOR, FLATTENING = 6378137.0, 1 / 298.257222101
MERIDIAN, SCALE, FALSE_EASTING = -81.0, 0.9996, 500000.0


def project(lon: Column, lat: Column) -> Column:
    """UTM zone 17 north, struct x, y, by Krüger's series to the sixth order in the third flattening."""
    n = FLATTENING / (2 - FLATTENING)
    radius = SEMI_MAJOR / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)
    a = (
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180 - 127 * n**5 / 288 + 7891 * n**6 / 37800,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440 + 281 * n**5 / 630 - 1983433 * n**6 / 1935360,
        61 * n**3 / 240 - 103 * n**4 / 140 + 15061 * n**5 / 26880 + 167603 * n**6 / 181440,
        49561 * n**4 / 161280 - 179 * n**5 / 168 + 6601661 * n**6 / 7257600,
        34729 * n**5 / 80640 - 3418889 * n**6 / 1995840,
        212378941 * n**6 / 319334400,
    )
    e = math.sqrt(FLATTENING * (2 - FLATTENING))
    phi, lam = F.radians(lat), F.radians(lon - F.lit(MERIDIAN))
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - F.lit(e) * F.atanh(F.lit(e) * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, alpha in enumerate(a, 1):
        x = x + F.lit(alpha) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + F.lit(alpha) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.struct((F.lit(FALSE_EASTING) + F.lit(SCALE * radius) * x).alias("x"), (F.lit(SCALE * radius) * y).alias("y"))


def from_mercator(x: Column, y: Column) -> Column:
    """Spherical Mercator metres as struct lon, lat."""
    return F.struct(
        F.degrees(x / F.lit(MERCATOR_M)).alias("lon"), F.degrees(F.atan(F.sinh(y / F.lit(MERCATOR_M)))).alias("lat")
    )


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(h))


def _steps(path: Column, length) -> Column:
    """Sum of ``length(a, b)`` over neighbouring points."""
    pairs = F.zip_with(F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(0))), F.slice(path, 2, F.greatest(F.size(path) - 1, F.lit(0))), length)
    return F.when(F.size(path) >= 2, F.aggregate(pairs, F.lit(0.0), lambda s, d: s + d)).otherwise(F.when(path.isNotNull(), 0.0))


def sphere_length(path: Column) -> Column:
    return _steps(path, lambda a, b: haversine(a["x"], a["y"], b["x"], b["y"]))


def plane_length(path: Column) -> Column:
    return _steps(path, lambda a, b: F.sqrt(F.pow(a["x"] - b["x"], 2) + F.pow(a["y"] - b["y"], 2)))


def flat_distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres on a local plane."""
    dx = (lon2 - lon1) * F.lit(LON_M) * F.cos(F.radians((lat1 + lat2) / 2))
    dy = (lat2 - lat1) * F.lit(LAT_M)
    return F.sqrt(dx * dx + dy * dy)


def bearing(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    d, p1, p2 = F.radians(lon2 - lon1), F.radians(lat1), F.radians(lat2)
    return F.degrees(F.atan2(F.sin(d) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(d)))


def moved(lon: Column, lat: Column, degrees: Column, metres: Column) -> Column:
    """The point that many metres away at a bearing, struct x, y."""
    r = F.radians(degrees)
    return F.struct(
        (lon + metres * F.sin(r) / (F.lit(LON_M) * F.cos(F.radians(lat)))).alias("x"), (lat + metres * F.cos(r) / F.lit(LAT_M)).alias("y")
    )


def circle(lon: Column, lat: Column, radius_deg: Column, sides: int = 24, stretch: float = 1.3) -> Column:
    """A closed ring around a point; latitudes are stretched."""
    def corner(i):
        angle = i * F.lit(2 * math.pi / sides)
        return F.struct((lon + radius_deg * F.cos(angle) * F.lit(stretch)).alias("x"), (lat + radius_deg * F.sin(angle)).alias("y"))

    return F.transform(F.sequence(F.lit(0), F.lit(sides)), lambda i: corner(F.pmod(i, F.lit(sides))))


def centroid(path: Column) -> Column:
    """Mean of the vertices, struct x, y."""
    n = F.size(path)
    mean = lambda f: F.aggregate(F.transform(path, lambda p: p[f]), F.lit(0.0), lambda s, v: s + v) / n
    return F.when(n > 0, F.struct(mean("x").alias("x"), mean("y").alias("y")))


def bounds(path: Column) -> Column:
    xs, ys = F.transform(path, lambda p: p["x"]), F.transform(path, lambda p: p["y"])
    return F.struct(
        F.array_min(xs).alias("west"), F.array_max(xs).alias("east"), F.array_min(ys).alias("south"), F.array_max(ys).alias("north")
    )


def within(lon: Column, lat: Column, box: dict) -> Column:
    return lon.between(box["west"], box["east"]) & lat.between(box["south"], box["north"])


def cell(x: Column, size) -> Column:
    return F.floor(x / size)


def tidy_ring(ring: Column, places: int = 5, least: int = 4) -> Column:
    """Rounded, without repeats of the vertex before; null if fewer than ``least`` vertices are left."""
    rounded = F.transform(ring, lambda p: F.struct(F.round(p["x"], places).alias("x"), F.round(p["y"], places).alias("y")))
    kept = F.filter(rounded, lambda p, i: (i == 0) | (p != F.get(rounded, i - 1)))
    return F.when(F.size(kept) >= least, kept)


def centre_km(lon: Column, lat: Column) -> Column:
    return F.sqrt(F.pow((lat - CENTRE[0]) * 111, 2) + F.pow((lon - CENTRE[1]) * 111 * F.cos(F.radians(lat)), 2))


def tile_row(zoom: Column, row: Column) -> Column:
    """Rows counted from the south as rows counted from the north, and back."""
    return (F.pow(F.lit(2), zoom) - 1 - row).cast("long")


def _along(px, py, ax, ay, bx, by) -> Column:
    """Where on a segment, from 0 to 1, the point nearest to another lies."""
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = F.when(length > 0, ((px - ax) * dx + (py - ay) * dy) / length).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))


def _to_place(px, py, ax, ay, bx, by, t) -> Column:
    """Squared distance of a point from the place ``t`` of a segment."""
    ex, ey = ax + t * (bx - ax) - px, ay + t * (by - ay) - py
    return ex * ex + ey * ey


def _side(ax, ay, bx, by, cx, cy) -> Column:
    return F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))


def _inside(ax, ay, bx, by, px, py) -> Column:
    return px.between(F.least(ax, bx), F.greatest(ax, bx)) & py.between(F.least(ay, by), F.greatest(ay, by))


def with_piece_distance(rows, *names: str):
    """Add ``distance`` of two segments whose ends' coordinates are the columns ax, ay, bx, by, cx, cy, dx, dy; zero if they have a point in common.

    Done in steps, each a projection of its own, so that no part of the expression is repeated.
    """
    a, b, c, d = (tuple(F.col(n) for n in names[i : i + 2]) for i in range(0, 8, 2))
    corners = ((a, c, d), (b, c, d), (c, a, b), (d, a, b))
    ends = ((a, b, c), (a, b, d), (c, d, a), (c, d, b))
    rows = rows.withColumns({f"_t{i}": _along(*r, *p, *q) for i, (r, p, q) in enumerate(corners)} | {f"_s{i}": _side(*p, *q, *r) for i, (p, q, r) in enumerate(ends)})
    rows = rows.withColumns({f"_d{i}": _to_place(*r, *p, *q, F.col(f"_t{i}")) for i, (r, p, q) in enumerate(corners)})
    s = [F.col(f"_s{i}") for i in range(4)]
    cross = (s[0] != s[1]) & (s[2] != s[3])
    for i, (p, q, r) in enumerate(ends):
        cross = cross | ((s[i] == 0) & _inside(*p, *q, *r))
    near = F.sqrt(F.least(*[F.col(f"_d{i}") for i in range(4)]))
    return rows.withColumn("distance", F.when(cross, 0.0).otherwise(near)).drop(*[f"_{k}{i}" for k in "tsd" for i in range(4)])
