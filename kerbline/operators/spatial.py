"""Spatial joins on grid cells.

Every path is cut into two-point pieces, and long pieces into parts. A part is listed under each cell that its box touches, one side's box grown
by the largest distance asked for; parts meet on equal cells, once, and then the exact test decides. Crowded cells are split.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.functions import geo

METRIC_CRS, SOURCE_CRS = "EPSG:26917", "EPSG:4326"
THRESHOLDS = (2.0, 5.0, 10.0)
#: Pairs of parts that a cell may hold before it is split into FINER by FINER cells.
CROWDED, FINER = 1_000_000, 4


# EPSG's codes of projected systems whose axes are in metres, as ranges of UTM and state or national grids and single ones.
METRE_SYSTEMS = (
    (2031, 2032), (2056, 2056), (2154, 2154), (2193, 2193), (2945, 2962), (3005, 3005), (3034, 3035), (3067, 3067), (3153, 3153), (3158, 3161), (3347, 3348), (3395, 3395), (3577, 3577), (3857, 3857), (3978, 3979),
    (5041, 5042), (5070, 5070), (6931, 6933), (7846, 7859), (25828, 25838), (26901, 26923), (27700, 27700), (28348, 28358), (31370, 31370), (32601, 32660), (32661, 32661), (32701, 32760), (32761, 32761),
)


def is_projected(crs: str) -> bool:
    """Whether an ``EPSG:n`` names a projected system in metres that is known here; geographic ones, those in feet and unknown ones are not."""
    authority, _, code = crs.upper().partition(":")
    return authority == "EPSG" and code.isascii() and code.isdigit() and any(a <= int(code) <= b for a, b in METRE_SYSTEMS)


def require_metric(crs: str) -> None:
    """Refuse a geographic or unknown system, whose distances aren't metres."""
    if not is_projected(crs):
        raise ValueError(f"distance matching requires a projected CRS in metres, not {crs}")


def refused(rows: DataFrame) -> DataFrame:
    """(crs, refused): of rows with a ``crs``, how many of each system metric matching refuses."""
    number = F.when(F.upper("crs").rlike("^EPSG:[0-9]+$"), F.expr("try_cast(substring_index(crs, ':', -1) as int)"))
    projected = F.lit(False)
    for a, b in METRE_SYSTEMS:
        projected = projected | number.between(a, b)
    return rows.where(~F.coalesce(projected, F.lit(False))).groupBy("crs").agg(F.count("*").alias("refused"))


def _pieces(rows: DataFrame, key: str, prefix: str, grow: float, size: float) -> DataFrame:
    """One row per part of a piece and cell (i, j) of rows (key, path); a single point is a piece of no length,
    and one without finite ends is near nothing.

    Pieces longer than a cell are cut into parts no longer than that, so a long diagonal is listed where it runs and not all over its box. A part
    keeps the ends of its piece for the exact test, and the corners of its own box, grown by ``grow``.
    """
    n = F.size("path")
    ends = F.zip_with(F.when(n > 1, F.slice("path", 1, n - 1)).otherwise(F.col("path")), F.when(n > 1, F.slice("path", 2, n - 1)).otherwise(F.col("path")), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    p = rows.where("size(path) > 0").select(key, F.explode(ends).alias("e")).select(
        key, F.col("e.a.x").cast("double").alias(f"{prefix}ax"), F.col("e.a.y").cast("double").alias(f"{prefix}ay"), F.col("e.b.x").cast("double").alias(f"{prefix}bx"), F.col("e.b.y").cast("double").alias(f"{prefix}by")
    )
    span = F.greatest(*[F.abs(F.col(f"{prefix}b{c}") - F.col(f"{prefix}a{c}")) for c in "xy"])
    p = p.where(span < float("inf")).withColumn("parts", F.greatest(F.lit(1), F.ceil(span / size))).withColumn("part", F.explode(F.sequence(F.lit(1).cast("long"), F.col("parts"))))

    def at(c, k):
        a, b = F.col(f"{prefix}a{c}"), F.col(f"{prefix}b{c}")
        return F.when(k == 0, a).when(k == F.col("parts"), b).otherwise(a + (b - a) * k / F.col("parts"))

    corners = {}
    for c in "xy":
        here, there = at(c, F.col("part") - 1), at(c, F.col("part"))
        slack = F.when(F.col("parts") > 1, F.abs(here) * F.lit(1e-12)).otherwise(F.lit(0.0))  # what rounding moves a cut by
        corners |= {f"{prefix}l{c}": F.least(here, there) - grow - slack, f"{prefix}h{c}": F.greatest(here, there) + grow + slack}
    p = p.withColumns(corners).drop("parts", "part")
    return _listed(p, prefix, size)


def _listed(parts: DataFrame, prefix: str, size: float, inside: bool = False) -> DataFrame:
    """One row per part and cell that its box touches; with ``inside``, only the cells within the row's cell (i, j) of FINER times the size."""
    for k, c in (("i", "x"), ("j", "y")):
        low, high = geo.cell(F.col(f"{prefix}l{c}"), F.lit(size)), geo.cell(F.col(f"{prefix}h{c}"), F.lit(size))
        if inside:
            low, high = F.greatest(low, F.col(k) * FINER), F.least(high, F.col(k) * FINER + (FINER - 1))
        parts = parts.withColumn(k, F.explode(F.sequence(low, high)))
    return parts


def _tested(a: DataFrame, b: DataFrame, left_key: str, right_key: str, size: float) -> DataFrame:
    """(left_key, right_key, distance) of the parts that meet, each two of them in one cell: that of the lower corner their boxes share."""
    first = lambda k, c: F.col(k) == F.greatest(geo.cell(F.col(f"ll{c}"), F.lit(size)), geo.cell(F.col(f"rl{c}"), F.lit(size)))
    met = a.join(b, ["i", "j"]).where(first("i", "x") & first("j", "y"))
    names = [f"{s}{e}{c}" for s in "lr" for e in "ab" for c in "xy"]
    return geo.with_piece_distance(met, *names).select(left_key, right_key, "distance")


def near_pairs(left: DataFrame, right: DataFrame, left_key: str, right_key: str, within: float, cell: float | None = None, crowded: int = CROWDED) -> DataFrame:
    """(left_key, right_key, distance) of all pairs of paths at most ``within`` apart; distance 0 if they touch or cross.

    A cell in which more than ``crowded`` pairs of parts would meet is split into FINER by FINER ones, and these again, while cells are wider
    than ``within`` and a metre. Two parts meet in the one smallest cell that holds the lower corner of what their boxes share, at any depth,
    so a pair is neither lost nor tested twice. Counting the cells is one aggregate over both sides; the crowded ones are a joined table.
    """
    from kerbline.plans.checkpoint import cut

    size = cell or max(50.0, 2 * within)
    a, b, tested = _pieces(left, left_key, "l", within, size), _pieces(right, right_key, "r", 0.0, size), []
    while size / FINER >= max(within, 1.0):
        full = a.groupBy("i", "j").agg(F.count("*").alias("n")).join(b.groupBy("i", "j").agg(F.count("*").alias("m")), ["i", "j"]).where(F.col("n") * F.col("m") > crowded)
        full = cut(full.select("i", "j"))
        if full.isEmpty():
            break
        tested.append(_tested(a.join(full, ["i", "j"], "left_anti"), b, left_key, right_key, size))
        size /= FINER
        a, b = _listed(a.join(full, ["i", "j"], "left_semi"), "l", size, True), _listed(b.join(full, ["i", "j"], "left_semi"), "r", size, True)
    found = _tested(a, b, left_key, right_key, size)
    for rows in tested:
        found = found.unionByName(rows)
    # the filter stands after the minimum: pushed below it, the long expression would be evaluated twice
    return found.groupBy(left_key, right_key).agg(F.min("distance").alias("distance")).where(F.col("distance") <= within)


def match_candidates(restrictions: DataFrame, segments: DataFrame, thresholds: Iterable[float] = THRESHOLDS, crs: str = METRIC_CRS) -> DataFrame:
    """(restriction_id, segment_id, signal, threshold_m, distance_m, confidence) of restrictions (restriction_id, malformed, path) and segments
    (segment_id, path), in metres. A segment that meets the restriction is a HIGH direct intersection; one within a threshold is MEDIUM
    proximity, once for every threshold; a malformed restriction's path is its point, and all it finds is LOW point_fallback."""
    require_metric(crs)
    limits = sorted(float(t) for t in thresholds)
    pairs = near_pairs(restrictions, segments, "restriction_id", "segment_id", limits[-1]).join(restrictions.select("restriction_id", "malformed"), "restriction_id")
    direct = ~F.col("malformed") & (F.col("distance") == 0)
    steps = F.when(direct, F.array(F.lit(None).cast("double"))).otherwise(F.filter(F.array(*map(F.lit, limits)), lambda t: F.col("distance") <= t))
    return pairs.withColumn("threshold_m", F.explode(steps)).select(
        "restriction_id", "segment_id",
        F.when(direct, "direct_intersection").when(F.col("malformed"), "point_fallback").otherwise("proximity").alias("signal"),
        "threshold_m", F.col("distance").alias("distance_m"),
        F.when(direct, "HIGH").when(F.col("malformed"), "LOW").otherwise("MEDIUM").alias("confidence"),
    )


def match_one(path: Column, segments: DataFrame, fallback: bool = False, thresholds: Iterable[float] = THRESHOLDS) -> DataFrame:
    """Match a single geometry; ``fallback`` treats it as the point of a malformed one. An empty segment table is refused."""
    if segments.isEmpty():
        raise ValueError("there are no segments to match")
    one = segments.sparkSession.range(1).select(F.lit("geometry").alias("restriction_id"), F.lit(fallback).alias("malformed"), path.alias("path"))
    return match_candidates(one, segments, thresholds)


def near_points(left: DataFrame, right: DataFrame, left_key: str, right_key: str, metres: float) -> DataFrame:
    """(left_key, right_key, metres) of points (key, lon, lat) at most ``metres`` apart on a local plane, at any latitude and over the date line.

    Points meet in cells of bands as high as the distance. A band's cells are as wide as the distance is at the latitude of its neighbour that is
    nearer to a pole, and a whole number of them goes around the earth, so a cell and its neighbours hold all that is near. Near a pole a band is
    one cell.
    """
    height = metres / geo.LAT_M * (1 + 1e-9)

    def band(lat):
        return F.floor(lat / F.lit(height))

    def around(j):
        """How many cells a band has. Distance is measured at the mean of two latitudes, so no pair is at more than the next band's far edge."""
        far = F.least(F.lit(90.0), (F.greatest(F.abs(j), F.abs(j + 1)) + 1) * F.lit(height))
        return F.greatest(F.lit(1), F.floor(F.lit(360 * geo.LON_M / metres) * F.cos(F.radians(far)) * (1 - 1e-9))).cast("long")

    def cell(lon, n):
        return F.floor((lon + 180) / 360 * n)

    turned = lambda lon: F.pmod(lon + 180, F.lit(360.0)) - 180
    a = left.where("lon is not null and lat is not null").select(left_key, F.col("lon").alias("lx"), F.col("lat").alias("ly"), band(F.col("lat")).alias("j"))
    a = a.withColumn("n", around(F.col("j"))).withColumn("i", F.pmod(cell(turned(F.col("lx")), F.col("n")), F.col("n")))
    # a point on the right is listed in its own cell and those beside it of its band and of both bands beside that
    b = right.where("lon is not null and lat is not null").select(right_key, F.col("lon").alias("rx"), F.col("lat").alias("ry"), F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: band(F.col("lat")) + k)).alias("j"))
    b = b.withColumn("n", around(F.col("j"))).withColumn("c", cell(turned(F.col("rx")), F.col("n")))
    b = b.withColumn("i", F.explode(F.array_distinct(F.array(*[F.pmod(F.col("c") + k, F.col("n")) for k in (-1, 0, 1)])))).drop("c", "n")
    apart = turned(F.col("rx") - F.col("lx"))
    d = geo.flat_distance(F.col("lx"), F.col("ly"), F.col("lx") + apart, F.col("ry"))
    return a.join(b, ["i", "j"]).select(left_key, right_key, d.alias("metres")).where(F.col("metres") <= metres)


def points_near_routes(points: DataFrame, vertices: DataFrame, metres: float = 150.0) -> DataFrame:
    """Distinct (route, point) with a vertex of the route nearby."""
    return near_points(points, vertices.withColumnRenamed("route", "route_id"), "point", "route_id", metres).select("route_id", "point").distinct()


def counts_near(restrictions: DataFrame, points: DataFrame, metres: float = 200.0) -> DataFrame:
    """(restriction_id, n) for every restriction, zero included."""
    found = near_points(restrictions, points, "restriction_id", "point", metres).groupBy("restriction_id").agg(F.count("*").alias("n"))
    return restrictions.select("restriction_id").join(found, "restriction_id", "left").na.fill(0, ["n"])


def restrictions_near(restrictions: DataFrame, vertices: DataFrame, metres: float = 75.0) -> DataFrame:
    """The restrictions that have any vertex nearby."""
    found = near_points(restrictions, vertices.select(F.monotonically_increasing_id().alias("v"), "lon", "lat"), "restriction_id", "v", metres)
    return restrictions.join(found.select("restriction_id").distinct(), "restriction_id", "left_semi")


def nearest(points: DataFrame, nodes: DataFrame, cell: float) -> DataFrame:
    """(point, node, d2): the node (node, x, y) nearest to each point (point, x, y); of equal ones the smallest. Points that have none within
    a cell's width look again at twice the width, until each has one; no point is left out unless there are no nodes."""
    from kerbline.plans.checkpoint import cut

    left, found, size = cut(points.where("x is not null and y is not null").select("point", "x", "y")), None, cell
    around = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    nodes = nodes.where("x is not null and y is not null")
    if nodes.isEmpty():
        return left.join(nodes.select("node"), F.lit(False)).select("point", "node", F.lit(0.0).alias("d2"))
    while True:
        at = lambda df: df.withColumns({"i": geo.cell(F.col("x"), F.lit(size)), "j": geo.cell(F.col("y"), F.lit(size))})
        near = at(left).withColumn("di", F.explode(around)).withColumn("dj", F.explode(around)).select("point", "x", "y", (F.col("i") + F.col("di")).alias("i"), (F.col("j") + F.col("dj")).alias("j"))
        d2 = F.pow(F.col("x") - F.col("nx"), 2) + F.pow(F.col("y") - F.col("ny"), 2)
        met = near.join(at(nodes).select("node", F.col("x").alias("nx"), F.col("y").alias("ny"), "i", "j"), ["i", "j"])
        best = met.groupBy("point").agg(F.min(F.struct(d2.alias("d2"), F.col("node").alias("node"))).alias("b")).where(F.col("b.d2") <= size * size)
        best = cut(best.select("point", "b.node", "b.d2"))
        found = best if found is None else found.unionByName(best)
        left = cut(left.join(best, "point", "left_anti"))
        if left.isEmpty():
            break
        size *= 2
    return found


def few_or_nearest(matches: DataFrame, anchors: DataFrame, enough: int = 6, k: int = 5) -> DataFrame:
    """Matches (restriction_id, segment_id, x, y) of each anchor (restriction_id, ax, ay): all if there are up to ``enough``, else the nearest ``k``."""
    d2 = F.pow(F.col("x") - F.col("ax"), 2) + F.pow(F.col("y") - F.col("ay"), 2)
    rows = matches.join(anchors, "restriction_id")
    one = Window.partitionBy("restriction_id")
    ranked = rows.withColumns({"n": F.count("*").over(one), "place": F.row_number().over(one.orderBy(d2, "segment_id"))})
    return ranked.where((F.col("n") <= enough) | (F.col("place") <= k)).select("restriction_id", "segment_id", "place")


def extent_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: how many points (x, y) of ``a`` lie in the extent of ``b``, and the width and height that both extents share."""
    ext = lambda df, p: df.agg(*[f(c).alias(f"{p}{n}") for c in "xy" for n, f in ((f"min{c}", F.min), (f"max{c}", F.max))])
    eb = ext(b, "b")
    inside = a.crossJoin(F.broadcast(eb)).agg(F.count_if(F.col("x").between(F.col("bminx"), F.col("bmaxx")) & F.col("y").between(F.col("bminy"), F.col("bmaxy"))).alias("inside"))
    both = ext(a, "a").crossJoin(F.broadcast(eb)).crossJoin(F.broadcast(inside))  # one row each
    side = lambda c: F.greatest(F.lit(0.0), F.least(f"amax{c}", f"bmax{c}") - F.greatest(f"amin{c}", f"bmin{c}"))
    return both.select("inside", side("x").alias("width"), side("y").alias("height"))


def cross_report(restrictions: DataFrame, network: DataFrame, network_crs: str = SOURCE_CRS) -> DataFrame:
    """One row on points (x, y) of both datasets: how many restrictions have a point, how many lie in the network's extent, the extents' common
    width and height, the network's system, and the one that metric work should take: its own if projected, else ``METRIC_CRS``."""
    known = restrictions.where("x is not null and y is not null")
    n = known.agg(F.count("*").alias("valid_points"))
    advice = network_crs if is_projected(network_crs) else METRIC_CRS
    return n.crossJoin(F.broadcast(extent_overlap(known, network))).withColumns({"network_crs": F.lit(network_crs), "metric_crs": F.lit(advice)})  # one row each


def network_nearby(restrictions: DataFrame, segments: DataFrame, metres: float = 100.0) -> DataFrame:
    """(restriction_id, edges, length_m) of the segments (segment_id, path, len_m) within reach, zero included."""
    pairs = near_pairs(restrictions, segments, "restriction_id", "segment_id", metres).join(segments.select("segment_id", "len_m"), "segment_id")
    n = pairs.groupBy("restriction_id").agg(F.count("*").alias("edges"), F.sum("len_m").alias("length_m"))
    return restrictions.select("restriction_id").join(n, "restriction_id", "left").na.fill({"edges": 0, "length_m": 0.0})


def nearby_by(found: DataFrame, records: DataFrame, field: str) -> DataFrame:
    """(value, restrictions, mean_edges, mean_length_m) of ``network_nearby``'s rows by a field of their records; unknown ones under null."""
    rows = found.join(records.select("restriction_id", F.col(field).alias("value")), "restriction_id", "left")
    return rows.groupBy("value").agg(F.count("*").alias("restrictions"), F.avg("edges").alias("mean_edges"), F.avg("length_m").alias("mean_length_m"))
