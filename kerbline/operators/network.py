"""The segment network: parts, endpoint clusters, graph and audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def exploded_parts(segments: DataFrame) -> DataFrame:
    """One row per part of (segment_id, parts): edge_id (segment:part), part, path."""
    return segments.select("segment_id", F.posexplode("parts").alias("part", "path")).withColumn(
        "edge_id", F.concat_ws(":", "segment_id", "part")
    )


def barrier_sets(matches: DataFrame) -> DataFrame:
    """(restriction_id, segments): each restriction's distinct segment ids, sorted."""
    return matches.groupBy("restriction_id").agg(F.array_sort(F.collect_set("segment_id")).alias("segments"))


def affected_length(matches: DataFrame, segments: DataFrame) -> DataFrame:
    return matches.join(segments, "segment_id").groupBy("restriction_id").agg(F.sum("length_m").alias("length_m"))


def endpoint_clusters(points: DataFrame, tolerance: float = 0.0, metric: str = "euclidean") -> DataFrame:
    """(point, cluster): the smallest point number of those linked by steps of up to ``tolerance``; 0 joins equal points only.

    ``metric`` is euclidean or per_axis. Points (point, x, y) meet in equal or neighbouring cells as wide as the tolerance.
    """
    from kerbline.functions.geo import cell
    from kerbline.operators.components import components

    if tolerance < 0:
        raise ValueError("endpoint tolerance must be non-negative")
    same = points.groupBy("x", "y").agg(F.min("point").alias("cluster"))
    if tolerance == 0:
        return points.join(same, ["x", "y"]).select("point", "cluster")
    spots = same.select(F.col("cluster").alias("p"), "x", "y", cell(F.col("x"), F.lit(tolerance)).alias("i"), cell(F.col("y"), F.lit(tolerance)).alias("j"))
    around = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    moved = spots.withColumn("di", F.explode(around)).withColumn("dj", F.explode(around))
    other = moved.select(F.col("p").alias("o"), F.col("x").alias("ox"), F.col("y").alias("oy"), (F.col("i") + F.col("di")).alias("i"), (F.col("j") + F.col("dj")).alias("j"))
    dx, dy = F.abs(F.col("x") - F.col("ox")), F.abs(F.col("y") - F.col("oy"))
    close = (F.greatest(dx, dy) <= tolerance) if metric == "per_axis" else (F.hypot(dx, dy) <= tolerance)
    links = spots.join(other, ["i", "j"]).where(F.col("p") < F.col("o")).where(close).select(F.col("o").alias("u"), F.col("p").alias("v"))
    found = components(links).select(F.col("node").alias("c"), "component")
    own = points.join(same, ["x", "y"]).select("point", F.col("cluster").alias("c"))
    return own.join(found, "c", "left").select("point", F.coalesce("component", "c").alias("cluster"))


def build_graph(parts: DataFrame, tolerance: float = 0.0, metric: str = "euclidean") -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) of parts (segment_id, part, pos, path): edges edge_id, segment_id, part, u, v, len_m; nodes node, x, y.

    ``pos`` orders the parts. Parts of fewer than two points or no length are left out. A node is the cluster of the endpoints that share it; its
    number is that of its first endpoint and its place that endpoint's.
    """
    from kerbline.functions.geo import plane_length
    from kerbline.plans.checkpoint import cut

    good = cut(parts.withColumn("len_m", plane_length(F.col("path"))).where("size(path) >= 2 and len_m > 0"))
    first, last = F.get("path", F.lit(0)), F.element_at("path", -1)
    ends = good.select(F.inline(F.array(
        F.struct((F.col("pos") * 2).alias("point"), first["x"].alias("x"), first["y"].alias("y")), F.struct((F.col("pos") * 2 + 1).alias("point"), last["x"].alias("x"), last["y"].alias("y")))))
    ends = cut(ends)
    of = cut(endpoint_clusters(ends, tolerance, metric))
    side = lambda odd, name: of.where(F.col("point") % 2 == odd).select(F.expr("point div 2").alias("pos"), F.col("cluster").alias(name))
    edges = good.join(side(0, "u"), "pos").join(side(1, "v"), "pos").select(F.concat_ws(":", "segment_id", "part").alias("edge_id"), "segment_id", "part", "u", "v", "len_m")
    nodes = of.select(F.col("cluster").alias("point")).distinct().join(ends, "point").select(F.col("point").alias("node"), "x", "y")
    return edges, nodes


def audit(edges: DataFrame, nodes: DataFrame, base: DataFrame) -> DataFrame:
    """One row: nodes, edges, components, largest, isolated, self_loops, and degrees as a map (a self-loop counts twice)."""
    ends = edges.select(F.explode(F.array("u", "v")).alias("node"))
    degree = nodes.select("node").join(ends.groupBy("node").agg(F.count("*").alias("d")), "node", "left").na.fill(0, ["d"])
    counts = degree.groupBy("d").agg(F.count("*").alias("n"))
    d = counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("d", "n")))).alias("degrees"), F.sum("n").alias("nodes"), F.coalesce(F.sum(F.when(F.col("d") == 0, F.col("n"))), F.lit(0)).alias("isolated"))  # a row per degree
    e = edges.agg(F.count("*").alias("edges"), F.count_if(F.col("u") == F.col("v")).alias("self_loops"))
    c = base.groupBy("component").agg(F.count("*").alias("n")).agg(F.count("*").alias("components"), F.max("n").alias("largest"))
    return d.crossJoin(F.broadcast(e)).crossJoin(F.broadcast(c)).select("nodes", "edges", "components", "largest", "isolated", "self_loops", "degrees")  # one row each


def last_part_edges(edges: DataFrame) -> DataFrame:
    """One edge per segment: that of its last part; ``part_count`` tells how many it has."""
    last = edges.groupBy("segment_id").agg(F.max("part").alias("part"), F.count("*").alias("part_count"))
    return edges.join(last, ["segment_id", "part"])
