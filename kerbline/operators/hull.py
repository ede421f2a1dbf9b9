"""Hulls of buffered paths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kerbline.functions.geo import LAT_M, LON_M


def _hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise, by two monotone chains."""
    if len(points) <= 3:
        return points
    order = points[np.lexsort((points[:, 1], points[:, 0]))]

    def chain(rows):
        out: list[np.ndarray] = []
        for p in rows:
            while len(out) >= 2:
                a, b = out[-2], out[-1]
                if (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) > 0:
                    break
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(order) + chain(order[::-1]))


def hull_buffer(paths: DataFrame, radius_m: float, steps: int = 16) -> DataFrame:
    """(id, ring) of (id, path): the hull of circles of ``steps`` corners around the path's vertices. Null or empty paths have empty rings."""
    angles = np.radians(np.arange(steps) * (360 / steps))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ring_type = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
        for batch in batches:
            rings = []
            for path in batch.column(1).to_pylist():
                if not path:
                    rings.append([])
                    continue
                xy = np.array([(p["x"], p["y"]) for p in path])
                dx = radius_m * np.sin(angles) / (LON_M * np.cos(np.radians(xy[:, 1:2])))
                dy = np.broadcast_to(radius_m * np.cos(angles) / LAT_M, dx.shape)
                around = np.stack([(xy[:, 0:1] + dx).ravel(), (xy[:, 1:2] + dy).ravel()], axis=1)
                rings.append([{"x": x, "y": y} for x, y in _hull(around).tolist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rings, ring_type)], ["id", "ring"])

    return paths.select("id", "path").mapInArrow(run, "id string, ring array<struct<x: double, y: double>>")
