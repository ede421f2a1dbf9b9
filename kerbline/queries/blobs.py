"""Feature blobs made from points, sound and damaged, that the queries on feature tables decode."""

import struct

import pyarrow as pa
from pyspark.sql import functions as F

from kerbline.sources.geopackage import LINE, MAGIC, MULTILINE


def _blob(body: bytes, flags: int = 1) -> bytes:
    return MAGIC + struct.pack("<BBi", 0, flags, 4326) + body


def _line(*at: float) -> bytes:
    return struct.pack(f"<BII{len(at)}d", 1, LINE, len(at) // 2, *at)


def encoded_lines(points):
    """Blobs (k, blob) made from points (k, x, y): lines, two-part lines and, where k mod 5 is 4, damaged ones."""

    def one(k, x, y):
        line = _line(x, y, x + 1, y + 1)
        blob = _blob(struct.pack("<BII", 1, MULTILINE, 2) + line + line if k % 5 == 3 else line)
        return blob[:-3] if k % 5 == 4 else blob

    return _made(points, one)


def mixed_blobs(points):
    """Blobs of all kinds: none (k mod 7 is 0), empty (11), cut off (4 of 5), of one point (13), infinite (17), of two parts (3 of 5) and lines."""

    def one(k, x, y):
        if k % 7 == 0:
            return None
        if k % 11 == 0:
            return _blob(b"", 0x11)
        if k % 5 == 4:
            return _blob(_line(x, y, x + 1, y + 1))[:-3]
        if k % 13 == 0:
            return _blob(_line(x, y))
        if k % 17 == 0:
            return _blob(_line(x, y, float("inf"), y + 1))
        line = _line(x, y, x + 1, y + 1)
        return _blob(struct.pack("<BII", 1, MULTILINE, 2) + line + line if k % 5 == 3 else line)

    return _made(points, one)


def _made(points, one):
    def run(batches):
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(3)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([one(*r) for r in rows], pa.binary())], ["k", "blob"])

    return points.select("k", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).mapInArrow(run, "k long, blob binary")
