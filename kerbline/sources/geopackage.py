"""Geometry blobs of feature tables: a header and well-known binary."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The header's marks and the sizes of its envelopes, and the geometry codes.
MAGIC = b"GP"
ENVELOPE_BYTES = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}
LINE, MULTILINE = 2, 5
PARTS = "array<array<struct<x: double, y: double>>>"


class BlobError(ValueError):
    pass


def _line(data: bytes, at: int, order: str) -> tuple[list[dict], int]:
    (n,) = struct.unpack_from(order + "I", data, at)
    end = at + 4 + 16 * n
    if end > len(data):
        raise BlobError("truncated")
    flat = struct.unpack_from(f"{order}{2 * n}d", data, at + 4)
    return [{"x": x, "y": y} for x, y in zip(flat[::2], flat[1::2])], end


def decode(blob: bytes | None) -> tuple[str | None, list | None, str | None]:
    """(type, parts, error)"""
    if blob is None:
        return None, None, "null"
    try:
        if blob[:2] != MAGIC or len(blob) < 8:
            raise BlobError("header")
        flags = blob[3]
        if flags & 0x10:
            raise BlobError("empty")
        size = ENVELOPE_BYTES.get(flags >> 1 & 7)
        if size is None:
            raise BlobError("header")
        at = 8 + size
        order = "<" if blob[at] == 1 else ">"
        (kind,) = struct.unpack_from(order + "I", blob, at + 1)
        at += 5
        if kind == LINE:
            line, at = _line(blob, at, order)
            name, parts = "LineString", [line]
        elif kind == MULTILINE:
            (n,) = struct.unpack_from(order + "I", blob, at)
            at, parts, name = at + 4, [], "MultiLineString"
            for _ in range(n):
                inner = "<" if blob[at] == 1 else ">"
                if struct.unpack_from(inner + "I", blob, at + 1)[0] != LINE:
                    raise BlobError("type")
                line, at = _line(blob, at + 5, inner)
                parts.append(line)
        else:
            raise BlobError("type")
        if at != len(blob):
            raise BlobError("trailing bytes")
        return name, parts, None
    except BlobError as e:
        return None, None, str(e)
    except (struct.error, IndexError):
        return None, None, "truncated"


def decoded(rows: DataFrame) -> DataFrame:
    """Add geom_type, parts and error to rows (blob, ...); a bad blob gives an error, not a failure."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
        for batch in batches:
            found = [decode(b) for b in batch.column(batch.schema.get_field_index("blob")).to_pylist()]
            kinds, parts, errors = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(kinds, pa.string()), pa.array(parts, part), pa.array(errors, pa.string())], [*batch.schema.names, "geom_type", "parts", "error"]
            )

    schema = rows.withColumns({"geom_type": F.lit(None).cast("string"), "parts": F.lit(None).cast(PARTS), "error": F.lit(None).cast("string")}).schema
    return rows.mapInArrow(run, schema)
