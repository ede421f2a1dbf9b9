"""Vectorised work on the bytes of many texts at once, for use inside tasks."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

#: Lower-cases A-Z and leaves all other bytes.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_RNG = np.random.default_rng(42)
_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_POWERS = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)
_LENGTH = np.uint64(0xD6E8FEB86659FD93)


def joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The lower-cased bytes of the texts, a zero byte after each, and where each text begins (with one more end)."""
    raw = [b"" if t is None else t.encode() for t in texts]
    starts = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in raw], out=starts[1:])
    return LOWER[np.frombuffer(b"\0".join([*raw, b""]), np.uint8)], starts


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column where Arrow holds them, and where each text begins (with one more end); null is empty."""
    column = column.fill_null("") if column.null_count else column
    _, offsets, data = column.buffers()
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    starts = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), starts


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(inside.view(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes, the same wherever the run stands."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = ends - starts
    first = np.cumsum(n) - n
    offset = np.arange(int(n.sum())) - np.repeat(first, n)
    at = np.repeat(starts, n) + offset
    return np.add.reduceat(_VALUE[data[at]] * _POWERS[offset % len(_POWERS)], first) + n.astype(np.uint64) * _LENGTH


def released(run):
    """``run`` for mapInArrow, giving memory back to the system at the end of a task, as the worker stays on for others."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim:
                trim(0)

    return wrapped


def slices(sizes: list[int], limit: int):
    """Ranges of neighbours whose sizes sum to about ``limit``; a larger one is alone."""
    at = 0
    while at < len(sizes):
        to, total = at, 0
        while to < len(sizes) and (to == at or total + sizes[to] <= limit):
            total += sizes[to]
            to += 1
        yield at, to
        at = to
