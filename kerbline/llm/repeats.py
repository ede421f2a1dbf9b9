"""Removal of repeated byte strings.

Every string of ``length`` bytes that also starts anywhere else goes, from all the places where it starts. Strings
are represented by anchors: in each window of ``length`` bytes the 8-byte gram with the smallest hash, so that equal
windows have the same anchor at the same offset, and one anchor stands for all neighbouring windows that share it.

1. Each text gives its anchors, each with a hash of the bytes that its windows span, and of the 200 bytes to one side of it.
   A window reaches 200 bytes to the left or to the right, so equal windows agree in one of these keys.
2. Rows are sorted by key: an anchor whose whole span stands elsewhere is settled, one whose key stands nowhere else is dropped.
3. For the rest the spans' bytes are fetched, and the windows within are compared by hash, per key.
4. Each text is joined with the runs of windows found, and the bytes that these cover are removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.llm.byte_runs import released, runs, slices, text_bytes
from kerbline.llm.common import cut, row_keys, shuffle_partitions

LENGTH = 400
GRAM = 8
SIDE = 200
BATCH_BYTES = 1_000_000
#: Bytes of spans with one key that a task compares at once; windows of larger sets are grouped by Spark, one row each.
SET_BYTES = 32_000_000

_RNG = np.random.default_rng(11)
_VALUE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_A, _B = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _A
    x = (x ^ (x >> np.uint64(33))) * _B
    return x ^ (x >> np.uint64(33))


class _Hashes:
    """64-bit hashes of any ranges of ``data``, the same wherever the range stands."""

    powers = np.ones(1, np.uint64)
    inverses = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        if len(self.powers) < n:
            one = np.ones(1, np.uint64)
            _Hashes.powers = np.concatenate([one, np.cumprod(np.full(n, _BASE, np.uint64), dtype=np.uint64)])
            _Hashes.inverses = np.concatenate([one, np.cumprod(np.full(n, _INVERSE, np.uint64), dtype=np.uint64)])
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(_VALUE[data] * self.powers[: n - 1], dtype=np.uint64, out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[begin]) * self.inverses[begin] + (end - begin).astype(np.uint64) * _B)


def _window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, first window, last window, anchor) of the anchors of texts that begin at ``starts`` (with one more end)."""
    none = tuple(np.zeros(0, np.int64) for _ in range(4))
    if len(data) < length:
        return none
    padded = np.concatenate([data, np.zeros(GRAM, np.uint8)])
    grams = np.ndarray((len(data),), "<u8", padded, strides=(1,))
    values = (_mix(grams * _A + _B) >> np.uint64(32) << np.uint64(32)) | np.arange(len(data), dtype=np.uint64)
    least = (_window_minima(values, length - GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    n = np.maximum(0, np.diff(starts) - length + 1)  # windows of each text
    first = np.cumsum(n) - n
    of = np.repeat(np.arange(len(n)), n)
    window = np.repeat(starts[:-1] - first, n) + np.arange(len(of))
    if not len(window):
        return none
    anchor = least[window]
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (of[1:] != of[:-1])])
    at = np.flatnonzero(new)
    last = np.concatenate([at[1:], [len(window)]]) - 1
    return of[at], window[at], window[last], anchor[at]


_ROW = "kind int, key long, span long, k1 long, k2 long, first int, last int, anchor int"
_NAMES = [x.split()[0] for x in _ROW.split(", ")]
_TYPES = [np.int32, np.int64, np.int64, np.int64, np.int64, np.int32, np.int32, np.int32]
# kinds of rows: to be compared, settled, stands for settled ones
_OPEN, _SETTLED, _WITNESS = 0, 1, 2


def _batch(columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array((x.view(np.int64) if x.dtype == np.uint64 else x).astype(t)) for x, t in zip(columns, _TYPES)], _NAMES
    )


def _anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    """Rows of _ROW for docs (k1, k2, text); of equal rows in a batch all are settled at once and one goes on as a witness."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (batch.column(i).to_numpy() for i in (0, 1))
            every, offsets = text_bytes(batch.column(2))
            for lo, hi in slices(np.diff(offsets).tolist(), BATCH_BYTES):
                data, starts = every[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                of, a, b, p = anchors(data, starts, length)
                if not len(of):
                    continue
                hashes = _Hashes(data)
                half = min(SIDE, length // 2)
                parts = []
                # the windows that reach less than ``half`` to the left, and so at least that far to the right; the others
                for right in (True, False):
                    x, y = (np.maximum(a, p - half), b) if right else (a, np.minimum(b, p - half - 1))
                    some = np.flatnonzero(x <= y)
                    x, y, q = x[some], y[some], p[some]
                    key = hashes.of(q, q + half) if right else hashes.of(q - half, q + GRAM)
                    span = _mix(hashes.of(x, y + length) ^ ((q - x).astype(np.uint64) * _A))
                    parts.append((key ^ np.uint64(right), span, of[some], x, y, q))
                key, span, of, x, y, q = (np.concatenate(z) for z in zip(*parts))
                both = _mix(key * _A ^ span)
                _, at, back, n = np.unique(both, return_index=True, return_inverse=True, return_counts=True)
                kind = np.where(n[back] > 1, _SETTLED, _OPEN)
                base = starts[of]
                columns = [kind, key, span, k1[lo:hi][of], k2[lo:hi][of], x - base, y - base, q - base]
                # settled rows are only passed on: dealt by their own place, as many copies share an anchor
                columns[1] = np.where(kind == _SETTLED, _mix(k1[lo:hi][of].view(np.uint64) ^ (base + x).astype(np.uint64) * _A), key)
                yield _batch(columns)
                again = at[n > 1]
                if len(again):
                    columns[0], columns[1] = np.full(len(kind), _WITNESS), key
                    yield _batch([c[again] for c in columns])

    return docs.mapInArrow(released(run), _ROW)


def _settled(rows: DataFrame) -> DataFrame:
    """Of rows sorted by (key, span): settled ones; and where a key has several spans, open rows and one witness of each settled span."""

    def finish(cols, before: bool, ended: bool):
        """Judge all runs of equal (key, span), the last only if ``ended``. before: the first key has had other spans."""
        kind, key, span = cols[0], cols[1], cols[2]
        n = len(key)
        new_key = np.concatenate([[True], key[1:] != key[:-1]])
        new = np.concatenate([[True], (span[1:] != span[:-1])]) | new_key
        at = np.flatnonzero(new)
        size = np.add.reduceat(np.where(kind == _WITNESS, 2, 1), at)
        key_at = np.flatnonzero(new_key[at])  # runs that begin a key
        spans = np.diff(key_at, append=len(at))
        several = np.repeat(spans > 1, spans)
        if before:
            several[: spans[0]] = True
        run_of = np.cumsum(new) - 1
        final = np.ones(len(at), bool)
        final[-1] = ended
        twice = size > 1
        out = []
        is_settled = (twice & (final | twice))[run_of] & (kind == _OPEN)
        out.append((_SETTLED, np.flatnonzero(is_settled)))
        out.append((_OPEN, at[final & ~twice & several]))
        out.append((_WITNESS, at[final & twice & several]))
        batches = []
        for k, index in out:
            if len(index):
                batches.append(_batch([np.full(len(index), k, np.int32), *[c[index] for c in cols[1:]]]))
        carry = None
        if not ended:
            carry = [c[at[-1] : at[-1] + 1].copy() for c in cols]
            if twice[-1]:
                carry[0][:] = _WITNESS
            before = bool(several[-1]) if len(key_at) > 1 or before or spans[-1] > 1 else False
            if len(key_at) > 1:
                before = bool(spans[-1] > 1)
        return batches, carry, before

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry, before = None, False
        for batch in batches:
            cols = [batch.column(i).to_numpy() for i in range(len(_NAMES))]
            done = cols[0] == _SETTLED
            if done.any():
                yield _batch([c[done] for c in cols])
                cols = [c[~done] for c in cols]
            if not len(cols[0]):
                continue
            if carry is not None:
                cols = [np.concatenate([x, y]) for x, y in zip(carry, cols)]
            out, carry, before = finish(cols, before, False)
            yield from out
        if carry is not None:
            yield from finish(carry, before, True)[0]

    return rows.mapInArrow(released(run), _ROW)


_FOUND = "g long, k1 long, k2 long, first int, last int, open boolean"


def _found(k1, k2, first, last, g=None, open_=None) -> pa.RecordBatch:
    n = len(k1)
    g = np.zeros(n, np.int64) if g is None else g.view(np.int64)
    open_ = np.zeros(n, bool) if open_ is None else open_
    return pa.RecordBatch.from_arrays(
        [pa.array(g), pa.array(k1), pa.array(k2), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(open_)],
        ["g", "k1", "k2", "first", "last", "open"],
    )


def _compared(spans: DataFrame, length: int, set_bytes: int) -> DataFrame:
    """Of rows (kind, key, k1, k2, first, last, anchor, bytes) sorted by key: the open rows' runs of windows that stand in
    another row of the key. Rows of keys with over ``set_bytes`` come out window by window (g: the window's hash)."""

    def windows(rows: list):
        data, starts, _ = _bytes_of_raw([r[7] for r in rows])
        kind, k1, k2, first, last, anchor = (np.array([r[i] for r in rows], np.int64) for i in (0, 2, 3, 4, 5, 6))
        key = np.array([r[1] for r in rows], np.int64).view(np.uint64)
        n = last - first + 1
        of = np.repeat(np.arange(len(rows)), n)
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        at = starts[of] + step
        h = _Hashes(data).of(at, at + length)
        offset = (anchor - first)[of] - step
        return _mix(h ^ _mix(key[of] + offset.astype(np.uint64) * _A)), of, step, n, (kind, k1, k2, first)

    def settle(rows: list):
        if len(rows) < 2:
            return
        g, of, step, n, (kind, k1, k2, first) = windows(rows)
        _, back, count = np.unique(g, return_inverse=True, return_counts=True)
        hit = (count[back] > 1) & (kind[of] == _OPEN)
        edge = np.concatenate([[0], np.cumsum(n)])
        ends = np.zeros(len(hit) + 1, bool)
        ends[edge] = True
        start = np.flatnonzero(hit & (ends[:-1] | ~np.concatenate([[False], hit[:-1]])))
        stop = np.flatnonzero(hit & (ends[1:] | ~np.concatenate([hit[1:], [False]])))
        r = of[start]
        if len(r):
            yield _found(k1[r], k2[r], first[r] + step[start], first[r] + step[stop])

    def spill(rows: list):
        g, of, step, _, (kind, k1, k2, first) = windows(rows)
        s = first[of] + step
        yield _found(k1[of], k2[of], s, s, g, kind[of] == _OPEN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []  # whole keys, and the last one as far as it has come
        size, last_key, last_at, last_size, spilling = 0, None, 0, 0, None
        for batch in batches:
            for row in zip(*[batch.column(i).to_pylist() for i in range(8)]):
                if row[1] != last_key:
                    if spilling is not None:
                        if held:
                            yield from spill(held)
                        held, size, spilling = [], 0, None
                    elif size > 2 * BATCH_BYTES:
                        yield from settle(held)
                        held, size = [], 0
                    last_key, last_at, last_size = row[1], len(held), 0
                held.append(row)
                size += len(row[7])
                last_size += len(row[7])
                if last_size > set_bytes:
                    if last_at:
                        yield from settle(held[:last_at])
                        held = held[last_at:]
                    yield from spill(held)
                    held, size, last_at, last_size, spilling = [], 0, 0, 0, last_key
        if held:
            if spilling is not None:
                yield from spill(held)
            else:
                yield from settle(held)

    return spans.mapInArrow(released(run), _FOUND)


def _bytes_of_raw(raw: list[bytes]):
    starts = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(x) for x in raw], out=starts[1:])
    return np.frombuffer(b"".join(raw), np.uint8), starts, raw


def _fetched(docs: DataFrame, rows: DataFrame, length: int) -> DataFrame:
    """The rows with the bytes that their windows span."""
    wanted = rows.groupBy(F.col("k1").alias("w1"), F.col("k2").alias("w2")).agg(
        F.collect_list(F.struct("kind", "key", "first", "last", "anchor")).alias("rows")  # of one text
    )
    # of texts that are whole copies with one id, one is enough: the rows have each copy's anchors already
    joined = docs.join(wanted, (F.col("k1") == F.col("w1")) & (F.col("k2") == F.col("w2"))).select("k1", "k2", "text", "rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "key", "k1", "k2", "first", "last", "anchor", "bytes"]
        for batch in batches:
            k1, k2 = (batch.column(i).to_numpy() for i in (0, 1))
            every, offsets = text_bytes(batch.column(2))
            rows = batch.column(3).flatten()
            of = np.repeat(np.arange(batch.num_rows), batch.column(3).value_lengths().to_numpy())
            kind, key, first, last, anchor = (rows.field(n).to_numpy() for n in ("kind", "key", "first", "last", "anchor"))
            begin, size = offsets[of] + first, last.astype(np.int64) - first + length
            for lo, hi in slices(size.tolist(), BATCH_BYTES):
                n = size[lo:hi]
                ends = np.cumsum(n)
                data = every[np.repeat(begin[lo:hi] - (ends - n), n) + np.arange(int(ends[-1]))]
                places = np.concatenate([[0], ends]).astype(np.int32)
                spans = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(places), pa.py_buffer(data)])
                columns = [pa.array(x[lo:hi]) for x in (kind, key, k1[of], k2[of], first, last, anchor)]
                yield pa.RecordBatch.from_arrays([*columns, spans], names)

    return joined.mapInArrow(released(run), "kind int, key long, k1 long, k2 long, first int, last int, anchor int, bytes binary")


def repeated_windows(docs: DataFrame, length: int = LENGTH, set_bytes: int = SET_BYTES) -> DataFrame:
    """(k1, k2, first, last): runs of places where a string starts that starts elsewhere too; docs has k1, k2, text."""
    n = shuffle_partitions(docs.sparkSession)
    rows = _anchor_rows(docs, length).repartition(n, "key").sortWithinPartitions("key", "span")
    judged = cut(_settled(rows))
    settled = judged.where(F.col("kind") == _SETTLED).select("k1", "k2", "first", "last")
    fetched = _fetched(docs, judged.where(F.col("kind") != _SETTLED), length)
    found = cut(_compared(fetched.repartition(n, "key").sortWithinPartitions("key"), length, set_bytes))
    out = settled.unionByName(found.where("g = 0").select("k1", "k2", "first", "last"))
    large = found.where("g <> 0")
    if not large.isEmpty():
        twice = large.groupBy(F.col("g").alias("h")).count().where("count > 1")
        out = out.unionByName(large.where("open").join(twice, F.col("g") == F.col("h")).select("k1", "k2", "first", "last"))
    return out


def remove_repeats(docs: DataFrame, text_col: str = "text", length: int = LENGTH, keep_text: bool = True, set_bytes: int = SET_BYTES) -> DataFrame:
    """One row per input row: ``row`` (its columns, without the text unless ``keep_text``), n_bytes, spans, n_removed, kept.

    ``spans`` are the removed runs of bytes [first, end) of the text in UTF-8, none touching another, and ``kept`` the
    bytes that remain, which need not be whole characters. Strings never cross texts, are judged on the input, and overlap freely. Texts shorter than
    ``length`` and null ones keep all they have; a null text has no bytes. Repeated rows are places of their own, so both lose the text that
    they share.
    """
    if length < 2 * GRAM:
        raise ValueError("strings must be at least 16 bytes long")
    columns = [c for c in docs.columns if keep_text or c != text_col]
    text = F.col(f"`{text_col}`")
    row = F.struct(*[F.col(f"`{c}`") for c in columns])
    k1, k2 = row_keys(docs.columns)
    work = docs.select(k1.alias("k1"), k2.alias("k2"), text.alias("text"), row.alias("row"))
    found = repeated_windows(work.select("k1", "k2", "text"), length, set_bytes)
    gathered = found.groupBy(F.col("k1").alias("w1"), F.col("k2").alias("w2")).agg(
        F.collect_list(F.struct("first", "last")).alias("runs")  # of one text
    )
    joined = work.join(gathered, (F.col("k1") == F.col("w1")) & (F.col("k2") == F.col("w2")), "left").select("row", "text", "runs")
    schema = (
        joined.select("row")
        .withColumns(
            {
                "n_bytes": F.lit(0).cast("long"),
                "spans": F.lit(None).cast("array<struct<first: bigint, end: bigint>>"),
                "n_removed": F.lit(0).cast("long"),
                "kept": F.lit(None).cast("binary"),
            }
        )
        .schema
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every, offsets = text_bytes(batch.column(1))
            column = batch.column(2)
            n = column.value_lengths().fill_null(0).to_numpy()
            places = column.flatten()
            first, end = places.field("first").to_numpy(), places.field("last").to_numpy() + length
            upto = np.concatenate([[0], np.cumsum(n)])
            for lo, hi in slices(np.diff(offsets).tolist(), BATCH_BYTES):
                data, starts = every[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                # one more place after each text parts the runs of neighbours
                cover = np.zeros(len(data) + hi - lo + 1, np.int64)
                x = slice(upto[lo], upto[hi])
                base = np.repeat(starts[:-1] + np.arange(hi - lo), n[lo:hi])
                np.add.at(cover, base + first[x], 1)
                np.add.at(cover, base + end[x], -1)
                gone = np.cumsum(cover[:-1]) > 0
                begin, stop = runs(gone)
                parting = starts[1:] + np.arange(hi - lo)
                of = np.searchsorted(parting, begin)
                shift = (starts[:-1] + np.arange(hi - lo))[of]
                spans = pa.StructArray.from_arrays([pa.array(begin - shift), pa.array(stop - shift)], ["first", "end"])
                edges = np.searchsorted(of, np.arange(hi - lo + 1)).astype(np.int32)
                real = np.ones(len(gone), bool)
                real[parting] = False
                kept = data[~gone[real]]
                size = np.diff(starts)
                removed = np.bincount(of, weights=stop - begin, minlength=hi - lo).astype(np.int64)
                ends = np.concatenate([[0], np.cumsum(size - removed)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo), pa.array(size), pa.ListArray.from_arrays(pa.array(edges), spans), pa.array(removed),
                        pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(ends), pa.py_buffer(kept)]),
                    ],
                    ["row", "n_bytes", "spans", "n_removed", "kept"],
                )

    return joined.mapInArrow(released(run), schema)
