"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 21, 21 and 22 bits, each padded to a word of the perfect binary Golay code (23, 12, 7).
A word, and the words one bit away from it, decode to one to six codewords; two words at most two bits apart share one of these.
If two fingerprints differ in at most four bits, two of their segments differ in at most two bits together: in none and at
most two, or in one each, and then in the third in two at most. So the keys are the bits of one segment with a codeword of another, or
codewords of all three, and fingerprints that share a key are compared. Copies have one fingerprint and are compared once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.llm.byte_runs import released
from kerbline.llm.common import cut, row_keys, shuffle_partitions
from kerbline.operators.components import components

SHINGLE = 5
MAX_BITS = 4
SEED = 42
#: Fingerprints with one key that a task compares at once; larger sets are split and their parts compared in pairs.
PART = 4096
# The Golay code's generator polynomial, and the segments' places and widths.
GENERATOR = 0xC75
SEGMENTS = ((0, 21), (21, 21), (42, 22))


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Majority of the bits of the shingles' XXH64; words are runs of anything but ASCII white space, A-Z are lower-cased."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    data = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_digest
    found = b"".join([digest(data[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist())])
    bits = np.zeros(64, np.int64)
    rows = np.frombuffer(found, np.uint8).reshape(-1, 8)
    for at in range(0, n, 8192):
        bits += np.unpackbits(rows[at : at + 8192], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(bits * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED, keep_text: bool = False) -> DataFrame:
    """One row per input row: ``row`` (its columns, without the text unless ``keep_text``) and fp, the fingerprint as a long."""
    columns = [c for c in docs.columns if keep_text or c != text_col]
    work = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle, seed) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["row", "fp"])

    return work.mapInArrow(released(run), work.select("row", F.lit(0).cast("long").alias("fp")).schema)


@lru_cache(maxsize=1)
def _decoder() -> np.ndarray:
    """The number of the codeword nearest to each 23-bit word."""
    words = np.arange(4096, dtype=np.int64) << 11
    rest = words.copy()
    for bit in range(22, 10, -1):
        rest ^= np.where(rest >> bit & 1, GENERATOR << (bit - 11), 0)
    code = words | rest
    ones = 1 << np.arange(23, dtype=np.int64)
    table = np.zeros(1 << 23, np.uint16)
    number = np.arange(4096, dtype=np.uint16)
    table[code] = number
    for i in range(23):
        table[code ^ ones[i]] = number
        for j in range(i):
            table[code ^ ones[i] ^ ones[j]] = number
            for k in range(j):
                table[code ^ ones[i] ^ ones[j] ^ ones[k]] = number
    return table


def _near(segment: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own codeword; then (row, codeword) of all different codewords of each word's neighbourhood."""
    table = _decoder()
    flips = np.concatenate([[0], 1 << np.arange(width, dtype=np.int64)])
    found = np.sort(table[segment[:, None] ^ flips], axis=1)
    new = np.ones(found.shape, bool)
    new[:, 1:] = found[:, 1:] != found[:, :-1]
    row, column = np.nonzero(new)
    return table[segment].astype(np.int64), row, found[row, column].astype(np.int64)


def _times(row: np.ndarray, other: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes that pair each entry of ``row`` with every entry of ``other`` for the same of ``n`` rows; ``other`` is sorted."""
    count = np.bincount(other, minlength=n)
    first = np.cumsum(count) - count
    times = count[row]
    left = np.repeat(np.arange(len(row)), times)
    step = np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times)
    return left, first[row[left]] + step


def fingerprint_words(hashes: np.ndarray, count: int) -> np.ndarray:
    """``count`` words of 23 bits of a set's fingerprint, from the 64-bit hashes of its members: a bit is 1 if set in over half of them."""
    factors, offsets = _mixers(-(-count * 23 // 64))
    ones = np.zeros(64 * len(factors), np.int64)
    for at in range(0, len(hashes), 255):  # as many as a byte counts
        x = hashes[at : at + 255, None] * factors + offsets
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        ones += np.add.reduce(np.unpackbits(x.view(np.uint8), axis=1), axis=0, dtype=np.uint8)
    bits = (ones * 2 > len(hashes))[: count * 23].reshape(count, 23)
    return bits @ (1 << np.arange(23, dtype=np.int64))


@lru_cache(maxsize=2)
def _mixers(n: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(SEED + 1)
    return random.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), random.integers(0, 1 << 63, n, np.uint64)


def codewords(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, codeword) of the one or six codewords that each 23-bit word and its neighbours decode to."""
    return _near(words, 23)[1:]


def share_codeword(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether words of 23 bits share a codeword: all do that differ in two bits at most, and none that differ in over eight."""
    bits = np.bitwise_count(x ^ y)
    found = bits <= 2
    at = np.flatnonzero(~found & (bits <= 8))
    (a, code_a), (b, code_b) = codewords(x[at]), codewords(y[at])
    found[at[b[np.isin(b << 12 | code_b, a << 12 | code_a)]]] = True
    return found


def fuzzy_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of each fingerprint's keys, of 33 or 34 bits for two segments, and of 36 for three."""
    value = fp.view(np.uint64)
    parts = [((value >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    near = [_near(x, width) for x, (_, width) in zip(parts, SEGMENTS)]
    rows, keys = [], []
    for p in range(3):
        for q in range(3):
            if p == q:
                continue
            row, code = near[q][1:]
            rows.append(row)
            keys.append((3 * p + q) << 40 | parts[p][row] << 12 | code)
            if p < q:
                own_p, row_p, code_p = near[p]
                own_q, row_q, code_q = near[q]
                extra = code_p != own_p[row_p]  # else it is among the left ones
                row = np.concatenate([row_q, row_p[extra]])
                code = np.concatenate([own_p[row_q] << 12 | code_q, (code_p << 12 | own_q[row_p])[extra]])
                # the third segment differs in two bits at most
                _, row_r, code_r = near[3 - p - q]
                left, right = _times(row, row_r, len(fp))
                rows.append(row[left])
                keys.append((9 + 3 * p + q) << 40 | code[left] << 12 | code_r[right])
    return np.concatenate(rows), np.concatenate(keys)


def _forest(x: np.ndarray, y: np.ndarray | None, max_bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect whatever the links within x (or between x and y) connect; fewer than there are fingerprints."""
    every = x if y is None else np.concatenate([x, y])
    side = np.zeros(len(every), bool)
    side[len(x) :] = True
    waiting = np.arange(len(every))
    out = []
    while len(waiting):
        frontier, waiting = [waiting[0]], waiting[1:]
        while frontier and len(waiting):
            at = frontier.pop()
            near = np.bitwise_count(every[waiting] ^ every[at]) <= max_bits
            if y is not None:
                near &= side[waiting] != side[at]
            hit = waiting[near]
            if len(hit):
                out.append((np.full(len(hit), every[at]), every[hit]))
                frontier += hit.tolist()
                waiting = waiting[~near]
    return out


_SMALL = 6


def _linked(keyed: DataFrame, max_bits: int, part: int) -> DataFrame:
    """Links (kind 0) of rows (key, fp) that are sorted by key; of a key with over ``part`` rows, its rows with their part (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "key", "part", "u", "v"]

        def links(u, v):
            zero = np.zeros(len(u), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (zero.astype(np.int32), zero, zero.astype(np.int32), u.view(np.int64), v.view(np.int64))], names)

        def large(key, number, fp):
            n = len(fp)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.ones(n, np.int32)), pa.array(np.full(n, key)), pa.array(np.full(n, number, np.int32)), pa.array(fp.view(np.int64)), pa.array(np.zeros(n, np.int64))], names
            )

        def settle(key, fp):
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            n = np.diff(starts, append=len(key))
            us, vs = [], []
            small = np.repeat(n <= _SMALL, n)
            for shift in range(1, _SMALL):
                if len(key) <= shift:
                    break
                same = (key[shift:] == key[:-shift]) & small[shift:]
                at = np.flatnonzero(same)
                at = at[np.bitwise_count(fp[at] ^ fp[at + shift]) <= max_bits]
                us.append(fp[at])
                vs.append(fp[at + shift])
            for a, m in zip(starts[n > _SMALL].tolist(), n[n > _SMALL].tolist()):
                for u, v in _forest(fp[a : a + m], None, max_bits):
                    us.append(u)
                    vs.append(v)
            if us:
                u, v = np.concatenate(us), np.concatenate(vs)
                if len(u):
                    pair = np.unique(np.stack([u, v], axis=1), axis=0)
                    yield links(np.ascontiguousarray(pair[:, 0]), np.ascontiguousarray(pair[:, 1]))

        key, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        parts_out, open_key = 0, None  # of a large set, the parts that have gone out
        for batch in batches:
            key = np.concatenate([key, batch.column(0).to_numpy()])
            fp = np.concatenate([fp, batch.column(1).to_numpy().view(np.uint64)])
            last = int(np.searchsorted(key, key[-1])) if len(key) else 0
            if open_key is not None and len(key) and key[0] == open_key:
                end = int(np.searchsorted(key, open_key, side="right"))
                whole = end if end < len(key) else end - end % part
                for a in range(0, whole, part):
                    yield large(open_key, parts_out, fp[a : min(a + part, whole)])
                    parts_out += 1
                key, fp = key[whole:], fp[whole:]
                if len(key) == 0 or key[0] == open_key:
                    continue
                open_key, last = None, int(np.searchsorted(key, key[-1]))
            elif open_key is not None and len(key):
                open_key = None
            if last:
                for out in _split(key[:last], fp[:last], part, settle, large):
                    yield out
                key, fp = key[last:], fp[last:]
            if len(key) > part:
                whole = len(key) - len(key) % part
                open_key, parts_out = int(key[0]), 0
                for a in range(0, whole, part):
                    yield large(open_key, parts_out, fp[a : a + part])
                    parts_out += 1
                key, fp = key[whole:], fp[whole:]
        if len(key):
            if open_key is not None and key[0] == open_key:
                yield large(open_key, parts_out, fp)
            else:
                for out in _split(key, fp, part, settle, large):
                    yield out

    return keyed.mapInArrow(released(run), "kind int, key long, part int, u long, v long")


def _split(key, fp, part, settle, large):
    """Settle the sets of up to ``part`` rows; give out larger ones."""
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    n = np.diff(starts, append=len(key))
    over = np.repeat(n > part, n)
    if over.any():
        for a, m in zip(starts[n > part].tolist(), n[n > part].tolist()):
            for number, b in enumerate(range(0, m, part)):
                yield large(int(key[a]), number, fp[a + b : a + min(b + part, m)])
        key, fp = key[~over], fp[~over]
    if len(key):
        yield from settle(key, fp)


def _part_links(rows: DataFrame, max_bits: int) -> DataFrame:
    """Links within sets that were split: every part meets itself and every other part in a task of its own."""
    sizes = rows.groupBy(F.col("key").alias("k")).agg(F.max("part").alias("last"))
    dealt = (
        rows.join(sizes, F.col("key") == F.col("k"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
        .select("key", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), "part", "u")
    )

    def run(table: pa.Table) -> pa.Table:
        part = table["part"].to_numpy()
        fp = table["u"].to_numpy().view(np.uint64)
        first = part == part.min()
        found = _forest(fp, None, max_bits) if first.all() else _forest(fp[first], fp[~first], max_bits)
        u = np.concatenate([x for x, _ in found] or [np.zeros(0, np.uint64)])
        v = np.concatenate([x for _, x in found] or [np.zeros(0, np.uint64)])
        return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})

    return dealt.groupBy("key", "a", "b").applyInArrow(run, "u long, v long")


def fingerprint_components(prints: DataFrame, max_bits: int = MAX_BITS, part: int = PART) -> DataFrame:
    """(fp, component) of each different fingerprint that links to another; ``prints`` has a column fp."""
    distinct = prints.select("fp").distinct()

    def key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            for at in range(0, len(fp), 5000):
                some = fp[at : at + 5000]
                row, key = fuzzy_keys(some)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(some[row])], ["key", "fp"])

    keyed = distinct.mapInArrow(released(key_rows), "key long, fp long")
    sorted_ = keyed.repartition(shuffle_partitions(prints.sparkSession), "key").sortWithinPartitions("key")
    found = cut(_linked(sorted_, max_bits, part).distinct())
    links = found.where("kind = 0").select("u", "v")
    large = found.where("kind = 1")
    if not large.isEmpty():
        links = links.unionByName(_part_links(large, max_bits))
    return components(links).select(F.col("node").alias("fp"), "component")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    max_bits: int = MAX_BITS,
    keep_text: bool = False,
) -> DataFrame:
    """One row per input row: ``row`` (its columns, without the text unless ``keep_text``), fp, group, component_id.

    component_id is the smallest id that can be reached over links, the row's own included; null ids don't count, and a component of
    null ids alone has null. Fingerprints link at ``max_bits`` (at most 4) or fewer differing bits. A text of fewer words than
    ``shingle`` is one shingle; one without words, or null, has fingerprint zero and links like any other. Repeated rows share a component.
    """
    if not 0 <= max_bits <= 4:
        raise ValueError("the keys find up to 4 differing bits")
    prints = fingerprints(docs, text_col, shingle, keep_text=keep_text)
    prints = cut(prints)
    found = cut(fingerprint_components(prints, max_bits)).select(F.col("fp").alias("of"), F.col("component"))
    labelled = prints.join(found, F.col("fp") == F.col("of"), "left").select("row", "fp", F.coalesce("component", "fp").alias("component"))
    smallest = labelled.groupBy(F.col("component").alias("c")).agg(F.min(F.col(f"row.`{id_col}`")).alias("component_id"))
    return labelled.join(cut(smallest), F.col("component") == F.col("c")).select("row", "fp", F.col("component").alias("group"), "component_id")


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` that stay when each group of near duplicates keeps the one with the smallest id (null last)."""
    every = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    k1, k2 = row_keys(docs.columns)
    keyed = docs.select(every.alias("whole"), k1.alias("k1"), k2.alias("k2"))
    narrow = keyed.select(F.col(f"whole.`{id_col}`").alias("id"), F.col(f"whole.`{text_col}`").alias("text"), "k1", "k2")
    found = near_duplicates(narrow, "id", "text", shingle, max_bits)
    place = F.struct(F.col("row.id").isNull().alias("last"), "row.id", "row.k1", "row.k2")
    stay = cut(found.groupBy("group").agg(F.min(place).alias("p")).select(F.col("p.k1").alias("s1"), F.col("p.k2").alias("s2")))
    # rows that are equal in every column have one key: one of them stays
    kept = keyed.join(stay, (F.col("k1") == F.col("s1")) & (F.col("k2") == F.col("s2"))).dropDuplicates(["k1", "k2"])
    return kept.select("whole.*")
