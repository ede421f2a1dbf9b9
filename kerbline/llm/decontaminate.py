"""Benchmark decontamination as a prefix-filtered set join.

A benchmark item is cut into windows of ``window`` words, a window into shingles of ``shingle`` words. A text contains a
window only if it contains all of its shingles, so a prefix of one shingle suffices to find it: the rarest, counted over
all documents. Texts are probed for these; a find must leave room for the window on both sides (positional and
length bounds) and is then compared word by word.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.llm.byte_runs import joined, released, run_hashes, runs, slices
from kerbline.llm.common import ascii_lower, cut

WINDOW = 10
SHINGLE = 5
#: Windows, and their bytes with the item ids, that are sent to the tasks at once; a larger benchmark is split into such parts, and each
#: text meets them in turn. A window of many items is several of ITEMS ids or so each.
BROADCAST_WINDOWS, BROADCAST_BYTES, ITEMS = 200_000, 64_000_000, 1000
BATCH_BYTES = 1_000_000
# Fixed value: what a word is.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True
_STEP = np.random.default_rng(7).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_BITS = 22

Window = tuple[tuple[bytes, ...], list[str]]


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(words, items): the distinct windows, with the ids (as text) of the items they are from, in lists of about ITEMS ids."""
    words = F.regexp_extract_all(ascii_lower(F.col(f"`{text_col}`")), F.lit(WORD), 0)
    items = benchmark.select(F.col(f"`{id_col}`").cast("string").alias("item"), words.alias("words")).where(
        "item is not null and size(words) > 0"
    )
    cuts = F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - window + 1)), lambda i: F.slice("words", i, window)
    )
    lists = -(-items.count() // ITEMS) or 1
    rows = items.select("item", F.explode(cuts).alias("words"), F.pmod(F.xxhash64("item"), F.lit(lists)).alias("list"))
    return rows.groupBy("words", "list").agg(F.collect_set("item").alias("items")).drop("list")


class _Words:
    """The words of a batch of texts, and hashes of their shingles."""

    def __init__(self, texts: list[str | None]):
        self.data, starts = joined(texts)
        self.begin, self.end = runs(_IN_WORD[self.data])
        self.hash = run_hashes(self.data, self.begin, self.end)
        self.first = np.searchsorted(self.begin, starts)  # of each text, its first word
        self.n = np.diff(self.first)
        self.of = np.repeat(np.arange(len(texts)), self.n)

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the runs of ``size`` words, and which of these lie within one text."""
        m = len(self.hash) - size + 1
        if m <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        out = np.zeros(m, np.uint64)
        for k in range(size):
            out += (self.hash[k : k + m] ^ (self.hash[k : k + m] >> np.uint64(29))) * _STEP[k]
        return out ^ (out >> np.uint64(31)), self.of[:m] == self.of[size - 1 :]

    def word(self, i: int) -> bytes:
        return self.data[self.begin[i] : self.end[i]].tobytes()


def _shingle_hashes(words: tuple[bytes, ...], size: int) -> np.ndarray:
    return _Words([b" ".join(words).decode()]).shingles(size)[0]


class _Probe:
    """Finds the places of a batch's words where one of the given shingle hashes stands."""

    def __init__(self, keys: dict[int, np.ndarray]):
        self.keys = {size: np.unique(k) for size, k in keys.items()}
        self.seen = {}
        for size, k in self.keys.items():
            self.seen[size] = np.zeros(1 << _BITS, bool)
            self.seen[size][k >> np.uint64(64 - _BITS)] = True

    def finds(self, words: _Words) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(size, places, indexes into keys[size])"""
        for size, keys in self.keys.items():
            hashes, whole = words.shingles(size)
            at = np.flatnonzero(self.seen[size][hashes >> np.uint64(64 - _BITS)] & whole)
            which = np.minimum(np.searchsorted(keys, hashes[at]), len(keys) - 1)
            same = keys[which] == hashes[at]
            yield size, at[same], which[same]


def _in_batches(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, list[str | None]]]:
    texts = batch.column(column).to_pylist()
    for a, b in slices([len(t or "") for t in texts], BATCH_BYTES):
        yield a, b, texts[a:b]


def _shingle_counts(docs: DataFrame, windows: list[Window], shingle: int) -> dict[tuple[int, int], int]:
    """How often each of the windows' shingles stands in all of ``docs`` (text)."""
    keys: dict[int, list[np.ndarray]] = defaultdict(list)
    for words, _ in windows:
        size = min(shingle, len(words))
        keys[size].append(_shingle_hashes(words, size))
    probe = _Probe({size: np.concatenate(k) for size, k in keys.items()})
    shared = docs.sparkSession.sparkContext.broadcast(probe)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe = shared.value
        counts = {size: np.zeros(len(k), np.int64) for size, k in probe.keys.items()}
        for batch in batches:
            for _, _, texts in _in_batches(batch, 0):
                for size, _, which in probe.finds(_Words(texts)):
                    counts[size] += np.bincount(which, minlength=len(counts[size]))
        for size, n in counts.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(some), size, np.int32)), pa.array(some), pa.array(n[some])], ["size", "which", "n"]
            )

    # as many rows as the windows sent out have shingles, at most
    rows = docs.mapInArrow(released(run), "size int, which long, n long").groupBy("size", "which").agg(F.sum("n").alias("n")).collect()
    return {(r["size"], int(probe.keys[r["size"]][r["which"]])): r["n"] for r in rows}


def _with_finds(docs: DataFrame, windows: list[Window], shingle: int, texts: DataFrame) -> DataFrame:
    """Extend ``spans`` and ``items`` of docs (row, text, n_words, spans, items) by the windows' occurrences; ``texts`` are the same texts alone."""
    counts = _shingle_counts(texts, windows, shingle)
    prefixes: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
    keys: dict[int, set[int]] = defaultdict(set)
    for w, (words, _) in enumerate(windows):
        size = min(shingle, len(words))
        hashes = [int(h) for h in _shingle_hashes(words, size)]
        rarest = min(range(len(hashes)), key=lambda i: (counts.get((size, hashes[i]), 0), hashes[i]))
        prefixes[size, hashes[rarest]].append((w, rarest))
        keys[size].add(hashes[rarest])
    probe = _Probe({size: np.array(sorted(k), np.uint64) for size, k in keys.items()})
    shared = docs.sparkSession.sparkContext.broadcast((probe, dict(prefixes), windows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe, prefixes, windows = shared.value
        for batch in batches:
            old_spans, old_items = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            counts, spans, items = [], [], []
            for a, b, texts in _in_batches(batch, 1):
                words = _Words(texts)
                covered: dict[int, list[tuple[int, int]]] = defaultdict(list)
                found: dict[int, set[str]] = defaultdict(set)
                for size, places, which in probe.finds(words):
                    for place, key in zip(places.tolist(), probe.keys[size][which].tolist()):
                        doc = int(words.of[place])
                        low, high = int(words.first[doc]), int(words.first[doc + 1])
                        for w, offset in prefixes[size, key]:
                            wanted, of = windows[w]
                            begin = place - offset
                            if begin < low or begin + len(wanted) > high:
                                continue
                            if all(words.word(begin + i) == x for i, x in enumerate(wanted)):
                                covered[doc].append((begin - low, begin - low + len(wanted)))
                                found[doc].update(of)
                counts += words.n.tolist()
                for i in range(b - a):
                    new = covered.get(i, []) + [(s["first"], s["end"]) for s in old_spans[a + i] or []]
                    merged: list[list[int]] = []
                    for x, y in sorted(new):
                        if merged and x <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], y)
                        else:
                            merged.append([x, y])
                    spans.append([{"first": x, "end": y} for x, y in merged])
                    items.append(sorted(found.get(i, set()) | set(old_items[a + i] or [])))
            span = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(spans, span), pa.array(items, pa.list_(pa.string()))],
                names=batch.schema.names,
            )

    return docs.mapInArrow(released(run), docs.schema)


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    shingle: int = SHINGLE,
    broadcast_windows: int = BROADCAST_WINDOWS,
    keep_text: bool = True,
) -> DataFrame:
    """One row per input row: ``row`` (its columns, without the text unless ``keep_text``), text, n_words, spans, items.

    ``spans`` are the runs of words [first, end) that lie inside occurrences of windows, merged; ``items`` the ids of the items
    that have any, as sorted text. An item of fewer words than ``window`` is one window. A null text has no words, no
    spans and no items; items with a null id, a null text or no words are not looked for; equal items are found under each of their ids.
    An empty benchmark finds nothing. Repeated rows are judged each.
    """
    windows = cut(benchmark_windows(benchmark, item_id_col, item_text_col, window))
    n, size = windows.agg(F.count("*"), F.sum(F.octet_length(F.array_join("words", " ")) + F.octet_length(F.array_join("items", ",")))).first()
    columns = [c for c in docs.columns if keep_text or c != text_col]
    work = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"),
        F.col(f"`{text_col}`").alias("text"),
        F.lit(None).cast("long").alias("n_words"),
        F.lit(None).cast("array<struct<first: bigint, end: bigint>>").alias("spans"),
        F.lit(None).cast("array<string>").alias("items"),
    )
    # counted over the texts as they came, so that a part's count does not run what the parts before it found
    texts = docs.select(F.col(f"`{text_col}`").alias("text"))
    parts = max(1, -(-n // broadcast_windows), -(-(size or 0) // BROADCAST_BYTES))
    for part in range(parts):
        chosen = windows.where(F.pmod(F.xxhash64("words", "items"), F.lit(parts)) == part).collect()
        work = _with_finds(work, [(tuple(w.encode() for w in r["words"]), sorted(r["items"])) for r in chosen], shingle, texts)
    return work


def n_hit(spans):
    """Words covered by the spans."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
