"""Token ids as ORC files.

Documents are dealt by ranges of their id and sorted, tokenized, and written with ORC's own integer run-length encoding,
row indexes, and Bloom filters on the document id. Readers split files by stripe and skip stripes by their statistics.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kerbline.llm.byte_runs import released, slices, text_bytes
from kerbline.llm.common import cut, shuffle_partitions

END_ID = 2
ORC = {
    "compression": "zstd",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(16 * 2**20),
    "orc.rows.between.memory.checks": "100",
}
#: Bytes of text that a worker encodes at a time; a longer text is cut between pieces.
BATCH_BYTES = 2_000_000
#: Pieces that a worker has at hand, in two generations of this many, and the longest of them in bytes.
KEPT_PIECES, KEPT_BYTES = 200_000, 64

#: White space beyond ASCII's, or that patterns differ on: texts with it are encoded whole.
_ODD_SPACE = "[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f\u2060\u3000\ufeff]"
#: Pieces that the tokenizer's pattern leaves whole, so that its model can have them as they are.
_WHOLE = re.compile(r" ?(?:[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+|[0-9]+|[!-&(-/:-@\[-`{-~]+)")

# Classes of bytes: white space, the space, letter, digit, other ASCII, other.
_WS, _SPACE, _LETTER, _DIGIT, _MARK, _HIGH = range(6)


def _classes() -> np.ndarray:
    out = np.full(256, _HIGH, np.uint8)
    out[:128] = _MARK
    out[[9, 10, 13]] = _WS
    out[32] = _SPACE
    out[48:58] = _DIGIT
    out[65:91] = out[97:123] = _LETTER
    return out


_CLASS = _classes()


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write bytes that aren't printable in Latin-1 as the characters from 256 on, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [x for x in range(256) if x not in printable]
    return {x: chr(256 + i) for i, x in enumerate(others)}


_BYTE_LETTERS = _byte_letters()


def piece_starts(data: np.ndarray, doc_starts: np.ndarray, odd: np.ndarray | None = None) -> np.ndarray:
    """Places where the tokenizer's own pre-tokens begin, or some of them; of texts that are ``odd``, the texts' first bytes.

    ``doc_starts`` has one more end. A piece is a run of letters, digits or other ASCII with the space before it, or white space. No
    boundary is set beside a byte that may be a letter or not, or after an apostrophe, so contractions and all else are left to the tokenizer.
    """
    kind = _CLASS[data]
    latin = np.flatnonzero(data[:-1] == 0xC3)
    latin = latin[(data[latin + 1] != 0x97) & (data[latin + 1] != 0xB7)]
    kind[latin] = kind[latin + 1] = _LETTER
    blank = kind <= _SPACE
    after = np.empty(len(kind), bool)
    after[:-1], after[-1] = ~blank[1:], False
    ends = doc_starts[1:] - 1
    after[ends[ends >= 0]] = False
    start = np.empty(len(kind), bool)
    start[0] = True
    prev, here = kind[:-1], kind[1:]
    apart = (prev != here) & (prev >= _LETTER) & (prev <= _MARK) & (here >= _LETTER) & (here <= _MARK) & (data[:-1] != 39)
    start[1:] = np.where(blank[1:], ~blank[:-1] | after[1:], (prev == _WS) | apart)
    if odd is not None:
        for i in np.flatnonzero(odd).tolist():
            start[doc_starts[i] : doc_starts[i + 1]] = False
    start[doc_starts[doc_starts < len(kind)]] = True
    return np.flatnonzero(start)


class PieceEncoder:
    """Encodes texts with the tokenizers library, which sees a piece once while the piece is kept.

    Pieces are told apart by their bytes. Those of the older generation go when the younger one is full.
    """

    def __init__(self, path: str, special_text: bool = True):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_text  # whether their strings in a text are ordinary text
        added = [re.escape(x.content) for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole_texts = "|".join([_ODD_SPACE, *([] if special_text else added)])
        self.tokens = self.tokenizer.model.tokenize
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encoded(self, piece: bytes) -> bytes:
        text = piece.decode()
        if not _WHOLE.fullmatch(text):
            ids = self._ids([text])[0]
        elif text.isascii():
            ids = [x.id for x in self.tokens(_BYTE_LETTERS[32] + text[1:] if text[0] == " " else text)]
        else:
            ids = [x.id for x in self.tokens(piece.decode("latin-1").translate(_BYTE_LETTERS))]
        return array("i", ids).tobytes()

    def _known(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, as bytes of int32."""
        out = [*map(self.young.get, pieces)]
        for i, x in enumerate(out):
            if x is None:
                p = pieces[i]
                x = out[i] = self.old.get(p) or self._encoded(p)
                if len(p) <= KEPT_BYTES:
                    if len(self.young) >= KEPT_PIECES:
                        self.old, self.young = self.young, {}
                    self.young[p] = x
        return out

    def begins(self, data: np.ndarray, starts: np.ndarray, odd: np.ndarray | None = None) -> np.ndarray:
        """Where pieces begin that are encoded apart from all others."""
        return piece_starts(data, starts, odd)

    def _part(self, data: np.ndarray, starts: np.ndarray, odd: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        begin = self.begins(data, starts, odd)
        offsets = np.append(begin, len(data)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        raw = self._known(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        known, at = np.frombuffer(b"".join(raw), np.int32), np.cumsum(sizes) - sizes
        of = pieces.indices.to_numpy()
        n = sizes[of]
        ends = np.cumsum(n)
        flat = known[np.repeat(at[of] - (ends - n), n) + np.arange(int(ends[-1]))]
        return flat, np.diff(np.concatenate([[0], ends])[np.searchsorted(begin, starts)])

    def encode(self, data: np.ndarray, starts: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and how many each has; ``starts``: where each text begins in ``data``, with one more end.

        A single text over BATCH_BYTES is cut after bytes that aren't white space, where a piece begins.
        """
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(starts) - 1, np.int64)
        if len(starts) > 2 or len(data) <= BATCH_BYTES or odd[0]:
            return self._part(data, starts, odd)
        found, at, width = [], 0, BATCH_BYTES
        while at < len(data):
            end = min(at + width, len(data))
            if end < len(data):
                begin = self.begins(data[at:end], np.array([0, end - at]))
                begin = begin[(begin > 0) & (begin < end - at - 1)]
                begin = begin[_CLASS[data[at + begin - 1]] > _SPACE]
                if not len(begin):
                    width *= 2
                    continue
                end = at + int(begin[-1])
            found.append(self._part(data[at:end], np.array([0, end - at]), None)[0])
            at, width = end, BATCH_BYTES
        flat = np.concatenate(found)
        return flat, np.array([len(flat)])

    def odd(self, texts: pa.Array) -> np.ndarray:
        """Which texts are encoded whole."""
        return pc.fill_null(pc.match_substring_regex(texts, self.whole_texts), False).to_numpy(zero_copy_only=False)

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        column = pa.array(texts, pa.string())
        data, starts = text_bytes(column)
        flat, n = self.encode(data[: starts[-1]], starts, self.odd(column))
        return np.split(flat, np.cumsum(n)[:-1])


@lru_cache(maxsize=1)
def shared_encoder(path: str, special_text: bool = True) -> PieceEncoder:
    """One for each worker process, which keeps its pieces from task to task."""
    return PieceEncoder(path, special_text)


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, special_text: bool = True) -> DataFrame:
    """(doc_id, ids) of (doc_id, text): whole texts, ``end_id`` after each; keeps partitions and order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(tokenizer_path, special_text)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            every, offsets = text_bytes(texts)
            odd = encoder.odd(texts)
            # a few texts at a time, or one long one, so that a batch's ids stay small
            for lo, hi in slices(np.diff(offsets).tolist(), BATCH_BYTES):
                flat, n = encoder.encode(every[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], odd[lo:hi])
                ends = np.cumsum(n + 1)
                out = np.full(int(ends[-1]), end_id, np.int32)
                out[np.arange(len(flat)) + np.repeat(np.arange(len(n)), n)] = flat
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(out))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), lists], ["doc_id", "ids"])

    return docs.mapInArrow(released(run), "doc_id long, ids array<int>")


def write_tokens(
    docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, special_text: bool = True
) -> None:
    """Write (shard, seq, doc_id, ids) as ORC below ``path``, in ascending order of doc_id across shards and within.

    A null text is empty: it has the end id alone. Null ids come first; rows that repeat an id stay next to one another, in the order
    of their texts. Other columns are not read. With ``special_text`` a special token's string in a text is ordinary text, so that no text
    can end a document; without it the tokenizer gives it the special id.
    """
    n = shuffle_partitions(docs.sparkSession)
    sorted_docs = (
        docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
        .repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    )
    tokens = tokenize(sorted_docs, tokenizer_path, end_id, special_text).select(
        F.spark_partition_id().alias("shard"), F.monotonically_increasing_id().alias("seq"), "doc_id", "ids"
    )
    tokens.write.options(**ORC).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The rows as written; a filter on doc_id skips stripes and row groups by statistics and Bloom filters."""
    return spark.read.schema("shard int, seq long, doc_id long, ids array<int>").orc(path)


def document_index(spark: SparkSession, path: str) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian uint32).

    Rows with a null id come first, and each row that repeats an id is a document of its own. Files of no documents have no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            values = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False)).astype("<u4")
            ends = lists.offsets.to_numpy()
            view = memoryview(values).cast("B")
            sums = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(ends).astype(np.int64)), pa.array(sums, pa.int64())],
                ["shard", "seq", "doc_id", "n_tokens", "ids_crc32"],
            )

    rows = cut(read_tokens(spark, path).mapInArrow(released(run), "shard int, seq long, doc_id long, n_tokens long, ids_crc32 long"))
    shards = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n"))  # as many rows as files were written
    starts = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    within = Window.partitionBy("shard").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.withColumn("here", F.sum("n_tokens").over(within) - F.col("n_tokens"))
        .join(starts, "shard")
        .select("doc_id", (F.col("before") + F.col("here")).alias("start"), "n_tokens", "ids_crc32")
    )
