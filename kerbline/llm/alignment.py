"""Alignment of two tokenizers' tokens over the same texts.

Both tokenizers cut the same bytes. Where both have a token's end, the text falls into groups; within a group tokens link where their bytes
overlap. Ends meet by a galloping intersection: the shorter list of a text's ends drives a search by doubled steps, then by halves, into the
longer one. The ranks that it finds give the groups, and neighbours' ranks the range of tokens that each token overlaps.

Texts go through in blocks of bounded bytes. A block is one row: its documents' counts, the id pairs that it holds, and which document holds
which. Pairs are counted by Spark over all blocks; what was counted comes back to the blocks by a shuffle on the block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.llm.byte_runs import released, slices, text_bytes
from kerbline.llm.common import cut
from kerbline.llm.token_output import _BYTE_LETTERS, PieceEncoder, shared_encoder

#: Bytes of text in a block, about; a longer text is a block of its own.
BLOCK_BYTES = 4_000_000
#: Every so many ends of a text are searched for from its begin, the others from the one of these before them.
STRIDE = 64
_BLANK = "▁"


class SpacedEncoder(PieceEncoder):
    """A SentencePiece model over texts that begin with a space, which stands for the one that the model adds.

    No piece of the model may have a blank after another character, so words with the blanks before them are encoded apart.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(_BLANK in x.lstrip(_BLANK) for x in names):
            raise ValueError("pieces of this model go over words")
        self.blank = self.model.piece_to_id(_BLANK)
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def begins(self, data: np.ndarray, starts: np.ndarray, odd: np.ndarray | None = None) -> np.ndarray:
        blank = data == 32
        start = np.empty(len(data), bool)
        start[0] = True
        start[1:] = blank[1:] & ~blank[:-1]
        start[starts[starts < len(data)]] = True
        return np.flatnonzero(start)

    def _encoded(self, piece: bytes) -> bytes:
        ids = self.model.encode(piece[1:].decode()) if len(piece) > 1 else [self.blank]
        return np.array(ids, np.int32).tobytes()


def _packed(entries: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, places and sizes of a vocabulary's entries."""
    size = np.array([len(x) for x in entries], np.int64)
    return np.frombuffer(b"".join(entries), np.uint8), np.cumsum(size) - size, size


@lru_cache(maxsize=2)
def _byte_vocabulary(path: str):
    encoder = shared_encoder(path)
    back = {chr(b): b for b in range(256)} | {c: b for b, c in _BYTE_LETTERS.items()}
    names = [encoder.tokenizer.id_to_token(i) for i in range(encoder.tokenizer.get_vocab_size())]
    return _packed([bytes(back[c] for c in x) if all(c in back for c in x) else x.encode() for x in names])


@lru_cache(maxsize=2)
def _spaced(path: str):
    encoder = SpacedEncoder(path)
    model = encoder.model
    entry = lambda i: bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace(_BLANK, " ").encode()
    return encoder, _packed([entry(i) for i in range(model.get_piece_size())])


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each of the ranges, one after the other."""
    ends = np.cumsum(n)
    return np.arange(int(ends[-1]) if len(n) else 0) + np.repeat(start - (ends - n), n)


def _same_bytes(data: np.ndarray, starts: np.ndarray, ids: np.ndarray, n: np.ndarray, vocabulary) -> np.ndarray:
    """Which texts their tokens' bytes spell."""
    raw, at, size = vocabulary
    own = size[ids]
    total = np.concatenate([[0], np.cumsum(own)])[np.concatenate([[0], np.cumsum(n)])]
    ok = np.diff(total) == np.diff(starts)
    kept = np.repeat(ok, n)
    spelled = raw[_ranges(at[ids[kept]], own[kept])]
    held = np.repeat(ok, np.diff(starts))
    differs = np.zeros(len(data) + 1, np.int64)
    differs[1:][held] = spelled != data[held]
    return ok & (np.diff(np.cumsum(differs)[starts]) == 0)


def gallop(ends: np.ndarray, wanted: np.ndarray, at: np.ndarray, last: np.ndarray) -> np.ndarray:
    """For each wanted end the first place from ``at`` to ``last`` where ``ends`` reaches it: by steps of 1, 2, 4, ..., then by halves."""
    low, high, step = at.copy(), at.copy(), 1
    going = np.flatnonzero(ends[high] < wanted)
    while len(going):
        low[going] = high[going] + 1
        high[going] = np.minimum(high[going] + step, last[going])
        step *= 2
        going = going[ends[high[going]] < wanted[going]]
    going = np.flatnonzero(low < high)
    while len(going):
        middle = (low[going] + high[going]) // 2
        less = ends[middle] < wanted[going]
        low[going[less]] = middle[less] + 1
        high[going[~less]] = middle[~less]
        going = going[low[going] < high[going]]
    return low


def _ranks(short: np.ndarray, n_short: np.ndarray, long: np.ndarray, n_long: np.ndarray) -> np.ndarray:
    """For each end of the short lists its rank in the long list of the same text; both lists of a text have its last byte as an end."""
    first = np.cumsum(n_long) - n_long
    own = np.arange(len(short)) - np.repeat(np.cumsum(n_short) - n_short, n_short)
    last = np.repeat(first + n_long - 1, n_short)
    anchor = own % STRIDE == 0
    from_anchor = gallop(long, short[anchor], np.repeat(first, n_short)[anchor], last[anchor])
    return gallop(long, short, from_anchor[np.cumsum(anchor) - 1], last)


def _overlaps(short, n_short, long, n_long):
    """(short token, long token) of all overlaps, and (short token, long token) of the groups' last tokens."""
    rank = _ranks(short, n_short, long, n_long)
    common = long[rank] == short
    after = rank + common
    begin = np.empty_like(rank)
    begin[1:] = after[:-1]
    first = (np.cumsum(n_short) - n_short)[n_short > 0]
    begin[first] = (np.cumsum(n_long) - n_long)[n_short > 0]
    n = rank - begin + 1
    return np.repeat(np.arange(len(short)), n), _ranges(begin, n), np.flatnonzero(common), rank[common]


def align(ends_a: np.ndarray, n_a: np.ndarray, ends_b: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a, b) of all linked tokens, and (a, b) of the last tokens of each group, in order, of texts with ``n_a`` and ``n_b`` tokens.

    Ends rise over all texts. In each text the shorter list drives.
    """
    parts = []
    for swap in (False, True):
        mine = (n_b < n_a) if swap else (n_a <= n_b)
        at_a, at_b = np.flatnonzero(np.repeat(mine, n_a)), np.flatnonzero(np.repeat(mine, n_b))
        if not len(at_a):
            continue
        if swap:
            j, i, gj, gi = _overlaps(ends_b[at_b], n_b[mine], ends_a[at_a], n_a[mine])
        else:
            i, j, gi, gj = _overlaps(ends_a[at_a], n_a[mine], ends_b[at_b], n_b[mine])
        parts.append((at_a[i], at_b[j], at_a[gi], at_b[gj]))
    if not parts:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    a, b, group_a, group_b = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(group_a, kind="stable")
    return a, b, group_a[order], group_b[order]


def _group_texts(ids_a, n_a, ids_b, n_b, group_a, group_b, groups) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` of each text: the ids of its groups. Every text has tokens of both kinds."""
    size_a, size_b = np.diff(group_a, prepend=-1), np.diff(group_b, prepend=-1)
    ids = np.empty(len(ids_a) + len(ids_b), np.int64)
    ids[np.arange(len(ids_a)) + np.repeat(np.cumsum(size_b) - size_b, size_a)] = ids_a
    ids[np.arange(len(ids_b)) + np.repeat(np.cumsum(size_a), size_b)] = ids_b
    mark = np.full(len(ids), 44, np.uint8)
    mark[group_a + np.cumsum(size_b) - size_b] = 124
    mark[group_a + group_b + 1] = 59
    digits = 1 + sum((ids >= 10**k).astype(np.int64) for k in range(1, 10))
    ends = np.cumsum(digits + 1)
    out = np.empty(int(ends[-1]) if len(ids) else 0, np.uint8)
    out[ends - 1] = mark
    rest = ids.copy()
    for k in range(int(digits.max()) if len(ids) else 0):
        has = digits > k
        out[ends[has] - 2 - k] = 48 + rest[has] % 10
        rest //= 10
    # a text's last mark is no part of it
    whole, to = out.tobytes(), np.concatenate([[0], ends])[np.cumsum(n_a + n_b)].tolist()
    return [whole[x : y - 1] for x, y in zip([0, *to[:-1]], to)]


def _small(values: np.ndarray) -> bytes:
    """Numbers from zero on as bytes, by the narrowest kind that holds them, whose width is the first byte."""
    width = next(w for w in (1, 2, 4, 8) if not len(values) or values.max() < 1 << 8 * w)
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def _numbers(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, f"<u{packed[0]}", offset=1).astype(np.int64)


_DOC = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups")
BLOCKS = "block long, docs array<struct<doc_id: long, n_a: long, n_b: long, n_groups: long, n_links: long, groups_sha256: string, groups: string>>, pairs array<long>, held array<long>, starts binary, at binary, times binary"


def _block(ids: pa.Array, texts: pa.Array, path_a: str, path_b: str, keep_groups: bool) -> dict:
    """One block's documents, pairs and who holds them; a pair is A's id times 2 ** 32 plus B's."""
    encoder_a, (encoder_b, words_b) = shared_encoder(path_a), _spaced(path_b)
    words_a = _byte_vocabulary(path_a)
    every, offsets = text_bytes(texts)
    data = every[offsets[0] : offsets[-1]]
    starts = offsets - offsets[0]
    full = np.diff(starts) > 0
    data = np.insert(data, starts[:-1][full], 32)
    starts = starts + np.concatenate([[0], np.cumsum(full)])
    odd = encoder_a.odd(texts)
    tokens_a, n_a = encoder_a.encode(data, starts, odd)
    tokens_b, n_b = encoder_b.encode(data, starts, np.zeros(len(full), bool))
    ok = full & _same_bytes(data, starts, tokens_a, n_a, words_a) & _same_bytes(data, starts, tokens_b, n_b, words_b)
    tokens_a, tokens_b = tokens_a[np.repeat(ok, n_a)].astype(np.int64), tokens_b[np.repeat(ok, n_b)].astype(np.int64)
    n_a, n_b = np.where(ok, n_a, 0), np.where(ok, n_b, 0)
    a, b, group_a, group_b = align(np.cumsum(words_a[2][tokens_a]), n_a, np.cumsum(words_b[2][tokens_b]), n_b)
    of = np.repeat(np.arange(len(ok)), n_a)
    n_groups, n_links = np.bincount(of[group_a], minlength=len(ok)), np.bincount(of[a], minlength=len(ok))
    known, place = np.unique(tokens_a[a] << 32 | tokens_b[b], return_inverse=True)
    holds, times = np.unique(of[a] * max(1, len(known)) + place, return_counts=True)
    doc, at = np.divmod(holds, max(1, len(known)))
    written = iter(_group_texts(tokens_a, n_a[ok], tokens_b, n_b[ok], group_a, group_b, n_groups[ok]))
    groups = [next(written) if x else b"" for x in ok]
    sums = [hashlib.sha256(x).hexdigest() if y else "" for x, y in zip(groups, ok)]
    columns = (ids.to_pylist(), n_a.tolist(), n_b.tolist(), n_groups.tolist(), n_links.tolist(), sums, [x.decode() if keep_groups else None for x in groups])
    return {
        "docs": [dict(zip(_DOC, x)) for x in zip(*columns)], "pairs": known, "held": np.bincount(at, minlength=len(known)),
        "starts": _small(np.searchsorted(doc, np.arange(len(ok) + 1))), "at": _small(at), "times": _small(times),
    }


def aligned_blocks(docs: DataFrame, path_a: str, path_b: str, keep_groups: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """BLOCKS of docs (doc_id, text)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(docs.sparkSession.createDataFrame([], BLOCKS).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = batch.column(1).fill_null("")
            for lo, hi in slices(np.diff(text_bytes(texts)[1]).tolist(), block_bytes):
                row = _block(batch.column(0).slice(lo, hi - lo), texts.slice(lo, hi - lo), path_a, path_b, keep_groups)
                yield pa.RecordBatch.from_arrays([pa.array([number if f.name == "block" else row[f.name]], f.type) for f in schema], schema=schema)
                number += 1

    return docs.mapInArrow(released(run), BLOCKS)


def cross_align(
    docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", keep_groups: bool = False, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, groups (null unless ``keep_groups``).

    A is a byte-level tokenizer file, B a SentencePiece model without normalisation; both see a space and the text. A pair's count is how many
    rows hold it linked. A text that is null or empty, or whose tokens' bytes don't spell it, has zeros and empty strings. Rows that repeat an
    id, or have none, are documents of their own; other columns are not read; an empty table gives an empty one.
    """
    typed = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    blocks = cut(aligned_blocks(typed, path_a, path_b, keep_groups, block_bytes))
    counts = blocks.select(F.inline(F.arrays_zip("pairs", "held"))).groupBy("pairs").agg(F.sum("held").alias("n"))
    counts = cut(counts.select(F.col("pairs").alias("pair"), F.shiftright("pairs", 32).alias("a"), "n"))
    highest = counts.groupBy("a").agg(F.max("n").alias("most"))
    known = counts.join(highest, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    asked = blocks.select(F.col("block").alias("of"), F.explode("pairs").alias("pair")).join(known, "pair").select("of", "pair", "n", "best")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right["pair"].to_numpy())
        n = right["n"].to_numpy()[order]
        best = right["best"].to_numpy(zero_copy_only=False)[order].astype(np.int64)
        found = pa.StructArray.from_arrays(left["docs"].combine_chunks().values.flatten(), list(_DOC))
        starts, at, times = (_numbers(left[c][0].as_py()) for c in ("starts", "at", "times"))
        sums = {c: np.diff(np.concatenate([[0], np.cumsum(v)])[starts]) for c, v in (("n_best", best[at] * times), ("count_sum", n[at] * times))}
        return pa.table({c: found.field(c) for c in _DOC} | sums)

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, n_best long, count_sum long"
    return blocks.groupBy("block").cogroup(asked.groupBy("of")).applyInArrow(run, schema)
