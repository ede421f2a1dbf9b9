"""Language ID with a bit-sliced Bloom filter over byte n-grams.

One filter holds all languages: each of its places is a mask with one bit for each language. Looking an n-gram up ANDs the masks at
its places and gives every language that contains it. A text's bits are counted for each language, what the filter's false positives
add is taken off, and the largest share decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbline.llm.byte_runs import joined, released, slices
from kerbline.llm.common import cut

#: Places in the filter (a power of two), and how many of them an n-gram has.
PLACES, HASHES = 1 << 21, 2
#: A language contains an n-gram that makes up at least MIN_RATE of its n-grams (so it has 1 / MIN_RATE of them at most) and that is
#: at least MIN_SHARE as frequent in it as in the language where it is most frequent.
MIN_RATE, MIN_SHARE = 2e-6, 0.5
BATCH_BYTES = 1_000_000
UNKNOWN = "und"
_FACTORS = (0x2545F491, 0x1B873593)

# Letters and bytes of other scripts as they are; white space, digits and marks are one space; zero ends a text.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[0] = 0
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def _grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The four-byte n-grams of the texts, as numbers, and the text that each is from."""
    data, starts = joined(texts)
    data = _FOLD[data]
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != 32) | (data[:-1] != 32)  # runs of spaces are one
    of = np.repeat(np.arange(len(texts)), np.diff(starts))[keep]
    data = data[keep].astype(np.uint32)
    if len(data) < 4:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    grams = data[:-3] | data[1:-2] << np.uint32(8) | data[2:-1] << np.uint32(16) | data[3:] << np.uint32(24)
    whole = (data[:-3] != 0) & (data[1:-2] != 0) & (data[2:-1] != 0) & (data[3:] != 0)
    return grams[whole], of[:-3][whole]


@dataclass
class LanguageModel:
    languages: list[str]
    masks: np.ndarray  # (bytes of languages, places)
    shift: int
    false_rates: np.ndarray
    common: int  # the language of most training rows


def _place(gram, k: int, shift: int):
    return F.shiftright((gram * _FACTORS[k]).bitwiseAND(0xFFFFFFFF), shift)


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", places: int = PLACES, hashes: int = HASHES) -> LanguageModel:
    """Learn from all rows with a language; rows with a null text or language teach nothing.

    The n-grams are counted where the texts are; what reaches the driver is the filter, of ``places`` rows at most.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices([len(t) for t in texts], BATCH_BYTES):
                grams, of = _grams(texts[a:b])
                names = sorted(set(langs[a:b]))
                number = np.array([names.index(x) for x in langs[a:b]])
                which = number[of]
                for i, name in enumerate(names):
                    parts = held.setdefault(name, [])
                    parts.append(np.unique(grams[which == i], return_counts=True))
                    while len(parts) > 1 and len(parts[-1][0]) * 2 > len(parts[-2][0]):
                        parts.append(_merged(parts.pop(), parts.pop()))
        for name, parts in held.items():
            while len(parts) > 1:
                parts.append(_merged(parts.pop(), parts.pop()))
            for grams, n in parts:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"]
                )

    taught = docs.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang")).where(
        "text is not null and lang is not null"
    )
    counts = cut(taught.mapInArrow(released(count), "lang string, gram long, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n")))
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}  # one row per language
    languages = sorted(totals)
    shift = 32 - (places.bit_length() - 1)
    masks = np.zeros((max(1, -(-len(languages) // 8)), places), np.uint8)
    if languages:
        info = docs.sparkSession.createDataFrame([(x, i, float(totals[x])) for i, x in enumerate(languages)], "lang string, number int, total double")
        rated = counts.join(F.broadcast(info), "lang").withColumn("rate", F.col("n") / F.col("total"))  # a row per language
        best = F.max("rate").over(Window.partitionBy("gram"))
        kept = rated.withColumn("best", best).where((F.col("rate") >= MIN_RATE) & (F.col("rate") >= MIN_SHARE * F.col("best")))
        at = F.explode(F.array(*[_place(F.col("gram"), k, shift) for k in range(hashes)]))
        slices_ = kept.select(at.alias("place"), F.expr("number div 8").alias("slice"), F.expr("shiftleft(1, number % 8)").alias("bit"))
        found = slices_.groupBy("slice", "place").agg(F.bit_or("bit").cast("int").alias("mask")).toArrow()
        masks[found["slice"].to_numpy(), found["place"].to_numpy()] = found["mask"].to_numpy()
    bits = np.unpackbits(masks, axis=0, bitorder="little")[: len(languages)]
    rates = bits.mean(axis=1) ** hashes if languages else np.zeros(0)
    common = max(range(len(languages)), key=lambda i: (totals[languages[i]], -i), default=0)
    return LanguageModel(languages, masks, shift, rates, common)


def _merged(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    grams, back = np.unique(np.concatenate([x[0], y[0]]), return_inverse=True)
    return grams, np.bincount(back, weights=np.concatenate([x[1], y[1]]), minlength=len(grams)).astype(np.int64)


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)


def _score(model: LanguageModel, texts: list[str | None], hashes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of the language, share, n-grams, share of these that the language knows) of each text."""
    grams, of = _grams(texts)
    n = np.bincount(of, minlength=len(texts)).astype(np.float64)
    places = [(grams * np.uint32(f)) >> np.uint32(model.shift) for f in _FACTORS[:hashes]]
    found = []
    for row in model.masks:
        mask = row[places[0]]
        for p in places[1:]:
            mask = mask & row[p]
        table = np.bincount(of * 256 + mask, minlength=len(texts) * 256).reshape(-1, 256)
        found.append(table @ _BITS)
    count = np.concatenate(found, axis=1)[:, : len(model.languages)]
    rate = model.false_rates
    real = np.maximum(0.0, (count - n[:, None] * rate) / np.maximum(1e-9, 1 - rate))
    total = real.sum(axis=1)
    best = np.where(total > 0, real.argmax(axis=1), model.common)
    share = np.where(total > 0, real.max(axis=1, initial=0.0) / np.maximum(total, 1e-9), 0.0)
    known = real.max(axis=1, initial=0.0) / np.maximum(n, 1.0)
    return best, np.clip(share, 0.0, 1.0), n.astype(np.int64), np.clip(known, 0.0, 1.0)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep_text: bool = True, hashes: int = HASHES, with_known: bool = False) -> DataFrame:
    """One row per input row: ``row`` (its other columns), text if ``keep_text``, lang_pred, score (0 to 1); and n_grams and
    known, the share of these that the language knows, if ``with_known``.

    ``und`` with score 0 for a null text, one without a letter of any script, and any text if nothing was learned. A text with letters but
    no known n-gram gets the language with most training text and score 0; ties go to the first name. Only the text is looked at.
    """
    columns = [c for c in docs.columns if c != text_col]
    row = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in columns])
    text = F.col(f"`{text_col}`")
    outputs = ["row", *(["text"] if keep_text else []), "lang_pred", "score", *(["n_grams", "known"] if with_known else [])]
    work = docs.select(row.alias("row"), text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    if not model.languages:
        return work.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "n_grams": F.lit(0).cast("long"), "known": F.lit(0.0)}).select(*outputs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array(model.languages, object)
        for batch in batches:
            texts = [t if x else None for t, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            preds, scores, sizes, known = [], [], [], []
            for a, b in slices([len(t or "") for t in texts], BATCH_BYTES):
                best, share, n, part = _score(model, texts[a:b], hashes)
                preds += [UNKNOWN if t is None else p for t, p in zip(texts[a:b], names[best])]
                scores += [0.0 if t is None else s for t, s in zip(texts[a:b], share.tolist())]
                sizes += n.tolist()
                known += part.tolist()
            kept = [batch.column(0), *([batch.column(1)] if keep_text else []), pa.array(preds, pa.string()), pa.array(scores, pa.float64())]
            if with_known:
                kept += [pa.array(sizes, pa.int64()), pa.array(known, pa.float64())]
            yield pa.RecordBatch.from_arrays(kept, outputs)

    schema = work.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "n_grams": F.lit(0).cast("long"), "known": F.lit(0.0)}).select(*outputs).schema
    return work.mapInArrow(released(run), schema)
