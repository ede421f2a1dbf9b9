"""Near-duplicates by SimHash and Golay-code fuzzy hashing, confirmed by the Jaccard similarity of sets of word shingles.

Texts with one set are one node. A set has a SimHash fingerprint of TABLES words of 23 bits; of two sets that are similar at 0.8 a bit
differs with probability 0.152, and 0.188 for the smallest ones (four shingles of five). A word, and the words one bit away from it, decode to
one or six words of the Golay code; two words at most two bits apart share one, and so do some further apart: 0.604 (0.466) of all. A
codeword has 12 bits, too few for a key, so each goes with three minima of the set, which are equal with probability 0.512. A pair of
similarity 0.8 shares no key in any table with probability (1 - 0.512 * 0.604) ** TABLES, 0.4 in a million; 18 in a million for the
smallest sets. Every candidate is then compared by its whole set before it links.

Minima that no two nodes share can't give a shared key. Where few nodes share them, the codewords are compared at once. Where more do, but no
more than a task holds, nodes that shared codewords connect are one key, and the task compares those of them that share one: so a node stands
once for a table, not for each of its codewords. Else the codewords become keys. Keys with few nodes give pairs, each compared once; the nodes of larger keys are compared in tasks of bounded size, which give
out links that connect what all pairs would connect. Sets that are nearly equal share most keys, so larger keys of the FIRST tables
are compared first, and of all others those whose nodes are not one component yet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.llm import simhash
from kerbline.llm.byte_runs import released
from kerbline.llm.common import cut, freed_shuffles, fresh_path, row_keys, shuffle_partitions
from kerbline.operators.components import components
from kerbline.plans.checkpoint import drop

SHINGLE = 5
SIMILARITY = 0.8
TABLES, ROWS = 40, 3
#: Tables whose larger keys are compared before those of the others.
FIRST = 8
SEED = 42
#: Keys with up to this many nodes give pairs.
SMALL = 8
#: Shingles that a task of a larger key holds at once, about; its nodes are split into parts of this many.
PART = 4_000_000
#: Nodes with one minima that are kept together at most.
HELD = 50_000
_EPS = 1e-9
_RANDOM = np.random.default_rng(SEED)
_FACTORS = _RANDOM.integers(0, 1 << 63, (TABLES * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _RANDOM.integers(0, 1 << 63, (TABLES * ROWS, 1), np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The different XXH64 of the text's shingles, sorted; words are those of ``simhash.fingerprint``."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    data = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    found = [digest(data[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist())]
    return np.unique(np.array(found, np.uint64))


def minima(shingles: np.ndarray) -> np.ndarray:
    """A hash of each table's ROWS minima; none for an empty set, which is like no other."""
    if not len(shingles):
        return np.zeros(0, np.uint64)
    least = np.full(TABLES * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        x = shingles[at : at + 2048] * _FACTORS + _OFFSETS
        x ^= x >> np.uint64(29)
        x *= _MIX
        least = np.minimum(least, x.min(axis=1))
    return _mixed(np.arange(1, TABLES + 1, dtype=np.uint64), *least.reshape(TABLES, ROWS).T)


def _mixed(key: np.ndarray, *more: np.ndarray) -> np.ndarray:
    for x in more:
        key = (key ^ x) * _MIX
        key ^= key >> np.uint64(32)
    return key


def _sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """(row, node, n, minima, words) of docs (row, text): the set's hash, its size, its minima and the words of its fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, n, least, words = [], [], [], []
            for t in batch.column(1):
                s = shingle_set(t.as_py(), shingle)
                node.append(xxhash.xxh64_intdigest(s.tobytes(), SEED))
                n.append(len(s))
                least.append(minima(s).view(np.int64))
                words.append(simhash.fingerprint_words(s, TABLES if len(s) else 0).astype(np.int32))
            arrays = [pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(n, pa.int64()), pa.array(least, pa.list_(pa.int64())), pa.array(words, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["row", "node", "n", "minima", "words"])

    zero = F.lit(0).cast("long")
    typed = docs.select("row", zero.alias("node"), zero.alias("n"), F.array(zero).alias("minima"), F.array(F.lit(0)).alias("words"))
    return docs.select("row", "text").mapInArrow(released(run), typed.schema)


def _connected(least: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Per row, the first row to which shared codewords lead, among rows of equal minima."""
    row, code = simhash.codewords(word)
    key = _mixed(least[row].view(np.uint64), code.astype(np.uint64))
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    bucket = np.empty(len(row), np.int64)
    bucket[order] = np.cumsum(new) - 1
    begins, own = np.flatnonzero(new), np.searchsorted(row, np.arange(len(word)))
    group = np.arange(len(word))
    while True:
        low = np.minimum.reduceat(group[row[order]], begins)
        found = np.minimum.reduceat(low[bucket], own)
        found = found[found]
        if (found == group).all():
            return group
        group = found


def _meetings(tabled: DataFrame, similarity: float, whole: int = 0) -> DataFrame:
    """Of rows (minima, at, word, node, n) sorted by minima, ``at`` their table: pairs (kind 0: u, v) of the nodes that share minima with few
    others and a codeword, and (kind 1: key, u, n) keys of minima and codeword of all that share minima with more. ``at`` is the key's last bits.

    Nodes with one minima and up to ``whole`` shingles in all have one key where shared codewords connect them, and their word with it; only
    those that share a codeword are candidates. The word of others is 0.
    """
    names = ["kind", "key", "u", "v", "n", "word"]

    def out(kind, key, u, v, n, word):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(u), kind, np.int32)), *(pa.array(x) for x in (key, u, v, n, word.astype(np.int32)))], names)

    def keys(least, at, word, node, n):
        for a in range(0, len(word), 50_000):
            row, code = simhash.codewords(word[a : a + 50_000])
            row += a
            key = _mixed(least[row].view(np.uint64), code.astype(np.uint64)) & ~np.uint64(63) | at[row].astype(np.uint64)
            zero = np.zeros(len(row), np.int64)
            yield out(1, key.view(np.int64), node[row], zero, n[row], zero)

    def settle(rows):
        least, _, _, _, n = rows
        starts = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        size = np.diff(starts, append=len(least))
        few = size <= SMALL
        held = ~few & (size <= HELD) & (np.add.reduceat(n, starts) <= whole)
        few, held = np.repeat(few, size), np.repeat(held, size)
        if not (few | held).all():
            yield from keys(*(x[~few & ~held] for x in rows))
        yield from pairs(least[few], *(x[few] for x in rows[2:]))
        if held.any():
            yield from connected(*(x[held] for x in rows))

    def connected(least, at, word, node, n):
        group = _connected(least, word)
        key = _mixed(least.view(np.uint64), node[group].view(np.uint64)) & ~np.uint64(63) | at.astype(np.uint64)
        order = np.argsort(group, kind="stable")
        group, key, word, node, n = (x[order] for x in (group, key.view(np.int64), word, node, n))
        size = np.unique(group, return_counts=True)[1]
        few = np.repeat(size <= SMALL, size)
        yield from pairs(group[few], word[few], node[few], n[few])
        yield out(1, key[~few], node[~few], np.zeros((~few).sum(), np.int64), n[~few], word[~few])

    def pairs(group, word, node, n):
        """Of groups of a few rows."""
        us, vs = [], []
        for shift in range(1, min(SMALL, len(group))):
            i = np.flatnonzero(group[shift:] == group[:-shift])
            i = i[_sizes_fit(n[i], n[i + shift], similarity)]
            i = i[simhash.share_codeword(word[i], word[i + shift])]
            us.append(np.minimum(node[i], node[i + shift]))
            vs.append(np.maximum(node[i], node[i + shift]))
        if us:
            u, v = np.concatenate(us), np.concatenate(vs)
            zero = np.zeros(len(u), np.int64)
            yield out(0, zero, u, v, zero, zero)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [np.zeros(0, np.int64)] * 5
        opened = None  # minima that more nodes share than are kept together and that go on
        for batch in batches:
            rows = [np.concatenate([x, batch.column(i).to_numpy().astype(np.int64)]) for i, x in enumerate(rows)]
            if opened is not None and len(rows[0]):
                end = int(np.searchsorted(rows[0], opened, side="right"))
                yield from keys(*(x[:end] for x in rows))
                rows = [x[end:] for x in rows]
            if not len(rows[0]):
                continue
            opened = None
            last = int(np.searchsorted(rows[0], rows[0][-1]))
            if last:
                yield from settle([x[:last] for x in rows])
                rows = [x[last:] for x in rows]
            if len(rows[0]) > SMALL and (len(rows[0]) > HELD or rows[4].sum() > whole):
                opened = int(rows[0][0])
                yield from keys(*rows)
                rows = [np.zeros(0, np.int64)] * 5
        if len(rows[0]):
            yield from settle(rows)

    return tabled.select("minima", "at", "word", "node", "n").mapInArrow(released(run), "kind int, key long, u long, v long, n long, word int")


def _sizes_fit(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of these sizes can be similar."""
    return np.minimum(a, b) >= similarity * np.maximum(a, b) - _EPS


def _candidates(keyed: DataFrame, part: int, similarity: float) -> DataFrame:
    """Of rows (key, node, n) sorted by key: pairs (kind 0: u, v) of small keys, and (kind 1: key, part, u, word) of the nodes of larger ones.

    Rows may have a word; where a key's words differ, only nodes whose words share a codeword are candidates.

    Pairs whose sizes alone keep them below ``similarity`` are left out. Each part of a larger key has the key's first node as well.
    """
    names = ["kind", "key", "part", "u", "v", "word"]
    if "word" not in keyed.columns:
        keyed = keyed.withColumn("word", F.lit(0))

    def out(kind, key, number, u, v, word):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(u), kind, np.int32)), pa.array(key), pa.array(number.astype(np.int32)), pa.array(u), pa.array(v), pa.array(word.astype(np.int32))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, node, n, word = (np.zeros(0, np.int64) for _ in range(4))
        opened = None  # the large key that goes on: [key, first node, shingles so far, last part, first word]

        def large(a, b, state):
            sums = state[2] + np.cumsum(n[a:b]) - n[a:b]
            number = sums // part
            state[2] += int(n[a:b].sum())
            new = [p for p in np.unique(number).tolist() if p > state[3]]
            state[3] = int(number[-1])
            u = np.concatenate([node[a:b], np.full(len(new), state[1])])
            number = np.concatenate([number, np.array(new, np.int64)])
            return out(1, np.full(len(u), state[0]), number, u, np.zeros(len(u), np.int64), np.concatenate([word[a:b], np.full(len(new), state[4])]))

        def settle(end):
            """The small keys among the first ``end`` rows."""
            k, x = key[:end], node[:end]
            starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            size = np.diff(starts, append=len(k))
            for a, m in zip(starts[size > SMALL].tolist(), size[size > SMALL].tolist()):
                yield large(a, a + m, [int(k[a]), int(x[a]), 0, 0, int(word[a])])
            few = np.repeat(size <= SMALL, size)
            us, vs = [], []
            for shift in range(1, min(SMALL, len(k))):
                at = np.flatnonzero((k[shift:] == k[:-shift]) & few[shift:])
                at = at[_sizes_fit(n[at], n[at + shift], similarity)]
                at = at[simhash.share_codeword(word[at], word[at + shift])]
                us.append(np.minimum(x[at], x[at + shift]))
                vs.append(np.maximum(x[at], x[at + shift]))
            if us:
                pair = np.unique(np.stack([np.concatenate(us), np.concatenate(vs)], axis=1), axis=0)
                zero = np.zeros(len(pair), np.int64)
                yield out(0, zero, zero, np.ascontiguousarray(pair[:, 0]), np.ascontiguousarray(pair[:, 1]), zero)

        for batch in batches:
            key, node, n, word = (np.concatenate([x, batch.column(i).to_numpy()]) for i, x in enumerate((key, node, n, word)))
            if not len(key):
                continue
            if opened is not None:
                end = int(np.searchsorted(key, opened[0], side="right"))
                if end:
                    yield large(0, end, opened)
                    key, node, n, word = key[end:], node[end:], n[end:], word[end:]
                if not len(key):
                    continue
                opened = None
            last = int(np.searchsorted(key, key[-1]))
            if last:
                yield from settle(last)
                key, node, n, word = key[last:], node[last:], n[last:], word[last:]
            if len(key) > SMALL:
                opened = [int(key[0]), int(node[0]), 0, 0, int(word[0])]
                yield large(0, len(key), opened)
                key, node, n, word = (np.zeros(0, np.int64) for _ in range(4))
        if len(key):
            yield from settle(len(key))

    return keyed.select("key", "node", "n", "word").mapInArrow(released(run), "kind int, key long, part int, u long, v long, word int")


def _forest(nodes: np.ndarray, values: np.ndarray, ends: np.ndarray, side: np.ndarray | None, similarity: float, words: np.ndarray | None = None) -> tuple[list, list]:
    """Links that connect what the similar pairs connect, of all nodes, of those on different sides, or of those whose words share a codeword.

    Of two nodes on different sides one isn't on the largest, so searches begin at the others, those of the smallest sides first.
    """
    size = np.diff(ends, prepend=0)
    waiting = np.ones(len(nodes), bool)
    us, vs = [], []
    begins = np.arange(len(nodes))
    if side is not None:
        _, of, n = np.unique(side, return_inverse=True, return_counts=True)
        largest = int(n.argmax())
        begins = np.lexsort((of, n[of]))
        begins = begins[of[begins] != largest]
    if words is not None:
        row, code = simhash.codewords(words)
        order = np.argsort(code, kind="stable")
        low, high = (np.searchsorted(code[order], code, x) for x in ("left", "right"))
        met, own_codes = row[order], np.searchsorted(row, np.arange(len(nodes) + 1))

    def others(at):
        if words is None:
            return np.flatnonzero(waiting)
        every = np.concatenate([met[low[k] : high[k]] for k in range(own_codes[at], own_codes[at + 1])])
        return np.unique(every[waiting[every]])

    for first in begins.tolist():
        if not waiting[first]:
            continue
        waiting[first] = False
        frontier = [first]
        while frontier:
            at = frontier.pop()
            may = others(at)
            may = may[_sizes_fit(size[may], size[at], similarity)]
            if side is not None:
                may = may[side[may] != side[at]]
            if not len(may):
                continue
            own = values[ends[at] - size[at] : ends[at]]
            n = size[may]
            stop = np.cumsum(n)
            theirs = values[np.arange(stop[-1]) + np.repeat(ends[may] - stop, n)]
            place = np.minimum(np.searchsorted(own, theirs), len(own) - 1)
            both = np.bincount(np.repeat(np.arange(len(may)), n)[own[place] == theirs], minlength=len(may))
            hit = may[both >= similarity * (n + size[at] - both) - _EPS]
            us += [nodes[at]] * len(hit)
            vs += nodes[hit].tolist()
            waiting[hit] = False
            frontier += hit.tolist()
    return us, vs


def _in_tasks(rows: DataFrame, by: list[str], similarity: float) -> DataFrame:
    """Links of rows (by..., part, node, word, set); where rows have a label, only links between labels, else where a group has two parts between these."""
    named = "label" in rows.columns

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        node, part = table["node"].to_numpy(), table["label" if named else "part"].to_numpy()
        sets = table["set"].combine_chunks()
        values = sets.flatten().to_numpy().view(np.uint64)
        ends = np.cumsum(sets.value_lengths().to_numpy().astype(np.int64))
        words = table["word"].to_numpy().astype(np.int64)
        u, v = _forest(node, values, ends, None if (part == part[0]).all() else part, similarity, None if (words == words[0]).all() else words)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return rows.select(*dict.fromkeys([*by, "part", "node", "word", "set", *(["label"] if named else [])])).groupBy(*by).applyInArrow(run, "u long, v long")


def linked_components(keyed: DataFrame, sets_of: Callable[[DataFrame], DataFrame], similarity: float = SIMILARITY, part: int = PART, labels: DataFrame | None = None, more: DataFrame | None = None, first: str = "true") -> tuple[DataFrame, DataFrame]:
    """(links, components) of rows (key, node, n), whose nodes with one key are compared: links (u, v) connect what similar pairs connect.

    Where rows have a word, those nodes of a key are compared that share a codeword.

    ``sets_of`` gives (node, set) of the nodes in a column w. Components are (node, component), of each node that links to another. With
    ``labels`` (node, label), a row for each node, only nodes of different labels are compared. ``more`` are pairs (u, v) that are compared
    too. Of larger keys, those for which ``first`` holds are compared before the others.
    """
    ordered = keyed.repartition(shuffle_partitions(keyed.sparkSession), "key").sortWithinPartitions("key")
    found = _candidates(ordered, part, similarity)
    if more is not None:
        found = found.unionByName(more.selectExpr("0 as kind", "0L as key", "0 as part", "u", "v", "0 as word"))
    found = cut(found.distinct())
    pairs, large = found.where("kind = 0").select("u", "v"), found.where("kind = 1").select("key", "part", F.col("u").alias("node"), "word")
    if labels is not None:
        a, b = (labels.select(F.col("node").alias(f"n{s}"), F.col("label").alias(f"l{s}")) for s in "ab")
        pairs = cut(pairs.join(a, F.col("u") == F.col("na")).join(b, F.col("v") == F.col("nb")).where("la <> lb").select("u", "v"))
        large = large.join(labels, "node")
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("w")).unionByName(large.select(F.col("node").alias("w"))).distinct()
    path = fresh_path(keyed.sparkSession, "sets")
    with freed_shuffles(keyed.sparkSession):
        sets_of(wanted).write.parquet(path)
    sets = keyed.sparkSession.read.schema("node long, set array<long>").parquet(path)
    links, known = _linked_by_sets(pairs, large.where(first), sets, similarity, labels is not None)
    late = large.where(f"not ({first})")
    if not late.isEmpty():
        known = cut(known).withColumnRenamed("component", "label")
        late = late.select("key", "part", "node", "word").join(known, "node", "left").withColumn("label", F.coalesce("label", "node"))
        open_ = late.groupBy(F.col("key").alias("k")).agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("k")
        late = cut(late.join(open_, F.col("key") == F.col("k"), "left_semi"))
        links = cut(links.unionByName(_linked_by_sets(pairs.limit(0), late, sets, similarity, True)[0]))
        known = cut(components(links))
    drop(keyed.sparkSession, path)
    return links, known


def _linked_by_sets(pairs: DataFrame, large: DataFrame, sets: DataFrame, similarity: float, named: bool) -> tuple[DataFrame, DataFrame]:
    """``linked_components`` of candidate pairs (u, v) and of larger keys' rows (key, part, node, word), whose sets (node, set) are compared."""
    a, b = (sets.select(F.col("node").alias(f"n{s}"), F.col("set").alias(f"s{s}")) for s in "ab")
    both = F.size(F.array_intersect("sa", "sb"))
    near = F.least(F.size("sa"), F.size("sb")) >= F.lit(similarity) * F.greatest(F.size("sa"), F.size("sb")) - _EPS
    enough = both >= F.lit(similarity) * (F.size("sa") + F.size("sb") - both) - _EPS
    links = pairs.join(a, F.col("u") == F.col("na")).join(b, F.col("v") == F.col("nb")).where(F.when(near, enough).otherwise(False)).select("u", "v")
    if large.isEmpty():
        links = cut(links)
        return links, components(links)
    links = cut(links.unionByName(_in_tasks(large.join(sets, "node"), ["key", "part"], similarity)))
    known = cut(components(links))
    # the parts of a key meet each other unless its nodes are one component already
    labelled = large.select("key", "part", "node").join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_ = labelled.groupBy(F.col("key").alias("k")).agg(F.max("part").alias("last"), F.min("component").alias("x"), F.max("component").alias("y")).where("last > 0 and x <> y")
    open_ = cut(open_.select("k", "last"))
    if open_.isEmpty():
        return links, known
    dealt = large.join(open_, F.col("key") == F.col("k")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last")))).where("other <> part")
    dealt = dealt.select("key", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "node", "word", *(["label"] if named else []))
    links = cut(links.unionByName(_in_tasks(dealt.join(sets, "node"), ["key", "lo", "hi"], similarity)))
    return links, components(links)


def sets_of_texts(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, set) of (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), shingle).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "set"])

    return texts.mapInArrow(released(run), "node long, set array<long>")


def similar_components(docs: DataFrame, prints: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, part: int = PART) -> DataFrame:
    """(node, component) of each node that links to another; docs (row, text), prints (row, node, n, minima, words)."""
    nodes = prints.where("n > 0").dropDuplicates(["node"])
    tabled = nodes.select("node", "n", F.posexplode(F.arrays_zip("minima", "words")).alias("at", "x")).select(F.col("x.minima").alias("minima"), "at", F.col("x.words").alias("word"), "node", "n")
    dealt = tabled.repartition(shuffle_partitions(prints.sparkSession), "minima").sortWithinPartitions("minima")
    found = cut(_meetings(dealt, similarity, part))

    def sets_of(wanted: DataFrame) -> DataFrame:
        # one row of each node that is wanted gives its set; rows that are equal in every column have one key, by which the join has dealt them
        rows = prints.join(wanted, F.col("node") == F.col("w"), "left_semi").groupBy("node").agg(F.min("row").alias("of"))
        return sets_of_texts(docs.join(rows, F.col("row") == F.col("of")).dropDuplicates(["of"]).select("node", "text"), shingle)

    keyed = found.where("kind = 1").select("key", F.col("u").alias("node"), "n", "word")
    return linked_components(keyed, sets_of, similarity, part, more=found.where("kind = 0").select("u", "v"), first=f"(key & 63) < {FIRST}")[1]


def one_of_each_group(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, part: int = PART
) -> DataFrame:
    """The rows of ``docs`` that stay when each group of near duplicates keeps the one with the smallest id (null last).

    A group is what links of at least ``similarity`` connect. A text of fewer words than ``shingle`` is one shingle; those without words, or
    null, are one group.
    """
    every = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    k1, k2 = row_keys(docs.columns)
    keyed = docs.select(every.alias("whole"), k1.alias("k1"), k2.alias("k2"))
    narrow = keyed.select(F.struct(F.col(f"whole.`{id_col}`").isNull().alias("last"), F.col(f"whole.`{id_col}`").alias("id"), "k1", "k2").alias("row"), F.col(f"whole.`{text_col}`").alias("text"))
    prints = cut(_sketches(narrow, shingle))
    by_key = F.struct(F.col("row.k1"), F.col("row.k2"))
    found = cut(similar_components(narrow.select(by_key.alias("row"), "text"), prints.select(by_key.alias("row"), "node", "n", "minima", "words"), similarity, shingle, part))
    labelled = prints.join(found.select(F.col("node").alias("of"), "component"), F.col("node") == F.col("of"), "left")
    labelled = labelled.select("row", F.coalesce("component", "node").alias("group"))
    stay = cut(labelled.groupBy("group").agg(F.min("row").alias("p")).select(F.col("p.k1").alias("s1"), F.col("p.k2").alias("s2")))
    # rows that are equal in every column have one key: one of them stays
    kept = keyed.join(stay, (F.col("k1") == F.col("s1")) & (F.col("k2") == F.col("s2"))).dropDuplicates(["k1", "k2"])
    return kept.select("whole.*")
