"""Plain versions of the contracts, for tests."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash


def lower(text):
    return (text or "").encode().lower()


def fingerprint(text, k=4):
    words = re.findall(rb"[^\x20\x09-\x0D]+", lower(text))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if counts[b] * 2 > len(shingles))


def simhash(rows, k=4, bits=4):
    fps = [fingerprint(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)].append(d)
    return sorted((d, f"{fps[i]:016x}", min(least[root(i)], default=None)) for i, (d, _) in enumerate(rows))


def contamination(docs, items, w=10):
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for item, text in items:
        ws = word.findall(lower(text))
        if item is None or not ws:
            continue
        for i in range(max(1, len(ws) - w + 1)):
            windows[tuple(ws[i : i + w])].add(str(item))
    sizes = {len(x) for x in windows}
    out = []
    for d, text in docs:
        ws = word.findall(lower(text))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(ws) - n + 1):
                if (of := windows.get(tuple(ws[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= of
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((d, len(ws), len(hit), len(found), sha, bool(hit)))
    return out


def repeats(docs, length=400):
    raw = [(d, (t or "").encode()) for d, t in docs]
    seen = Counter(b[i : i + length] for _, b in raw for i in range(len(b) - length + 1))
    out = []
    for d, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def tokens(docs, path, end=2):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    start, out = 0, []
    for d, t in sorted(docs, key=lambda r: (r[0] is not None, r[0])):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [end]
        out.append((d, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    return out


def one_of_each_group(rows, k=5, similarity=0.8):
    """The ids that stay of (id, text) without null ids."""
    sets = {}
    for d, t in rows:
        words = lower(t).split()
        sets[d] = {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return [d for d in ids if root(d) == d]


def mix(docs, labels, weights=(5, 2, 1), epochs=3):
    """(id, source, size, copies) of docs (id, text, source), in the order of their exponential keys within a source.

    The key is -ln(u) / weight, u from Spark's XXH64 of the seed and the id: its first 53 bits and a half.
    """
    quality = {}
    for d, q in labels:
        if d is not None and q is not None:
            quality[d] = max(q, quality.get(d, q))

    def key(d):
        seed = xxhash.xxh64_intdigest((17).to_bytes(4, "little"), 42)
        h = seed if d is None else xxhash.xxh64_intdigest(d.to_bytes(8, "little", signed=True), seed)
        weight = {None: 0.5, 1: 1.0, 0: 0.25}[quality.get(d)]
        return -math.log(((h >> 11) + 0.5) / 2.0**53) / weight

    rows = [(d, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for d, t, s in docs]
    sources = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s or ""))
    size = {s: sum(n for _, x, n in rows if x == s) for s in sources}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    total, capped = sum(size.values()), set()
    while len(capped) < len(sources):
        level = (total - sum(epochs * size[s] for s in capped)) / sum(weight[s] for s in sources if s not in capped)
        more = {s for s in sources if s not in capped and weight[s] * level > epochs * size[s]}
        if not more:
            break
        capped |= more
    out = []
    for s in sources:
        target = epochs * size[s] if s in capped else weight[s] * level
        whole = min(epochs, int(target // size[s])) if size[s] else 0
        rest, before = target - whole * size[s], 0
        for d, _, n in sorted((r for r in rows if r[1] == s), key=lambda r: (key(r[0]), r[0] is not None, r[0] or 0, r[2])):
            out.append((d, s, n, 0 if n == 0 else whole + (whole < epochs and before + n / 2 <= rest)))
            before += n
    return out


def language(train, docs, places=1 << 21, min_rate=2e-6, min_share=0.5):
    """(language, score) of each text of ``docs``, learned from (text, language); the filter is two tables of sets."""
    factors, shift = (0x2545F491, 0x1B873593), 32 - (places.bit_length() - 1)

    def grams(text):
        data = b"".join(bytes([x]) if 97 <= x <= 122 or x >= 128 or x == 0 else b" " for x in lower(text))
        data = re.sub(rb" +", b" ", data)
        return [int.from_bytes(data[i : i + 4], "little") for i in range(len(data) - 3) if 0 not in data[i : i + 4]]

    counts = defaultdict(Counter)
    for text, lang in train:
        if text is not None and lang is not None:
            counts[lang].update(grams(text))
    names = sorted(counts)
    totals = {x: sum(c.values()) for x, c in counts.items()}
    best = Counter()
    for x, c in counts.items():
        for g, n in c.items():
            best[g] = max(best[g], n / totals[x])
    held = {x: {g for g, n in c.items() if n / totals[x] >= min_rate and n / totals[x] >= min_share * best[g]} for x, c in counts.items()}
    place = lambda g: [(g * f & 0xFFFFFFFF) >> shift for f in factors]
    filled = {x: {p for g in held[x] for p in place(g)} for x in names}
    false = {x: (len(filled[x]) / places) ** 2 for x in names}
    common = max(names, key=lambda x: totals[x], default=None)
    out = []
    for text in docs:
        if text is None or not any(c.isalpha() for c in text) or not names:
            out.append(("und", 0.0))
            continue
        gs = grams(text)
        real = [max(0.0, (sum(all(p in filled[x] for p in place(g)) for g in gs) - len(gs) * false[x]) / (1 - false[x])) for x in names]
        total = sum(real)
        out.append((names[real.index(max(real))], max(real) / total) if total > 0 else (common, 0.0))
    return out


def minhash(rows, k=3, percent=85):
    """(doc_id, n_shingles, component_id, kept) of (id, text) without null ids, over all pairs."""
    sets = []
    for _, t in rows:
        words = lower(t).split()
        sets.append({tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= percent * (len(a) + len(b) - both):
                    parent[root(i)] = root(j)
    smallest = {}
    for i, (d, _) in enumerate(rows):
        smallest[root(i)] = min(d, smallest.get(root(i), d))
    return [(d, len(sets[i]), smallest[root(i)], d == smallest[root(i)]) for i, (d, _) in enumerate(rows)]


def search(docs, items, k=50):
    """(item_id, rank, doc_id, score) of (id, text) and (id, text)."""
    word = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
    counts = [Counter(word.findall(lower(t))) for _, t in docs]
    sizes = [sum(c.values()) for c in counts]
    n, total = sum(x > 0 for x in sizes), sum(sizes)
    df = Counter(t for c in counts for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        terms = set(word.findall(lower(text)))
        scores = []
        for (d, _), c, size in zip(docs, counts, sizes):
            m = 50 + (50 * size * n) // max(1, total)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if s > 0:
                scores.append((-s, d is None, d, s))
        out += [(item, i + 1, d, s) for i, (_, _, d, s) in enumerate(sorted(scores)[:k])]
    return out


def cross_tokens(docs, path_a, path_b):
    """The columns of op13_cross_tokens by plain loops over whole texts."""
    import json

    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
    a.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(x): x for x in printable} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in printable)}
    names = {i: t for t, i in json.load(open(path_a))["model"]["vocab"].items()}
    linked, rows = [], []
    for d, t in docs:
        groups, links, x, y = [], [], [], []
        if t:
            x, y = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
            xb = [bytes(letters[c] for c in names[i]) for i in x]
            yb = [bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
            if not b"".join(xb) == b"".join(yb) == (" " + t).encode():
                x, y = [], []
        if x:
            i = j = at_a = at_b = 0
            first = (0, 0)
            while i < len(x) and j < len(y):
                links.append((x[i], y[j]))
                end_a, end_b = at_a + len(xb[i]), at_b + len(yb[j])
                if end_a == end_b:
                    groups.append((x[first[0] : i + 1], y[first[1] : j + 1]))
                    first = (i + 1, j + 1)
                if end_a <= end_b:
                    i, at_a = i + 1, end_a
                if end_b <= end_a:
                    j, at_b = j + 1, end_b
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        rows.append((d, len(x), len(y), len(groups), len(links), hashlib.sha256(text.encode()).hexdigest() if x else ""))
        linked.append(links)
    counts = Counter(p for links in linked for p in set(links))
    most = defaultdict(int)
    for (i, _), n in counts.items():
        most[i] = max(most[i], n)
    return [(*r[:5], sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), r[5]) for r, links in zip(rows, linked)]
