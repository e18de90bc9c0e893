"""Plain Python versions of the contracts, for small tables."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

WORD = re.compile(r"[^ \t-\r]+")
PART = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(data: str | bytes) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def in_order(docs):
    """(doc_id, text) rows by id, nulls last, ties by text."""
    return sorted(docs, key=lambda d: (d[0] is None, d[0] or 0, d[1] is None, (d[1] or "").encode()))


def substring(docs, size=13):
    large = math.inf
    first = {}
    words = [(large if i is None else i, WORD.findall(t or "")) for i, t in docs]
    for i, w in words:
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            first[key] = min(first.get(key, large), i)
    out = []
    for (doc_id, _), (i, w) in zip(docs, words):
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < i:
                gone[k : k + size] = [True] * size
        out.append((doc_id, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def suffix(docs, size=100):
    seen, out = set(), []
    for doc_id, text in in_order(docs):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - size + 1):
            key = data[k : k + size]
            if key in seen:
                gone[k : k + size] = b"\1" * size
            seen.add(key)
        spans = sum(1 for k in range(len(data)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((doc_id, len(data), sum(gone), spans, bytes(c for c, g in zip(data, gone) if not g)))
    return out


def lines(docs, least=10):
    large = math.inf
    first = {}

    def keys(text):
        return [x.strip(" \t\n\x0b\x0c\r").translate(LOWER) for x in (text or "").split("\n")]

    for i, t in docs:
        for k in keys(t):
            first[k] = min(first.get(k, large), large if i is None else i)
    out = []
    for i, t in docs:
        all_lines = (t or "").split("\n")
        kept = [x for x, k in zip(all_lines, keys(t)) if not (len(k) >= least and first[k] < (large if i is None else i))]
        out.append((i, len(all_lines), len(all_lines) - len(kept), "\n".join(kept)))
    return out


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def near(docs, percent=75):
    """{doc_id: (n_shingles, component_id)} of documents with distinct ids."""
    sets = {i: shingles(t) for i, t in docs}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def leaks(docs, items, size=10):
    windows = collections.defaultdict(set)
    for item_id, text in items:
        words = PART.findall((text or "").translate(LOWER))
        n = min(size, len(words))
        for k in range(len(words) - n + 1 if words else 0):
            windows[tuple(words[k : k + n])].add(str(item_id))
    lengths = {len(w) for w in windows}
    out = []
    for i, t in docs:
        words = PART.findall((t or "").translate(LOWER))
        hit, found = [0] * len(words), set()
        for n in lengths:
            for k in range(len(words) - n + 1):
                owners = windows.get(tuple(words[k : k + n]))
                if owners:
                    found |= owners
                    hit[k : k + n] = [1] * n
        out.append((i, len(words), sum(hit), sorted(found)))
    return out


_KINDS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def personal(text):
    found = []
    for order, (kind, pattern) in enumerate(_KINDS.items()):
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {
                "email": True,
                "ip": kind != "ip" or all(int(p) <= 255 for p in m.group().split(".")),
                "card": 14 <= len(digits) <= 19 and luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if ok:
                found.append((m.start(), order, kind, m.end()))
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found))


def held_out(doc_id, modulus, remainder):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % modulus == remainder


def _steps(data, depth):
    for p in range(len(data)):
        context = data[max(0, p - depth) : p]
        context = bytes(depth - len(context)) + context
        for k in range(8):
            yield context, (1 << k) | (data[p] >> (8 - k)), (data[p] >> (7 - k)) & 1


def context_tree(docs, modulus=7, remainder=2, depth=4):
    """{doc_id: (held_out, n_tokens, n_known, train_tokens, base_score, score)} by direct recursion."""
    train = [t for i, t in docs if not held_out(i, modulus, remainder)]
    tokens = collections.Counter()
    counts = [collections.Counter() for _ in range(depth + 1)]
    for t in train:
        tokens.update([*WORD.findall((t or "").translate(LOWER)), None])
        for context, node, bit in _steps((t or "").translate(LOWER).encode(), depth):
            for d in range(depth + 1):
                counts[d][context[depth - d :], node, bit] += 1
    weighted, own = [{} for _ in range(depth + 1)], [{} for _ in range(depth + 1)]

    def kt(d, state):
        a, b = counts[d][(*state, 0)], counts[d][(*state, 1)]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    for d in range(depth, -1, -1):
        below = collections.defaultdict(float)
        if d < depth:
            for (context, node), w in weighted[d + 1].items():
                below[context[1:], node] += w
        for state in {k[:2] for k in counts[d]}:
            estimate = kt(d, state)
            if d == depth:
                weighted[d][state], own[d][state] = estimate, 1.0
            else:
                high = max(estimate, below[state])
                weighted[d][state] = high + math.log(math.exp(estimate - high) + math.exp(below[state] - high)) - math.log(2)
                own[d][state] = math.exp(estimate - math.log(2) - weighted[d][state])
    total, distinct, out = sum(tokens.values()), len(tokens), {}
    for i, t in docs:
        score = 0.0
        for context, node, bit in _steps((t or "").translate(LOWER).encode(), depth):
            p = 0.5
            for d in range(depth, -1, -1):
                state = (context[depth - d :], node)
                if state in own[d]:
                    a, b = counts[d][(*state, 0)], counts[d][(*state, 1)]
                    p = own[d][state] * ((b if bit else a) + 0.5) / (a + b + 1) + (1 - own[d][state]) * p
                else:
                    p = 0.5
            score += math.log10(p)
        words = [*WORD.findall((t or "").translate(LOWER)), None]
        base = sum(math.log10((tokens[w] + 1) / (total + distinct + 1)) for w in words)
        out[i] = (held_out(i, modulus, remainder), len(words), sum(tokens[w] > 0 for w in words), total, base, score)
    return out


def vector(cells, scale):
    """Whole components, or None where one is missing or not finite."""
    if cells is None or not cells or any(x is None or not math.isfinite(x) for x in cells):
        return None
    return [math.floor(scale * x) for x in cells]


def squared(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def centroids(rows, clusters=16, rounds=3, dims=64, scale=64):
    """(vec_id, cluster, distance) of all rows, and the final centroids."""
    kept = [(i, v) for i, v in ((i, vector(c, scale)) for i, c in rows) if v is not None and len(v) == dims]
    first = sorted((sha(f"1:{'' if i is None else i}"), v) for i, v in kept)[:clusters]
    centres = [v for _, v in first]
    for number in range(rounds + 1):
        nearest = [min((squared(v, c), n) for n, c in enumerate(centres)) for _, v in kept]
        if number < rounds:
            for n in range(len(centres)):
                own = [v for (_, v), (_, at) in zip(kept, nearest) if at == n]
                if own:
                    centres[n] = [sum(x) // len(own) for x in zip(*own)]
    return [(i, n, d) for (i, _), (d, n) in zip(kept, nearest)], centres


def codes(rows, positions=16, entries=64, rounds=2, scale=256):
    """(vec_id, label, code, error) of all rows of (vec_id, label, cells), and the codebooks by position and entry."""
    whole = [(i, label, v) for i, label, v in ((i, label, vector(c, scale)) for i, label, c in rows) if v is not None and len(v) % positions == 0]
    lengths = collections.Counter(len(v) for _, _, v in whole)
    dims = max(lengths, key=lambda n: (lengths[n], n), default=positions)
    kept, width = [r for r in whole if len(r[2]) == dims], dims // positions
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(positions)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    books = [list(b) for b in zip(*(cut(v) for _, _, v in first))]
    for number in range(rounds + 1):
        nearest = [[min((squared(part, e), n) for n, e in enumerate(book)) for part, book in zip(cut(v), books)] for _, _, v in kept]
        if number < rounds:
            for p, book in enumerate(books):
                for n in range(len(book)):
                    own = [cut(v)[p] for (_, _, v), near_ in zip(kept, nearest) if near_[p][1] == n]
                    if own:
                        book[n] = [sum(x) // len(own) for x in zip(*own)]
    return [(i, label, bytes(n for _, n in found), sum(d for d, _ in found)) for (i, label, _), found in zip(kept, nearest)], books


def licenses(docs, templates, rare=8, slack=8, share=0.5):
    """(doc_id, n_words, places) of all rows; a place is (template number, start, end, score)."""
    split = [PART.findall((t or "").translate(LOWER)) for _, t in docs]
    every = {w for t in templates for text in (t.text, *t.phrases) for w in text.split()}
    weight = {w: 1 + math.log((1 + len(docs)) / (1 + sum(w in set(words) for words in split))) for w in every}
    out = []
    for (i, _), words in zip(docs, split):
        at = lambda phrase: [k for k in range(len(words)) if words[k : k + len(phrase)] == phrase]  # noqa: E731, B023
        places = []
        for number, t in enumerate(templates):
            body = t.text.split()
            if not t.phrases:
                places += [(number, k, k + len(body), 1.0) for k in at(body)]
                continue
            best = sorted(set(body), key=lambda w: (-weight[w], w))[:rare]
            hits = sorted((k - body.index(w), w) for k, w in enumerate(words) if w in best)
            groups = []
            for offset, w in hits:
                if groups and offset - groups[-1][-1][0] <= slack:
                    groups[-1].append((offset, w))
                else:
                    groups.append([(offset, w)])
            for group in groups:
                score = sum(weight[w] for w in {w for _, w in group}) / sum(weight[w] for w in best)
                lo, hi = max(0, group[0][0] - slack), min(len(words), group[-1][0] + len(body) + slack)
                if score >= share - 1e-12 and all(any(lo <= k and k + len(p.split()) <= hi for k in at(p.split())) for p in t.phrases):
                    places.append((number, lo, hi, min(score, 1.0)))
        out.append((i, len(words), sorted(places)))
    return out
