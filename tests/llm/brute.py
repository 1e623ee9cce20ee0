"""Plain Python versions of the corpus operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingle_set(text, n):
    w = words(lower(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1)))


def components(docs, n, num, den):
    """docs: (id, text). id -> smallest id reachable by links."""
    sets = [(i, shingle_set(t, n)) for i, t in docs if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and den * len(a & b) >= num * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def removed(docs, length=50):
    """docs: (id, text). For each in order: (bytes kept, bytes, bytes removed, runs removed)."""
    first = {}
    data = [(i, (t or "").encode()) for i, t in docs]
    for i, b in data:
        if i is not None:
            for p in range(len(b) - length + 1):
                w = b[p : p + length]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, b in data:
        mark = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if i is not None and first[b[p : p + length]] < i:
                mark[p : p + length] = b"\1" * length
        kept = bytes(c for c, m in zip(b, mark, strict=True) if not m)
        runs = sum(1 for p in range(len(mark)) if mark[p] and (p == 0 or not mark[p - 1]))
        out.append((kept, len(b), sum(mark), runs))
    return out


def digest(kept):
    return hashlib.sha256(kept).hexdigest()


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    grams = defaultdict(list)
    for i in range(len(w) - 4):
        grams[tuple(w[i : i + 5])].append(i)
    repeat = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(5)}
    failed = len(w) < 10 or 100 * len(repeat) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeat), failed


def kept(text):
    n, chars, symbols, dup, _, failed = quality(text)
    lines = sum(1 for x in (text or "").split("\n") if words(x))
    other = sum(1 for c in "".join(words(text)) if not c.isalpha())
    return not (failed or 10 * symbols > n or not 2 * n <= chars <= 15 * n or (dup >= 2 and 2 * dup > lines) or 10 * other > 7 * chars)


def targets(sizes, weights=(1, 2, 3), epochs=3):
    """sizes: source -> words. Shares by weight; what is above epochs * size is shared again among the others."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    capped: set = set()
    total = sum(sizes.values())
    while True:
        rest = total - sum(epochs * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > epochs * sizes[s] + 1e-9]
        if not over:
            return {s: float(epochs * sizes[s]) if s in capped else share[s] for s in order}
        capped |= set(over)


GOLDEN = 0.6180339887498949


def taken(docs, weights=(1, 2, 3), slots=121_393, point=lambda i: i * GOLDEN - math.floor(i * GOLDEN)):
    """docs: (id, text, source). For each: (size, source size, target, words taken, first slot)."""
    rows = [(i, len(words(t)), s) for i, t, s in docs]
    sizes = defaultdict(int)
    for _, n, s in rows:
        sizes[s] += n
    goal = targets(sizes, weights)
    total = sum(sizes.values())
    tape = defaultdict(list)  # for each word, the row that it belongs to
    for k in sorted(range(len(rows)), key=lambda k: (hashlib.md5(str("" if rows[k][0] is None else rows[k][0]).encode()).hexdigest(), rows[k][1])):
        tape[rows[k][2]] += [k] * rows[k][1]
    ends, at = [], 0.0
    for s in sorted((s for s in goal if goal[s] > 0), key=lambda s: (s is None, (s or "").encode())):
        at += goal[s]
        ends.append((at, at - goal[s], s))
    filled = defaultdict(list)
    for slot in range(slots if total else 0):
        u = point(slot)
        filled[next(s for to, lo, s in ends if lo / at <= u < to / at)].append(slot)
    got, first = Counter(), {}
    for to, lo, s in ends:
        have = filled[s] or [math.floor((lo / at + to / at) / 2 * slots)]
        words_to_take = math.floor(goal[s] + 0.5)
        for r, slot in enumerate(have):
            for x in range(r * words_to_take // len(have), (r + 1) * words_to_take // len(have)):
                k = tape[s][x % sizes[s]]
                got[k] += 1
                first[k] = min(first.get(k, slot), slot)
    return [(n, sizes[s], goal[s], got[k], first.get(k)) for k, (_, n, s) in enumerate(rows)]


def clusters(rows, k=40, rounds=5, seed=2, dim=64):
    """rows: (id, vector). For each kept row: (id, cluster, distance, inertia of the cluster, of all, centroid hash)."""
    kept = [(i, tuple(math.floor(256 * float(x)) for x in v)) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in start[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        of = assign()
        for j in range(len(centroids)):
            mine = [v for (_, v), (_, c) in zip(kept, of, strict=True) if c == j]
            if mine:
                centroids[j] = tuple(sum(col) // len(mine) for col in zip(*mine, strict=True))
    of, inertia = assign(), Counter()
    for d, c in of:
        inertia[c] += d
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, c, d, inertia[c], sum(inertia.values()), name[c]) for (i, _), (d, c) in zip(kept, of, strict=True)]


TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def ranked(docs, items, k=10):
    """docs: (id, text), items: (id, text). (item, rank, document, score) of each item's k best."""
    held = [(i, Counter(TERM.findall(lower(t)))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        asked = set(TERM.findall(lower(text)))
        for i, c in held:
            m = 10 + 90 * sum(c.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in asked if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(found, key=lambda x: x[:3])[:k])]
    return out
