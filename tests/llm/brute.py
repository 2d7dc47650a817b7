"""The operators' rules written plainly, for small inputs."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k=5):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if i < j and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def spans(texts, width):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[p : p + width] for d in data for p in range(len(d) - width + 1))
    out = []
    for d in data:
        hit = bytearray(len(d))
        for p in range(len(d) - width + 1):
            if seen[d[p : p + width]] > 1:
                hit[p : p + width] = b"\1" * width
        kept = bytes(x for x, h in zip(d, hit, strict=True) if not h)
        runs = len(re.findall(b"\1+", bytes(hit)))
        out.append((len(d), sum(hit), runs, hashlib.sha256(kept).hexdigest()))
    return out


def best(vectors, k):
    """vectors: [(id, list)]; queries are ids divisible by 100."""
    out = set()
    for q, a in vectors:
        if q % 100 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in vectors if i != q)
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])}
    return out


def fits(lengths, capacity):
    """The least number of bins, by exhaustive search; for a handful of pieces."""
    pieces, best_ = sorted(lengths, reverse=True), [len(lengths)]

    def go(i, bins):
        if len(bins) >= best_[0]:
            return
        if i == len(pieces):
            best_[0] = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + pieces[i] <= capacity:
                bins[b] += pieces[i]
                go(i + 1, bins)
                bins[b] -= pieces[i]
        bins.append(pieces[i])
        go(i + 1, bins)
        bins.pop()

    go(0, [])
    return best_[0]
