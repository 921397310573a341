"""BagMinHash signatures of weighted word shingles, in numpy.

A document is a bag: each shingle of five words has the number of its
occurrences as weight, discretised to whole levels. Level ranges [0, 1), [1, 2),
[2, 4), [4, 8), ... are the first hierarchy: each has a Poisson process of its
own, seeded by shingle and range, so all documents see the same points. A range
that the weight ends in is thinned: each point has a level, and counts only
below the weight. A point's register is uniform, a register keeps its earliest
point, and the shares of equal registers estimate weighted Jaccard similarity
without bias. Points are generated in order of time up to a horizon at which
almost every register is taken; documents with a free register go on.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)

#: A-Z in lower case, other bytes that are no ASCII letter or digit as space.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(NORMAL).split()


_powers = np.ones((2, 1), U)


def powers(n: int) -> np.ndarray:
    """Powers of the base and of its inverse, 0 to n - 1."""
    global _powers
    if _powers.shape[1] < n:
        step = np.array([[BASE], [BASE_INVERSE]], U)
        _powers = np.cumprod(np.concatenate([np.ones((2, 1), U), np.repeat(step, 2 * n, 1)], 1), axis=1)
    return _powers


def shingles(docs: list[list[bytes]], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, 64-bit hash) of every shingle; a document of fewer words has one of all of them, of none has none."""
    counts = np.array([len(d) for d in docs], np.int64)
    data = np.frombuffer(b" ".join(b" ".join(d) for d in docs if d), np.uint8)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, U)
    pw, inv = powers(len(data) + 1)
    prefix = np.concatenate([np.zeros(1, U), np.cumsum((data.astype(U) + U(1)) * pw[: len(data)])])
    gaps = np.flatnonzero(data == 32)
    begin, end = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(data)]])
    doc = np.repeat(np.arange(len(docs)), counts)
    first = np.cumsum(counts) - counts
    nth = np.arange(len(doc)) - first[doc]
    at = np.flatnonzero((nth + size <= counts[doc]) | (nth == 0))
    last = np.minimum(at + size, (first + counts)[doc[at]]) - 1
    return doc[at], mix((prefix[end[last]] - prefix[begin[at]]) * inv[begin[at]])


def weighted(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, hash, occurrences), and each occurrence's number in sorted order."""
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    start = np.flatnonzero(new)
    weight = np.diff(np.append(start, len(doc)))
    nth = np.arange(len(doc)) - np.repeat(start, weight)
    return doc[start], h[start], weight, nth


def units(h: np.ndarray, weight: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """A number for each occurrence, equal in two documents for equal shingle and occurrence: multisets as sets."""
    return mix(np.repeat(h, weight) + nth.astype(U) * U(0xD1342543DE82EF95)).view(np.int64)


def signatures(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """n_docs x m registers; documents without shingles have infinite ones."""
    total = np.bincount(doc, weight, n_docs)
    horizon = np.full(n_docs, np.inf)
    np.divide(np.log(m) + 4.0, total, out=horizon, where=total > 0)
    out = np.full((n_docs, m), np.inf)
    # ranges of levels: number o begins at 0 for 0, else at 2 ** (o - 1)
    n_ranges = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1, 1)
    unit = np.repeat(np.arange(len(doc)), n_ranges)
    o = np.arange(len(unit)) - np.repeat(np.cumsum(n_ranges) - n_ranges, n_ranges)
    low = np.where(o > 0, 2.0 ** (o - 1), 0.0)
    width = np.maximum(low, 1.0)
    seed = mix(h[unit] + o.astype(U) * U(0xA0761D6478BD642F))
    todo = total > 0
    while todo.any():
        now = np.flatnonzero(todo[doc[unit]])
        d, s, w, lo, wd = doc[unit[now]], seed[now], weight[unit[now]].astype(float), low[now], width[now]
        t, limit = np.zeros(len(now)), horizon[d]
        while len(d):
            s = s + U(0x9E3779B97F4A7C15)
            a = mix(s)
            t = t - np.log(((a >> U(11)).astype(float) + 0.5) * 2.0**-53) / (m * wd)
            on = t <= limit
            d, s, w, lo, wd, t, limit, a = d[on], s[on], w[on], lo[on], wd[on], t[on], limit[on], a[on]
            b = mix(a ^ U(0x5851F42D4C957F2D))
            register = ((b >> U(32)) * U(m) >> U(32)).astype(np.int64)
            below = lo + wd * (b & U(0xFFFFFFFF)).astype(float) * 2.0**-32 < w
            np.minimum.at(out.ravel(), (d * m + register)[below], t[below])
        todo &= np.isinf(out).any(1)
        horizon[todo] *= 2
        out[todo] = np.inf
    return out


def bands(registers: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key of each band of ``rows`` registers, band number included."""
    n, m = registers.shape
    x = np.ascontiguousarray(registers).view(U).reshape(n, m // rows, rows)
    key = np.broadcast_to(np.arange(1, m // rows + 1, dtype=U) * U(0xE7037ED1A0B428DB), (n, m // rows)).copy()
    for i in range(rows):
        key = mix(key + x[:, :, i])
    return key.view(np.int64)
