"""A gated recurrent language model in numpy: forward, truncated backpropagation, class-factored softmax."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

f32 = np.float32


@dataclass
class Shape:
    """Output layout: words 0..n_words-1 lie in ``bounds``' ranges, one class each; ``n_tails`` classes without words follow.

    A token is a word id, or n_words + k for the tail class k. Word 0 is the end of a document and starts it, too.
    """

    hidden: int
    bounds: np.ndarray  # class c has words bounds[c]..bounds[c + 1] - 1
    n_tails: int

    @property
    def n_words(self) -> int:
        return int(self.bounds[-1])

    def class_of(self) -> np.ndarray:
        of_words = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))
        return np.concatenate([of_words, len(self.bounds) - 1 + np.arange(self.n_tails)]).astype(np.int32)


def initial(shape: Shape, counts: np.ndarray, seed: int = 1) -> dict[str, np.ndarray]:
    """Small random weights, with output biases that start at the tokens' frequencies."""
    rng = np.random.default_rng(seed)
    h, n = shape.hidden, shape.n_words + shape.n_tails
    cls = shape.class_of()
    mass = np.bincount(cls, counts, len(shape.bounds) - 1 + shape.n_tails) + 1
    uniform = lambda *size: rng.uniform(-1, 1, size).astype(f32)
    return {
        "x": uniform(n, 3 * h) * f32(0.5),
        "u": uniform(h, 3 * h) / f32(np.sqrt(h)),
        "cw": uniform(h, len(mass)) * f32(0.05),
        "cb": np.log(mass / mass.sum()).astype(f32),
        "ww": uniform(shape.n_words, h) * f32(0.05),
        "wb": np.log(counts[: shape.n_words] + 1).astype(f32),
    }


class Buffers(dict):
    """Arrays that are used again in each window; fresh pages for each would cost more than the numbers in them."""

    def of(self, name: str, *shape: int) -> np.ndarray:
        n = int(np.prod(shape))
        if name not in self or self[name].size < n:
            self[name] = np.empty(n, f32)
        return self[name][:n].reshape(shape)


def sigmoid(a: np.ndarray) -> np.ndarray:
    """Overwrites ``a``."""
    np.negative(a, out=a)
    np.exp(a, out=a)
    a += f32(1)
    return np.reciprocal(a, out=a)


def logits(h: np.ndarray, w: np.ndarray, bias: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Into ``out``, with the greatest bias taken off and kept within what exponentials of 32-bit numbers
    stand, so that no row needs a search for its greatest entry."""
    np.matmul(h, w, out=out)
    bias = bias - bias.max()
    out += bias
    # states are within 1, so where the weights are small no entry can be out of these limits
    if np.abs(w).sum(0).max() - bias.min() < 60:
        return out
    return np.clip(out, -60, 60, out=out)


def exponents(a: np.ndarray) -> np.ndarray:
    """Overwrites ``a`` by its exponentials and returns the sums of its rows."""
    np.exp(a, out=a)
    return a @ np.ones(a.shape[1], f32)


def picked(a: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each row's log softmax the entry ``at``; overwrites ``a``."""
    out = a[np.arange(len(at)), at]
    return out - np.log(exponents(a))


def by_class(shape: Shape, cls: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
    """An order of tokens by class, and (begin, end, first word, behind the last word) of each class of several words that has tokens."""
    order = np.argsort(cls.astype(np.int16), kind="stable")
    ends = np.searchsorted(cls[order], np.arange(len(shape.bounds)))
    parts = zip(ends[:-1].tolist(), ends[1:].tolist(), shape.bounds[:-1].tolist(), shape.bounds[1:].tolist(), strict=True)
    return order, [p for p in parts if p[0] < p[1] and p[3] - p[2] > 1]


def sorted_states(p: dict, shape: Shape, cls_of: np.ndarray, h: np.ndarray, y: np.ndarray, buffers: Buffers):
    """Order and parts of ``by_class``, states and targets in that order, their classes, and the class logits."""
    order, parts = by_class(shape, cls_of[y])
    by = np.take(h, order, axis=0, out=buffers.of("by", *h.shape), mode="clip")
    y = y[order]
    a = logits(by, p["cw"], p["cb"], buffers.of("class", len(y), p["cw"].shape[1]))
    return order, parts, by, y, cls_of[y], a


def token_logs(p: dict, shape: Shape, cls_of: np.ndarray, h: np.ndarray, y: np.ndarray, buffers: Buffers) -> np.ndarray:
    """Natural log probability of each target; of its class alone for tails."""
    order, parts, by, y, cls, a = sorted_states(p, shape, cls_of, h, y, buffers)
    logs = picked(a, cls)
    for i, j, lo, hi in parts:
        a = logits(by[i:j], p["ww"][lo:hi].T, p["wb"][lo:hi], buffers.of("words", j - i, hi - lo))
        logs[i:j] += picked(a, y[i:j] - lo)
    out = np.empty_like(logs)
    out[order] = logs
    return out


def lanes_of(lengths: np.ndarray, most: int, least_steps: int) -> list[list[int]]:
    """Documents dealt to lanes of about equal length, longest lane first."""
    longest = int(lengths.max())
    n = int(np.clip(lengths.sum() // max(longest, least_steps), 1, most))
    order = np.argsort(-lengths, kind="stable")
    lanes: list[list[int]] = [[] for _ in range(n)]
    size = np.zeros(n, np.int64)
    for at in range(0, len(order), n):  # longest to the emptiest, n documents at a time
        part, free = order[at : at + n], np.argsort(size, kind="stable")
        for i, lane in zip(part.tolist(), free.tolist(), strict=False):
            lanes[lane].append(i)
            size[lane] += lengths[i]
    return [lanes[i] for i in np.argsort(-size, kind="stable")]


def layout(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray, most: int, least_steps: int):
    """Inputs, targets, start marks and target positions, each (steps, lanes), and how many lanes run at each step.

    A document of tokens t1..tn has the inputs end, t1..tn and the targets t1..tn, end.
    """
    lanes = lanes_of(lengths + 1, most, least_steps)
    size = np.array([int((lengths[lane] + 1).sum()) for lane in lanes])
    steps = int(size.max())
    both = np.zeros((steps + 1, len(lanes)), np.int32)
    x, y = both[:-1], both[1:]  # a target is the next input, the end that of the next document
    fresh, doc = np.zeros(x.shape, bool), np.zeros_like(x)
    for k, lane in enumerate(lanes):
        at = 0
        for d in lane:
            n = int(lengths[d])
            y[at : at + n, k] = ids[starts[d] : starts[d] + n]
            fresh[at, k] = True
            doc[at : at + n + 1, k] = d
            at += n + 1
    running = np.searchsorted(-size, -np.arange(steps), "left")  # lanes longer than t
    return x, y, fresh, doc, running


def score(p: dict, shape: Shape, ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray, lanes: int = 512, window: int = 128) -> np.ndarray:
    """Natural log probability of each document, with the state carried from window to window."""
    out = np.zeros(len(lengths))
    if not len(lengths):
        return out
    cls_of, buffers = shape.class_of(), Buffers()
    x, y, fresh, doc, running = layout(ids, starts, lengths, lanes, 512)
    h = np.zeros((x.shape[1], shape.hidden), f32)
    for low in range(0, len(x), window):
        n = running[low]  # lanes that end within the window go on over padding, which is not counted
        part = slice(low, low + window)
        states, _ = forward(p, x[part, :n], fresh[part, :n], h[:n], buffers)
        h = states[-1]
        live = np.arange(n) < running[part, None]
        hs = states.reshape(-1, shape.hidden) if live.all() else states[live]
        out += np.bincount(doc[part, :n][live], token_logs(p, shape, cls_of, hs, y[part, :n][live], buffers), len(out))
    return out


def stream(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray, lanes: int, least_steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, targets and start marks of all documents on end, cut into equal lanes: each (steps, lanes).

    A document that a cut falls in goes on in the next lane. Targets behind the last token are -1.
    """
    ends = np.cumsum(lengths)
    flat = ids[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1])]
    n = len(flat) + len(lengths)
    n_lanes = int(np.clip(n // least_steps, 1, lanes))
    pad = -n % n_lanes
    first = ends - lengths + np.arange(len(lengths))
    fresh = np.zeros(n + pad, bool)
    fresh[first] = True
    x = np.concatenate([np.insert(flat, ends - lengths, 0), np.zeros(pad, flat.dtype)])
    y = np.concatenate([np.insert(flat, ends, 0), np.full(pad, -1, flat.dtype)])
    return tuple(np.ascontiguousarray(v.reshape(n_lanes, -1).T) for v in (x, y, fresh))


def softmax_error(a: np.ndarray, at: np.ndarray, scale: np.float32) -> np.ndarray:
    """Gradient of the negative log softmax of each row at ``at``, times ``scale``; overwrites ``a``."""
    a *= (scale / exponents(a))[:, None]
    a[np.arange(len(at)), at] -= scale
    return a


def output_gradients(p: dict, shape: Shape, cls_of: np.ndarray, hs: np.ndarray, ys: np.ndarray, scale: np.float32, buffers: Buffers):
    """Gradients of the states, of the class weights, and (slice, weights, biases) of each class's words."""
    order, parts, by, ys, cls, a = sorted_states(p, shape, cls_of, hs, ys, buffers)
    d = softmax_error(a, cls, scale)
    of_by, words = np.matmul(d, p["cw"].T, out=buffers.of("of by", *by.shape)), []
    for i, j, lo, hi in parts:
        a = logits(by[i:j], p["ww"][lo:hi].T, p["wb"][lo:hi], buffers.of("words", j - i, hi - lo))
        e = softmax_error(a, ys[i:j] - lo, scale)
        of_by[i:j] += np.matmul(e, p["ww"][lo:hi], out=buffers.of("of words", j - i, by.shape[1]))
        words.append((slice(lo, hi), e.T @ by[i:j], e.sum(0)))
    dh = buffers.of("dh", *hs.shape)
    dh[order] = of_by
    return dh, by.T @ d, d.sum(0), words


def forward(p: dict, x: np.ndarray, fresh: np.ndarray, h: np.ndarray, buffers: Buffers) -> tuple[np.ndarray, tuple]:
    """The states of a window (steps, lanes, hidden) from the state before, and what backpropagation needs of it."""
    steps, lanes = x.shape
    n = h.shape[1]
    begins = fresh.any(1).tolist()
    taken = np.take(p["x"], x, axis=0, out=buffers.of("taken", steps, lanes, 3 * n), mode="clip")
    states, before, new, gn = (buffers.of(k, steps, lanes, n) for k in ("states", "before", "new", "gn"))
    rz, g = buffers.of("rz", steps, lanes, 2 * n), buffers.of("g", lanes, 3 * n)
    for t in range(steps):
        h0 = before[t]
        h0[:] = h
        if begins[t]:
            h0[fresh[t]] = 0
        np.matmul(h0, p["u"], out=g)
        np.add(g[:, : 2 * n], taken[t, :, : 2 * n], out=rz[t])
        sigmoid(rz[t])
        gn[t] = g[:, 2 * n :]
        np.multiply(rz[t, :, :n], gn[t], out=new[t])
        new[t] += taken[t, :, 2 * n :]
        np.tanh(new[t], out=new[t])
        h = np.subtract(h0, new[t], out=states[t])
        h *= rz[t, :, n:]
        h += new[t]
    return states, (before, rz, new, gn, begins)


def window_gradients(p: dict, shape: Shape, cls_of: np.ndarray, x: np.ndarray, y: np.ndarray, fresh: np.ndarray, h: np.ndarray, scale: float, buffers: Buffers):
    """Gradients of a window's loss by backpropagation to its begin, and the state behind it.

    The gradients: ``cw``, ``cb``, ``u``, words as ``output_gradients`` gives them, and (rows, gradients) of ``x``.
    """
    steps, lanes = x.shape
    n = shape.hidden
    states, (before, rz, new, gn, begins) = forward(p, x, fresh, h, buffers)
    live = y.ravel() >= 0
    hs, ys = states.reshape(-1, n), y.ravel()
    if live.all():
        dh, cw, cb, words = output_gradients(p, shape, cls_of, hs, ys, f32(scale), buffers)
    else:
        dh = np.zeros_like(hs)
        dh[live], cw, cb, words = output_gradients(p, shape, cls_of, hs[live], ys[live], f32(scale), buffers)
    dh = dh.reshape(states.shape)
    dx, dg = (buffers.of(k, steps, lanes, 3 * n) for k in ("dx", "dg"))
    back, g, one = (buffers.of(k, lanes, n) for k in ("back", "grad", "one"))
    back[:] = 0
    back_u = np.ascontiguousarray(p["u"].T)
    for t in range(steps - 1, -1, -1):
        r, z = rz[t, :, :n], rz[t, :, n:]
        np.add(dh[t], back, out=g)
        dr, dz, dnew = dx[t, :, :n], dx[t, :, n : 2 * n], dx[t, :, 2 * n :]
        np.subtract(before[t], new[t], out=dz)
        dz *= z
        dz *= g
        np.subtract(1, z, out=one)
        dz *= one
        np.multiply(g, one, out=dnew)
        np.square(new[t], out=one)
        np.subtract(1, one, out=one)
        dnew *= one
        np.subtract(1, r, out=one)
        one *= r
        one *= gn[t]
        np.multiply(dnew, one, out=dr)
        dg[t, :, : 2 * n] = dx[t, :, : 2 * n]
        np.multiply(dnew, r, out=dg[t, :, 2 * n :])
        np.matmul(dg[t], back_u, out=back)
        g *= z
        back += g
        if begins[t]:
            back[fresh[t]] = 0
    u = before.reshape(-1, n).T @ dg.reshape(-1, 3 * n)
    order = np.argsort(x.ravel().astype(np.int16) if x.max() < 1 << 15 else x.ravel(), kind="stable")
    sorted_ = x.ravel()[order]
    begin = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]])
    by_token = np.take(dx.reshape(-1, 3 * n), order, axis=0, out=dg.reshape(-1, 3 * n), mode="clip")
    return cw, cb, u, words, (sorted_[begin], np.add.reduceat(by_token, begin, axis=0)), states[-1]


def train(p: dict, shape: Shape, ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray, lanes: int = 512, window: int = 20, rate: float = 0.1) -> dict[str, np.ndarray]:
    """One pass of truncated backpropagation over the documents, by Adagrad; returns new weights."""
    p = {k: v.copy() for k, v in p.items()}
    if not len(lengths):
        return p
    seen = {k: np.full(v.shape, 0.1, f32) for k, v in p.items()}
    cls_of, buffers = shape.class_of(), Buffers()
    x, y, fresh = stream(ids, starts, lengths, lanes, 256)
    h = np.zeros((x.shape[1], shape.hidden), f32)

    def update(k: str, g: np.ndarray, at=...) -> None:
        seen[k][at] += g * g
        p[k][at] -= f32(rate) * g / np.sqrt(seen[k][at])

    for low in range(0, len(x), window):
        part = slice(low, low + window)
        cw, cb, u, words, (rows, gx), h = window_gradients(p, shape, cls_of, x[part], y[part], fresh[part], h, 1 / 16, buffers)
        update("cw", cw)
        update("cb", cb)
        update("u", u.clip(-5, 5))
        for at, g, gb in words:
            update("ww", g, at)
            update("wb", gb, at)
        update("x", gx.clip(-5, 5), rows)
    return p
