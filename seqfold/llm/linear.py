"""Sparse linear models over hashed text features, fitted in numpy on a bounded sample of labelled rows.

Features of a document: its words, prefixes of its words (5, 6, 7 and 9 bytes) and its runs of symbols, each
hashed to an id; the value is 0.5 + sqrt(8 * share of the document's tokens), so that both a
single telling word in a long text and the density of milder ones count.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from seqfold.llm import tokens as T

BITS = 40  # width of a feature id; at 2**40 ids collisions between the features of a model are negligible
PREFIXES = (5, 6, 7, 9)
PIECE = 1 << 18  # cells of a matrix whose products are held at once


def features(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature id, value) of a chunk of texts, one entry for each distinct feature of a text."""
    w, s = T.words(texts), T.words(texts, symbols=True)
    doc, h = w.doc, w.hash
    parts = [(doc, T.salted(h, 1)), (s.doc, T.salted(s.hash, 2))]
    for n in PREFIXES:
        long, p = w.prefix(n)
        parts.append((doc[long], T.salted(p, 10 + n)))
    row = np.concatenate([p[0] for p in parts]).astype(np.uint64)
    key = np.concatenate([p[1] for p in parts]) >> np.uint64(64 - BITS)
    pair, tf = np.unique((row << np.uint64(BITS)) | key, return_counts=True)  # a chunk has far fewer than 2**24 texts
    row = (pair >> np.uint64(BITS)).astype(np.int64)
    total = np.maximum(1, np.diff(w.bounds) + np.diff(s.bounds))
    return row, pair & np.uint64((1 << BITS) - 1), (0.5 + np.sqrt(8.0 * tf / total[row])).astype(np.float32)


@dataclass
class Sparse:
    """Rows of a training set in coordinate form over the columns whose ids are vocab."""

    row: np.ndarray
    col: np.ndarray
    val: np.ndarray
    n: int
    vocab: np.ndarray


def matrix(texts: list, min_docs: int = 4) -> Sparse:
    """Coordinate form of texts, with the features that min_docs of them have; two passes bound the memory."""
    ids, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for lo, hi in T.chunks(texts):
        k, c = np.unique(features(texts[lo:hi])[1], return_counts=True)
        both, at = np.unique(np.concatenate([ids, k]), return_inverse=True)
        ids, counts = both, np.bincount(at, np.concatenate([counts, c]), len(both)).astype(np.int64)
    vocab = ids[counts >= min_docs]
    rows, cols, vals = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(0, np.float32)]
    for lo, hi in T.chunks(texts):
        r, k, v = features(texts[lo:hi])
        at, known = locate(vocab, k)
        rows.append((r[known] + lo).astype(np.int32))
        cols.append(at.astype(np.int32))
        vals.append(v[known])
    return Sparse(np.concatenate(rows), np.concatenate(cols), np.concatenate(vals), len(texts), vocab)


def locate(vocab: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the sorted vocab of those keys that it has, and which keys those are."""
    if not len(vocab):
        return np.zeros(0, np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(vocab, keys), len(vocab) - 1)
    known = vocab[at] == keys
    return at[known], known


@dataclass
class Linear:
    """Sparse weights; score adds them up over a document's features. extra: weights of dense inputs."""

    vocab: np.ndarray
    weight: np.ndarray
    bias: float = 0.0
    extra: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def score(self, row: np.ndarray, key: np.ndarray, val: np.ndarray, n: int, dense: np.ndarray | None = None) -> np.ndarray:
        at, known = locate(self.vocab, key)
        out = np.bincount(row[known], self.weight[at] * val[known], n) + self.bias
        return out if dense is None or not self.extra.size else out + dense @ self.extra


def scores(m: Linear, x: Sparse) -> np.ndarray:
    """Each row's sum of weights by values, without bias. Columns are looked up once each and cells are added piece by piece, in order."""
    at, known = locate(m.vocab, x.vocab)
    weight, used = np.zeros(len(x.vocab)), np.zeros(len(x.vocab), bool)
    weight[known], used[known] = m.weight[at], True
    out = np.zeros(x.n)
    for lo in range(0, len(x.col), PIECE):
        row, col, val = x.row[lo : lo + PIECE], x.col[lo : lo + PIECE], x.val[lo : lo + PIECE]
        cell = used[col]
        np.add.at(out, row[cell], weight[col[cell]] * val[cell])
    return out


def screened(x: Sparse, y: np.ndarray, rows: np.ndarray, top: int) -> np.ndarray:
    """The top columns by the standardised difference of their mean value between high and low y."""
    k = len(x.vocab)
    t = (y - (y * rows).sum() / max(1.0, rows.sum())) * rows
    s1, s2 = np.zeros(k), np.zeros(k)
    for lo in range(0, len(x.col), PIECE):  # add.at adds in the cells' order, as one bincount of all would, but needs products of a piece alone
        row, col, val = x.row[lo : lo + PIECE], x.col[lo : lo + PIECE], x.val[lo : lo + PIECE]
        np.add.at(s1, col, val * t[row])
        np.add.at(s2, col, (val * val) * rows[row])
    z = np.abs(s1) / np.sqrt(s2 + 1.0)
    return np.sort(np.argsort(-z, kind="stable")[:top])


def restrict(x: Sparse, cols: np.ndarray) -> Sparse:
    to = np.full(len(x.vocab), -1, np.int64)
    to[cols] = np.arange(len(cols))
    keep = to[x.col] >= 0
    return Sparse(x.row[keep], to[x.col[keep]], x.val[keep], x.n, x.vocab[cols])


def descend(x: Sparse, dense: np.ndarray, rows: np.ndarray, slope, n_extra: int, l1: float, l2: float, steps: int):
    """Accelerated proximal gradient descent with an L1 and an L2 penalty on the sparse weights.

    slope(score, extra) gives the loss, its derivative by each score and by the extra parameters."""
    k, d, m = len(x.vocab), dense.shape[1], max(1.0, float(rows.sum()))
    w, e, b = np.zeros(k), np.zeros(d), np.zeros(n_extra)
    zw, ze, zb, t, rate, last = w, e, b, 1.0, 1.0, np.inf
    for _ in range(steps):
        s = np.bincount(x.row, x.val * zw[x.col], x.n) + dense @ ze
        loss, g, gb = slope(s, zb)
        g = g * rows / m
        gw = np.bincount(x.col, x.val * g[x.row], k) + l2 * zw
        nw = zw - rate * gw
        nw = np.sign(nw) * np.maximum(np.abs(nw) - rate * l1, 0)
        ne, nb = ze - rate * (dense.T @ g + l2 * ze), zb - rate * gb
        if loss > last + 1e-4:  # too long a step: halve it and begin the momentum anew
            rate, t = rate / 2, 1.0
            zw, ze, zb, last = w, e, b, np.inf
            continue
        last = loss
        u = (1 + np.sqrt(1 + 4 * t * t)) / 2
        zw, ze, zb = nw + (t - 1) / u * (nw - w), ne + (t - 1) / u * (ne - e), nb + (t - 1) / u * (nb - b)
        w, e, b, t = nw, ne, nb, u
    return w, e, b


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * np.clip(z, -60, 60)))


def fit_logistic(x: Sparse, y: np.ndarray, rows: np.ndarray | None = None, dense: np.ndarray | None = None, top: int = 3000, l1: float = 2e-4, l2: float = 1e-5, steps: int = 150) -> Linear:
    """L1-penalised logistic regression on the rows marked; with one class only, a constant."""
    rows = np.ones(x.n) if rows is None else rows.astype(float)
    dense = np.zeros((x.n, 0)) if dense is None else dense
    share = (y * rows).sum() / max(1.0, rows.sum())
    if not 0 < share < 1:
        return Linear(np.zeros(0, np.uint64), np.zeros(0), 20.0 if share == 1 else -20.0, np.zeros(dense.shape[1]))
    cut = restrict(x, screened(x, y.astype(float), rows, top))
    m = rows.sum()

    def slope(s, b):
        p = sigmoid(s + b[0])
        loss = -(rows * (y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12))).sum() / m
        g = p - y
        return loss, g, np.array([(g * rows).sum() / m])

    w, e, b = descend(cut, dense, rows, slope, 1, l1, l2, steps)
    keep = np.flatnonzero(w)
    return Linear(cut.vocab[keep], w[keep], float(b[0]), e)


def fit_ordinal(x: Sparse, y: np.ndarray, grades: int, top: int = 6000, l1: float = 1e-4, l2: float = 1e-5, steps: int = 200) -> tuple[Linear, np.ndarray]:
    """Cumulative-link (logit) model P(grade > k) = sigmoid(score - threshold_k) with shared weights.

    The thresholds stay in order: the first is free, each later one adds the exponential of a parameter."""
    rows = np.ones(x.n)
    cut = restrict(x, screened(x, y.astype(float), rows, top))
    tail = np.array([(np.sum(y > k) + 0.5) / (len(y) + 1.0) for k in range(grades - 1)])
    first = -np.log(tail / (1 - tail))
    base = np.concatenate([first[:1], np.log(np.maximum(np.diff(first), 1e-3))])

    def thresholds(p):
        q = p + base
        return np.cumsum(np.concatenate([q[:1], np.exp(q[1:])]))

    def slope(s, p):
        th = thresholds(p)
        edges = np.concatenate([[-np.inf], th, [np.inf]])
        up, low = sigmoid(edges[y + 1] - s), sigmoid(edges[y] - s)
        prob = np.maximum(up - low, 1e-9)
        du, dl = up * (1 - up), low * (1 - low)
        by_th = np.zeros(grades - 1)
        for k in range(grades - 1):
            by_th[k] = -(np.where(y == k, du / prob, 0) - np.where(y == k + 1, dl / prob, 0)).sum() / x.n
        q = np.exp((p + base)[1:])
        by_p = np.array([by_th[j:].sum() * (1.0 if j == 0 else q[j - 1]) for j in range(grades - 1)])
        return -np.log(prob).mean(), (du - dl) / prob, by_p

    w, _, p = descend(cut, np.zeros((x.n, 0)), rows, slope, grades - 1, l1, l2, steps)
    keep = np.flatnonzero(w)
    return Linear(cut.vocab[keep], w[keep]), thresholds(p)
