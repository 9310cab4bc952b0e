"""A two-label linear-chain conditional random field in numpy.

Sequences of a batch lie end to end as one chain that restarts at every sequence start. A restart is a transition that ignores
the label before it, so forward and backward messages can be computed over equal blocks of the whole chain at once:
products of 2x2 matrices within blocks, a short walk over the blocks, and a second pass inside them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Chain:
    """weights: of hashed or indexed features for label 1 against 0; trans[x, y] and start[y] are log potentials."""

    weights: np.ndarray
    bias: float = 0.0
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: np.ndarray = field(default_factory=lambda: np.zeros(2))

    def emissions(self, features: np.ndarray) -> np.ndarray:
        """features: rows of feature indices, one row per position."""
        total = np.full(len(features), self.bias)
        for col in features.T:
            total += self.weights[col]
        return total


def _steps(e: np.ndarray, first: np.ndarray, c: Chain) -> np.ndarray:
    """k[t, x, y]: the potential of going from x to y at t, with y's emission."""
    k = np.empty((len(e), 2, 2))
    t, s = np.exp(c.trans - c.trans.max()), np.exp(c.start - c.start.max())
    k[:] = t
    k[first] = s
    one = np.exp(np.clip(e, -30, 30))
    k[:, :, 0] *= (1 / (1 + one))[:, None]
    k[:, :, 1] *= (one / (1 + one))[:, None]
    return k


def _messages(k: np.ndarray) -> np.ndarray:
    """Row vectors a[t] = a[t-1] k[t], normed, from an even start."""
    n = len(k)
    width = max(1, int(np.sqrt(n)))
    blocks = -(-n // width)
    pad = blocks * width - n
    if pad:
        k = np.concatenate([k, np.broadcast_to(np.eye(2), (pad, 2, 2))])
    k = k.reshape(blocks, width, 2, 2)
    total = np.broadcast_to(np.eye(2), (blocks, 2, 2)).copy()
    for t in range(width):
        total = np.einsum("bxy,byz->bxz", total, k[:, t])
        total /= total.sum(axis=(1, 2), keepdims=True)
    into = np.empty((blocks, 2))
    a = np.array([0.5, 0.5])
    for b in range(blocks):
        into[b] = a
        a = a @ total[b]
        a /= a.sum()
    out = np.empty((blocks, width, 2))
    for t in range(width):
        into = np.einsum("bx,bxy->by", into, k[:, t])
        into /= into.sum(axis=1, keepdims=True)
        out[:, t] = into
    return out.reshape(-1, 2)[:n]


def marginals(e: np.ndarray, first: np.ndarray, c: Chain, pairs: bool = False):
    """P(label 1) at every position; first: whether a sequence starts there. pairs: also expected transitions (2x2)."""
    if not len(e):
        return (np.zeros(0), np.zeros((2, 2)), np.zeros(2)) if pairs else np.zeros(0)
    k = _steps(e, first, c)
    forward = _messages(k)
    turned = np.concatenate([np.swapaxes(k[:0:-1], 1, 2), np.ones((0, 2, 2))]) if len(e) > 1 else np.zeros((0, 2, 2))
    backward = np.full((len(e), 2), 0.5)
    if len(turned):
        backward[:-1] = _messages(turned)[::-1]
    joint = forward * backward
    p = joint[:, 1] / joint.sum(axis=1)
    if not pairs:
        return p
    inner = np.flatnonzero(~first)
    xi = forward[inner - 1][:, :, None] * k[inner] * backward[inner][:, None, :]
    xi /= xi.sum(axis=(1, 2), keepdims=True)
    begin = p[first]
    return p, xi.sum(axis=0), np.array([(1 - begin).sum(), begin.sum()])


def train(features: np.ndarray, first: np.ndarray, label: np.ndarray, size: int, weight: np.ndarray | None = None, rounds: int = 60, rate: float = 0.3, ridge: float = 1e-4) -> Chain:
    """Ascend the conditional log-likelihood of labelled chains (AdaGrad, L2). weight: of each position's emission part."""
    c = Chain(np.zeros(size))
    y = label.astype(np.float64)
    weight = np.ones(len(y)) if weight is None else weight
    n = max(1.0, weight.sum())
    inner = np.flatnonzero(~first)
    seen = np.zeros((2, 2))
    np.add.at(seen, (label[inner - 1], label[inner]), 1)
    began = np.bincount(label[first], minlength=2).astype(np.float64)
    squares = np.full(size, 1e-8), np.full((2, 2), 1e-8), np.full(2, 1e-8), np.full(1, 1e-8)
    for _ in range(rounds):
        p, pairs, starts = marginals(c.emissions(features), first, c, pairs=True)
        off = (y - p) * weight
        grads = (
            sum(np.bincount(col, weights=off, minlength=size) for col in features.T) / n - ridge * c.weights,
            (seen - pairs) / n - ridge * c.trans,
            (began - starts) / n - ridge * c.start,
            np.array([off.sum() / n]),
        )
        moves = []
        for g, s in zip(grads, squares):
            s += g * g
            moves.append(rate * g / np.sqrt(s))
        c.weights += moves[0]
        c.trans += moves[1]
        c.start += moves[2]
        c.bias += float(moves[3][0])
    return c


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50, ridge: float = 1e-3) -> np.ndarray:
    """Weights (the last is the intercept) of a logistic regression by Newton steps; weight: of each row."""
    a = np.column_stack([x, np.ones(len(x))])
    weight = weight * (len(weight) / weight.sum())
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = sigmoid(a @ w)
        g = a.T @ ((y - p) * weight) - ridge * len(a) * np.r_[w[:-1], 0]
        h = (a * (p * (1 - p) * weight)[:, None]).T @ a + np.eye(len(w)) * (ridge * len(a) + 1e-9)
        step = np.linalg.solve(h, g)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))
