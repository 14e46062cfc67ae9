"""A skip-chain conditional random field over token arrays: fitting by pseudo-likelihood, marginals by loopy messages.

Tokens are nodes. Neighbours in a window are joined by chain edges, and tokens that recur in a document by
skip edges from each occurrence to the next, so that a label found at one place bears on the others. Every
node has a list of hashed features, every edge type a table of potentials.
"""

from __future__ import annotations

import numpy as np


class Graph:
    """Edges of a batch of tokens. ``window`` and ``doc`` number the tokens' windows and documents; ``key`` is
    equal for repeated or similar tokens and 0 for tokens that get no skip edges."""

    def __init__(self, window: np.ndarray, doc: np.ndarray, key: np.ndarray):
        n = len(window)
        a = np.flatnonzero(window[1:] == window[:-1]) if n else np.zeros(0, np.int64)
        order = np.lexsort((np.arange(n), key, doc))
        s, t = order[:-1], order[1:]
        same = (doc[s] == doc[t]) & (key[s] == key[t]) & (key[s] != 0) & (t - s > 1)
        self.n = n
        self.left = np.concatenate([a, s[same]])
        self.right = np.concatenate([a + 1, t[same]])
        self.kind = np.concatenate([np.zeros(len(a), np.int8), np.ones(int(same.sum()), np.int8)])


def _scattered(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sum of the rows by index."""
    return np.stack([np.bincount(index, rows[:, c], n) for c in range(rows.shape[1])], 1)


def _log_sum(x: np.ndarray) -> np.ndarray:
    top = x.max(1, keepdims=True)
    return top + np.log(np.exp(x - top).sum(1, keepdims=True))


class Model:
    """Weights of hashed features (buckets x labels) and potentials of both edge types (2 x labels x labels)."""

    def __init__(self, labels: int, buckets: int):
        self.unary = np.zeros((buckets, labels), np.float32)
        self.pair = np.zeros((2, labels, labels), np.float32)

    def scores(self, features: np.ndarray) -> np.ndarray:
        out = np.zeros((len(features), self.unary.shape[1]), np.float32)
        for k in range(features.shape[1]):
            out += np.take(self.unary, features[:, k], 0)
        return out

    def gains(self) -> tuple[np.ndarray, np.ndarray]:
        """Sums of squared gradients to begin with."""
        return np.full_like(self.unary, 1e-6), np.full_like(self.pair, 1e-6)

    def fit(self, features: np.ndarray, labels: np.ndarray, graph: Graph, rounds: int = 60, rate: float = 1.0, decay: float = 1e-6, gains: tuple[np.ndarray, np.ndarray] | None = None) -> Model:
        """Maximise the probability of each label given the labels around it (Adagrad over all tokens). With the ``gains``
        of earlier batches of tokens, which are added to, the fit goes on from them."""
        n, k = len(labels), self.pair.shape[1]
        flat = features.reshape(-1)
        gain_u, gain_p = gains or self.gains()
        truth = np.eye(k, dtype=np.float32)[labels]
        for _ in range(rounds):
            z = self.scores(features)
            for kind in (0, 1):
                e = graph.kind == kind
                z = z + _scattered(graph.right[e], self.pair[kind][labels[graph.left[e]]], n) + _scattered(graph.left[e], self.pair[kind].T[labels[graph.right[e]]], n)
            miss = truth - np.exp(z - _log_sum(z))
            grad = np.stack([np.bincount(flat, np.repeat(miss[:, c], features.shape[1]), len(self.unary)) for c in range(k)], 1) / n - decay * self.unary
            gain_u += grad**2
            self.unary += (rate * grad / np.sqrt(gain_u)).astype(np.float32)
            for kind in (0, 1):
                e = graph.kind == kind
                g = _scattered(labels[graph.left[e]], miss[graph.right[e]], k) + _scattered(labels[graph.right[e]], miss[graph.left[e]], k).T
                g = g / n - decay * self.pair[kind]
                gain_p[kind] += g**2
                self.pair[kind] += (rate * 0.3 * g / np.sqrt(gain_p[kind])).astype(np.float32)
        return self

    def marginals(self, features: np.ndarray, graph: Graph, rounds: int = 8, enough: float = 1e-3) -> np.ndarray:
        """Label probabilities of each token after some rounds of loopy belief propagation."""
        return self.beliefs(self.scores(features).astype(np.float64), graph, rounds, enough)

    def beliefs(self, base: np.ndarray, graph: Graph, rounds: int = 8, enough: float = 1e-3) -> np.ndarray:
        """Label probabilities from the scores of the tokens on their own."""
        m = len(graph.left)
        source = np.concatenate([graph.left, graph.right])
        target = np.concatenate([graph.right, graph.left])
        table = np.concatenate([self.pair[graph.kind], self.pair[graph.kind].transpose(0, 2, 1)])
        message = np.zeros((2 * m, base.shape[1]))
        belief = base
        for _ in range(rounds if m else 0):
            back = np.concatenate([message[m:], message[:m]])
            out = (belief[source] - back)[:, :, None] + table
            top = out.max(1)
            out = top + np.log(np.exp(out - top[:, None]).sum(1))
            before, message = message, out - _log_sum(out)
            belief = base + _scattered(target, message, graph.n)
            if np.abs(message - before).max() < enough:
                break
        return np.exp(belief - _log_sum(belief)) if graph.n else belief
