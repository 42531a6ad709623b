"""A linear-chain conditional random field with binary features, trained by gradient ascent."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


class ChainCRF:
    """Labels 0..labels-1; each position has a set of feature names."""

    def __init__(self, labels: int = 2):
        self.labels = labels
        self.index: dict[str, int] = {}
        self.weights = np.zeros((0, labels))
        self.move = np.zeros((labels, labels))

    def fit(self, pages: Sequence[Sequence[set[str]]], tags: Sequence[Sequence[int]], steps: int = 200, rate: float = 0.15, decay: float = 0.00001) -> list[float]:
        """Maximise the conditional likelihood; returns it per position for every step."""
        for features in (f for p in pages for f in p):
            for name in sorted(features):
                self.index.setdefault(name, len(self.index))
        order = sorted(range(len(pages)), key=lambda i: -len(pages[i]))
        lengths = np.array([len(pages[i]) for i in order])
        there = np.arange(lengths[0])[:, None] < lengths[None, :]  # time x page
        at = [(t, k) for k, n in enumerate(lengths) for t in range(n)]
        rows = np.zeros(there.shape, dtype=np.int64)
        rows[tuple(zip(*at))] = np.arange(len(at))
        x = np.zeros((len(at), len(self.index)), dtype=np.float32)
        for row, (t, k) in enumerate(at):
            x[row, [self.index[f] for f in pages[order[k]][t]]] = 1
        y = np.array([tags[order[k]][t] for t, k in at])
        truth = np.eye(self.labels)[y]
        follow = there[1:]
        pairs = np.zeros((self.labels, self.labels))
        np.add.at(pairs, (y[rows[:-1][follow]], y[rows[1:][follow]]), 1)
        self.weights = np.zeros((len(self.index), self.labels))
        theta = [self.weights, self.move]
        first, second = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
        told, n = [], len(at)
        for step in range(1, steps + 1):
            emit = (x @ self.weights.astype(np.float32)).astype(float)
            gamma, moved, total = self._expect(emit[rows], lengths)
            told.append(float(((truth * emit).sum() + (pairs * self.move).sum() - total) / n))
            grads = [(x.T @ (truth - gamma[there.nonzero()][np.argsort(rows[there])]).astype(np.float32)) / n - decay * self.weights, (pairs - moved) / n - decay * self.move]
            for k, g in enumerate(grads):  # Adam
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                theta[k] += rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
        return told

    def _expect(self, emit: np.ndarray, lengths: np.ndarray):
        """Expected labels and moves, and the sum of the log partition functions; emit is time x page x label, pages by falling length."""
        longest, pages, _ = emit.shape
        live = np.searchsorted(-lengths, -np.arange(longest), side="left")  # pages longer than t
        alpha, beta = np.zeros_like(emit), np.zeros_like(emit)
        alpha[0] = emit[0]
        for t in range(1, longest):
            n = live[t]
            alpha[t, :n] = np.logaddexp.reduce(alpha[t - 1, :n, :, None] + self.move, axis=1) + emit[t, :n]
        log_z = np.logaddexp.reduce(alpha[lengths - 1, np.arange(pages)], axis=1)
        moved = np.zeros_like(self.move)
        for t in range(longest - 2, -1, -1):
            n = live[t + 1]
            ahead = self.move + (emit[t + 1, :n] + beta[t + 1, :n])[:, None, :]
            beta[t, :n] = np.logaddexp.reduce(ahead, axis=2)
            moved += np.exp(alpha[t, :n, :, None] + ahead - log_z[:n, None, None]).sum(axis=0)
        return np.exp(alpha + beta - log_z[None, :, None]), moved, log_z.sum()

    def scores(self, features: set[str]) -> np.ndarray:
        at = [self.index[f] for f in features if f in self.index]
        return self.weights[at].sum(axis=0) if at else np.zeros(self.labels)

    def decode(self, emit: np.ndarray) -> list[int]:
        """The most likely labels (Viterbi) for the scores of a sequence."""
        if not len(emit):
            return []
        if self.labels == 2:
            return self._decode_two(emit)
        best, back = emit[0], []
        for row in emit[1:]:
            each = best[:, None] + self.move
            back.append(each.argmax(axis=0))
            best = each.max(axis=0) + row
        out = [int(best.argmax())]
        for b in reversed(back):
            out.append(int(b[out[-1]]))
        return out[::-1]

    def _decode_two(self, emit: np.ndarray) -> list[int]:
        (m00, m01), (m10, m11) = self.move.tolist()
        rows = emit.tolist()
        a, b = rows[0]
        back = []
        for x, y in rows[1:]:
            a0, b0, a1, b1 = a + m00, b + m10, a + m01, b + m11
            back.append((a0 < b0, a1 < b1))
            a, b = (b0 if a0 < b0 else a0) + x, (b1 if a1 < b1 else a1) + y
        out = [int(a < b)]
        for p in reversed(back):
            out.append(int(p[out[-1]]))
        return out[::-1]
