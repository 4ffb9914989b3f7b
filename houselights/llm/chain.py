"""A linear-chain conditional random field in numpy: trained on a small labelled table, decoded by Viterbi in batches.

An item (a line, a word) has a fixed number of slots, each holding one feature number; its scores are the sum of the
weights of its features. Features that training has not seen weigh nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


@dataclass
class Chain:
    labels: tuple[str, ...]
    numbers: dict = field(default_factory=dict)
    weight: np.ndarray | None = None
    move: np.ndarray | None = None
    first: np.ndarray | None = None

    def encode(self, features: list[tuple]) -> np.ndarray:
        """Feature numbers of items; 0 stands for a feature that training has not seen."""
        known = self.numbers
        return np.array([[known.get((slot, x), 0) for slot, x in enumerate(item)] for item in features], np.int32)

    def scores(self, encoded: np.ndarray) -> np.ndarray:
        return self.weight[encoded].sum(axis=1)

    def train(self, sequences: list[tuple[list[tuple], list[str]]], rounds: int = 300, rate: float = 0.5,
              penalty: float = 0.01) -> Chain:
        """Maximise the penalised likelihood of the labelled sequences by gradient steps scaled per weight."""
        for items, _ in sequences:
            for item in items:
                for slot, x in enumerate(item):
                    self.numbers.setdefault((slot, x), len(self.numbers) + 1)
        k = len(self.labels)
        theta = [np.zeros((len(self.numbers) + 1, k)), np.zeros((k, k)), np.zeros(k)]
        squares = [np.full(x.shape, 1e-6) for x in theta]
        data = [(self.encode(items), np.array([self.labels.index(y) for y in ys])) for items, ys in sequences if items]
        for _ in range(rounds):
            slopes = [-penalty * x for x in theta]
            for items, ys in data:
                self._slope(items, ys, theta, slopes)
            slopes[0][0] = 0
            for x, s, q in zip(theta, slopes, squares):
                q += s * s
                x += rate * s / np.sqrt(q)
        self.weight, self.move, self.first = theta
        return self

    @staticmethod
    def _slope(items: np.ndarray, ys: np.ndarray, theta: list[np.ndarray], slopes: list[np.ndarray]) -> None:
        """Observed less expected counts of one sequence, by forward and backward sums."""
        weight, move, first = theta
        score, n = weight[items].sum(axis=1), len(ys)
        ahead, back = np.zeros_like(score), np.zeros_like(score)
        ahead[0] = first + score[0]
        for t in range(1, n):
            ahead[t] = _log_sum(ahead[t - 1][:, None] + move, 0) + score[t]
        for t in range(n - 2, -1, -1):
            back[t] = _log_sum(move + (score[t + 1] + back[t + 1])[None], 1)
        total = _log_sum(ahead[-1], 0)
        gap = -np.exp(ahead + back - total)
        gap[np.arange(n), ys] += 1
        np.add.at(slopes[0], items.ravel(), np.repeat(gap, items.shape[1], axis=0))
        slopes[2] += gap[0]
        for t in range(1, n):
            slopes[1] -= np.exp(ahead[t - 1][:, None] + move + (score[t] + back[t])[None] - total)
            slopes[1][ys[t - 1], ys[t]] += 1

    def decode(self, score: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The best label numbers of many sequences at once; `score` holds their items one sequence after the other.

        All sequences step together; those that have ended leave, so a step costs what is still open.
        """
        best = np.zeros(len(score), np.int64)
        sizes = np.asarray(sizes)
        start = np.cumsum(sizes) - sizes
        order = np.argsort(-sizes, kind="stable")
        order = order[sizes[order] > 0]
        if not len(order):
            return best
        start, sizes = start[order], sizes[order]
        from_ = np.zeros(score.shape, np.int16)
        value = self.first + score[start]
        last = np.zeros(len(order), np.int64)
        for t in range(1, int(sizes[0]) + 1):
            going = int(np.searchsorted(-sizes, -t, side="left"))  # the sequences with more than t items
            last[going:len(value)] = value[going:].argmax(axis=1)
            if not going:
                break
            paths = value[:going, :, None] + self.move[None]
            from_[start[:going] + t] = paths.argmax(axis=1)
            value = paths.max(axis=1) + score[start[:going] + t]
        at = start + sizes - 1
        label = last
        while len(at):
            best[at] = label
            label = from_[at, label].astype(np.int64)
            at = at - 1
            going = at >= start
            at, label, start = at[going], label[going], start[going]
        return best
