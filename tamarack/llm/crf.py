"""Conditional random fields on small label sets: loopy sum-product messages, training, Viterbi."""

from __future__ import annotations

import numpy as np

#: Damping of the messages: a field that has not settled after ROUNDS goes on with the next one.
DAMPING, ROUNDS = (0.3, 0.6, 0.85, 0.95), 200


class PairwiseCRF:
    """Nodes with binary features, edges of a few types; log-linear in both.

    ``unary``: (features, labels). ``pair``: (edge types, labels, labels), read from the earlier
    node to the later one. ``fixed`` has the label of nodes that are observed, -1 for the others.
    """

    def __init__(self, features: int, labels: int, types: int):
        self.unary = np.zeros((features, labels))
        self.pair = np.zeros((types, labels, labels))

    def node_scores(self, x: np.ndarray, fixed: np.ndarray | None = None) -> np.ndarray:
        """Log scores of the labels of every node; an observed node has its label with certainty."""
        scores = x @ self.unary
        if fixed is not None:
            known = np.flatnonzero(fixed >= 0)
            scores[known] = -1e3
            scores[known, fixed[known]] = 0
        return scores

    def marginals(self, scores: np.ndarray, edges: np.ndarray, types: np.ndarray, rounds: int = ROUNDS, dampings: tuple[float, ...] = DAMPING, settled: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
        """(node marginals, edge marginals) by parallel loopy sum-product, until no message moves by more than ``settled``.

        Messages that swing are damped more and more; if they still move after the last DAMPING, the last ones count.
        """
        n, k = scores.shape
        scores = scores - scores.max(axis=1, keepdims=True)
        if not len(edges):
            return _normal(np.exp(scores)), np.zeros((0, k, k))
        a, b = edges[:, 0], edges[:, 1]
        potential = np.exp(self.pair[types])
        forward = np.zeros((len(edges), k))  # log messages a -> b
        backward = np.zeros((len(edges), k))
        for damping in [d for d in dampings for _ in range(rounds)]:
            belief = scores + _gathered(b, forward, n) + _gathered(a, backward, n)
            to_b = np.log(np.einsum("ei,eij->ej", _soft(belief[a] - backward), potential) + 1e-300)
            to_a = np.log(np.einsum("ej,eij->ei", _soft(belief[b] - forward), potential) + 1e-300)
            before = forward, backward
            forward = damping * forward + (1 - damping) * (to_b - to_b.max(axis=1, keepdims=True))
            backward = damping * backward + (1 - damping) * (to_a - to_a.max(axis=1, keepdims=True))
            if max(np.abs(forward - before[0]).max(), np.abs(backward - before[1]).max()) <= settled:
                break
        belief = scores + _gathered(b, forward, n) + _gathered(a, backward, n)
        joint = _soft(belief[a] - backward)[:, :, None] * potential * _soft(belief[b] - forward)[:, None, :]
        return _normal(np.exp(belief - belief.max(axis=1, keepdims=True))), joint / joint.sum(axis=(1, 2), keepdims=True)

    def fit(self, x: np.ndarray, gold: np.ndarray, edges: np.ndarray, types: np.ndarray, fixed: np.ndarray, steps: int = 150, rate: float = 0.5, decay: float = 1e-4) -> None:
        """Gradient ascent on the likelihood: observed counts minus expected counts under the messages."""
        n, k = len(x), self.unary.shape[1]
        seen = np.zeros((n, k))
        seen[np.arange(n), gold] = 1
        squares_u, squares_p = np.full_like(self.unary, 1e-6), np.full_like(self.pair, 1e-6)
        for _ in range(steps):
            node, joint = self.marginals(self.node_scores(x, fixed), edges, types, rounds=6, dampings=DAMPING[:1])
            g = x.T @ (seen - node) / n - decay * self.unary
            squares_u += g * g
            self.unary += rate * g / np.sqrt(squares_u)
            if len(edges):
                delta = -joint
                delta[np.arange(len(edges)), gold[edges[:, 0]], gold[edges[:, 1]]] += 1
                gp = np.zeros_like(self.pair)
                np.add.at(gp, types, delta)
                gp = gp / n - decay * self.pair
                squares_p += gp * gp
                self.pair += rate * gp / np.sqrt(squares_p)


def viterbi(scores: np.ndarray, moves: np.ndarray) -> list[int]:
    """Best label path of one chain: ``scores`` (steps, labels), ``moves`` (labels, labels)."""
    best, back = scores[0], []
    for step in scores[1:]:
        total = best[:, None] + moves
        back.append(total.argmax(axis=0))
        best = total.max(axis=0) + step
    path = [int(best.argmax())]
    for pointers in reversed(back):
        path.append(int(pointers[path[-1]]))
    return path[::-1]


def _gathered(index: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sum of the rows of ``values`` for each of ``n`` indices."""
    return np.stack([np.bincount(index, column, n) for column in values.T], axis=1)


def _soft(logs: np.ndarray) -> np.ndarray:
    return np.exp(logs - logs.max(axis=1, keepdims=True))


def _normal(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=1, keepdims=True)
