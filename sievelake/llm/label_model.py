"""A generative model of voters: their accuracies and correlations, and the posterior of a label given their votes.

Votes are +1, -1 or 0 (no vote). Given the label, the votes form a tree: each voter's vote depends on the label and on one other voter's, the tree of the
greatest conditional mutual information, so that voters who copy each other count once. Class balance, tables and tree are estimated by expectation-maximisation over
counts of vote patterns, rows with a known label keeping it. Where both labels are known, the rows without one weigh together no more than those with one: many more of them would settle
on two classes of their own, whatever the labels say. With V voters there are at most 3^V patterns, however many rows were voted on.
"""

from __future__ import annotations

import numpy as np

STATES = 3


class LabelModel:
    """``patterns`` (P x V of -1, 0, 1), ``known`` (1, 0, or -1 for none) and ``counts`` (P), of which a pattern may have several rows."""

    def __init__(self, patterns: np.ndarray, known: np.ndarray, counts: np.ndarray, rounds: int = 25, smooth: float = 0.5):
        self.voters = patterns.shape[1]
        v, counts = patterns.astype(int) + 1, counts.astype(float)
        told = known >= 0
        if len(np.unique(known[told])) == 2:
            counts = np.where(told, counts, counts * min(1.0, counts[told].sum() / max(counts[~told].sum(), 1e-12)))
        lean = patterns.sum(1)
        # votes are believed a little at first, and that most rows without one are clean
        p = np.where(told, known, np.where(lean > 0, 0.85, np.where(lean < 0, 0.02, 0.05))).astype(float)
        for _ in range(rounds):
            weight = np.stack([(1 - p) * counts, p * counts], 1)
            self._fit(v, weight, smooth)
            p = np.where(told, known, self.posterior(patterns))

    def _fit(self, v: np.ndarray, weight: np.ndarray, smooth: float) -> None:
        n, each = self.voters, [np.eye(STATES)[v[:, j]] for j in range(self.voters)]
        self.balance = (weight.sum(0) + 1) / (weight.sum() + 2)
        both = {(i, j): np.einsum("py,pa,pb->yab", weight, each[i], each[j]) for i in range(n) for j in range(n) if i < j}
        gain = np.zeros((n, n))
        for (i, j), t in both.items():
            t = t / max(t.sum(), 1e-12)
            y, a, b = t.sum((1, 2), keepdims=True), t.sum(2, keepdims=True), t.sum(1, keepdims=True)
            with np.errstate(divide="ignore", invalid="ignore"):
                gain[i, j] = gain[j, i] = np.nansum(np.where(t > 0, t * np.log(t * y / (a * b)), 0))
        self.parent, reached = np.full(n, -1), {0} if n else set()
        while len(reached) < n:
            i, j = max(((i, j) for i in reached for j in range(n) if j not in reached), key=lambda e: (gain[e], -e[0], -e[1]))
            self.parent[j] = i
            reached.add(j)
        self.correlation, self.tables = gain, []
        for j in range(n):
            i = self.parent[j]
            if i < 0:
                t = np.einsum("py,pb->yb", weight, each[j])[:, None, :].repeat(STATES, 1)
            else:
                t = both[i, j] if i < j else both[j, i].transpose(0, 2, 1)
            prior = t.sum(1, keepdims=True) / np.maximum(t.sum((1, 2))[:, None, None], 1e-12) + 1e-6
            self.tables.append(np.log((t + smooth * prior) / (t + smooth * prior).sum(2, keepdims=True)))
        self.accuracy = np.array([(weight[:, 1] * (v[:, j] == 2) + weight[:, 0] * (v[:, j] == 0)).sum() / max((weight.sum(1) * (v[:, j] != 1)).sum(), 1e-12) for j in range(n)])

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of votes."""
        v = patterns.astype(int) + 1
        score = np.log(self.balance)[None, :].repeat(len(v), 0)
        for j in range(self.voters):
            parent = v[:, self.parent[j]] if self.parent[j] >= 0 else np.zeros(len(v), int)
            score += self.tables[j][:, parent, v[:, j]].T
        return 1 / (1 + np.exp(np.clip(score[:, 0] - score[:, 1], -50, 50)))
