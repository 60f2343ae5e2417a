"""A linear-chain conditional random field over sparse binary features, in numpy.

Training maximises the penalised log-likelihood of whole label sequences by forward-backward and Adam; decoding is
Viterbi. The model is a dict {feature: weights per label} and a matrix of transitions, small enough for a closure.
"""

from __future__ import annotations

import numpy as np

LABELS = ("O", "B", "I")


class _Bucket:
    """Lines of about one length, padded to the longest."""

    def __init__(self, sequences: list[list[list[str]]], labels: list[list[int]], ids: dict[str, int]):
        k = len(LABELS)
        self.n, self.width = len(sequences), max(len(s) for s in sequences)
        sizes = np.array([len(s) for s in sequences])
        flat = [(i * self.width + j, ids[f]) for i, s in enumerate(sequences) for j, t in enumerate(s) for f in t if f in ids]
        self.token_of, self.feats = np.array(flat, np.int64).reshape(-1, 2).T
        self.mask = np.arange(self.width)[None, :] < sizes[:, None]
        self.both = self.mask[:, 1:]
        gold = np.zeros((self.n, self.width), np.int64)
        for i, y in enumerate(labels):
            gold[i, : len(y)] = y
        self.one_hot = (np.eye(k)[gold] * self.mask[..., None]).reshape(-1, k)
        self.real = np.zeros((k, k))
        np.add.at(self.real, (gold[:, :-1][self.both], gold[:, 1:][self.both]), 1)

    def gradient(self, w: np.ndarray, tr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k, n, width, mask = len(LABELS), self.n, self.width, self.mask
        e = np.stack([np.bincount(self.token_of, w[self.feats, y], n * width) for y in range(k)], 1).reshape(n, width, k)
        # forward and backward in probabilities, scaled at each step, so that nothing over- or underflows
        psi = np.exp(e - e.max(2, keepdims=True))
        step = np.exp(tr - tr.max())
        scaled = lambda x: x / x.sum(-1, keepdims=True)
        alpha, beta = np.empty_like(psi), np.ones_like(psi)
        alpha[:, 0] = scaled(psi[:, 0])
        for t in range(1, width):
            alpha[:, t] = np.where(mask[:, t, None], scaled((alpha[:, t - 1] @ step) * psi[:, t]), alpha[:, t - 1])
        for t in range(width - 2, -1, -1):
            beta[:, t] = np.where(mask[:, t + 1, None], scaled((psi[:, t + 1] * beta[:, t + 1]) @ step.T), 1.0)
        p = scaled(alpha * beta) * mask[..., None]
        onward = psi[:, 1:] * beta[:, 1:]
        whole = np.einsum("nti,ij,ntj->nt", alpha[:, :-1], step, onward)
        part = np.where(self.both, 1 / whole, 0.0)
        expected = step * np.einsum("nti,ntj->ij", alpha[:, :-1] * part[..., None], onward)
        diff = (self.one_hot - p.reshape(-1, k))[self.token_of]
        return np.stack([np.bincount(self.feats, diff[:, y], len(w)) for y in range(k)], 1), self.real - expected


def train(sequences: list[list[list[str]]], labels: list[list[int]], rounds: int = 60, rate: float = 0.2, penalty: float = 2e-4, least: int = 2) -> tuple[dict[str, tuple[float, ...]], list[list[float]]]:
    """sequences: per line, per token, its features. Features of fewer than `least` tokens are left out."""
    counts: dict[str, int] = {}
    for s in sequences:
        for t in s:
            for f in t:
                counts[f] = counts.get(f, 0) + 1
    ids = {f: i for i, f in enumerate(sorted(f for f, n in counts.items() if n >= least))}
    order = sorted(range(len(sequences)), key=lambda i: len(sequences[i]))
    parts: list[list[int]] = []
    for i in order:  # lines of about one length, so that little is padding
        if parts and (len(sequences[i]) <= len(sequences[parts[-1][0]]) * 1.25 or len(parts[-1]) < 50):
            parts[-1].append(i)
        else:
            parts.append([i])
    buckets = [_Bucket([sequences[i] for i in part], [labels[i] for i in part], ids) for part in parts]
    total = sum(len(s) for s in sequences)
    k = len(LABELS)
    w, tr = np.zeros((len(ids), k)), np.zeros((k, k))
    state = [(np.zeros_like(x), np.zeros_like(x)) for x in (w, tr)]
    for step in range(1, rounds + 1):
        grads = [b.gradient(w, tr) for b in buckets]
        for i, (x, (m, v)) in enumerate(zip((w, tr), state)):
            grad = sum(g[i] for g in grads) / total - penalty * x
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            x += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return {f: tuple(w[i].tolist()) for f, i in ids.items() if np.abs(w[i]).max() > 1e-3}, tr.tolist()


def emission(features: list[str], weights: dict[str, tuple[float, ...]], k: int) -> list[float]:
    """The weight of each label of a token with these features."""
    e = [0.0] * k
    for f in features:
        w = weights.get(f)
        if w:
            for y, x in enumerate(w):
                e[y] += x
    return e


def best_path(emissions: list[list[float]], transitions: list[list[float]], start: list[float] | None = None, end: list[float] | None = None) -> list[int]:
    """Viterbi: the best labels of a run of tokens. `start` and `end` weigh the labels at its ends."""
    if not emissions:
        return []
    k = range(len(transitions))
    best = [a + b for a, b in zip(emissions[0], start)] if start else emissions[0]
    back = []
    for e in emissions[1:]:
        row, new = [], []
        for y in k:
            at = max(k, key=lambda x: best[x] + transitions[x][y])
            row.append(at)
            new.append(best[at] + transitions[at][y] + e[y])
        back.append(row)
        best = new
    if end:
        best = [a + b for a, b in zip(best, end)]
    out = [max(k, key=lambda x: best[x])]
    for row in reversed(back):
        out.append(row[out[-1]])
    return out[::-1]


def viterbi(features: list[list[str]], weights: dict[str, tuple[float, ...]], transitions: list[list[float]], barred: list[bool] | None = None) -> list[int]:
    """The best labels of one line; barred tokens get O."""
    k = len(transitions)
    emissions = [emission(f, weights, k) for f in features]
    for i, no in enumerate(barred or []):
        if no:
            emissions[i][1:] = [-1e9] * (k - 1)
    return best_path(emissions, transitions)
