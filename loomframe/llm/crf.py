"""Linear-chain conditional random field with any number of tags, for many sequences at once.

Sequences lie one after the other: sequence i is rows first[i]:first[i + 1] of the potentials.  All
go on together, position by position, longest first, so the work per position is one array step.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def _live(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    base, length = first[:-1][order], length[order]
    longest = int(length[0]) if len(length) else 0
    return base, np.searchsorted(-length, -np.arange(longest), "left")


def _sum(x: np.ndarray) -> np.ndarray:
    top = x.max(-1, keepdims=True)
    return np.log(np.exp(x - top).sum(-1)) + top[..., 0]


def messages(emit: np.ndarray, first: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward log messages and each sequence's log normalizer (sequences are not empty)."""
    base, live = _live(first)
    ahead, back = emit.copy(), np.zeros_like(emit)
    for t in range(1, len(live)):
        at = base[: live[t]] + t
        ahead[at] += _sum(ahead[at - 1][:, None, :] + move.T[None])
    for t in range(len(live) - 1, 0, -1):
        at = base[: live[t]] + t
        back[at - 1] = _sum((back[at] + emit[at])[:, None, :] + move[None])
    return ahead, back, _sum(ahead[first[1:] - 1])


def viterbi(emit: np.ndarray, first: np.ndarray, move: np.ndarray) -> np.ndarray:
    """The best tag of each position."""
    base, live = _live(first)
    best, came = emit.copy(), np.zeros(emit.shape, np.int8)
    for t in range(1, len(live)):
        at = base[: live[t]] + t
        ways = best[at - 1][:, None, :] + move.T[None]
        came[at] = ways.argmax(-1)
        best[at] += ways.max(-1)
    tags = np.zeros(len(emit), np.int8)
    ends = first[1:] - 1
    tags[ends] = best[ends].argmax(-1)
    for t in range(len(live) - 1, 0, -1):
        at = base[: live[t]] + t
        tags[at - 1] = came[at, tags[at]]
    return tags


@dataclass
class ChainModel:
    """Weights (features, tags) and transitions (from, to)."""

    weight: np.ndarray
    move: np.ndarray

    def potentials(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weight


def fit(x: np.ndarray, tags: np.ndarray, first: np.ndarray, n_tags: int, forbidden: list[tuple[int, int]] = (), rounds: int = 120, ridge: float = 1e-3) -> ChainModel:
    """Maximum likelihood with a ridge, by Adam.  Tag 0 is the reference: its weights stay 0."""
    n_f = x.shape[1]
    x = x.astype(np.float64)
    inside = np.ones(len(x), bool)
    inside[first[:-1]] = False
    inside = np.flatnonzero(inside)
    gold = np.eye(n_tags)[tags]
    seen = np.zeros((n_tags, n_tags))
    np.add.at(seen, (tags[inside - 1], tags[inside]), 1)
    weight, move = np.zeros((n_f, n_tags)), np.zeros((n_tags, n_tags))
    moments = [[np.zeros_like(w), np.zeros_like(w)] for w in (weight, move)]
    n = max(1, len(first) - 1)
    for step in range(1, rounds + 1):
        for a, b in forbidden:
            move[a, b] = -30
        emit = x @ weight
        ahead, back, total = messages(emit, first, move)
        norm = np.repeat(total, np.diff(first))
        p = np.exp(ahead + back - norm[:, None])
        pair = np.exp(ahead[inside - 1][:, :, None] + move[None] + (emit[inside] + back[inside])[:, None, :] - norm[inside][:, None, None]).sum(0)
        grads = [x.T @ (p - gold) / n + ridge * weight, (pair - seen) / n + ridge * move]
        grads[0][:, 0] = 0
        for w, g, mv in zip((weight, move), grads, moments, strict=True):
            mv[0] = 0.9 * mv[0] + 0.1 * g
            mv[1] = 0.99 * mv[1] + 0.01 * g**2
            w -= 0.1 * (mv[0] / (1 - 0.9**step)) / (np.sqrt(mv[1] / (1 - 0.99**step)) + 1e-8)
    for a, b in forbidden:
        move[a, b] = -30
    return ChainModel(weight, move)
