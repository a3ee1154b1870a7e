"""Forward and backward recursions over many sequences at once.

Sequences are laid out by time: all first items, then all second items, and so on, the longest sequence first, so that a
step of the recursion is one matrix product over the sequences that are still running.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


class Layout:
    """Places of the items of sequences of given lengths (all at least 1)."""

    def __init__(self, lengths: np.ndarray) -> None:
        lengths = np.asarray(lengths, dtype=np.int64)
        order = np.argsort(-lengths, kind="stable")
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        top = int(lengths.max()) if len(lengths) else 0
        self.running = np.searchsorted(-lengths[order], -np.arange(top), side="left")
        self.begin = np.cumsum(self.running) - self.running
        self.owner = np.repeat(np.arange(len(lengths)), lengths)
        t = np.arange(len(self.owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        #: Place of each item, items given one sequence after another.
        self.place = self.begin[t] + rank[self.owner]
        self.steps = list(zip(self.begin.tolist(), self.running.tolist(), strict=True))


def forward(layout: Layout, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward values and the scale of each item; emit: states by places. The scales' logarithms add up to the likelihood's."""
    alpha, scale, before, into = np.empty_like(emit), np.empty(emit.shape[1], dtype=emit.dtype), 0, move.T.astype(emit.dtype)
    for s, n in layout.steps:
        a = (into @ alpha[:, before : before + n] if s else start.astype(emit.dtype)[:, None]) * emit[:, s : s + n]
        c = scale[s : s + n] = a.sum(axis=0)
        np.divide(a, c, out=alpha[:, s : s + n])
        before = s
    return alpha, scale


def backward(layout: Layout, move: np.ndarray, emit: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Backward values that fit forward()'s scales: alpha * beta is each item's posterior."""
    beta, ahead, out = np.ones_like(emit), emit / scale, move.astype(emit.dtype)
    for (s, _), (after, m) in zip(layout.steps[-2::-1], layout.steps[:0:-1], strict=True):
        np.matmul(out, beta[:, after : after + m] * ahead[:, after : after + m], out=beta[:, s : s + m])
    return beta


def pairs(layout: Layout, move: np.ndarray, emit: np.ndarray, alpha: np.ndarray, beta: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Expected number of moves from state to state."""
    total, ahead = np.zeros_like(move), beta * emit / scale
    for (s, _), (after, m) in zip(layout.steps, layout.steps[1:], strict=False):
        total += alpha[:, s : s + m] @ ahead[:, after : after + m].T
    return total * move


def batches(lengths: list[int], most: int) -> Iterator[list[int]]:
    """Indices of sequences in groups of like length, of at most `most` items together (one sequence at least)."""
    group, items = [], 0
    for i in sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True):
        if group and items + lengths[i] > most:
            yield group
            group, items = [], 0
        group.append(i)
        items += lengths[i]
    if group:
        yield group
