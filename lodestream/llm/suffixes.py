"""Two-stage suffix sorting of an array of small integers, and the adjacent common prefixes of the result.

Only suffixes smaller than their successors are compared directly, and only to ``depth`` symbols, which is all that a caller asks about. The others follow by
bucket scans: a bucket's own suffixes are in order once every smaller bucket is, because the successor of each stands in one that has been scanned.
"""

from __future__ import annotations

import numpy as np


def smaller_than_successor(t: np.ndarray) -> np.ndarray:
    """For each suffix whether it is smaller than the next one; the last is not, as the end is smaller than any symbol."""
    n = len(t)
    if not n:
        return np.zeros(0, bool)
    step = np.sign(np.diff(t.astype(np.int64)))  # 1: rises to the next symbol
    step = np.append(step, -1)
    at = np.where(step != 0, np.arange(n), n)
    nearest = np.minimum.accumulate(at[::-1])[::-1]  # where the run of equal symbols ends
    return step[nearest] > 0


def sorted_suffixes(t: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes, in order of their first ``depth`` symbols (0 and more)."""
    n = len(t)
    if not n:
        return np.zeros(0, np.int64)
    small = smaller_than_successor(t)
    symbols, code = np.unique(t, return_inverse=True)
    code = code.astype(np.int64)
    direct = _direct(code, np.flatnonzero(small), depth)
    heads = np.searchsorted(code[direct], np.arange(len(symbols) + 1))
    waiting: list[list[np.ndarray]] = [[] for _ in symbols]
    # the end of the text is the smallest suffix of all: its predecessor is the first to be induced
    waiting[code[-1]].append(np.array([n - 1]))
    out = []
    for c in range(len(symbols)):
        rounds = [np.concatenate(waiting[c])] if waiting[c] else []
        while rounds and len(rounds[-1]):
            before = rounds[-1] - 1
            before = before[before >= 0]
            rounds.append(before[(code[before] == c) & ~small[before]])
        bucket = np.concatenate([*rounds, direct[heads[c] : heads[c + 1]]]) if rounds else direct[heads[c] : heads[c + 1]]
        waiting[c] = []
        out.append(bucket)
        before = bucket - 1
        before = before[before >= 0]
        head = code[before]
        later = head > c
        before, head = before[later], head[later]
        if len(before):
            order = np.argsort(head, kind="stable")
            before, head = before[order], head[order]
            cut = np.flatnonzero(np.diff(head)) + 1
            for part, x in zip(np.split(before, cut), head[np.concatenate(([0], cut))].tolist(), strict=True):
                waiting[x].append(part)
    return np.concatenate(out)


def _direct(code: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """The starts in order of their first ``depth`` symbols, compared as strings of two-byte symbols."""
    if not len(starts):
        return starts
    if code.max() >= 0xFFFF:
        raise ValueError("too many different symbols")
    padded = np.concatenate([code + 1, np.zeros(depth, np.int64)]).astype(">u2")
    rows = np.lib.stride_tricks.sliding_window_view(padded, depth)[starts]
    return starts[np.argsort(np.ascontiguousarray(rows).view(f"S{2 * depth}").reshape(-1), kind="stable")]


def adjacent_prefixes(t: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each suffix in ``order`` the number of symbols, up to ``depth``, that it shares with the one before it."""
    found = np.zeros(len(order), np.int64)
    padded = np.concatenate([t.astype(np.int64), -1 - np.arange(depth)])  # beyond the end nothing is equal
    alive = np.arange(1, len(order))
    for k in range(depth):
        a, b = order[alive] + k, order[alive - 1] + k
        alive = alive[(padded[a] == padded[b]) & (np.maximum(a, b) < len(t))]
        if not len(alive):
            break
        found[alive] += 1
    return found
