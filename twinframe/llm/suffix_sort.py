"""Sparse two-stage suffix sorting of byte strings, up to a depth, and adjacent common prefixes."""

from __future__ import annotations

import numpy as np


def two_stage_order(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, needed: np.ndarray, depth: int) -> np.ndarray:
    """The positions of ``needed`` suffixes in order of their first ``depth`` bytes.

    ``text`` is the concatenation of pieces ``[starts, ends)``; ``needed`` marks the positions
    whose order is wanted. A suffix smaller than its successor is sorted directly. Any other one
    is larger than its successor, so it's induced: scanning the buckets of first bytes upwards,
    the predecessor of each sorted suffix goes to the end of the larger-type part of its own
    bucket. Besides the needed positions only the run up to the next directly sorted one is used.
    """
    n = len(text)
    last = np.zeros(n, dtype=bool)
    last[ends - 1] = True
    # where a run of equal bytes ends decides the type of the whole run; a piece's end counts as larger
    differs = last.copy()
    differs[:-1] |= text[:-1] != text[1:]
    at = np.where(differs, np.arange(n), n)
    run_end = np.minimum.accumulate(at[::-1])[::-1]
    following = np.append(text[1:], 255)
    smaller = last[run_end] | (text[run_end] < following[run_end])
    # needed positions and, after each, everything up to the next directly sorted one
    direct_at = np.where(smaller, np.arange(n), n)
    next_direct = np.minimum.accumulate(direct_at[::-1])[::-1]
    edge = np.zeros(n + 1, dtype=np.int64)
    wanted = np.flatnonzero(needed)
    np.add.at(edge, wanted, 1)
    np.add.at(edge, next_direct[wanted] + 1, -1)
    used = np.cumsum(edge[:n]) > 0
    raw = text.tobytes()
    direct = np.array(sorted(np.flatnonzero(used & smaller).tolist(), key=lambda i: raw[i : i + depth]), dtype=np.int64)
    by_byte = np.argsort(text[direct], kind="stable")
    direct = direct[by_byte]
    bounds = np.searchsorted(text[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    first = np.zeros(n, dtype=bool)
    first[starts] = True
    order = []

    def induce(positions: np.ndarray, bucket: int) -> np.ndarray:
        """Hand the predecessors that are larger than these suffixes to their buckets; those of the same one are returned."""
        before = positions[~first[positions]] - 1
        before = before[used[before] & ~smaller[before]]
        heads = text[before]
        for byte in np.unique(heads).tolist():
            if byte != bucket:
                induced[byte].append(before[heads == byte])
        return before[heads == bucket]

    for bucket in range(256):
        waiting = induced[bucket]
        while waiting:
            part = np.concatenate(waiting)
            order.append(part)
            more = induce(part, bucket)
            waiting = [more] if len(more) else []
        part = direct[bounds[bucket] : bounds[bucket + 1]]
        if len(part):
            order.append(part)
            induce(part, bucket)
    whole = np.concatenate(order) if order else np.zeros(0, dtype=np.int64)
    return whole[needed[whole]]


def adjacent_equal(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For neighbours in ``order``, whether their common prefix reaches ``depth`` bytes; 8 bytes a step."""
    a, b = order[:-1], order[1:]
    padded = np.concatenate([text, np.zeros(8, dtype=np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    left = np.arange(len(a))
    for step in range(0, depth, 8):
        at = min(step, depth - 8)
        same = (words[a[left] + at] == words[b[left] + at]).all(axis=1)
        left = left[same]
        if not len(left):
            break
    out = np.zeros(len(a), dtype=bool)
    out[left] = True
    return out


def repeated(pieces: list[bytes], weights: list[int], depth: int) -> list[np.ndarray]:
    """Per piece, which of its ``depth``-byte strings occur twice among all pieces; a piece of weight above 1 repeats itself."""
    sizes = np.array([len(p) for p in pieces])
    text = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    edge = np.zeros(len(text) + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends - depth + 1, -1)
    order = two_stage_order(text, starts, ends, np.cumsum(edge[:-1]) > 0, depth)
    equal = adjacent_equal(text, order, depth)
    twice = np.zeros(len(text), dtype=bool)
    twice[order[:-1][equal]] = True
    twice[order[1:][equal]] = True
    return [twice[s : e - depth + 1] | (w > 1) for s, e, w in zip(starts, ends, weights)]
