"""Content-defined runs of windows: which suffixes of a text are worth comparing.

Every window (string of ``width`` bytes) has one anchor, the leftmost smallest
hash among its grams, which depends on nothing outside the window. Consecutive
windows with one anchor are a run. Two equal windows have equal anchors at equal
places, so equal windows are only found in runs under equal anchors.
"""

from __future__ import annotations

import numpy as np
import xxhash

from quiver.llm.polyhash import SPREAD, prefixes, stretch

GRAM = 28


def anchors(raw: np.ndarray, width: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """For every window start: the place of its anchor; and the hash of every gram."""
    grams = len(raw) - gram + 1
    h = prefixes(raw)
    at = np.arange(grams)
    hashes = stretch(h, at, at + gram)
    hashes = (hashes ^ (hashes >> np.uint64(31))) * SPREAD
    span = width - gram + 1                      # grams in a window
    # the smallest of each block's heads and tails, with its place in the low bits: the leftmost of equals wins
    blocks = -(-grams // span)
    bits = np.uint64(max(1, int(span - 1).bit_length()))
    keys = np.full(blocks * span, np.iinfo(np.uint64).max, np.uint64)
    keys[:grams] = (hashes >> bits) << bits
    keys = keys.reshape(blocks, span) | np.arange(span, dtype=np.uint64)[None, :]
    heads = np.minimum.accumulate(keys, axis=1).reshape(-1)
    tails = np.minimum.accumulate(keys[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    starts = np.arange(len(raw) - width + 1)
    tail, head = tails[starts], heads[starts + span - 1]
    mask = (np.uint64(1) << bits) - np.uint64(1)
    in_tail = (tail >> bits) <= (head >> bits)
    place = np.where(in_tail, starts // span * span + (tail & mask).astype(np.int64),
                     (starts + span - 1) // span * span + (head & mask).astype(np.int64))
    return place, hashes


def runs(data: bytes, width: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, content hash, first start, number of windows, anchor's place) of every run of a text.

    The content hash covers all bytes of the run's windows, with the anchor's
    place among them and the number of windows.
    """
    if len(data) < width:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    raw = np.frombuffer(data, np.uint8)
    place, hashes = anchors(raw, width)
    first = np.concatenate(([0], np.nonzero(place[1:] != place[:-1])[0] + 1))
    number = np.diff(np.append(first, len(place)))
    digest = xxhash.xxh3_64_intdigest
    content = np.fromiter((digest(data[s: s + n + width - 1], n) for s, n in zip(first.tolist(), number.tolist())),
                          np.uint64, len(first))
    at = place[first]
    content = content ^ ((at - first).astype(np.uint64) * SPREAD)
    return hashes[at].view(np.int64), content.view(np.int64), first, number, at
