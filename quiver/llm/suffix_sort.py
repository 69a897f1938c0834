"""Hash-compared suffix sort of many short strings, in groups.

Two suffixes are compared through their longest common extension, which a binary
search over prefix polynomial hashes finds in a logarithmic number of steps; a
merge sort orders the suffixes of every group with such comparisons, all groups
at once. Common extensions of neighbours are verified byte by byte afterwards; on
a collision the group order is made anew from the bytes themselves.
"""

from __future__ import annotations

import numpy as np

from quiver.llm.polyhash import prefixes, stretch


class Suffixes:
    """Strings given as stretches of one buffer, sorted by group (ascending numbers) and then by content."""

    def __init__(self, data: bytes, starts: np.ndarray, sizes: np.ndarray, groups: np.ndarray):
        self.raw = np.frombuffer(data, np.uint8)
        self.h = prefixes(self.raw)
        self.starts, self.sizes, self.groups = starts, sizes, groups
        self.order = self._merge_sort()
        self.common = self._neighbours()

    def extension(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Lengths of the common beginnings of strings x and y, by binary search over hashes."""
        low, high = np.zeros(len(x), np.int64), np.minimum(self.sizes[x], self.sizes[y])
        sx, sy = self.starts[x], self.starts[y]
        while (low < high).any():
            middle = (low + high + 1) >> 1
            same = stretch(self.h, sx, sx + middle) == stretch(self.h, sy, sy + middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def _less(self, x: np.ndarray, y: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """x < y, or x <= y where ``or_equal``; both in one group."""
        n = self.extension(x, y)
        x_ends, y_ends = n == self.sizes[x], n == self.sizes[y]
        last = len(self.raw) - 1
        by_byte = self.raw[np.minimum(self.starts[x] + n, last)] < self.raw[np.minimum(self.starts[y] + n, last)]
        return np.where(x_ends & y_ends, or_equal, np.where(x_ends, True, np.where(y_ends, False, by_byte)))

    def _merge_sort(self) -> np.ndarray:
        """Bottom-up; in each round every string finds its place among its sibling run by binary search."""
        order = np.argsort(self.groups, kind="stable")
        if not len(order):
            return order
        sorted_groups = self.groups[order]
        first = np.nonzero(np.concatenate(([True], sorted_groups[1:] != sorted_groups[:-1])))[0]
        size_of = np.diff(np.append(first, len(order)))
        begin, size = np.repeat(first, size_of), np.repeat(size_of, size_of)
        width = 1
        while (size > width).any():
            live = np.nonzero(size > width)[0]
            local = live - begin[live]
            run = local // width
            other = (run ^ 1) * width
            n_other = np.clip(size[live] - other, 0, width)
            low, high = np.zeros(len(live), np.int64), n_other.copy()
            mine, right = order[live], run % 2 == 1
            while True:
                open_ = np.nonzero(low < high)[0]
                if not len(open_):
                    break
                middle = (low[open_] + high[open_]) >> 1
                theirs = order[begin[live[open_]] + other[open_] + middle]
                before = self._less(theirs, mine[open_], right[open_])     # of equals the left run's go first
                low[open_] = np.where(before, middle + 1, low[open_])
                high[open_] = np.where(before, high[open_], middle)
            merged = order.copy()
            merged[begin[live] + run // 2 * (2 * width) + local - run * width + low] = mine
            order, width = merged, 2 * width
        return order

    def _neighbours(self) -> np.ndarray:
        """Common beginning of each string in order with the one before it; -1 where a group begins."""
        common = np.full(len(self.order), -1, np.int64)
        if len(self.order) < 2:
            return common
        x, y = self.order[:-1], self.order[1:]
        same_group = np.nonzero(self.groups[x] == self.groups[y])[0]
        x, y = x[same_group], y[same_group]
        n = self.extension(x, y)
        common[same_group + 1] = n
        if not self._verified(x, y, n):
            self._sort_by_bytes()
            return self._by_bytes()
        return common

    def _verified(self, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> bool:
        """Do the first n bytes agree, and does the order hold at the byte after them?"""
        for at in range(int(n.max(initial=0))):
            rows = np.nonzero(n > at)[0]
            if (self.raw[self.starts[x[rows]] + at] != self.raw[self.starts[y[rows]] + at]).any():
                return False
        return True

    def _bytes(self, i: int) -> bytes:
        return self.raw[self.starts[i]: self.starts[i] + self.sizes[i]].tobytes()

    def _sort_by_bytes(self) -> None:
        self.order = np.array(sorted(range(len(self.order)), key=lambda i: (self.groups[i], self._bytes(i))), np.int64)

    def _by_bytes(self) -> np.ndarray:
        common = np.full(len(self.order), -1, np.int64)
        for k in range(1, len(self.order)):
            i, j = self.order[k - 1], self.order[k]
            if self.groups[i] == self.groups[j]:
                x, y = self._bytes(i), self._bytes(j)
                common[k] = next((m for m, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))
        return common

    def classes(self, depth: int) -> np.ndarray:
        """A number per string: equal for strings of one group that share their first ``depth`` bytes."""
        number = np.empty(len(self.order), np.int64)
        number[self.order] = np.cumsum(self.common < depth)
        return number


def repeated_windows(contexts: list[bytes], places: np.ndarray, groups: np.ndarray, width: int) -> np.ndarray:
    """Which windows of each context also occur in an earlier context of its group: [context, bytes before the anchor].

    ``contexts`` are in order of position, earliest first; ``places`` are the
    anchor's places in them. A window lies ``l`` bytes before the anchor and is
    equal to another of its group if the ``l`` bytes before the anchors and the
    ``width - l`` bytes from the anchors on are: two suffix sorts, one of the
    texts from the anchor on and one of the reversed texts before it, tell.
    """
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
    starts = np.cumsum(sizes) - sizes
    data = b"".join(contexts)
    after = Suffixes(data, starts + places, sizes - places, groups)
    total = len(data)
    before = Suffixes(data[::-1], total - starts - places, places, groups)
    found = np.zeros((len(contexts), width + 1), bool)
    for left in range(width + 1):
        rows = np.nonzero((places >= left) & (sizes - places >= width - left))[0]
        if len(rows) > 1:
            kinds = after.classes(width - left)[rows] * (len(contexts) + 1) + before.classes(left)[rows]
            _, first = np.unique(kinds, return_index=True)
            again = np.ones(len(rows), bool)
            again[first] = False
            found[rows, left] = again
    return found
