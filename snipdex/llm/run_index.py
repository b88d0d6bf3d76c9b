"""A run-length index over strings: run-compressed Burrows-Wheeler transform, sampled positions, matching statistics.

The strings (UTF-8, or any bytes below 248) lie one behind the other, each with a separator that is smaller than all
bytes and, among separators, ordered by string. Their suffixes are sorted by doubling, which gives the transform; what
is kept of it are its runs. Suffixes that begin with the same `length` bytes form an interval, a group. Groups of two and
more are the long repeats; for them the smallest position in the text is sampled, but only where it cannot be told from
the step before: as long as a group lies within one run, the step to the left moves all of its members, and the smallest
position goes down by one (the toehold of a run-length index). Samples are needed where a group holds the end of a run,
grows or shrinks by the step, or begins a stream.

Strings are streamed from their last `length` bytes, whose place is sampled, to their first byte, all of them in step.
Every step gives the matching statistic of the position, cut off at `length`: the interval of the text's suffixes that
share its next bytes, and the smallest position among them.
"""

from __future__ import annotations

import numpy as np

#: Symbols are 0 (separator) and a byte plus 1; eight of them are one key.
FIRST_KEY = 8


class RunLengthIndex:
    """Index of strings (their bytes in a row, and their sizes), for repeats of `length` bytes."""

    def __init__(self, data: np.ndarray, sizes: np.ndarray, length: int):
        self.length = length
        self.sizes = sizes.astype(np.int64)
        m = len(sizes)
        n = len(data) + m
        ends = np.cumsum(self.sizes + 1) - 1
        self.starts = ends - self.sizes
        if len(data) and data.max() >= 248:
            raise ValueError("bytes from 248 on are not indexed")
        text = np.zeros(n, np.uint8)
        inside = np.ones(n, bool)
        inside[ends] = False
        text[inside] = data + np.uint8(1)
        left = (np.repeat(ends, self.sizes + 1) - np.arange(n)).astype(np.int32)  # bytes up to the separator
        self.n = n

        order, same = self._sorted(text, left)
        # The transform and its runs.
        before = text[order - 1].astype(np.int64)
        before[order == 0] = 0
        begins = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]])) if n else np.zeros(0, np.int64)
        symbol = before[begins]
        lengths = np.diff(np.append(begins, n))
        self.run_begins = begins
        by_symbol = np.argsort(symbol, kind="stable")
        self.key = symbol[by_symbol] * (n + 1) + begins[by_symbol]
        self.symbol, self.begin, self.size = symbol[by_symbol], begins[by_symbol], lengths[by_symbol]
        self.target = np.cumsum(self.size) - self.size

        # Groups of two and more: where they begin and end, and the smallest position in each.
        # Where the last `length` bytes of each string stand, for the strings that have them.
        self.long = np.flatnonzero(self.sizes >= length)
        last = np.full(n, -1, np.int32)
        at_end = np.flatnonzero(left[order] == length)
        last[order[at_end]] = at_end
        self.last_window = last[ends[self.long] - length].astype(np.int64)
        joins = np.concatenate([same, [False]])  # whether the suffix at q shares `length` bytes with the one at q + 1
        follows = np.concatenate([[False], same])
        self.group_begin = np.flatnonzero(joins & ~follows)
        self.group_end = np.flatnonzero(follows & ~joins) + 1
        sample = np.zeros(0, np.int64)
        if len(self.group_begin):
            edges = np.stack([self.group_begin, self.group_end], axis=1).reshape(-1)
            sample = np.minimum.reduceat(np.append(order, n).astype(np.int64), edges)[0::2]
            entry = np.maximum.reduceat(np.append(left[order] == length, False), edges)[0::2]
            one_run, c = self._one_run(self.group_begin, self.group_end)
            told = np.zeros(len(sample), bool)
            rows = np.flatnonzero(one_run & (c > 0))
            group, low, high = self._widen(self._step(c[rows], self.group_begin[rows]))
            whole = (group >= 0) & (high - low == self.group_end[rows] - self.group_begin[rows])
            told[group[whole]] = True
            needed = entry | ~told
            self.sampled = np.flatnonzero(needed)
            sample = sample[needed]
        else:
            self.sampled = np.zeros(0, np.int64)
        self.sample = sample

    def _sorted(self, text: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All suffixes in order, and for each but the last whether it shares `length` bytes with the next."""
        n = len(text)
        depth = min(FIRST_KEY, self.length)
        padded = np.concatenate([text, np.zeros(FIRST_KEY, np.uint8)])
        key = np.ndarray((n,), ">u8", padded, strides=(1,)).astype(np.uint64) >> np.uint64(8 * (FIRST_KEY - depth))
        short = np.flatnonzero(left < depth)
        gone = (8 * (depth - left[short])).astype(np.uint64)  # what stands behind the separator
        key[short] = np.where(left[short] == 0, np.uint64(0), (key[short] >> (gone % np.uint64(64))) << (gone % np.uint64(64)))
        order = np.argsort(key).astype(np.int32)
        key, ended = key[order], left[order] < depth
        # Ended suffixes that are equal stand in the order of strings.
        rows = np.flatnonzero(ended)
        order[rows] = order[rows[np.lexsort((order[rows], key[rows]))]]
        new = np.ones(n, bool)
        new[1:] = (key[1:] != key[:-1]) | ended[1:] | ended[:-1]
        rank = np.empty(n, np.int32)
        starts = np.flatnonzero(new)
        rank[order] = np.repeat(starts, np.diff(np.append(starts, n)))
        known, known_depth = rank.copy(), depth
        while True:
            rows = np.flatnonzero(~new | np.append(~new[1:], False))  # in groups of two and more
            if not len(rows):
                break
            some = order[rows]
            pair = (rank[some].astype(np.int64) << 32) | rank[some + depth]
            again = np.argsort(pair)
            some, pair = some[again], pair[again]
            order[rows] = some
            # Rows of one group lie side by side, so what differs from the row before begins a group.
            differs = np.concatenate([[True], pair[1:] != pair[:-1]])
            new[rows] = differs
            rank[some] = np.maximum.accumulate(np.where(differs, rows, 0))
            depth *= 2
            if depth <= self.length:
                known, known_depth = rank.copy(), depth
        # Two overlapping pieces of known_depth bytes make up `length` bytes.
        shift = self.length - known_depth
        a, b = order[:-1], order[1:]
        same = (left[a] >= self.length) & (left[b] >= self.length) & (known[a] == known[b])
        at = np.flatnonzero(same)
        same[at] = known[a[at] + shift] == known[b[at] + shift]
        return order, same

    def _step(self, c: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Where suffixes begin that have c before them, of those from place q on."""
        run = np.searchsorted(self.key, c * (self.n + 1) + q) - 1
        at = np.maximum(run, 0)
        inside = np.where(self.symbol[at] == c, np.minimum(q - self.begin[at], self.size[at]), self.size[at])
        return np.where(run < 0, 0, self.target[at] + inside)

    def _one_run(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether an interval lies within one run, and the symbol of its first place."""
        a = np.searchsorted(self.run_begins, low, side="right") - 1
        b = np.searchsorted(self.run_begins, high - 1, side="right") - 1
        if not hasattr(self, "run_symbol"):
            self.run_symbol = self.symbol[np.argsort(self.begin, kind="stable")]
        return a == b, self.run_symbol[a]

    def _widen(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The group that holds a place (-1 if it is alone), where it begins and ends."""
        group = np.searchsorted(self.group_begin, place, side="right") - 1
        at = np.maximum(group, 0)
        if not len(self.group_begin):
            return np.full(len(place), -1), place, place + 1
        inside = (group >= 0) & (place < self.group_end[at])
        return np.where(inside, group, -1), np.where(inside, self.group_begin[at], place), np.where(inside, self.group_end[at], place + 1)

    def stream(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows (string, offset, smallest position) of all places of the indexed strings whose next bytes repeat.

        `data` are the bytes that the index was built of.
        """
        longest = np.argsort(-self.sizes[self.long], kind="stable")
        strings, low = self.long[longest], self.last_window[longest]
        windows = self.sizes[strings] - self.length + 1
        first = np.concatenate([[0], np.cumsum(self.sizes)])[:-1][strings]
        group, low, high = self._widen(low)
        least = np.full(len(strings), -1)
        told = np.zeros(len(strings), bool)
        out = []
        for t in range(1, int(windows.max(initial=0)) + 1):
            live = int(np.searchsorted(-windows, -t, side="right"))
            offset = windows[:live] - t
            if t > 1:
                low, high, least = low[:live], high[:live], least[:live]
                c = data[first[:live] + offset].astype(np.int64) + 1
                told = least >= 0
                rows = np.flatnonzero(told)
                one_run, _ = self._one_run(low[rows], high[rows])
                size = (high - low)[rows]
                group, low, high = self._widen(self._step(c, low))
                told[rows] = one_run & (size == (high - low)[rows])
            least = np.where(told, least - 1, -1)
            rows = np.flatnonzero((group >= 0) & ~told)
            least[rows] = self.sample[np.searchsorted(self.sampled, group[rows])]
            rows = np.flatnonzero(group >= 0)
            out.append((strings[rows], offset[rows], least[rows]))
        if not out:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*out))

    def owner(self, position: np.ndarray) -> np.ndarray:
        """The string that a position lies in."""
        return np.searchsorted(self.starts, position, side="right") - 1
