"""An adaptive context-mixing range coder for ids, many independent blocks at a time.

Each block starts from an empty model, so blocks can be decoded alone; all blocks of a group are coded in step, one id
of each per turn, with numpy over the blocks. A block begins with its different ids, ascending; what is coded are their
numbers, so that the tables of a block are as small as its own alphabet. For every id the model has three predictions:

* order 2: the id that last proved right after the two ids before, with a confidence of 0 to 7;
* order 1: the same after the one id before;
* order 0: frequencies of all ids of the block so far, brought up to date after the turns in `REFRESH`.

The first coded symbol says which prediction holds (order 2, order 1 or neither). Its probabilities are mixed from the
orders by adaptive shares for each pair of confidences. In the last case the id follows by its order-0 frequency.
The coder keeps 64 bits of low end and range and moves 32 bits at a time; carries go into what is already written.
"""

from __future__ import annotations

import zlib

import numpy as np

U64 = np.uint64
SLOT_BITS = 11
BOTTOM = U64(1 << 32)
UNIT = U64(32)
SHARE = U64(16)  # bits of the shares of a choice
RATE = 5
FULL_SHARE = (1 << 16) - (1 << 9)  # both shares stay below 2 ** 16 together
GAIN = 2
REFRESH = [16, 32, 64, 128, 256, 512, 1024, 1536, 2048]
MAX_BLOCK = 2500  # numbers of ids and a confidence fit 16 bits
SURE = 12  # bits below the confidence
MARKED = 1 << 20  # cells to find the different ids of some blocks at once
MAGIC = b"CMR3"
HEAD = 24


def _first_shares() -> np.ndarray:
    """Shares of order 2 (low 16 bits) and order 1 (high) at first, for each confidence of both and whether they agree."""
    two, one, agree = np.meshgrid(np.arange(8), np.arange(8), np.arange(2), indexing="ij")
    expected = np.array([0.04, 0.25, 0.5, 0.65, 0.75, 0.8, 0.85, 0.9])
    low = expected[two] * FULL_SHARE
    high = np.where(agree == 1, 0.01, expected[one] * 0.8) * (FULL_SHARE - low)
    return (low.astype(np.uint32) | high.astype(np.uint32) << np.uint32(16)).reshape(-1)


class _Model:
    """Predictions for lanes of falling length; `sizes` has the number of different ids of each."""

    def __init__(self, sizes: np.ndarray):
        lanes = len(sizes)
        ends = np.cumsum(sizes + 1)
        self.base = ends - sizes - 1  # a lane's cells for its numbers 0 (none), 1, 2, ...
        self.cells = np.append(self.base, ends[-1:] if lanes else 0)
        self.numbers = (np.arange(self.cells[-1]) - np.repeat(self.base, sizes + 1)).astype(np.uint16)
        self.counts = np.ones(len(self.numbers), np.int64)
        self.counts[self.base] = 0
        self.total, self.most = sizes.astype(np.uint64), sizes.astype(np.uint64) - U64(1)
        self.choice_row = np.arange(lanes) << 7
        self.slot_row = np.arange(lanes) << SLOT_BITS
        self.first_order = lanes << SLOT_BITS  # cells of order 1 lie behind those of order 2
        self.guess = np.zeros(self.first_order + len(self.counts), np.uint16)
        self.choice = np.tile(_first_shares(), lanes)
        self.last = np.zeros(lanes, np.uint32)
        self.older = np.zeros(lanes, np.uint32)
        self.slots = np.empty((2, lanes), np.int64)
        self.learned, self.steps = 0, iter(REFRESH)
        self.next = next(self.steps)
        self._sum(lanes)

    def _sum(self, lanes: int) -> None:
        """`spans`: what lies below a number in its lane (high 16 bits) and its count."""
        counts = self.counts[: self.cells[lanes]]
        below = np.cumsum(counts)
        self.lane_below = below[self.base[:lanes]]
        below -= np.repeat(self.lane_below, np.diff(self.cells[: lanes + 1]))
        self.spans = ((below - counts) << 16 | counts).astype(np.uint32)

    def refresh(self, turn: int, lanes: int, table: np.ndarray, places: bool) -> None:
        """Count the numbers of the turns since the last time; `table` has them by turn and lane."""
        if turn == self.next:
            cells = table[self.learned : turn, :lanes] + self.base[:lanes]
            self.counts[: self.cells[lanes]] += GAIN * np.bincount(cells.reshape(-1), minlength=self.cells[lanes])
            self.total[:lanes] += U64(GAIN * (turn - self.learned))
            self.most[:lanes] += U64(GAIN * (turn - self.learned))
            self.learned, self.next = turn, next(self.steps, 0)
            self._sum(lanes)
        elif turn:
            return
        if places:  # the number at every place, to decode
            self.number_at = np.repeat(self.numbers[: self.cells[lanes]], self.counts[: self.cells[lanes]])

    def predict(self, lanes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Cells of both orders and what they hold, their guesses, and the row of shares for the choice."""
        slots = self.slots[:, :lanes]
        pair = self.older[:lanes] << np.uint32(12)
        pair |= self.last[:lanes]
        pair *= np.uint32(2654435761)
        pair >>= np.uint32(32 - SLOT_BITS)
        np.add(self.slot_row[:lanes], pair, out=slots[0])
        np.add(self.base[:lanes], self.last[:lanes], out=slots[1])
        slots[1] += self.first_order
        found = self.guess.take(slots, mode="clip")
        guesses = found & np.uint16((1 << SURE) - 1)
        sure = found >> np.uint16(SURE)
        rows = sure[0] << np.uint16(3)
        rows |= sure[1]
        rows <<= np.uint16(1)
        rows |= guesses[0] == guesses[1]
        return slots, found, guesses, self.choice_row[:lanes] + rows

    def learn(self, lanes: int, slots: np.ndarray, found: np.ndarray, guesses: np.ndarray, rows: np.ndarray, shares: np.ndarray, few: np.ndarray, first: np.ndarray, numbers: np.ndarray) -> None:
        """`few`: the lanes where order 2 (`first`) or else order 1 was right."""
        step = np.uint32(FULL_SHARE >> RATE)
        less = shares >> np.uint32(RATE)
        less &= np.uint32(0x07FF07FF)
        shares -= less
        shares[few] += np.where(first, step, step << np.uint32(16))
        self.choice[rows] = shares
        more = np.minimum(found + np.uint16(1 << SURE), guesses | np.uint16(7 << SURE))
        other = np.where(found >= np.uint16(1 << SURE), found - np.uint16(1 << SURE), numbers)
        self.guess[slots] = np.where(guesses == numbers, more, other)
        self.older[:lanes] = self.last[:lanes]
        self.last[:lanes] = numbers


def _turned(table: np.ndarray) -> np.ndarray:
    """Rows as columns, some at a time so that memory is read and written by lines."""
    out = np.empty(table.shape[::-1], table.dtype)
    for first in range(0, len(table), 32):
        out[:, first : first + 32] = table[first : first + 32].T
    return out


def _short_numbers(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers as bytes of seven bits, the lowest first and the last below 128, and the bytes of each."""
    width = np.ones(len(values), np.int64)
    for bits in (7, 14, 21, 28):
        if values.max(initial=0) >> bits:
            width += values >= (1 << bits)
    ends = np.cumsum(width)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(width.max(initial=0)):
        here = np.flatnonzero(width > k)
        out[ends[here] - width[here] + k] = (values[here] >> (7 * k)) & 127 | np.where(width[here] > k + 1, 128, 0)
    return out, width


def _long_numbers(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of `_short_numbers`, and where each ends."""
    ends = np.flatnonzero(data < 128) + 1
    data = data[: ends[-1] if len(ends) else 0]
    starts = np.append(0, ends[:-1])[: len(ends)]
    width = ends - starts
    if width.max(initial=0) > 5:
        raise ValueError("the ids of a block of coded ids are damaged")
    place = np.arange(len(data)) - np.repeat(starts, width)
    parts = (data & 127).astype(np.int64) << (7 * place)
    return np.add.reduceat(parts, starts) if len(starts) else np.zeros(0, np.int64), ends


def _alphabets(blocks: list[np.ndarray], ids: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The different ids of all blocks, ascending in each, how many each has, and the blocks in their numbers from 1 on."""
    found, sizes, numbers = [], [], []
    ids = -(-ids // 8) * 8
    some = max(1, MARKED // max(ids, 1))
    mark, number = np.zeros(min(some, len(blocks)) * ids, bool), np.empty(min(some, len(blocks)) * ids, np.uint16)
    for first in range(0, len(blocks), some):
        these = blocks[first : first + some]
        lengths = [len(b) for b in these]
        cells = np.concatenate(these).astype(np.int64) + np.repeat(np.arange(len(these)) * ids, lengths)
        mark[cells] = True
        eights = np.flatnonzero(mark.view(np.uint64))  # few are marked: look at eight cells at once
        cell = np.flatnonzero(mark.reshape(-1, 8)[eights])
        used = (eights << 3)[cell >> 3] + (cell & 7)
        lane = used // ids
        size = np.bincount(lane, minlength=len(these))
        begin = np.cumsum(size) - size
        number[used] = np.arange(1, len(used) + 1) - begin[lane]
        numbers += np.split(number[cells], np.cumsum(lengths)[:-1])
        mark[used] = False
        found.append(used - lane * ids)
        sizes.append(size)
    return np.concatenate(found), np.concatenate(sizes), numbers


def encode_blocks(blocks: list[np.ndarray], ids: int) -> list[bytes]:
    """Each block of ids (below `ids`) as bytes with its number of ids and checksum."""
    if not blocks:
        return []
    lengths = np.array([len(b) for b in blocks])
    if lengths.max() > MAX_BLOCK:
        raise ValueError(f"a block has at most {MAX_BLOCK} ids")
    if max((int(b.max()) for b in blocks if len(b)), default=-1) >= ids:
        raise ValueError(f"ids are below {ids}")
    alphabet, sizes, numbers = _alphabets(blocks, ids)
    order = np.argsort(-lengths, kind="stable")  # those still in work come first
    longest = int(lengths.max())
    by_lane = np.zeros((len(blocks), longest), np.uint16)
    for lane, at in enumerate(order):
        by_lane[lane, : lengths[at]] = numbers[at]
    table = _turned(by_lane)
    working = len(blocks) - np.searchsorted(lengths[order][::-1], np.arange(longest), side="right")
    model = _Model(sizes[order])
    low, size = np.zeros(len(blocks), np.uint64), np.full(len(blocks), U64(2**64 - 1))
    width = longest + longest // 8 + 16
    out = np.zeros(len(blocks) * width, np.uint32)
    filled = np.arange(len(blocks)) * width
    for turn in range(longest):
        lanes = int(working[turn])
        model.refresh(turn, lanes, table, False)
        these = table[turn, :lanes]
        slots, found, guesses, rows = model.predict(lanes)
        shares = model.choice.take(rows)
        holds = guesses == these
        few = np.flatnonzero(holds[0] | holds[1])
        first = holds[0].take(few)
        old, whole = low[:lanes], size[:lanes]
        step = whole >> SHARE
        two = (shares & np.uint32(0xFFFF)) * step
        step *= shares >> np.uint32(16)
        start = two + step
        rest = (whole - start) // model.total[:lanes]
        spans = model.spans.take(model.base[:lanes] + these)
        start += (spans >> np.uint32(16)) * rest
        rest *= spans & np.uint32(0xFFFF)
        start[few] = np.where(first, U64(0), two.take(few))
        rest[few] = np.where(first, two.take(few), step.take(few))
        start += old
        carried = np.flatnonzero(start < old)
        if len(carried):
            carried = filled[carried] - 1
        while len(carried):
            out[carried] += np.uint32(1)
            carried = carried[out[carried] == 0] - 1
        moving = np.flatnonzero(rest < BOTTOM)
        at = filled.take(moving)
        end = start.take(moving)
        out[at] = (end >> UNIT).astype(np.uint32)
        filled[moving] = at + 1
        start[moving] = end << UNIT
        rest[moving] <<= UNIT
        low[:lanes], size[:lanes] = start, rest
        model.learn(lanes, slots, found, guesses, rows, shares, few, first, these)
    for _ in range(2):
        out[filled] = low >> UNIT
        filled += 1
        low <<= UNIT
    filled -= np.arange(len(blocks)) * width
    # The first id of a block as it is, the others as differences.
    ends = np.cumsum(sizes)
    steps = np.diff(alphabet, prepend=0)
    firsts = (ends - sizes)[sizes > 0]
    steps[firsts] = alphabet[firsts]
    packed, widths = _short_numbers(steps)
    bounds = np.append(0, np.cumsum(widths))
    made: list[bytes] = [b""] * len(blocks)
    for lane, at in enumerate(order):
        letters = packed[bounds[ends[at] - sizes[at]] : bounds[ends[at]]]
        head = np.array([lengths[at], zlib.crc32(blocks[at].astype("<u4")), sizes[at], len(letters), filled[lane]], "<u4")
        made[at] = MAGIC + head.tobytes() + letters.tobytes() + out[lane * width : lane * width + filled[lane]].astype("<u4").tobytes()
    return made


def decode_blocks(coded: list[bytes]) -> list[np.ndarray]:
    """The ids of each block; a block that is cut, damaged or of another format is an error."""
    if not coded:
        return []
    heads = np.zeros((len(coded), 5), np.int64)
    for at, data in enumerate(coded):
        if data[:4] != MAGIC or len(data) < HEAD:
            raise ValueError("this is not a block of coded ids")
        heads[at] = np.frombuffer(data, "<u4", 5, 4)
        n, _, different, letters, units = heads[at].tolist()
        if len(data) != HEAD + letters + 4 * units or n > MAX_BLOCK or different > n or (n > 0) > different:
            raise ValueError("a block of coded ids is cut")
    order = np.argsort(-heads[:, 0], kind="stable")
    lengths, sums, sizes, letters, filled = heads[order].T
    longest = int(lengths[0])
    steps, ends = _long_numbers(np.frombuffer(b"".join([coded[at][HEAD : HEAD + n] for at, n in zip(order, letters)]), np.uint8))
    last = np.cumsum(sizes)
    if len(steps) != last[-1] or (ends[last[sizes > 0] - 1] != np.cumsum(letters)[sizes > 0]).any():
        raise ValueError("the ids of a block of coded ids are damaged")
    model = _Model(sizes)
    alphabet = np.zeros(len(model.counts), np.int64)
    alphabet[np.flatnonzero(model.counts)] = steps
    alphabet = np.cumsum(alphabet)
    alphabet -= np.repeat(alphabet[model.base], sizes + 1)  # a lane's first cell, of no id, adds nothing
    width = int(filled.max()) + 4
    units = np.zeros(len(coded) * width, np.uint32)
    for lane, at in enumerate(order):
        units[lane * width : lane * width + filled[lane]] = np.frombuffer(coded[at], "<u4", filled[lane], HEAD + letters[lane])
    working = len(coded) - np.searchsorted(lengths[::-1], np.arange(longest), side="right")
    read = np.arange(len(coded)) * width + 2
    size = np.full(len(coded), U64(2**64 - 1))
    ahead = units[read - 2].astype(np.uint64) << UNIT | units[read - 1]  # what is coded, above the low end
    table = np.zeros((longest, len(coded)), np.uint16)
    for turn in range(longest):
        lanes = int(working[turn])
        model.refresh(turn, lanes, table, True)
        slots, found, guesses, rows = model.predict(lanes)
        shares = model.choice.take(rows)
        value, whole = ahead[:lanes], size[:lanes]
        step = whole >> SHARE
        two = (shares & np.uint32(0xFFFF)) * step
        step *= shares >> np.uint32(16)
        both = two + step
        few = np.flatnonzero(value < both)
        known = value.take(few)
        first = known < two.take(few)
        value = value - both
        rest = (whole - both) // model.total[:lanes]
        place = np.minimum(value // rest, model.most[:lanes]).view(np.int64)
        place += model.lane_below[:lanes]
        these = model.number_at.take(place)
        spans = model.spans.take(model.base[:lanes] + these)
        value -= (spans >> np.uint32(16)) * rest
        rest *= spans & np.uint32(0xFFFF)
        value[few] = np.where(first, known, known - two.take(few))
        rest[few] = np.where(first, two.take(few), step.take(few))
        these[few] = np.maximum(np.where(first, guesses[0].take(few), guesses[1].take(few)), 1)  # 0, no id, only if the block is damaged
        moving = np.flatnonzero(rest < BOTTOM)
        at = read.take(moving)
        value[moving] = value.take(moving) << UNIT | units.take(at, mode="clip")
        read[moving] = at + 1
        rest[moving] <<= UNIT
        ahead[:lanes], size[:lanes] = value, rest
        table[turn, :lanes] = these
        model.learn(lanes, slots, found, guesses, rows, shares, few, first, these)
    made: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(coded)
    by_lane, alphabet = _turned(table), alphabet.astype(np.uint32)
    for lane, at in enumerate(order):
        made[at] = alphabet[model.base[lane] :].take(by_lane[lane, : lengths[lane]])
        if zlib.crc32(made[at].astype("<u4")) != sums[lane]:
            raise ValueError("the checksum of a block of coded ids is wrong")
    return made
