"""Run-length index of many short byte strings: a run-compressed Burrows-Wheeler transform with sampled run ends.

The strings stand behind each other with an end mark each; their suffixes are sorted by doubling ranks, the transform is
cut into runs, and only the runs stay: character, length, rank before the run, text place at both ends. A run is also
cut where the first `length` characters of the suffixes change, so that a run lies in one class of equal windows, and
the least owner (document) of each class is kept. Patterns are streamed from right to left, all at once, each holding a
row of the transform, its place and the length of its match; a mismatch moves the row to the next run end of that
character, above or below, whichever shares more.
"""

from __future__ import annotations

import numpy as np

INDEX_BITS = 21  # places of an index that is sorted as packed numbers


def _ranked(keys: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """(order by the keys, equal ones by place; rank of each place from 1; whether all differ). bits: of each key."""
    n = len(keys[0])
    if len(keys) * bits + INDEX_BITS <= 64 and n < 1 << INDEX_BITS:
        packed = keys[0]
        for k in keys[1:]:
            packed = (packed << np.uint64(bits)) | k
        packed = np.sort((packed << np.uint64(INDEX_BITS)) | np.arange(n, dtype=np.uint64))  # plain sorting of numbers is the fastest there is
        order = (packed & np.uint64((1 << INDEX_BITS) - 1)).astype(np.int64)
        packed >>= np.uint64(INDEX_BITS)
        new = packed[1:] != packed[:-1]
    else:
        order = np.lexsort(keys[::-1])
        new = np.zeros(max(0, n - 1), bool)
        for k in keys:
            new |= k[order[1:]] != k[order[:-1]]
    rank = np.empty(n, np.uint64)
    rank[order] = np.concatenate([[1], 1 + np.cumsum(new)])
    return order, rank, bool(new.all())


def suffix_order(text: np.ndarray, left: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of all suffixes, each up to its end mark, equal ones by place; number of the class of equal first `length`
    characters by place, -1 where fewer are left). text: characters from 1, end marks 0; left: characters before the
    end mark."""
    n = len(text)
    present = np.bincount(text, minlength=258) > 0
    present[0] = True
    dense = (np.cumsum(present) - 1).astype(np.uint64)[text]
    bits = max(1, int(present.sum() - 1).bit_length())
    width = max(1, min(length, (64 - INDEX_BITS) // bits))
    key, padded = np.zeros(n, np.uint64), np.concatenate([dense, np.zeros(width, np.uint64)])
    for k in range(width):
        key = (key << np.uint64(bits)) | np.where(k < left, padded[k : k + n], np.uint64(0))
    order, rank, differ = _ranked([key], bits * width)
    longest, window = int(left.max(initial=0)), None
    while True:
        if window is None and width <= length <= 2 * width:  # two overlapping stretches of `width` cover a window
            window, at = np.full(n, -1, np.int64), np.flatnonzero(left >= length)
            if len(at):
                _, number, _ = _ranked([rank[at], rank[at + length - width]], INDEX_BITS)
                window[at] = number.astype(np.int64) - 1
        if width >= longest or (window is not None and differ):
            return order, window if window is not None else np.full(n, -1, np.int64)
        after = np.concatenate([rank[width:], np.zeros(min(width, n), np.uint64)])[:n]
        order, rank, differ = _ranked([rank, np.where(left > width, after, np.uint64(0))], INDEX_BITS)
        width *= 2


class RunIndex:
    def __init__(self, strings: np.ndarray, sizes: np.ndarray, owners: np.ndarray, length: int):
        """strings: all bytes, one string behind another; owners: a number for each string; length: of a window."""
        self.length, m = length, len(sizes)
        ends = np.cumsum(sizes + 1) - 1
        self.text = np.zeros(len(strings) + m, np.int16)
        inner = np.ones(len(self.text), bool)
        inner[ends] = False
        self.text[inner] = strings.astype(np.int16) + 1
        raw = np.zeros(len(self.text) + 8, np.uint8)
        raw[:-8][inner] = strings
        self.words = np.ndarray((len(self.text),), "<u8", raw, 0, (1,))
        self.starts = ends - sizes
        self.left = np.repeat(ends, sizes + 1) - np.arange(len(self.text))
        of = np.repeat(np.arange(m), sizes + 1)
        order, window = suffix_order(self.text, self.left, length)
        before = np.where(order == self.starts[of[order]], 0, self.text[order - 1])  # the end mark stands before a start
        window = window[order]
        cut = np.ones(len(order), bool)
        cut[1:] = (before[1:] != before[:-1]) | (window[1:] != window[:-1])
        self.run = np.flatnonzero(cut).astype(np.int32 if len(order) < 1 << 31 else np.int64)
        self.last = np.append(self.run[1:], len(order)) - 1
        self.char, self.first_at, self.last_at = before[self.run].astype(np.int64), order[self.run], order[self.last]
        size = self.last - self.run + 1
        by = np.argsort(self.char, kind="stable")
        rank = np.empty(len(size), np.int64)
        rank[by] = np.cumsum(size[by]) - size[by]
        self.to = rank  # row of the first character of the run in sorted order
        self.window = window[self.run]
        least = np.minimum.reduceat(owners[of[order]], self.run)
        self.least = np.full(int(window.max(initial=-1)) + 1, np.iinfo(np.int64).max)
        on = self.window >= 0
        np.minimum.at(self.least, self.window[on], least[on])
        self.by_char = np.lexsort((np.arange(len(self.char)), self.char))
        self.char_key = self.char[self.by_char] * (len(self.char) + 1) + self.by_char

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many characters the suffixes at a and b share, up to `most` of each; eight bytes at a time."""
        limit = np.minimum(np.minimum(self.left[a], self.left[b]), most)
        n, live = np.zeros(len(a), np.int64), np.flatnonzero(limit > 0)
        for k in range(0, int(limit.max(initial=0)), 8):
            x = self.words[a[live] + k] ^ self.words[b[live] + k]
            same = np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)).astype(np.int64) >> 3  # bytes below the first that differs
            n[live] += same
            live = live[(same == 8) & (limit[live] > k + 8)]
            if not len(live):
                break
        return np.minimum(n, limit)

    def statistics(self, patterns: np.ndarray, sizes: np.ndarray, own: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """For each place of the patterns: length of the longest match that starts there, and the window class of its
        row (which holds if the match is as long as a window). own: the patterns are the strings of the index in order,
        so each starts at its own end mark."""
        total, ends, m = len(patterns), np.cumsum(sizes), len(sizes)
        length, found = np.zeros(total, np.int64), np.full(total, -1, np.int64)
        order = np.argsort(-sizes, kind="stable")
        row = np.arange(m) if own else np.zeros(m, np.int64)
        run = np.searchsorted(self.run, row, "right") - 1
        at = self.starts + sizes if own else np.full(m, self.first_at[0])
        match = np.zeros(m, np.int64)
        for step in range(1, int(sizes.max(initial=0)) + 1):
            live = order[: np.searchsorted(-sizes[order], -step, "right")]
            place = ends[live] - step
            c = patterns[place].astype(np.int64) + 1
            miss = np.flatnonzero(self.char[run[live]] != c)
            if len(miss):
                self._jump(live[miss], c[miss], row, at, match, run)
            r = run[live]
            ok = self.char[r] == c  # a character that the index doesn't have starts over
            row[live] = np.where(ok, self.to[r] + row[live] - self.run[r], 0)
            match[live] = np.where(ok, match[live] + 1, 0)
            at[live] = np.where(ok, at[live] - 1, self.first_at[0])
            r = np.searchsorted(self.run, row[live], "right") - 1
            run[live] = r
            length[place] = match[live]
            found[place] = self.window[r]
        return length, found

    def _jump(self, who: np.ndarray, c: np.ndarray, row: np.ndarray, at: np.ndarray, match: np.ndarray, run: np.ndarray) -> None:
        """Rows whose run has another character go to the nearest run with c: the end of one above or the start of one
        below, whichever shares more with the match so far (by the sampled places)."""
        size = len(self.char)
        k = np.searchsorted(self.char_key, c * (size + 1) + run[who])
        up, down = self.by_char[np.maximum(k - 1, 0)], self.by_char[np.minimum(k, size - 1)]
        share_up = np.where(self.char[up] == c, self.common(at[who], self.last_at[up], match[who]), -1)
        share_down = np.where(self.char[down] == c, self.common(at[who], self.first_at[down], match[who]), -1)
        above = share_up >= share_down
        run[who] = np.where(above, up, down)
        row[who] = np.where(above, self.last[up], self.run[down])
        at[who] = np.where(above, self.last_at[up], self.first_at[down])
        match[who] = np.maximum(np.maximum(share_up, share_down), 0)
