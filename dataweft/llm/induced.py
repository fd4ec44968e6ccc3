"""Suffix array and common prefixes of one shard by external induced sorting.

The queues of the induction are priority queues over (leading symbol, order of arrival): what is induced from the suffixes in
order arrives in order, so a queue per symbol that keeps its arrivals in sequence pops tuples in their final order. A tuple is a
suffix and its common prefix with the tuple before it. A queue holds its latest arrivals in memory; once all queues
hold more than ``MEMORY`` tuples, they are appended to the queue's scratch file, which lives as long as the task's
sort. Tuples of one symbol that are ready together are taken in one step.

The suffixes that start where symbols turn from falling to rising are named by the stretch up to the next one. The names are
sorted by a first induction, and the reduced string of names by the next level of the recursion, until it fits
``BASE`` symbols, where doubling of ranks sorts it. Common prefixes count up to ``depth``; suffixes that agree so far may
stand in either order.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

#: Suffixes up to which they are handed on one by one.
FEW = 6
#: Tuples that all queues of a sort keep in memory, and symbols of a reduced string that is sorted by doubling.
MEMORY, BASE = 1 << 22, 1 << 22
TUPLE = np.dtype([("at", np.int64), ("lcp", np.int32)])


class Queues:
    """One first-in-first-out queue of (suffix, common prefix) for every symbol."""

    def __init__(self, symbols: int, folder: str):
        self.new: list[list[np.ndarray]] = [[] for _ in range(symbols)]
        self.files: dict[int, object] = {}
        self.read = np.zeros(symbols, np.int64)  # tuples of the file that were taken
        self.size = np.zeros(symbols, np.int64)
        self.held, self.folder = 0, folder

    def put(self, symbol: int, at: np.ndarray, lcp: np.ndarray) -> None:
        rows = np.empty(len(at), TUPLE)
        rows["at"], rows["lcp"] = at, lcp
        self.new[symbol].append(rows)
        self.size[symbol] += len(at)
        self.held += len(at)
        if self.held > MEMORY:
            self.spill()

    def spill(self) -> None:
        for s, parts in enumerate(self.new):
            if parts:
                if s not in self.files:
                    self.files[s] = tempfile.TemporaryFile(dir=self.folder)
                self.files[s].seek(0, 2)
                for p in parts:
                    p.tofile(self.files[s])
                self.new[s] = []
        self.held = 0

    def take(self, symbol: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All tuples that arrived since the last take, in parts, those in the file first."""
        file = self.files.get(symbol)
        if file is not None:
            file.seek(self.read[symbol] * TUPLE.itemsize)
            while len(rows := np.fromfile(file, TUPLE, 1 << 20)):
                self.read[symbol] += len(rows)
                yield rows["at"].copy(), rows["lcp"].copy()
        parts, self.new[symbol] = self.new[symbol], []
        for rows in parts:
            self.held -= len(rows)
            yield rows["at"].copy(), rows["lcp"].copy()

    def close(self) -> None:
        for f in self.files.values():
            f.close()


def falling(t: np.ndarray) -> np.ndarray:
    """True for suffixes larger than the one after them; the last one counts as such."""
    n = len(t)
    turn = np.ones(n, bool)  # where the next symbol differs
    turn[:-1] = t[:-1] != t[1:]
    last = np.minimum.accumulate(np.where(turn, np.arange(n), n)[::-1])[::-1]
    after = np.append(t, -1)[last + 1]
    return after < t[last]


def runs(t: np.ndarray, at: np.ndarray, most: int) -> np.ndarray:
    """How often the first symbol of a suffix repeats at its start, up to ``most``."""
    out = np.ones(len(at), np.int64)
    open_ = np.arange(len(at))
    for k in range(1, most):
        open_ = open_[at[open_] + k < len(t)]
        open_ = open_[t[at[open_] + k] == t[at[open_]]]
        if not len(open_):
            break
        out[open_] += 1
    return out


class _Scan:
    """Hands the suffixes before those scanned to their queues, with common prefixes, for one leading symbol at a time."""

    def __init__(self, t: np.ndarray, wanted: np.ndarray, queues: Queues, depth: int):
        self.queues, self.depth = queues, depth
        self.none = 255 if t.dtype == np.uint8 else -1  # symbols stay below
        self.before = np.full(len(t), self.none, t.dtype)  # the symbol before each suffix, where that suffix is wanted
        self.before[1:] = np.where(wanted[:-1], t[:-1], self.none)
        self.least = np.zeros(len(queues.size), np.int64)

    def begin(self) -> None:
        self.least[:] = 0  # suffixes of other leading symbols have nothing in common with those to come

    def feed(self, at: np.ndarray, lcp: np.ndarray) -> None:
        """``lcp``: with the suffix scanned before; not looked at where the depth is 0."""
        if not len(at):
            return
        if len(at) <= FEW and self.depth:
            return self._feed_few(at.tolist(), lcp.tolist())
        to = self.before[at]
        use = np.flatnonzero(to != self.none)
        to = to[use]
        order = np.argsort(to, kind="stable")
        to, use = to[order], use[order]
        ends = np.flatnonzero(to[1:] != to[:-1]).tolist() + [len(to)] if len(to) else []
        start, put = 0, self.queues.put
        previous = at[use] - 1
        if self.depth == 0:
            for k, end in enumerate(ends):
                end += k < len(ends) - 1
                part = previous[start:end]
                put(int(to[start]), part, np.zeros(len(part), np.int32))
                start = end
            return
        left = np.minimum(self.least, int(lcp.min()))
        size, least, depth, last = self.queues.size, self.least, self.depth, len(at)
        for k, end in enumerate(ends):
            end += k < len(ends) - 1
            s, spot = int(to[start]), use[start:end]
            cuts = np.empty(len(spot) + 1, np.int64)
            cuts[0] = 0
            np.add(spot, 1, out=cuts[1:])
            more = cuts[-1] < last
            low = np.minimum.reduceat(lcp, cuts if more else cuts[:-1])
            left[s] = low[-1] if more else depth
            got = low[: len(spot)] + 1
            got[0] = min(int(low[0]), int(least[s])) + 1 if size[s] else 0
            np.minimum(got, depth, out=got)
            put(s, previous[start:end], got)
            start = end
        self.least = left

    def _feed_few(self, at: list[int], lcp: list[int]) -> None:
        """The same one by one, which is faster for a handful."""
        least, size, depth, none = self.least, self.queues.size, self.depth, self.none
        for i, common_ in zip(at, lcp, strict=True):
            np.minimum(least, common_, out=least)
            s = int(self.before[i])
            if s != none:
                got = min(int(least[s]) + 1, depth) if size[s] else 0
                self.queues.put(s, np.array([i - 1]), np.array([got]))
                least[s] = depth


def _meet(t: np.ndarray, a: int | None, b: int | None, depth: int) -> int:
    """Common prefix of a falling and a rising suffix of one symbol: their shorter run of it."""
    return 0 if a is None or b is None or depth == 0 else int(min(runs(t, np.array([a, b]), depth)))


def induce(t: np.ndarray, fall: np.ndarray, turns: np.ndarray, turn_lcp: np.ndarray, symbols: int, depth: int, folder: str) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in order and their common prefixes, from the sorted turning ones (and theirs)."""
    down, up = Queues(symbols, folder), Queues(symbols, folder)
    first = t[turns]
    edge = np.searchsorted(first, np.arange(symbols + 1))
    scan = _Scan(t, fall, down, depth)
    down.put(int(t[-1]), np.array([len(t) - 1]), np.zeros(1, np.int64))  # nothing follows it, so it is the least of its symbol
    fallen: list[tuple[np.ndarray, np.ndarray]] = []
    for c in range(symbols):
        scan.begin()
        got: list[tuple[np.ndarray, np.ndarray]] = []
        while batch := list(down.take(c)):
            for at, lcp in batch:
                got.append((at, lcp))
                scan.feed(at, lcp)
        a, b = edge[c], edge[c + 1]
        if a < b:
            lcp = turn_lcp[a:b].copy()
            lcp[0] = _meet(t, int(got[-1][0][-1]) if got else None, int(turns[a]), depth)
            scan.feed(turns[a:b], lcp)
        fallen.append((np.concatenate([x for x, _ in got]), np.concatenate([x for _, x in got])) if got else (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    down.close()
    scan = _Scan(t, ~fall, up, depth)
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    for c in range(symbols - 1, -1, -1):
        scan.begin()
        got = []
        while batch := list(up.take(c)):
            for at, lcp in batch:
                got.append((at, lcp))
                scan.feed(at, lcp)
        at, lcp = fallen[c]
        fallen[c] = (at[:0], lcp[:0])
        rise = (np.concatenate([x for x, _ in got]), np.concatenate([x for _, x in got])) if got else (at[:0], lcp[:0])
        between = _meet(t, int(at[-1]) if len(at) else None, int(rise[0][-1]) if len(rise[0]) else None, depth)
        if len(at):
            scan.feed(at[::-1], np.concatenate(([between], lcp[1:][::-1])))
        # Rising suffixes came largest first, each with what it shares with the next larger one.
        rising_lcp = np.concatenate(([between], rise[1][1:][::-1])) if len(rise[0]) else rise[1]
        parts.append((np.concatenate((at, rise[0][::-1])), np.concatenate((lcp, rising_lcp))))
    up.close()
    parts.reverse()
    return np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])


def doubling(names: np.ndarray, steps: int) -> np.ndarray:
    """Order of the suffixes of a short string over names, by as many doublings of the rank as are asked for.

    A rank is the first place of its group in the order; only groups of several suffixes are sorted again.
    """
    n, h = len(names), 1
    order = np.argsort(names, kind="stable")
    first = np.ones(n, bool)
    first[1:] = names[order][1:] != names[order][:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    for _ in range(steps):
        slots = np.flatnonzero(~(first & np.append(first[1:], True)))
        if not len(slots):
            break
        at = order[slots]
        after = np.where(at + h < n, rank[np.minimum(at + h, n - 1)] + 1, 0)
        key = rank[at] * (n + 1) + after
        by = np.argsort(key, kind="stable")
        key = key[by]
        order[slots] = at[by]
        change = np.ones(len(slots), bool)
        change[1:] = key[1:] != key[:-1]
        first[slots] = change
        rank[order[slots]] = np.maximum.accumulate(np.where(change, slots, 0))
        h *= 2
    return order


def common(t: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Common prefixes of pairs of suffixes, up to ``depth``; byte strings go eight symbols at a time."""
    out = np.zeros(len(a), np.int64)
    open_ = np.arange(len(a))
    if t.dtype == np.uint8:
        padded = np.concatenate((t, np.zeros(depth + 16, np.uint8)))
        word = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)).view("<u8").ravel()
        while len(open_):
            apart = word[a[open_] + out[open_]] ^ word[b[open_] + out[open_]]
            same = apart == 0
            low = apart[~same] & (~apart[~same] + np.uint64(1))  # the lowest bit that differs
            out[open_[~same]] += (np.log2(low.astype(np.float64)) // 8).astype(np.int64)
            open_ = open_[same]
            out[open_] += 8
            open_ = open_[out[open_] < depth]
    else:
        padded = np.concatenate((t, np.full(depth + 1, -1, t.dtype)))
        while len(open_):
            open_ = open_[padded[a[open_] + out[open_]] == padded[b[open_] + out[open_]]]
            out[open_] += 1
            open_ = open_[out[open_] < depth]
    return np.minimum(np.minimum(out, depth), len(t) - np.maximum(a, b))


def suffix_array(t: np.ndarray, symbols: int, depth: int, folder: str) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, common prefix of each with the one before) of a string over 0..symbols-1."""
    n = len(t)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    fall = falling(t)
    turns = np.flatnonzero(~fall[1:] & fall[:-1]) + 1
    if len(turns):
        order = _sorted_turns(t, fall, turns, symbols, depth, folder)
        lcp = np.zeros(len(order), np.int32)
        lcp[1:] = common(t, order[:-1], order[1:], depth)
    else:
        order, lcp = turns, turns.astype(np.int32)
    return induce(t, fall, order, lcp, symbols, depth, folder)


def _sorted_turns(t: np.ndarray, fall: np.ndarray, turns: np.ndarray, symbols: int, depth: int, folder: str) -> np.ndarray:
    """The turning suffixes in order, through their names."""
    by_first = turns[np.argsort(t[turns], kind="stable")]
    rough, _ = induce(t, fall, by_first, np.zeros(len(turns), np.int32), symbols, 0, folder)
    turning = np.zeros(len(t), bool)
    turning[turns] = True
    rough = rough[turning[rough]]
    # Stretches up to and including the next turn; equal ones are neighbours now.
    stretch = np.zeros(len(t), np.int64)
    stretch[turns] = np.append(turns[1:], len(t) - 1) - turns + 1
    length = stretch[rough]
    power = np.full(len(t) + 1, 0x9E3779B97F4A7C15, np.uint64)
    power[0] = 1
    power = np.cumprod(power)
    total = np.zeros(len(t) + 1, np.uint64)
    np.cumsum((t.astype(np.uint64) + np.uint64(1)) * power[:-1], out=total[1:])
    mark = (total[rough + length] - total[rough]) * power[len(t) - rough]
    new = np.ones(len(rough), bool)
    new[1:] = (mark[1:] != mark[:-1]) | (length[1:] != length[:-1])
    new |= rough == turns[-1]  # the last stretch ends with the string and equals no other
    name = np.zeros(len(t), np.int64)
    ids = np.cumsum(new) - 1
    after_last = np.flatnonzero(rough == turns[-1])[0] + 1
    if after_last < len(rough) and not new[after_last]:
        ids[after_last:] += 1
    name[rough] = ids
    reduced = name[turns]
    if len(np.unique(reduced)) == len(reduced):
        return turns[np.argsort(reduced)]
    # A turn comes every other symbol at most, so half the depth in names is enough.
    if len(reduced) <= BASE:
        return turns[doubling(reduced, int(np.ceil(np.log2(max(2, depth / 2 + 2)))))]
    return turns[suffix_array(reduced, int(reduced.max()) + 1, depth, folder)[0]]
