"""Merges of byte-pair encoding over one array of all distinct words, in numpy.

A slot holds a letter of a word, and a 0 follows each word. A token's first slot holds its number, its last one
the number with ``flag``, those between the flag; so both neighbours of a token are found from its place. Pairs
that occur ``least`` times of the present phase are tracked, with their places; a phase ends when all of them are
merged or too many new places have gathered, and then one pass counts all pairs anew. Large arrays are mapped
files in the temporary folder, so what is held in memory grows with the pairs, not with the words.
"""

from __future__ import annotations

import heapq
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np

#: Slots that places of four bytes reach.
MOST = (1 << 31) - 2
#: Slots looked at in one step of a pass, and bytes of an array that stays in memory.
STEP, HELD = 1 << 21, 8 << 20
#: New places of a phase; a phase tracks pairs down to this part of the most frequent one's count.
PLACES, PART = 1 << 24, 16
#: Kinds of pairs that a pass counts in one table; where there may be more, they are sorted.
TABLE = 1 << 22


def _array(n: int, dtype) -> np.ndarray:
    if n * np.dtype(dtype).itemsize <= HELD:
        return np.zeros(n, dtype)
    with tempfile.TemporaryFile() as out:
        return np.asarray(np.memmap(out, dtype, "w+", shape=(n,)))


def _groups(kinds: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order by kind, where each kind starts in it, the kinds, and their weights' sums."""
    order = np.argsort(kinds, kind="stable")
    own = kinds[order]
    starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
    return order, starts, own[starts], np.add.reduceat(weights[order], starts) if len(own) else np.zeros(0, np.int64)


class Learner:
    """Words as slots. ``parts`` gives (letters as bytes, each word ended by ``end``; counts; slots of each count)."""

    def __init__(self, slots: int, parts: Iterable[tuple[bytes, list[int], list[int]]], letters: list[str], end: int, tokens: int, step: int = STEP, places: int = PLACES, part: int = PART, table: int = TABLE):
        kind = np.uint16 if tokens < 1 << 15 else np.uint32
        self.dtype, self.flag = kind, 1 << (np.dtype(kind).itemsize * 8 - 1)
        self.step, self.most, self.part, self.table = step, max(places, slots // 8), part, table
        self.slots = _array(slots + 1, kind)
        self.names = ["", *letters]
        self.ids = {x: i for i, x in enumerate(self.names)}
        self.lengths = np.zeros(tokens + 1, np.int32)
        self.lengths[1 : len(self.names)] = 1
        numbers = np.arange(1, 257).astype(kind)
        numbers[end] = 0
        at, starts, counts = 1, [], []
        for blob, ns, sizes in parts:
            own = np.frombuffer(blob, np.uint8)
            self.slots[at : at + len(own)] = numbers[own]
            starts.append(at + np.r_[0, np.cumsum(sizes)[:-1]])
            counts.append(np.array(ns, np.int64))
            at += len(own)
        if at != slots + 1:
            raise ValueError("words and their counted slots differ")
        self.starts = np.concatenate(starts).astype(np.int32) if starts else np.zeros(0, np.int32)
        self.counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)

    def _times(self, at: np.ndarray) -> np.ndarray:
        """How often the words at these places occur."""
        return self.counts[np.searchsorted(self.starts, at.astype(np.int32, copy=False), "right") - 1]

    def _pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places of all neighbours, their keys (of both numbers, to the base of all tokens) and their words' counts, step by step."""
        before_at, before, base = 0, 0, len(self.names)
        for i in range(0, len(self.slots), self.step):
            own = self.slots[i : i + self.step]
            at = np.flatnonzero(own < self.flag)
            if not len(at):
                continue
            token = own[at].astype(np.int64)
            at = np.r_[before_at, at + i]
            token = np.r_[before, token]
            low, high = at[0], at[-1]
            before_at, before = at[-1], token[-1]
            both = np.flatnonzero((token[:-1] != 0) & (token[1:] != 0))
            if not len(both):
                continue
            first, last = np.searchsorted(self.starts, [low, high], "right") - 1
            edges = np.clip(self.starts[max(first, 0) : last + 1], low, high)
            edges[0] = low
            times = np.repeat(self.counts[max(first, 0) : last + 1], np.diff(np.r_[edges, high]))
            at = at[both]
            yield at.astype(np.int32), token[both] * base + token[both + 1], times[at - low]

    def _counted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys of all pairs, rising, how often they occur, and their places."""
        kinds = len(self.names) ** 2
        if kinds <= self.table:
            sums, sizes = np.zeros(kinds, np.int64), np.zeros(kinds, np.int64)
            for _, own, times in self._pairs():
                np.add.at(sums, own, times)
                sizes += np.bincount(own, minlength=kinds)
            keys = np.flatnonzero(sizes)
            return keys, sums[keys], sizes[keys]
        keys, sums, sizes = (np.zeros(0, np.int64) for _ in range(3))
        for _, own, times in self._pairs():
            order, starts, kinds, n = _groups(own, times)
            size = np.diff(np.r_[starts, len(order)])
            both = np.r_[keys, kinds]
            order, starts, keys, n = _groups(both, np.r_[sums, n])
            sizes = np.add.reduceat(np.r_[sizes, size][order], starts) if len(order) else sizes
            sums = n
        return keys, sums, sizes

    def _phase(self, least: int) -> bool:
        """Count all pairs and track the frequent ones; whether there are any."""
        keys, sums, sizes = self._counted()
        self.heap, self.n, self.at, self.new = [], {}, {}, 0
        top = int(sums.max(initial=0))
        if top < least:
            return False
        self.least = max(least, top // self.part)
        some = sums >= self.least
        keys, sums, sizes = keys[some], sums[some], sizes[some]
        base = len(self.names)
        number = np.uint16 if len(keys) < 1 << 16 else np.int32  # two bytes are sorted by their value, without comparing
        rank = None
        if base**2 <= self.table:
            rank = np.full(base**2, -1, np.int32)
            rank[keys] = np.arange(len(keys))
        ends = np.cumsum(sizes)
        filled = ends - sizes
        places = _array(int(ends[-1]), np.int32)
        for at, own, _ in self._pairs():
            if rank is None:
                which = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                there = np.flatnonzero(keys[which] == own)
            else:
                which = rank[own]
                there = np.flatnonzero(which >= 0)
            which = which[there].astype(number)
            order = np.argsort(which, kind="stable")
            size = np.bincount(which, minlength=len(keys))
            to = np.repeat(filled - np.cumsum(size) + size, size) + np.arange(len(order))
            places[to] = at[there[order]]
            filled += size
        keys = keys // base << 32 | keys % base
        for key, n, size, end in zip(keys.tolist(), sums.tolist(), sizes.tolist(), ends.tolist(), strict=True):
            self._track(key, n, places[end - size : end])
        self.new = 0
        return True

    def _track(self, key: int, n: int, at: np.ndarray) -> None:
        self.n[key], self.at[key] = n, at
        self.new += len(at)
        heapq.heappush(self.heap, (-n, self.names[key >> 32], self.names[key & 0xFFFFFFFF], key))

    def _made(self, kinds: np.ndarray, at: np.ndarray, times: np.ndarray, key, known: bool = False) -> None:
        """Track the new pairs of a token and these neighbours; of a known token, correct those that are too rare."""
        order, starts, own, n = _groups(kinds, times)
        ends = np.r_[starts[1:], len(order)]
        for g in np.flatnonzero(n >= self.least).tolist():
            self._track(key(int(own[g])), int(n[g]), at[order[starts[g] : ends[g]]])
        if known:
            for g in np.flatnonzero(n < self.least).tolist():
                if key(int(own[g])) in self.n:
                    self.n[key(int(own[g]))] = int(n[g])

    def _gone(self, kinds: np.ndarray, times: np.ndarray, key) -> None:
        _, _, own, n = _groups(kinds, times)
        for x, d in zip(own.tolist(), n.tolist(), strict=True):
            if (k := key(x)) in self.n:
                self.n[k] -= d

    def _merge(self, key: int) -> None:
        a, b, slots, mask = key >> 32, key & 0xFFFFFFFF, self.slots, self.flag - 1
        la, lb = int(self.lengths[a]), int(self.lengths[b])
        name = self.names[a] + self.names[b]
        known = name in self.ids  # by another cut; one string is one token
        if not known:
            self.ids[name] = len(self.names)
            self.names.append(name)
        c = self.ids[name]
        self.lengths[c] = la + lb
        at = self.at.pop(key)
        at = at[slots[at] == a]
        at = at[slots[at + la] == b]
        if a == b and len(at) > 1:  # of a run, each second one from its first
            first = np.r_[True, np.diff(at) != la]
            place = np.arange(len(at))
            at = at[(place - np.maximum.accumulate(np.where(first, place, 0))) % 2 == 0]
        after = at + (la + lb)
        left, right, times = slots[at - 1] & self.dtype(mask), slots[after], self._times(at)
        joined = np.r_[after[:-1] == at[1:], False] if len(at) else np.zeros(0, bool)
        has_left, has_right = left != 0, (right != 0) & ~joined
        if lb > 1:
            slots[at + la] = self.flag
        slots[after - 1] = c | self.flag
        slots[at] = c
        self._gone(left[has_left], times[has_left], lambda x: x << 32 | a)
        self._gone(right[has_right], times[has_right], lambda x: b << 32 | x)
        self.n.pop(key)
        if known:
            self._again(c)
            return
        if joined.any():
            left = np.where(np.r_[False, joined[:-1]], self.dtype(c), left)
        own = left[has_left]
        self._made(own, at[has_left] - self.lengths[own], times[has_left], lambda x: x << 32 | c)
        self._made(right[has_right], at[has_right], times[has_right], lambda x: c << 32 | x)

    def _again(self, c: int) -> None:
        """Count the pairs of a token that was there before by a pass over the slots."""
        found = [np.flatnonzero(self.slots[i : i + 8 * self.step] == c) + i for i in range(0, len(self.slots), 8 * self.step)]
        at = np.concatenate(found).astype(np.int32)
        left, right, times = self.slots[at - 1] & self.dtype(self.flag - 1), self.slots[at + int(self.lengths[c])], self._times(at)
        one, other = left != 0, (right != 0) & (right != c)
        self._made(left[one], at[one] - self.lengths[left[one]], times[one], lambda x: x << 32 | c, True)
        self._made(right[other], at[other], times[other], lambda x: c << 32 | x, True)

    def learn(self, merges: int, least: int) -> list[tuple[str, str]]:
        """The merges in order: the most frequent pair each time, of equal ones the first by its two strings."""
        found: list[tuple[str, str]] = []
        while len(found) < merges and self._phase(least):
            while self.heap and len(found) < merges and self.new <= self.most:
                n, a, b, key = heapq.heappop(self.heap)
                now = self.n.get(key, 0)
                if now != -n:  # an older count
                    if self.least <= now < -n:
                        heapq.heappush(self.heap, (-now, a, b, key))
                    continue
                found.append((a, b))
                self._merge(key)
        return found
