"""Best-fit packing by linear grouping.

Documents become pieces of at most ``capacity`` tokens (a longer document is cut into full pieces,
its first piece is the remainder). Only the histogram of piece lengths, at most ``capacity`` numbers,
goes to the driver. There:

1. lengths over ``capacity / SMALL`` are *large*; sorted, they are dealt into ``GROUPS`` groups of
   equal cardinality and rounded up to the largest of their group;
2. the few sizes that are left are packed by configurations: column generation (a knapsack prices
   new configurations against the dual prices), then the fractional optimum is rounded down;
3. actual lengths take the places of the rounded ones, the longest of the group first. What rounding up
   left free is given back to a configuration's last place, which takes the longest large piece that
   fits there. Steps 1 to 3 are repeated with the pieces that rounding down left over, while that fills
   configurations;
4. the last few of these and the small lengths are packed by best fit, longest first, into the room
   that the configurations leave.

Equal sequences are kept as runs, so the plan's size follows from the capacity, not from the number
of documents. Pieces of one length are told apart by a rank, made from counts by task and length, and
the plan gives each range of ranks its sequences.

Defined results: a null text is empty and gives one piece with the end id; repeated rows each have
their pieces. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkquill.llm.tokens import encoder
from sparkquill.session import stored

CAPACITY, END_ID = 1024, 2
#: Lengths up to capacity / SMALL are small; groups of large lengths.
SMALL, GROUPS = 4, 128


def _groups(counts: dict[int, int], number: int) -> list[list[tuple[int, int]]]:
    """Groups of about equal cardinality, longest first, each a list of (length, count), longest first.

    Pieces of one length stay together; a length that would fill a group is one.
    """
    least, out, held = sum(counts.values()) / number, [], 0
    if len(counts) <= number:
        least = 0
    for length in sorted(counts, reverse=True):
        if not out or held >= least or counts[length] >= least:
            out.append([])
            held = 0
        out[-1].append((length, counts[length]))
        held += counts[length]
    return out


def _configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, float]]:
    """A fractional packing of the demanded sizes: (how often each size, how many sequences)."""
    k = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    for _ in range(40 * k):
        prices = np.linalg.solve(basis.T, np.ones(k))
        # The most valuable configuration: best[w] is the value of room w, by the last size taken.
        best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for w in range(int(sizes.min()), capacity + 1):
            fits = np.flatnonzero(sizes <= w)
            value = best[w - sizes[fits]] + prices[fits]
            at = int(value.argmax())
            if value[at] > best[w - 1] + 1e-12:
                best[w], last[w] = value[at], fits[at]
            else:
                best[w] = best[w - 1]
        if best[capacity] <= 1 + 1e-7:
            break
        column, w = np.zeros(k), capacity
        while w > 0:
            if last[w] < 0 or best[w] == best[w - 1]:
                w -= 1
            else:
                column[last[w]] += 1
                w -= sizes[last[w]]
        direction, amounts = np.linalg.solve(basis, column), np.linalg.solve(basis, demand)
        ratio = np.where(direction > 1e-9, amounts / np.where(direction > 1e-9, direction, 1), np.inf)
        leaves = int(ratio.argmin())
        if not np.isfinite(ratio[leaves]):
            break
        basis[:, leaves] = column
    amounts = np.linalg.solve(basis, demand)
    return [(basis[:, j].round().astype(int), float(amounts[j])) for j in range(k) if amounts[j] > 1e-9]


class _Runs:
    """Runs of equal sequences by the room left in them."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.by_room, self.rooms = capacity, defaultdict(list), 0

    def add(self, content: tuple[int, ...], number: int, configured: bool = False) -> None:
        room = self.capacity - sum(content)
        self.by_room[room].append((content, number, configured))
        self.rooms |= 1 << room

    def best_fit(self, length: int, number: int) -> None:
        """Each piece goes where it leaves the least room; new sequences are opened when none fits."""
        while number:
            fitting = self.rooms >> length
            if not fitting:
                each = min(self.capacity // length, number)
                self.add((length,) * each, number // each)
                number -= number // each * each
                continue
            room = length + (fitting & -fitting).bit_length() - 1
            content, there, configured = self.by_room[room].pop()
            each = min(room // length, max(1, number // there))
            k = min(there, number // each)
            if there > k:
                self.by_room[room].append((content, there - k, configured))
            if not self.by_room[room]:
                self.rooms &= ~(1 << room)
            self.add(content + (length,) * each, k, configured)
            number -= k * each


class _Stock:
    """Pieces that have no place yet, by length."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.counts, self.lengths = dict(counts), 0
        for n in counts:
            self.lengths |= 1 << n

    def longest(self, most: int, taken: list[int]) -> int | None:
        """The longest length up to ``most`` of which a piece is left beside those taken."""
        there = self.lengths & (2 << most) - 1
        while there:
            n = there.bit_length() - 1
            if self.counts[n] > taken.count(n):
                return n
            there ^= 1 << n
        return None

    def take(self, content: list[int], number: int) -> None:
        for n in content:
            self.counts[n] -= number
            if not self.counts[n]:
                del self.counts[n]
                self.lengths ^= 1 << n


def _configured(stock: _Stock, runs: _Runs, groups: int) -> bool:
    """Fill configurations of grouped sizes from the stock; whether any was filled."""
    capacity, found = runs.capacity, False
    demand: dict[int, int] = defaultdict(int)  # groups of the same rounded size are one size
    for g in _groups(stock.counts, groups):
        demand[g[0][0]] += sum(c for _, c in g)
    sizes = np.array(list(demand))
    solved = _configurations(sizes, np.array(list(demand.values()), float), capacity)
    for column, amount in sorted(solved, key=lambda x: -x[1]):
        places = sorted((int(sizes[i]) for i, k in enumerate(column) for _ in range(k)), reverse=True)
        left = int(amount + 1e-6)
        while left:
            content: list[int] = []
            for k, size in enumerate(places):
                length = stock.longest(capacity - sum(content) if k == len(places) - 1 else size, content)
                if length is None:
                    break
                content.append(length)
            if len(content) < len(places):
                break
            number = min(left, *(stock.counts[n] // content.count(n) for n in content))
            stock.take(content, number)
            runs.add(tuple(content), number, True)
            left -= number
            found = True
    return found


def plan(counts: dict[int, int], capacity: int = CAPACITY, small: int = SMALL, groups: int = GROUPS) -> list[tuple[tuple[int, ...], int, bool]]:
    """Runs of sequences (the lengths in one, how many, whether a configuration) that hold all pieces of a histogram."""
    runs = _Runs(capacity)
    counts = {n: c for n, c in counts.items() if c}
    if full := counts.pop(capacity, 0):
        runs.add((capacity,), full)
    stock = _Stock({n: c for n, c in counts.items() if n * small > capacity})
    while stock.counts and _configured(stock, runs, groups):
        pass
    rest = {n: c for n, c in counts.items() if n * small <= capacity} | stock.counts
    for n in sorted(rest, reverse=True):
        runs.best_fit(n, rest[n])
    return [run for room in sorted(runs.by_room) for run in runs.by_room[room] if run[1]]


def _places(runs: list[tuple[tuple[int, ...], int, bool]]) -> dict[str, np.ndarray]:
    """For ranks of each length, in order: where a range begins, its first sequence and its offset."""
    used: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for content, number, _ in runs:
        offset = 0
        for n in content:
            out.append((n, used[n], sequence, offset))
            used[n] += number
            offset += n
        sequence += number
    cols = np.array(sorted(out), np.int64).reshape(-1, 4)
    return {"key": cols[:, 0] << 44 | cols[:, 1], "rank": cols[:, 1], "sequence": cols[:, 2], "offset": cols[:, 3]}


_CUT = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"
_PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def cut(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of all documents; ``nth`` counts the pieces of one length within a task."""

    def pieces(batches):
        task, enc = TaskContext.get().partitionId(), encoder(tokenizer)
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for first, ids, ends in enc.encode(batch.column("text"), END_ID):
                tokens = np.diff(ends)
                number = -(-tokens // capacity)
                total = int(number.sum())
                heads = np.cumsum(number) - number
                piece = np.arange(total) - np.repeat(heads, number)
                # Cuts of a document, counted from its end, are multiples of the capacity.
                start = np.maximum(np.repeat(tokens - number * capacity, number) + piece * capacity, 0)
                length = np.diff(start, append=0)
                length[heads + number - 1] = tokens - start[heads + number - 1]
                order = np.argsort(length, kind="stable")
                each = np.bincount(length, minlength=capacity + 1)
                nth = np.empty(total, np.int64)
                nth[order] = np.arange(total) - (np.cumsum(each) - each)[length[order]] + seen[length[order]]
                seen += each
                data = memoryview(ids.astype("<u4", copy=False)).cast("B")
                at = (np.repeat(ends[:-1], number) + start) * 4
                crc = [zlib.crc32(data[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)]
                owner = pa.array(np.repeat(np.arange(first, first + len(tokens)), number))
                cols = (piece.astype(np.int32), start, length, crc, np.full(total, task, np.int32), nth)
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(owner), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pieces, _CUT)


def pack(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """All pieces with the sequence each lies in and its offset there."""
    pieces = stored(cut(documents, tokenizer, capacity), "pieces")
    by_task = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    places = _places(plan(counts, capacity))
    before = by_task.select("task", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    ranked = pieces.join(before, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))

    def place(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(places["key"], length << 44 | rank, "right") - 1
            sequence = places["sequence"][at] + rank - places["rank"][at]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(sequence), pa.array(places["offset"][at])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, _PACKED)
