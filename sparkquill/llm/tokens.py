"""Whole-text encoding with the ``tokenizers`` library, by distinct chunk.

The public tokenizers split a text before any merge: before white space that follows other signs, after
a lone line end, and between Latin letters, digits and punctuation (apostrophes apart, which contractions
need; letters of U+00C0 to U+00FF count, all other signs beyond ASCII stay with their neighbours). A text's ids
are therefore the concatenated ids of its chunks. The chunks of a batch are cut out of its bytes with
numpy, made distinct by Arrow, and only those that the worker's bounded table lacks go to the library;
the ids of all texts are then one gather.

Tokenizers of another build are recognised when they are loaded, and encode every text whole. So are, under
any tokenizer, texts with unusual white space, where chunks could depend on their neighbours, and texts
that hold an added token's content: it is that token there, as in the library's plain encode.
"""

from __future__ import annotations

import json
import os
import re
import string
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa

from sparkquill.llm.tables import keep_only

#: Entries of a worker's table, which begins anew beyond them, and the bytes of the longest chunk it keeps.
CACHE_ENTRIES, CACHE_CHUNK = 1_000_000, 64
#: Bytes of texts that are encoded together.
BATCH_BYTES = 4 << 20
#: Chunks that the library encodes as one text.
_JOINED = 200

_SPACE, _LETTER, _DIGIT, _SIGN, _OTHER = range(5)


def _kinds() -> np.ndarray:
    kind = np.full(256, _OTHER, np.uint8)
    for chars, k in ((" \t\n\r\x0b\x0c", _SPACE), (string.ascii_letters, _LETTER), (string.digits, _DIGIT), (string.punctuation.replace("'", ""), _SIGN)):
        kind[list(chars.encode())] = k
    return kind


_KIND = _kinds()
#: By the kinds of two neighbours, as 8 * former + latter: does a chunk begin at the latter?
_CHANGES = np.array([a != b and (b == _SPACE or (_OTHER not in (a, b) and a != _SPACE)) for a in range(8) for b in range(8)])
_WORDS = np.array([a != b and b != _SPACE and (a == _SPACE or _OTHER not in (a, b)) for a in range(8) for b in range(8)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_UNUSUAL = re.compile("[\0\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Bytes that unusual white space may hold.
_SUSPECT = np.zeros(256, bool)
_SUSPECT[[0, 11, 12, 28, 29, 30, 31, 0xC2, 0xE1, 0xE2, 0xE3]] = True

#: What the two recognised builds have before their model.
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
_WORD_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_WORD_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]


def _build(spec: dict) -> str | None:
    """``spaced`` (white space is part of pieces), ``words`` (it is dropped, letters are lower-cased) or None."""
    before, normal, model = spec["pre_tokenizer"], spec["normalizer"], spec["model"]
    if model["type"] != "BPE" or model.get("dropout") or spec["truncation"] or spec["padding"]:
        return None
    if normal is None and before == _BYTE_LEVEL:
        return "spaced"
    if normal == {"type": "Sequence", "normalizers": _WORD_NORMAL} and before == {"type": "Sequence", "pretokenizers": [_WORD_SPLIT, _BYTE_LEVEL | {"use_regex": False}]}:
        return "words"
    return None


def _ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The positions of all ranges, one after another."""
    end = np.cumsum(length, dtype=np.int64)
    return np.repeat(start - end + length, length) + np.arange(end[-1] if len(end) else 0)


class Encoder:
    """Ids of whole texts, as arrays of unsigned 32-bit integers."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.build = _build(json.load(f))
        added = self.tokenizer.get_added_tokens_decoder().values()
        # Tokens sought in the normalised text may be met in other spellings: their first signs, or all texts.
        self.marks = tuple({(t.content if not t.normalized else re.match("[^A-Za-z]*", t.content)[0]).encode() for t in added})
        vocabulary = self.tokenizer.get_vocab()
        # What tells joined chunks apart: a line end's own id, or ids that end words.
        self.between = "\n" if self.build == "spaced" else " "
        suffix = self.tokenizer.model.end_of_word_suffix or "\0"
        apart = set(self.whole(["\n"])[0].tolist()) if self.build == "spaced" else {k for x, k in vocabulary.items() if x.endswith(suffix)}
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[list(apart)] = True
        self._clear()

    def _clear(self) -> None:
        self.table: dict[bytes, int] = {}
        self.used = 0
        self.ids = np.empty(1 << 16, np.uint32)
        self.start, self.length = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int32)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        """Without chunks."""
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _one_piece(self, chunk: str) -> bool:
        """Whether a chunk is surely one piece before merges, also among others."""
        body = chunk[1:] if chunk[0] == " " else chunk
        return body.isalpha() and (body.isascii() or max(body) < "\u0250") or self.build == "spaced" and body.isascii() and body.isdecimal()

    def _encoded(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and ids of chunks. Those of one piece are encoded many at once, told apart by pieces' ends."""
        single = [k for k, x in enumerate(chunks) if self._one_piece(x)]
        groups = [single[i : i + _JOINED] for i in range(0, len(single), _JOINED)]
        lengths, parts, order = np.zeros(len(chunks), np.int64), [], []
        alone = np.ones(len(chunks), bool)
        for group, ids in zip(groups, self.whole([self.between.join(chunks[k] for k in g) for g in groups]), strict=True):
            ends = np.flatnonzero(self.ends[ids])
            if self.build == "spaced":  # the sign between is a piece by itself
                counts, ids = np.diff(ends, prepend=-1, append=len(ids)) - 1, np.delete(ids, ends)
            else:
                counts = np.diff(ends, prepend=-1)
            if len(counts) == len(group) and counts.sum() == len(ids):
                lengths[group] = counts
                alone[group] = False
                parts.append(ids)
                order.extend(group)
        rest = np.flatnonzero(alone).tolist()
        for k, ids in zip(rest, self.whole([chunks[k] for k in rest]), strict=True):
            lengths[k] = len(ids)
            parts.append(ids)
        order = np.array(order + rest, np.int64)
        flat = np.concatenate(parts) if parts else np.empty(0, np.uint32)
        start = np.empty(len(chunks), np.int64)
        start[order] = np.cumsum(lengths[order]) - lengths[order]
        return lengths, flat[_ragged(start, lengths)]

    def _add(self, chunks: list[bytes]) -> np.ndarray:
        """Places in the table's arrays for new chunks."""
        lengths, ids = self._encoded([x.decode() for x in chunks])
        first = len(self.table)
        n, end = first + len(chunks), self.used + len(ids)
        if n > len(self.start):
            self.start, self.length = np.resize(self.start, 2 * n), np.resize(self.length, 2 * n)
        if end > len(self.ids):
            self.ids = np.resize(self.ids, 2 * end)
        self.ids[self.used : end] = ids
        self.length[first:n] = lengths
        self.start[first:n] = self.used + np.cumsum(lengths) - lengths
        # Long chunks come last and are forgotten: their places are given anew with the next batch.
        keep = next((k for k, x in enumerate(chunks) if len(x) > CACHE_CHUNK), len(chunks))
        self.table.update(zip(chunks[:keep], range(first, first + keep), strict=True))
        self.used += int(lengths[:keep].sum())
        return np.arange(first, n)

    def _chunks(self, data: np.ndarray, bounds: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """All chunks of texts that lie in ``data`` at ``bounds``, and how many lie before each text."""
        kind = _KIND[data]
        latin = np.flatnonzero(data[:-1] == 0xC3)
        latin = latin[~np.isin(data[latin + 1], (0x97, 0xB7))]
        kind[latin] = kind[latin + 1] = _LETTER
        begins = np.empty(len(data), bool)
        begins[1:] = (_CHANGES if self.build == "spaced" else _WORDS)[kind[:-1] << 3 | kind[1:]]
        if self.build == "spaced":
            blank = kind == _SPACE
            begins[2:] |= blank[1:-1] & (data[1:-1] != 32) & ~blank[:-2] & ~blank[2:]
        heads = bounds[:-1][np.diff(bounds) > 0]
        begins[heads] = True if self.build == "spaced" else kind[heads] != _SPACE
        at = np.flatnonzero(begins)
        before = np.searchsorted(at, bounds)
        if self.build == "words":
            solid = kind != _SPACE
            at = np.cumsum(solid)[at] - 1
            data = _LOWER[data[solid]]
        offsets = np.append(at, len(data)).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)]), before

    def _batch(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(self.table) > CACHE_ENTRIES:
            self._clear()
        chunks, before = self._chunks(data, bounds)
        if not len(chunks):
            return np.empty(0, np.uint32), np.zeros(len(bounds), np.int64)
        chunks = chunks.dictionary_encode()
        words = chunks.dictionary.to_pylist()
        place = np.fromiter(map(self.table.get, words, repeat(-1)), np.int64, len(words))
        if (new := np.flatnonzero(place < 0)).size:
            size = np.diff(np.frombuffer(chunks.dictionary.buffers()[1], np.int32, len(words) + 1))[new]
            new = np.concatenate((new[size <= CACHE_CHUNK], new[size > CACHE_CHUNK]))
            place[new] = self._add([words[k] for k in new.tolist()])
        place = place[chunks.indices.to_numpy()]
        length = self.length[place]
        ends = np.concatenate(([0], np.cumsum(length)))
        return self.ids[_ragged(self.start[place], length)], ends[before]

    def _special(self, data: np.ndarray, bounds: np.ndarray) -> list[int]:
        """Texts that must be encoded whole."""
        raw, found = data.tobytes(), set()
        for mark in self.marks:
            at = raw.find(mark)
            while at >= 0 and len(raw):
                k = int(np.searchsorted(bounds, at, "right")) - 1
                found.add(k)
                at = raw.find(mark, int(bounds[k + 1])) if bounds[k + 1] < len(raw) else -1
        if self.build == "spaced":
            for k in np.unique(np.searchsorted(bounds, np.flatnonzero(_SUSPECT[data]), "right") - 1).tolist():
                if _UNUSUAL.search(raw[bounds[k] : bounds[k + 1]].decode()):
                    found.add(k)
        return sorted(found)

    def _cut(self, data: np.ndarray, at: int) -> int:
        """The first place from ``at`` on where a chunk begins, or the end."""
        size = 4096
        while at < len(data):
            kind = _KIND[data[at - 1 : at + size]]
            begins = np.flatnonzero((_CHANGES if self.build == "spaced" else _WORDS)[kind[:-1] << 3 | kind[1:]])
            if len(begins):
                return at + int(begins[0])
            at, size = at + size, 2 * size
        return len(data)

    def _encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(bounds) - 1
        special = list(range(n)) if self.build is None else self._special(data, bounds)
        if not special and n == 1 and len(data) > 2 * BATCH_BYTES:
            # One long text, in parts that end where chunks do.
            cuts = [0]
            while cuts[-1] < len(data):
                cuts.append(self._cut(data, min(cuts[-1] + BATCH_BYTES, len(data))))
            parts = [self._batch(data[a:b], np.array([0, b - a]))[0] for a, b in zip(cuts, cuts[1:], strict=False)]
            ids = np.concatenate(parts)
            return ids, np.array([0, len(ids)])
        if not special:
            return self._batch(data, bounds)
        # Runs of other texts are encoded by chunks, each special text by itself.
        parts, counts, at = [], np.zeros(n, np.int64), 0
        for k in [*special, n]:
            if at < k:
                ids, ends = self._batch(data[bounds[at] : bounds[k]], bounds[at : k + 1] - bounds[at])
                parts.append(ids)
                counts[at:k] = np.diff(ends)
            if k < n:
                parts += self.whole([data[bounds[k] : bounds[k + 1]].tobytes().decode()])
                counts[k] = len(parts[-1])
            at = k + 1
        return np.concatenate(parts), np.concatenate(([0], np.cumsum(counts)))

    def encode(self, texts: pa.Array, end_id: int | None = None):
        """Runs of texts in order, each as (first text, all ids, where each text's ids start and end).

        A null text is empty. ``end_id`` ends each text. Runs are bounded by ``BATCH_BYTES``, but texts are whole.
        """
        texts = texts.cast(pa.large_string()).fill_null("")
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8) if n else np.zeros(1, np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8) if n and offsets[-1] else np.empty(0, np.uint8)
        first = 0
        while first < n:
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BATCH_BYTES, "right")) - 1)
            bounds = offsets[first : last + 1]
            ids, ends = self._encode(data[bounds[0] : bounds[-1]], bounds - bounds[0])
            if end_id is not None:
                ids, ends = np.insert(ids, ends[1:], np.uint32(end_id)), ends + np.arange(len(ends))
            yield first, ids, ends
            first = last


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(1)
def _encoder(path: str) -> Encoder:
    return Encoder(path if os.path.sep in path else vocabulary(path))


def encoder(path: str) -> Encoder:
    """One for each worker process. ``path`` is a file, or a name of the public tokenizers package."""
    keep_only("tokens", _encoder.cache_clear)
    return _encoder(path)
