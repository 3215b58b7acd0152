"""Codecs over independent streams: one document, one coder, all documents in parallel.

The probability model is a count model of the previous characters (see ``operators.model``). It is
small (its size is checked) and goes to the tasks whole; texts are coded where they lie, so no
per-token relation is shuffled. Encoder and decoder read the same integer intervals.
"""

from __future__ import annotations

import bisect
import bz2
import gzip
import hashlib
import io
import lzma
import zipfile
import zlib
from dataclasses import dataclass
from time import perf_counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkquill.functions import bits, coder, containers, huffman, lanes
from sparkquill.operators import model as md
from sparkquill.operators import tokens as tk
from sparkquill.session import spread, stored

#: Rows of a model that may be sent to the tasks; where there would be more, a lower order is taken.
MODEL_ROWS = 2_000_000


@dataclass
class CharModel:
    """Integer intervals by context: sorted dense ids and where each begins, over a sorted alphabet."""

    alphabet: list[str]
    order: int
    total: int
    table: dict[str, tuple[list[int], list[int], list[int]]]  # ids, lows, frequencies

    def __post_init__(self) -> None:
        self.index = {c: i for i, c in enumerate(self.alphabet)}

    def context(self, text: str, at: int) -> str:
        return text[max(0, at - self.order) : at]

    def interval(self, ctx: str, token: str) -> tuple[int, int]:
        """Seen tokens have their own width, unseen ones a unit each; an unseen context is uniform."""
        d = self.index[token]
        if ctx not in self.table:
            size = len(self.alphabet)
            wide, more = divmod(self.total, size)
            lo = d * wide + min(d, more)
            return lo, lo + wide + (d < more)
        ids, lows, freqs = self.table[ctx]
        k = bisect.bisect_left(ids, d)
        if k < len(ids) and ids[k] == d:
            return lows[k], lows[k] + freqs[k]
        lo = d if k == 0 else lows[k - 1] + freqs[k - 1] + d - ids[k - 1] - 1
        return lo, lo + 1

    def token(self, ctx: str, slot: int) -> str:
        """The token whose interval holds a unit."""
        if ctx not in self.table:
            size = len(self.alphabet)
            wide, more = divmod(self.total, size)
            edge = more * (wide + 1)
            return self.alphabet[slot // (wide + 1) if slot < edge else more + (slot - edge) // wide]
        ids, lows, freqs = self.table[ctx]
        k = bisect.bisect_right(lows, slot) - 1
        if k < 0:
            return self.alphabet[slot]
        if slot < lows[k] + freqs[k]:
            return self.alphabet[ids[k]]
        return self.alphabet[ids[k] + 1 + slot - lows[k] - freqs[k]]

    def ranks(self, ctx: str) -> tuple[list[int], dict[int, int]]:
        """Dense ids from the most to the least likely (ties by id), and each one's rank."""
        if not hasattr(self, "_ranks"):
            self._ranks: dict = {}
        if ctx not in self._ranks:
            seen = dict(zip(*(self.table[ctx][i] for i in (0, 2)), strict=True)) if ctx in self.table else {}
            order = sorted(range(len(self.alphabet)), key=lambda d: (-seen.get(d, 0), d))
            self._ranks[ctx] = order, {d: r for r, d in enumerate(order)}
        return self._ranks[ctx]


#: Code points, the vocabulary of an open model.
CODE_POINTS = 0x110000


class Intervals:
    """A model's intervals as arrays, for many symbols at a time.

    A context is a number: its characters' dense ids from 1 on, as digits; rows of the table are sorted by it and
    dense id. ``points`` are the code points of the dense ids, or None if a dense id is its code point.
    """

    def __init__(self, order: int, total: int, points: np.ndarray | None, contexts: np.ndarray, ids: np.ndarray, lows: np.ndarray, freqs: np.ndarray) -> None:
        self.order, self.total, self.points = order, total, points
        self.size = CODE_POINTS if points is None else len(points)
        self.base = self.size + 1
        if self.base**order * 1.0 > 2.0**62:
            raise ValueError("contexts of that order have no 62-bit number")
        by = np.lexsort((ids, contexts))
        self.codes, first = np.unique(contexts[by], return_index=True)
        self.first = np.append(first, len(by))
        self.ids, self.lows, self.freqs = ids[by], lows[by], freqs[by]
        row = np.repeat(np.arange(len(self.codes)), np.diff(self.first))
        self.by_id, self.by_low = row * self.size + self.ids, row * total + self.lows
        self.sorter = None if points is None else np.argsort(points)

    def symbols(self, text: str) -> np.ndarray:
        """Dense ids of a text's characters; one that the vocabulary lacks is an error."""
        points = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
        if self.points is None:
            return points
        at = np.minimum(np.searchsorted(self.points, points, sorter=self.sorter), self.size - 1)
        found = self.sorter[at]
        if (self.points[found] != points).any():
            raise ValueError("a character that the vocabulary lacks")
        return found

    def text(self, symbols: np.ndarray) -> str:
        points = symbols if self.points is None else self.points[symbols]
        return points.astype("<u4").tobytes().decode("utf-32-le")

    def contexts(self, symbols: np.ndarray) -> np.ndarray:
        """The context of each position of a stream."""
        out = np.zeros(len(symbols), np.int64)
        for k in range(1, self.order + 1):
            out[k:] += (symbols[: len(symbols) - k] + 1) * self.base ** (k - 1)
        return out

    def following(self, context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        return (context * self.base + symbol + 1) % self.base**self.order if self.order else context

    def _rows(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.codes):
            return np.zeros(len(context), np.int64), np.zeros(len(context), bool)
        row = np.minimum(np.searchsorted(self.codes, context), len(self.codes) - 1)
        return row, self.codes[row] == context

    def interval(self, context: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Seen symbols have their own width, unseen ones a unit each; an unseen context is uniform."""
        wide, more = divmod(self.total, self.size)
        low, high = symbol * wide + np.minimum(symbol, more), wide + (symbol < more)
        row, seen = self._rows(context)
        if seen.any():
            k = np.searchsorted(self.by_id, row * self.size + symbol, "right") - 1
            inside = k >= self.first[row]
            own = inside & (self.ids[k] == symbol)
            after = np.where(inside, self.lows[k] + self.freqs[k] - self.ids[k] - 1, 0) + symbol
            low = np.where(seen, np.where(own, self.lows[k], after), low)
            high = np.where(seen, np.where(own, self.freqs[k], 1), high)
        return low, low + high

    def find(self, context: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The symbols whose intervals hold units, and these intervals."""
        wide, more = divmod(self.total, self.size)
        edge = more * (wide + 1)
        symbol = np.where(slot < edge, slot // (wide + 1), more + (slot - edge) // max(1, wide))
        row, seen = self._rows(context)
        if seen.any():
            k = np.searchsorted(self.by_low, row * self.total + slot, "right") - 1
            inside = k >= self.first[row]
            beyond = slot - self.lows[k] - self.freqs[k]
            found = np.where(inside, np.where(beyond < 0, self.ids[k], self.ids[k] + 1 + beyond), slot)
            symbol = np.where(seen, found, symbol)
        return symbol, *self.interval(context, symbol)

    def find_one(self, context: int, slot: int) -> tuple[int, int, int]:
        """``find`` for plain numbers."""
        if not hasattr(self, "_by_code"):
            self._by_code = {int(c): (int(a), int(b)) for c, a, b in zip(self.codes, self.first[:-1], self.first[1:], strict=True)}
            self._lists: dict[int, tuple[list[int], list[int], list[int]]] = {}
        if context not in self._by_code:
            wide, more = divmod(self.total, self.size)
            edge = more * (wide + 1)
            d = slot // (wide + 1) if slot < edge else more + (slot - edge) // wide
            lo = d * wide + min(d, more)
            return d, lo, lo + wide + (d < more)
        if context not in self._lists:
            a, b = self._by_code[context]
            self._lists[context] = (self.ids[a:b].tolist(), self.lows[a:b].tolist(), self.freqs[a:b].tolist())
        ids, lows, freqs = self._lists[context]
        k = bisect.bisect_right(lows, slot) - 1
        if k < 0:
            return slot, slot, slot + 1
        beyond = slot - lows[k] - freqs[k]
        if beyond < 0:
            return ids[k], lows[k], lows[k] + freqs[k]
        return ids[k] + 1 + beyond, slot, slot + 1

    def following_one(self, context: int, symbol: int) -> int:
        return (context * self.base + symbol + 1) % self.base**self.order if self.order else context

    def _ranked(self) -> None:
        row = np.repeat(np.arange(len(self.codes)), np.diff(self.first))
        at = np.arange(len(row)) - self.first[row]
        order = np.lexsort((self.ids, -self.freqs, row))
        self._rank = np.empty(len(row), np.int64)
        self._rank[order] = at
        self._by_rank = self.ids[order]
        self._gaps = row * self.size + self.ids - at  # unseen symbols before each seen one

    def ranks(self, context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """How many symbols are likelier in the context, ties by dense id."""
        if not hasattr(self, "_rank"):
            self._ranked()
        row, seen = self._rows(context)
        if not seen.any():
            return symbol
        k = np.searchsorted(self.by_id, row * self.size + symbol, "right") - 1
        own = (k >= self.first[row]) & (self.ids[k] == symbol)
        later = self.first[row + 1] + symbol - (k + 1)
        return np.where(seen, np.where(own, self._rank[k], later), symbol)

    def ranked(self, context: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The symbols of given ranks."""
        if not hasattr(self, "_rank"):
            self._ranked()
        row, seen = self._rows(context)
        if not seen.any():
            return rank
        known = self.first[row + 1] - self.first[row]
        likely = self._by_rank[np.minimum(self.first[row] + rank, len(self._by_rank) - 1)]
        m = np.maximum(rank - known, 0)
        unseen = m + np.searchsorted(self._gaps, row * self.size + m, "right") - self.first[row]
        return np.where(seen, np.where(rank < known, likely, unseen), rank)

    def unranked(self, streams: list[np.ndarray]) -> list[np.ndarray]:
        """The symbols of streams of ranks, a step of all streams at a time."""
        sizes = np.array([len(x) for x in streams], np.int64)
        order = np.argsort(-sizes, kind="stable")
        out = [np.empty(n, np.int64) for n in sizes.tolist()]
        flat = np.concatenate([np.empty(0, np.int64), *(streams[i] for i in order)])
        starts, sizes = np.cumsum(sizes[order]) - sizes[order], sizes[order]
        back, context, step = np.empty_like(flat), np.zeros(len(order), np.int64), 0
        while active := int(np.searchsorted(-sizes, -step, "left")):
            at = starts[:active] + step
            back[at] = symbol = self.ranked(context[:active], flat[at])
            context[:active] = self.following(context[:active], symbol)
            step += 1
        for lane, i in enumerate(order.tolist()):
            out[i] = back[starts[lane] : starts[lane] + sizes[lane]]
        return out


def _counted(docs: DataFrame, order: int) -> DataFrame:
    return stored(md.counts(tk.with_context(docs, tk.characters(F.col("text")), order=order)), "codec-counts")


def _table(docs: DataFrame, order: int, total: int, rows: int, vocabulary):
    """(order, vocabulary, sorted rows) at the highest order whose table has at most ``rows`` rows.

    Without context a table has a row for each character of Unicode at most, which every limit here allows.
    """
    for k in range(order, -1, -1):
        counted = _counted(docs, k)
        if k and counted.count() > rows:
            continue
        words, size = vocabulary(counted)
        got = md.intervals(md.frequencies(counted, size, total), words).select("ctx", "dense_id", "cum_lo", "freq").toArrow()
        return k, words, got


def fit(docs: DataFrame, order: int = 1, total: int = md.TOTAL, rows: int = MODEL_ROWS) -> CharModel:
    """A character model of all texts, of a lower order where the table would have over ``rows`` rows."""

    def vocabulary(counted):
        words = stored(tk.vocabulary(counted), "codec-vocabulary")
        return words, max(1, words.count())

    order, words, got = _table(docs, order, total, rows, vocabulary)
    table: dict[str, list] = {}
    for ctx, d, lo, f in sorted(zip(*(c.to_pylist() for c in got.columns), strict=True)):
        ids, lows, freqs = table.setdefault(ctx, ([], [], []))
        ids.append(d)
        lows.append(lo)
        freqs.append(f)
    return CharModel([r["token"] for r in words.orderBy("dense_id").collect()], order, total, table)


def intervals_of(model: CharModel) -> Intervals:
    """A model's table as arrays."""
    points = np.array([ord(c) for c in model.alphabet], np.int64)
    base = len(model.alphabet) + 1
    code = {ctx: sum((model.index[c] + 1) * base**k for k, c in enumerate(reversed(ctx))) for ctx in model.table}
    flat = [np.concatenate([np.empty(0, np.int64), *(np.array(model.table[c][i], np.int64) for c in code)]) for i in range(3)]
    contexts = np.repeat(np.array(list(code.values()), np.int64), [len(model.table[c][0]) for c in code])
    return Intervals(model.order, model.total, points, contexts, *flat)


def fit_open(docs: DataFrame, order: int = 1, total: int = 1 << 26, rows: int = MODEL_ROWS) -> Intervals:
    """A model of all texts over every character there is, so that any other text can be coded with it."""
    order, _, got = _table(docs, order, total, rows, lambda counted: (counted.select("token").distinct().select("token", F.ascii("token").alias("dense_id")), CODE_POINTS))
    base = CODE_POINTS + 1
    contexts = [sum((ord(c) + 1) * base**k for k, c in enumerate(reversed(ctx))) for ctx in got.column("ctx").to_pylist()]
    return Intervals(order, total, None, np.array(contexts, np.int64), *(got.column(c).to_numpy().astype(np.int64) for c in ("dense_id", "cum_lo", "freq")))


def encode_text(model: CharModel, text: str) -> list[int]:
    c = coder.Encoder()
    for i, token in enumerate(text):
        c.put(*model.interval(model.context(text, i), token), model.total)
    return c.finished()


def decode_text(model: CharModel, payload, count: int) -> str:
    c, out = coder.Decoder(payload), ""
    parts: list[str] = []
    for _ in range(count):
        slot = c.slot(model.total)
        token = model.token(out, slot)
        c.take(*model.interval(out, token), model.total)
        parts.append(token)
        out = (out + token)[-model.order :] if model.order else ""
    return "".join(parts)


def _mapped(rows: DataFrame, columns: list[str], schema: str, function):
    """Rows through a per-row Python function in Arrow batches."""

    def run(batches):
        for batch in batches:
            got = [function(*row) for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True)]
            yield pa.RecordBatch.from_pylist(got, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return spread(rows.select(*columns)).mapInArrow(run, schema)


#: Symbols of streams that are coded together, but for one longer stream.
LANE_SYMBOLS = 1_500_000


def _runs(sizes: list[int]):
    """Ranges of streams of bounded size together."""
    first, total = 0, 0
    for k, n in enumerate(sizes):
        if k > first and total + n > LANE_SYMBOLS:
            yield range(first, k)
            first, total = k, 0
        total += n
    if sizes:
        yield range(first, len(sizes))


def _sent(df: DataFrame, model: CharModel | Intervals):
    """The model's arrays, broadcast; its rows are bounded."""
    return df.sparkSession.sparkContext.broadcast(intervals_of(model) if isinstance(model, CharModel) else model)


def arithmetic(docs: DataFrame, model: CharModel | Intervals) -> DataFrame:
    """(doc_id, n_tokens, payload, payload_bits): each text's arithmetic code."""
    sent = _sent(docs, model)

    def run(batches):
        own = sent.value
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            for part in _runs([len(x) for x in texts]):
                symbols = [own.symbols(texts[i]) for i in part]
                flat = np.concatenate([np.empty(0, np.int64), *symbols])
                low, high = own.interval(np.concatenate([np.empty(0, np.int64), *map(own.contexts, symbols)]), flat)
                cuts = np.cumsum([len(x) for x in symbols])[:-1]
                codes = lanes.encode(np.split(low, cuts), np.split(high, cuts), own.total)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(part.start, len(part)), pa.array([len(x) for x in symbols], pa.int64()), pa.array([x for x, _ in codes], pa.binary()), pa.array([n for _, n in codes], pa.int64())], ["doc_id", "n_tokens", "payload", "payload_bits"])

    return spread(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, n_tokens long, payload binary, payload_bits long")


def texts_of(streams: DataFrame, model: CharModel | Intervals) -> DataFrame:
    """(doc_id, text) of what the payloads decode to."""
    sent = _sent(streams, model)

    def run(batches):
        own = sent.value
        for batch in batches:
            doc_ids, counts, payloads, sizes = (batch.column(i) for i in range(4))
            counts, payloads, sizes = counts.to_pylist(), payloads.to_pylist(), sizes.to_pylist()
            for part in _runs(counts):
                back = lanes.decode([(payloads[i], sizes[i]) for i in part], [counts[i] for i in part], own.total, own.find, own.following, single=(own.find_one, own.following_one))
                yield pa.RecordBatch.from_arrays([doc_ids.slice(part.start, len(part)), pa.array([own.text(x) for x in back], pa.string())], ["doc_id", "text"])

    return spread(streams.select("doc_id", "n_tokens", "payload", "payload_bits")).mapInArrow(run, "doc_id long, text string")


def arithmetic_decoded(streams: DataFrame, model: CharModel | Intervals) -> DataFrame:
    """(doc_id, sha256, n_tokens) of what the payloads decode to."""
    return texts_of(streams, model).select("doc_id", F.sha2("text", 256).alias("sha256"), F.length("text").cast("bigint").alias("n_tokens"))


def rank_stream(model: CharModel, text: str) -> list[int]:
    return [model.ranks(model.context(text, i))[1][model.index[t]] for i, t in enumerate(text)]


def unranked(model: CharModel, ranks) -> str:
    out: list[str] = []
    for r in ranks:
        ctx = "".join(out[-model.order :]) if model.order else ""
        out.append(model.alphabet[model.ranks(ctx)[0][r]])
    return "".join(out)


def rank_codes(docs: DataFrame, model: CharModel) -> DataFrame:
    """Per document the sizes of its rank stream in each rank codec, and whether each decodes to it.

    Bit packing uses the width of the greatest rank, Huffman its own code book, zstd 32-bit ranks.
    """
    sent = _sent(docs, model)

    def run(batches):
        import zstandard

        own = sent.value
        squeeze, expand = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), [x or "" for x in batch.column(1).to_pylist()]
            for part in _runs([len(x) for x in texts]):
                streams, packs, rows = [], [], []
                for i in part:
                    symbols = own.symbols(texts[i])
                    streams.append(own.ranks(own.contexts(symbols), symbols))
                    width = max(1, int(streams[-1].max(initial=0)).bit_length())
                    packs.append((width, bits.pack_fixed(streams[-1], width)))
                backs = own.unranked([bits.unpack_fixed(data, width, len(x)) for (width, data), x in zip(packs, streams, strict=True)])
                for i, ranks, (width, _), symbols in zip(part, streams, packs, backs, strict=True):
                    listed = ranks.tolist()
                    book = huffman.codebook(listed)
                    code = huffman.encode(listed, book)
                    small = squeeze.compress(ranks.astype("<u4").tobytes())
                    exact = huffman.decode(code, book) == listed and expand.decompress(small, max_output_size=4 * len(ranks)) == ranks.astype("<u4").tobytes()
                    text = own.text(symbols)
                    rows.append({"doc_id": doc_ids[i], "n_tokens": len(ranks), "max_rank": int(ranks.max(initial=0)), "sum_rank": int(ranks.sum()), "packed_bits": width * len(ranks), "huffman_bits": len(code), "codebook_bits": sum(map(len, book.values())), "zstd_bytes": len(small), "sha256": hashlib.sha256(text.encode()).hexdigest(), "lossless": exact and text == texts[i]})
                yield pa.RecordBatch.from_pylist(rows, schema=_RANK_ARROW)

    return spread(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, n_tokens long, max_rank long, sum_rank long, packed_bits long, huffman_bits long, codebook_bits long, zstd_bytes long, sha256 string, lossless boolean")


_RANK_ARROW = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_tokens", "max_rank", "sum_rank", "packed_bits", "huffman_bits", "codebook_bits", "zstd_bytes")), ("sha256", pa.string()), ("lossless", pa.bool_())])


#: The rank and arithmetic codecs by the names that results use.
ENCODINGS = {"arithmetic": arithmetic, "ranks": rank_codes, "huffman": rank_codes, "zstd": rank_codes}


def coded(docs: DataFrame, model: CharModel, encoding: str) -> DataFrame:
    """Streams under a named encoding; an unknown name is an error."""
    if encoding not in ENCODINGS:
        raise ValueError(f"unknown encoding {encoding}: one of {', '.join(sorted(ENCODINGS))}")
    return ENCODINGS[encoding](docs, model)


def containers_of(docs: DataFrame, model: CharModel, name: str = "characters") -> DataFrame:
    """Per document of two characters at least its stream containers' sizes, and what reading them gives back.

    Streams are encoded, put into containers, parsed, decoded and compared by length and digest.
    """
    sent = _sent(docs, model)

    def run(batches):
        own = sent.value
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for part in _runs([len(x) for x in texts]):
                data = [texts[i].encode() for i in part]
                symbols = [own.symbols(texts[i]) for i in part]
                spans = [own.interval(own.contexts(x)[1:], x[1:]) for x in symbols]
                codes = lanes.encode([a for a, _ in spans], [b for _, b in spans], own.total)
                streams = [containers.write_stream(*code, d, name, [int(x[0])], len(x), np.unique(x).tolist(), frequency_total=own.total) for code, d, x in zip(codes, data, symbols, strict=True)]
                parsed = [containers.read_stream(x) for x in streams]
                seeds = [m["seed_token_ids"][0] for m, _, _ in parsed]
                begin = own.following(np.zeros(len(seeds), np.int64), np.array(seeds, np.int64)).tolist()
                backs = lanes.decode([(p, n) for _, p, n in parsed], [m["token_count"] - 1 for m, _, _ in parsed], own.total, own.find, own.following, begin, (own.find_one, own.following_one))
                rows = []
                for i, d, x, code, stream, (meta, _, _), seed, back in zip(part, data, symbols, codes, streams, parsed, seeds, backs, strict=True):
                    whole = own.text(np.concatenate(([seed], back)))
                    packed = containers.write_ids(x, own.size, len(d))
                    again, raw = containers.read_ids(packed)
                    short = containers.write_predictive(*code, seed, 1, len(x), len(d))
                    predicted = containers.read_predictive(short)
                    ok = containers.verify(meta, whole.encode()) and again == x.tolist() and raw == len(d) and (predicted["payload"], predicted["payload_bits"]) == code
                    rows.append({"doc_id": doc_ids[i], "sha256": hashlib.sha256(whole.encode()).hexdigest(), "n_tokens": len(x), "id_stream_bytes": len(packed), "frame_bytes": len(short) - len(code[0]), "verified": ok, "stream_bytes": len(stream)})
                yield pa.RecordBatch.from_pylist(rows, schema=_CONTAINER_ARROW)

    return spread(docs.where(F.length("text") > 1).select("doc_id", "text")).mapInArrow(run, "doc_id long, sha256 string, n_tokens long, id_stream_bytes long, frame_bytes long, verified boolean, stream_bytes long")


_CONTAINER_ARROW = pa.schema([("doc_id", pa.int64()), ("sha256", pa.string()), ("n_tokens", pa.int64()), ("id_stream_bytes", pa.int64()), ("frame_bytes", pa.int64()), ("verified", pa.bool_()), ("stream_bytes", pa.int64())])

#: Lanes of a global file.
FILE_LANES = 4


def _layout(n: int, number: int) -> np.ndarray:
    """The positions of a stream's tokens, step by step over its contiguous lanes; the first ones are the seeds."""
    sizes = n // number + (np.arange(number) < n % number)
    starts = np.cumsum(sizes) - sizes
    step = np.arange(sizes.max(initial=0))[:, None]
    return (starts + step)[step < sizes]


def global_files(docs: DataFrame, model: CharModel) -> DataFrame:
    """(doc_id, content): each text as one file: header, a seed for each lane, one code for all lanes, vocabulary bitmap."""
    sent = _sent(docs, model)

    def run(batches):
        own = sent.value
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            for part in _runs([len(x) for x in texts]):
                out, heads, lows, highs = [], [], [], []
                for i in part:
                    x = own.symbols(texts[i])
                    number = min(FILE_LANES, len(x))
                    at = _layout(len(x), number)
                    coded, former = x[at[number:]], x[at[number:] - 1]
                    low, high = own.interval(own.following(np.zeros(len(former), np.int64), former), coded)
                    mask = np.zeros(-(-own.size // 8) * 8, np.uint8)
                    mask[x] = 1
                    heads.append(({"tokens": len(x), "total": own.total}, x[at[:number]].tolist(), np.packbits(mask).tobytes()))
                    lows.append(low)
                    highs.append(high)
                for (head, seeds, mask), code in zip(heads, lanes.encode(lows, highs, own.total), strict=True):
                    out.append(containers.write_global(head, seeds, *code, mask))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(part.start, len(part)), pa.array(out, pa.binary())], ["doc_id", "content"])

    return spread(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, content binary")


def global_texts(files: DataFrame, model: CharModel) -> DataFrame:
    """(doc_id, text, n_used): what global files hold; n_used counts the bitmap's tokens."""
    sent = _sent(files, model)

    def run(batches):
        own = sent.value
        for batch in batches:
            read = [containers.read_global(x) for x in batch.column("content").to_pylist()]
            sizes = [head["tokens"] for head, *_ in read]
            for part in _runs(sizes):
                mine = [read[i] for i in part]
                counts = np.array([sizes[i] - len(mine[k][1]) for k, i in enumerate(part)], np.int64)
                order = np.argsort(-counts, kind="stable")
                # The last context of each lane; all streams are at the same step and so in the same lane.
                last = np.zeros((len(mine), FILE_LANES), np.int64)
                for row, k in enumerate(order.tolist()):
                    seeds = np.array(mine[k][1], np.int64)
                    last[row, : len(seeds)] = own.following(np.zeros(len(seeds), np.int64), seeds)
                step = 0

                def find(context, slot, last=last):
                    return own.find(last[: len(context), step % FILE_LANES], slot)

                def after(context, symbol, last=last):
                    nonlocal step
                    last[: len(context), step % FILE_LANES] = own.following(np.zeros(len(symbol), np.int64), symbol)
                    step += 1
                    return context

                backs = lanes.decode([(p, n) for _, _, p, n, _ in mine], counts.tolist(), own.total, find, after)
                texts, used = [], []
                for i, (_, seeds, _, _, mask), back in zip(part, mine, backs, strict=True):
                    x = np.empty(sizes[i], np.int64)
                    x[_layout(sizes[i], len(seeds))] = np.concatenate((np.array(seeds, np.int64), back))
                    texts.append(own.text(x))
                    used.append(int(np.unpackbits(np.frombuffer(mask, np.uint8)).sum()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(part.start, len(part)), pa.array(texts, pa.string()), pa.array(used, pa.int64())], ["doc_id", "text", "n_used"])

    return files.select("doc_id", "content").mapInArrow(run, "doc_id long, text string, n_used long")


def _zip(data: bytes) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo("data"), data)
    return out.getvalue()


def _xz(data: bytes) -> bytes:
    """Preset 6 with a dictionary no larger than the data can use, which gives the same code for less memory."""
    size = min(8 << 20, max(4096, 1 << max(0, len(data) - 1).bit_length()))
    return lzma.compress(data, filters=[{"id": lzma.FILTER_LZMA2, "preset": 6, "dict_size": size}])


def general_codecs() -> dict:
    """Name to (compress, decompress); contexts are made once and used again."""
    import zstandard

    fast, best, back = zstandard.ZstdCompressor(level=3), zstandard.ZstdCompressor(level=22), zstandard.ZstdDecompressor()
    return {
        "gzip-9": (lambda x: gzip.compress(x, 9, mtime=0), gzip.decompress),
        "zip": (_zip, lambda x: zipfile.ZipFile(io.BytesIO(x)).read("data")),
        "zlib-1": (lambda x: zlib.compress(x, 1), zlib.decompress),
        "zstd-3": (fast.compress, back.decompress),
        "zstd-22": (best.compress, back.decompress),
        "bz2-9": (lambda x: bz2.compress(x, 9), bz2.decompress),
        "xz-6": (_xz, lzma.decompress),
    }


def speeds(measured: DataFrame, *keys: str) -> DataFrame:
    """(keys, raw, ratio, kb_s, back_kb_s, exact) of measured compressors: sizes by size, kilobytes of 1,024 by second."""
    out = measured.groupBy(*keys).agg(F.sum("raw").alias("raw"), F.sum("compressed").alias("compressed"), F.sum("compress_s").alias("s"), F.sum("decompress_s").alias("back"), F.bool_and("exact").alias("exact"))
    return out.select(*keys, "raw", F.try_divide("compressed", "raw").alias("ratio"), F.try_divide(F.col("raw") / 1024, "s").alias("kb_s"), F.try_divide(F.col("raw") / 1024, "back").alias("back_kb_s"), "exact")


def byte_codecs(docs: DataFrame) -> DataFrame:
    """(doc_id, codec, raw, compressed, exact, compress_s, decompress_s): general-purpose compressors on the same bytes."""

    def run(batches):
        pairs = general_codecs()
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = (text or "").encode()
                for name, (squeeze, back) in pairs.items():
                    begun = perf_counter()
                    small = squeeze(data)
                    half = perf_counter()
                    exact = back(small) == data
                    out.append((doc_id, name, len(data), len(small), exact, half - begun, perf_counter() - half))
            cols = zip(*out, strict=True) if out else [[]] * 7
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "codec", "raw", "compressed", "exact", "compress_s", "decompress_s"])

    return spread(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, codec string, raw long, compressed long, exact boolean, compress_s double, decompress_s double")
