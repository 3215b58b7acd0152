"""Byte-level byte-pair encoding: merges learned from word counts, applied to distinct words.

Words are strings of letters that stand for their UTF-8 bytes (printing bytes for themselves, the others from
256 on), so the alphabet has 256 letters and no text is unknown. Learning touches the corpus once, to count
words. A table of at most ``WORDS`` distinct words and 2^31 bytes goes to the driver a partition at a time, where
pair counts are kept up to date merge by merge (``functions.merges``); beyond that each merge is an aggregation
over the table, whose lineage is cut by a written table every few merges. Both give the same merges: ties go to
the pair that sorts first.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkquill.functions.merges import MOST, Learner
from sparkquill.operators.tokens import byte_array
from sparkquill.session import discard, spread, stored

#: Distinct words that the driver may hold, in files of its temporary folder: some 6 bytes a letter.
WORDS = 1 << 27
#: Bytes of texts whose words are counted at once, and distinct words that a check of texts keeps.
BATCH, KNOWN = 32 << 20, 200_000
#: Tokens beside the bytes and merges of a vocabulary.
SPECIAL = ("[UNK]",)
_OPEN, _CLOSE, _END = "\x02", "\x03", "\n"


def _letters() -> list[str]:
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(prints)]
    return [chr(b) if b in prints else chr(256 + others.index(b)) for b in range(256)]


LETTERS = _letters()
_BYTES = {x: b for b, x in enumerate(LETTERS)}


def lettered(word: str) -> str:
    """A word as letters of its bytes."""
    return "".join([LETTERS[b] for b in word.encode()])


def unlettered(pieces: list[str]) -> str:
    """The text of pieces."""
    return bytes([_BYTES[x] for p in pieces for x in p]).decode()


def _slices(texts: pa.Array, most: int) -> Iterator[pa.Array]:
    """Slices of texts of so many bytes at most, or of one text."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + most, "right")))
        yield texts.slice(i, j - i)
        i = j


def _text_words(texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """All words of texts between runs of ASCII white space, and the first one of each text that has any."""
    split = pc.ascii_split_whitespace(texts.drop_null())
    words, ends = split.flatten(), np.asarray(split.offsets, np.int64) - split.offsets[0].as_py()
    full = pc.not_equal(words, "")
    some = full.to_numpy(zero_copy_only=False)
    if not some.all():  # empty ones before the first word and after the last
        words, ends = words.filter(full), np.r_[0, np.cumsum(some)][ends]
    return words, words.take(pa.array(ends[:-1][np.diff(ends) > 0]))


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over all documents; each word but a document's first begins with a space.

    White space is that of ``\\s`` in Java's patterns. Words are counted where texts lie, before they are dealt out.
    """

    def count(batches):
        for batch in batches:
            for texts in _slices(batch.column(0), BATCH):
                every, first = _text_words(texts)
                of = dict(zip(*(pc.value_counts(first).field(k).to_pylist() for k in (0, 1)), strict=True))
                found = pc.value_counts(every)
                words, n = found.field(0), found.field(1).to_numpy(zero_copy_only=False).copy()
                if of:
                    names = pa.array(list(of), words.type)
                    n[pc.index_in(names, words).to_numpy(zero_copy_only=False)] -= list(of.values())
                    later = pa.array(n > 0)
                    marked = pc.binary_join_element_wise("", words.filter(later), " ")
                    yield pa.RecordBatch.from_arrays([pa.concat_arrays([marked, names]), pa.array(np.r_[n[n > 0], list(of.values())], pa.int64())], ["word", "n"])

    return docs.select(text).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _packed(counted: DataFrame) -> DataFrame:
    """(letters, counts, slots): each batch's words by falling count, ended by a line end, which no word holds."""

    def pack(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column(1).to_numpy(zero_copy_only=False)
            order = np.argsort(-n, kind="stable")
            words, n = batch.column(0).cast(pa.string()).take(pa.array(order)), n[order]
            ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
            out = np.full(ends[-1] - ends[0] + len(words), ord(_END), np.uint8)
            stops = ends[1:] - ends[0] + np.arange(len(words))
            inside = np.ones(len(out), bool)
            inside[stops] = False
            out[inside] = np.frombuffer(words.buffers()[2], np.uint8)[ends[0] : ends[-1]]
            last = np.flatnonzero(np.r_[n[1:] != n[:-1], True])
            sizes = np.diff(np.r_[-1, stops[last]])
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary()), pa.array([n[last]], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64()))], ["letters", "counts", "slots"])

    return counted.select("word", "n").mapInArrow(pack, "letters binary, counts array<long>, slots array<long>")


def _learn_here(counted: DataFrame, slots: int, merges: int, least: int, **how: int) -> list[tuple[str, str]]:
    """Words reach the driver a partition at a time."""
    parts = ((bytes(r["letters"]), r["counts"], r["slots"]) for r in _packed(counted).toLocalIterator(prefetchPartitions=True))
    return Learner(slots, parts, LETTERS, ord(_END), len(LETTERS) + merges, **how).learn(merges, least)


def _parts(word: Column) -> Column:
    """A word's letters, each between two signs that no letter is: merging is one string replacement."""
    named = F.array(*(F.lit(_OPEN + x + _CLOSE) for x in LETTERS))
    return F.array_join(F.transform(byte_array(word), lambda b: F.get(named, b)), "")


def _learn_apart(counted: DataFrame, merges: int, least: int, keep_every: int) -> list[tuple[str, str]]:
    words = stored(counted.select("n", _parts(F.col("word")).alias("parts")), "bpe")
    kept, found = words, []
    for k in range(merges):
        split = F.split(F.expr("substring(parts, 2, length(parts) - 2)"), f"{_CLOSE}{_OPEN}")
        pairs = words.select("n", split.alias("p")).where(F.size("p") > 1).select("n", F.explode(F.arrays_zip(F.slice("p", F.lit(1), F.size("p") - 1).alias("a"), F.slice("p", F.lit(2), F.size("p") - 1).alias("b"))).alias("p"))
        best = pairs.groupBy("p.a", "p.b").agg(F.sum("n").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "a", "b").first()
        if best is None:
            break
        a, b = best["a"], best["b"]
        found.append((a, b))
        words = words.withColumn("parts", F.replace("parts", F.lit(f"{_OPEN}{a}{_CLOSE}{_OPEN}{b}{_CLOSE}"), F.lit(f"{_OPEN}{a}{b}{_CLOSE}")))
        if k % keep_every == keep_every - 1:
            words = stored(words, "bpe")
            discard(kept)
            kept = words
    return found


def learn(docs: DataFrame, vocabulary: int = 32_000, least: int = 2, words: int = WORDS, keep_every: int = 8) -> list[tuple[str, str]]:
    """The merges of a vocabulary, in order; they end early when no pair occurs ``least`` times."""
    return learn_counted(stored(word_counts(docs), "bpe-words"), vocabulary, least, words, keep_every)


def learn_counted(counted: DataFrame, vocabulary: int = 32_000, least: int = 2, words: int = WORDS, keep_every: int = 8) -> list[tuple[str, str]]:
    """As ``learn``, from a stored table (word, n)."""
    merges = vocabulary - len(LETTERS) - len(SPECIAL)
    if merges < 0:
        raise ValueError("a vocabulary holds the bytes and the special tokens at least")
    size = counted.agg(F.count(F.lit(1)).alias("words"), F.sum(F.octet_length("word") + 1).alias("slots")).first()
    if size["words"] > words or (size["slots"] or 0) > MOST:
        return _learn_apart(counted, merges, least, keep_every)
    return _learn_here(counted, size["slots"] or 0, merges, least)


def encode_word(word: str, ranks: dict[tuple[str, str], int]) -> list[str]:
    """Merge the earliest learned pair until none is left; long words take no longer by letter than short ones."""
    parts: list[str | None] = list(lettered(word))
    after = list(range(1, len(parts) + 1))
    before = list(range(-1, len(parts) - 1))
    heap = [(ranks[pair], i, *pair) for i, pair in enumerate(zip(parts, parts[1:], strict=False)) if pair in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i] if parts[i] is not None else len(parts)
        if parts[i] != a or j >= len(parts) or parts[j] != b:
            continue
        parts[i], parts[j] = a + b, None
        after[i] = after[j]
        if after[j] < len(parts):
            before[after[j]] = i
        for x, y in ((before[i], i), (i, after[i])):
            if x >= 0 and y < len(parts) and (pair := (parts[x], parts[y])) in ranks:
                heapq.heappush(heap, (ranks[pair], x, *pair))
    return [x for x in parts if x is not None]


def encode(words: DataFrame, merges: list[tuple[str, str]], *kept: str) -> DataFrame:
    """(word, kept, pieces) of distinct words; the merges are a bounded list."""
    ranks = {pair: i for i, pair in enumerate(merges)}
    sent = words.sparkSession.sparkContext.broadcast(ranks)
    own = words.select("word", *kept)

    def apply(batches):
        ranks = sent.value
        for batch in batches:
            pieces = [encode_word(w, ranks) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pieces, pa.list_(pa.string()))], ["word", *kept, "pieces"])

    return own.mapInArrow(apply, T.StructType([*own.schema.fields, T.StructField("pieces", T.ArrayType(T.StringType()))]))


def _known_word(word: str, ranks: dict[tuple[str, str], int], known: dict[str, list[str]]) -> list[str]:
    """A word's pieces, from a bounded table if they are there."""
    pieces = known.get(word)
    if pieces is None:
        pieces = encode_word(word, ranks)
        if len(word) <= 256:
            if len(known) >= KNOWN:
                known.clear()
            known[word] = pieces
    return pieces


def canonical_words(text: str, pieces: list[str], ranks: dict[tuple[str, str], int], known: dict[str, list[str]]) -> bool | None:
    """Whether pieces are those of their text, by its words alone; None where pieces do not keep to words.

    Encoding never joins words, so pieces that end where words end are canonical if each word's are.
    """
    at, same = 0, True
    for k, w in enumerate(text.split()):
        want = _known_word(" " * (k > 0) + w, ranks, known)
        if pieces[at : at + len(want)] == want:
            at += len(want)
            continue
        whole, start, size = "".join(want), at, 0
        while at < len(pieces) and size < len(whole):
            size += len(pieces[at])
            at += 1
        if "".join(pieces[start:at]) != whole:
            return None
        same = False
    return same and at == len(pieces)


def encode_text(text: str, ranks: dict[tuple[str, str], int], known: dict[str, list[str]] | None = None) -> list[str]:
    known = {} if known is None else known
    return [p for k, w in enumerate(text.split()) for p in _known_word(" " * (k > 0) + w, ranks, known)]


def round_trips(docs: DataFrame, key: str, merges: list[tuple[str, str]]) -> DataFrame:
    """(key, n_pieces, local, whole, changed_local, changed_whole): the word-wise check of a text's pieces and the full one.

    ``changed`` is of the pieces with the first that can be cut in two; a word-wise check that cannot tell falls
    back to the full one.
    """
    sent = docs.sparkSession.sparkContext.broadcast({pair: i for i, pair in enumerate(merges)})

    def run(batches):
        ranks, known = sent.value, {}
        for batch in batches:
            rows = []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = text or ""
                pieces = encode_text(text, ranks, known)
                cut = next((i for i, p in enumerate(pieces) if len(p) > 1), None)
                changed = pieces if cut is None else [*pieces[:cut], pieces[cut][0], pieces[cut][1:], *pieces[cut + 1 :]]
                row = [name, len(pieces)]
                for some in (pieces, changed):
                    back = unlettered(some)
                    full = some == encode_text(back, ranks, known)
                    local = canonical_words(back, some, ranks, known)
                    row += [full if local is None else local, full]
                rows.append(row)
            cols = zip(*rows, strict=True) if rows else [[]] * 6
            kinds = (batch.schema.field(0).type, pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [key, "n_pieces", "local", "whole", "changed_local", "changed_whole"])

    return spread(docs.select(key, "text")).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_pieces long, local boolean, whole boolean, changed_local boolean, changed_whole boolean")
