"""Token-id files: one concatenated id array with Elias-Fano coded document boundaries.

A file image holds, little-endian: magic ``TIDS``, version, bytes of an id, the numbers of documents, of
those without a ``doc_id`` (they come first) and of ids; then two Elias-Fano sequences, the n + 1
boundaries and the ascending ``doc_id``s less the smallest; then the ids. A sequence of n values up to u
takes about ``2 + log2(u / n)`` bits a value instead of 64: its low bits, its high bits in unary, and the
position of every ``SAMPLE``-th one among them. ``select(k)`` finds value k from the nearest sample by
counting bits in words. Documents are read through ``select``; no table of offsets is made.

Texts are encoded where they lie; only ids, in ``id_bytes`` bytes each, are shuffled, by ranges of
``doc_id`` whose bounds are approximate quantiles.

Defined results: a null text is empty and has only the end id; ties of ``doc_id`` are ordered by their
ids' bytes; null ``doc_id``s come first. Repeated rows each have their ids. An empty table gives no file
and no rows. Further columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkquill.llm.tokens import encoder
from sparkquill.session import stored

END_ID = 2
#: Ids of one file image at most (a longer document has an image of its own).
FILE_IDS = 2 << 20
SAMPLE = 256
_HEAD, _SEQUENCE = struct.Struct("<4sBBQQQ"), struct.Struct("<BQQQ")


class EliasFano:
    """An ascending sequence of integers from 0 on."""

    def __init__(self, low: int, low_bits: bytes | memoryview, words: np.ndarray, samples: np.ndarray, n: int) -> None:
        self.low, self.low_bits, self.words, self.samples, self.n = low, low_bits, words, samples, n

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        low = max(0, (int(values[-1]) // n).bit_length() - 1) if n else 0
        high = (values >> np.uint64(low)) + np.arange(n, dtype=np.uint64)
        unary = np.zeros((int(high[-1]) // 64 + 1) * 64 if n else 0, np.uint8)
        unary[high] = 1
        shifts = np.arange(low, dtype=np.uint64)
        bits = ((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel()
        return cls(low, np.packbits(bits, bitorder="little").tobytes(), np.packbits(unary, bitorder="little").view("<u8"), high[::SAMPLE].astype("<u8"), n)

    def packed(self) -> bytes:
        return _SEQUENCE.pack(self.low, self.n, len(self.words), len(self.samples)) + bytes(self.low_bits) + self.words.tobytes() + self.samples.tobytes()

    @classmethod
    def read(cls, data: memoryview) -> tuple[EliasFano, memoryview]:
        """A packed sequence, and what follows it."""
        low, n, words, samples = _SEQUENCE.unpack_from(data)
        a = _SEQUENCE.size
        b = a + -(-n * low // 8)
        c = b + 8 * words
        d = c + 8 * samples
        return cls(low, data[a:b], np.frombuffer(data[b:c], "<u8"), np.frombuffer(data[c:d], "<u8"), n), data[d:]

    def select(self, k: int) -> int:
        """Value k."""
        position, left = int(self.samples[k // SAMPLE]), k % SAMPLE
        word = position // 64
        value = int(self.words[word]) >> position % 64 << position % 64
        while (count := value.bit_count()) <= left:
            left -= count
            word += 1
            value = int(self.words[word])
        for _ in range(left):
            value &= value - 1
        high = word * 64 + (value & -value).bit_length() - 1 - k
        first = k * self.low
        window = int.from_bytes(self.low_bits[first // 8 : -(-(first + self.low) // 8)], "little") >> first % 8
        return high << self.low | window & (1 << self.low) - 1


def write_image(doc_ids: list, documents: list[bytes], id_bytes: int = 2) -> bytes:
    """The file image of documents given as packed ids of ``id_bytes`` bytes, by ascending id, nulls first."""
    bounds = np.zeros(len(documents) + 1, np.int64)
    np.cumsum([len(x) // id_bytes for x in documents], out=bounds[1:])
    known = [x for x in doc_ids if x is not None]
    base = known[0] if known else 0
    above = np.array(known, np.int64).astype(np.uint64) - np.uint64(base % (1 << 64))
    return b"".join((
        _HEAD.pack(b"TIDS", 2, id_bytes, len(documents), len(documents) - len(known), int(bounds[-1])),
        struct.pack("<q", base), EliasFano.of(bounds).packed(), EliasFano.of(above).packed(), *documents,
    ))


class Image:
    """A file image that is read by document."""

    def __init__(self, data: bytes) -> None:
        magic, version, self.id_bytes, self.n, self.nameless, self.total = _HEAD.unpack_from(data)
        if magic != b"TIDS" or version != 2:
            raise ValueError("not a token-id file of version 2")
        rest = memoryview(data)[_HEAD.size :]
        (self.base,) = struct.unpack_from("<q", rest)
        self.bounds, rest = EliasFano.read(rest[8:])
        self.names, rest = EliasFano.read(rest)
        if len(rest) != self.id_bytes * self.total:
            raise ValueError("a token-id file of another length than its header says")
        self.ids = np.frombuffer(rest, f"<u{self.id_bytes}")

    def start(self, k: int) -> int:
        """Where document k starts; for k = n, where the last one ends."""
        return self.bounds.select(k)

    def doc_id(self, k: int) -> int | None:
        return None if k < self.nameless else self.base + self.names.select(k - self.nameless)

    def document(self, k: int) -> np.ndarray:
        return self.ids[self.start(k) : self.start(k + 1)]


_IDS = "doc_id long, part int, key int, ids binary"
_FILES = "part int, base long, n_docs long, n_ids long, image binary"
_ROWS = "part int, local long, doc_id long, n_tokens long, ids_crc32 long"


def _keys(spark: SparkSession, parts: int) -> np.ndarray:
    """For each partition of a shuffle a number that hashing deals there, so that ranges and partitions go one to one.

    The driver gets one row for each partition, which is a setting of the cluster.
    """
    tried = spark.range(int(parts * (np.log(parts + 1) + 8) * 1.5)).select(F.col("id").cast("int").alias("key"))
    found = {r["at"]: r["key"] for r in tried.groupBy(F.pmod(F.hash("key"), F.lit(parts)).alias("at")).agg(F.min("key").alias("key")).collect()}
    return np.array([found.get(k, k) for k in range(parts)], np.int32)


def write_files(documents: DataFrame, tokenizer: str, id_bytes: int = 2, name: str = "token-files") -> DataFrame:
    """Encode and write all documents in ascending ``doc_id`` order; the table of files.

    ``part`` numbers the ranges of ids in order, ``base`` counts the part's ids before the file.
    """
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Bounds of ranges: one number for each partition of a shuffle, from a scan of the ids alone.
    found = documents.select(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 20 * parts).alias("q")).first()["q"] if parts > 1 else None
    bounds, keys = np.unique(np.array(found or [], np.int64)), _keys(documents.sparkSession, parts)

    def encode(batches):
        enc = encoder(tokenizer)
        for batch in batches:
            names = batch.column("doc_id")
            part = np.where(names.is_null().to_numpy(False), 0, np.searchsorted(bounds, names.fill_null(0).to_numpy(False))).astype(np.int32)
            for first, ids, ends in enc.encode(batch.column("text"), END_ID):
                if id_bytes < 4 and ids.max() >> 8 * id_bytes:
                    raise ValueError(f"an id does not fit in {id_bytes} bytes")
                n = len(ends) - 1
                packed = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((ends * id_bytes).astype(np.int32)), pa.py_buffer(ids.astype(f"<u{id_bytes}"))])
                yield pa.RecordBatch.from_arrays([names.slice(first, n), pa.array(part[first : first + n]), pa.array(keys[part[first : first + n]]), packed], ["doc_id", "part", "key", "ids"])

    def pack(batches):
        part, base, names, docs, size = None, 0, [], [], 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "base": [base], "n_docs": [len(docs)], "n_ids": [size], "image": pa.array([write_image(names, docs, id_bytes)], pa.binary())})

        for batch in batches:
            for doc_id, its, ids in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if docs and (its != part or size >= FILE_IDS):
                    yield row()
                    base, names, docs, size = base + size, [], [], 0
                if its != part:
                    part, base = its, 0
                names.append(doc_id)
                docs.append(ids)
                size += len(ids) // id_bytes
        if docs:
            yield row()

    ids = documents.mapInArrow(encode, _IDS)
    ordered = ids.repartition(parts, "key").sortWithinPartitions("part", "doc_id", "ids")
    return stored(ordered.select("doc_id", "part", "ids").mapInArrow(pack, _FILES), name)


def read_files(files: DataFrame) -> DataFrame:
    """Each document as the files hold it: doc_id, start, n_tokens, ids_crc32."""

    def parse(batches):
        for batch in batches:
            for part, base, data in zip(batch.column("part").to_pylist(), batch.column("base").to_pylist(), batch.column("image"), strict=True):
                image = Image(data.as_py())
                local, names, tokens, crc = [], [], [], []
                for k in range(image.n):
                    ids = image.document(k)
                    local.append(base + image.start(k))
                    names.append(image.doc_id(k))
                    tokens.append(len(ids))
                    crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
                yield pa.RecordBatch.from_pydict({"part": pa.array([part] * image.n, pa.int32()), "local": pa.array(local, pa.int64()), "doc_id": pa.array(names, pa.int64()), "n_tokens": pa.array(tokens, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    rows = files.select("part", "base", "image").mapInArrow(parse, _ROWS)
    # One row for each range partition: its count is a setting of the cluster, not of the data.
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return rows.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
