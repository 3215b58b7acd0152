"""Near-duplicate documents: one-permutation hashing, banded buckets, star-shaped candidate edges.

1. One pass makes each document's set of distinct five-word shingles (64-bit hashes), its digest, and
   one-permutation MinHash values with optimal densification, folded into bands.
2. Documents of one set form a class; from here on only classes count, so copies make no pairs.
3. Each bucket links its members to one centre. The stars connect what the buckets connect, with a
   number of edges that is linear in the members; their components are candidate clusters.
4. Within a cluster the full sets are compared. All members but those of one component act as pivots
   against all others, so no link between different sets of a cluster is lost. A cluster over
   ``TASK_SHINGLES`` is dealt out in blocks: members linked to its most central one are merged, and
   blocks of the rest meet blocks of all.
5. A document's component is that of its class.

With ``BANDS`` bands of ``ROWS`` values a pair at the threshold shares no bucket with a probability of
(1 - 0.85 ** 6) ** 36, about 4e-8 (more similar pairs: less); and a pair missed in all buckets may
still meet in its cluster. Links themselves are exact.

Defined results: null, empty and wordless texts have no shingles and are linked with nothing. Rows of
one ``doc_id`` are told apart by their text. A component's id is the smallest ``doc_id`` of its rows;
null if all are null, and then its rows are kept. Further columns are ignored. ``one_of_each`` goes by
rows: of each group one row stays, the first by (id, stored row key) with null ids last, with all its columns,
whatever their names; texts without words are in no group and stay. An empty table gives no rows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkquill.llm.components import components
from sparkquill.llm.tables import join_hot, keep_only
from sparkquill.session import small, stored, unused

SHINGLE, PERCENT = 5, 85
BANDS, ROWS = 36, 6
#: Shingles that one task compares at once (8 bytes each); a larger cluster is dealt out in blocks.
TASK_SHINGLES = 1 << 20
#: Bytes of candidate rows that may be broadcast; more are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
_WORD_TABLE = 300_000
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_ODD = _mix(np.arange(1, 65, dtype=np.uint64)) | _U(1)


class Shingler:
    """Sets of shingle hashes of whole texts; word hashes are kept in a bounded table."""

    def __init__(self, n: int = SHINGLE) -> None:
        self.n, self.table = n, {}

    def __call__(self, text: str | None) -> np.ndarray:
        """The sorted distinct hashes; A-Z are lower-cased, words end at ASCII white space."""
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        table = self.table
        if len(table) > _WORD_TABLE:
            table.clear()
        try:
            h = np.fromiter(map(table.__getitem__, words), np.uint64, len(words))
        except KeyError:
            for word in set(words).difference(table):
                table[word] = xxhash.xxh3_64_intdigest(word)
            h = np.fromiter(map(table.__getitem__, words), np.uint64, len(words))
        n = min(self.n, len(h))
        total = np.full(len(h) - n + 1, n, np.uint64)
        for j in range(n):
            total += h[j : len(h) - n + 1 + j] * _ODD[j]
        out = _mix(total)
        out.sort()
        return out[np.concatenate(([True], out[1:] != out[:-1]))]


class Bands:
    """Bucket keys of a set by one-permutation hashing with optimal densification."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS) -> None:
        self.bands, self.rows = bands, rows
        k = bands * rows
        self.edges = np.array([-(-(i << 32) // k) << 32 for i in range(k)], np.uint64)
        steps = np.arange(k * 640, dtype=np.uint64).reshape(k, 640)
        self.donors = (_mix(steps + _U(0x5DEECE66D)) % _U(k)).astype(np.int64)
        self.salt = _mix(np.arange(1000, 1000 + bands, dtype=np.uint64))

    def values(self, shingles: np.ndarray) -> np.ndarray:
        """The least hash of each bin; an empty bin takes that of the first non-empty bin on its own walk."""
        at = np.searchsorted(shingles, self.edges)
        full = np.append(at[1:], len(shingles)) > at
        source = np.where(full, np.arange(len(full)), -1)
        empty = np.flatnonzero(~full)
        for a, b in ((0, 12), (12, 80), (80, 640)):
            if empty.size:
                walk = self.donors[empty, a:b]
                hit = full[walk]
                first = hit.argmax(1)
                found = hit[np.arange(len(empty)), first]
                source[empty[found]] = walk[found, first[found]]
                empty = empty[~found]
        if empty.size:
            source[empty] = np.flatnonzero(full)[empty % full.sum()]
        return shingles[at[source]]

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        v = self.values(shingles).reshape(self.bands, self.rows)
        return _mix((v * _ODD[: self.rows]).sum(1) + self.salt).view(np.int64)


@lru_cache(1)
def _worker() -> tuple[Shingler, Bands]:
    return Shingler(), Bands()


#: A set of fewer shingles is linked only with the same set: with one element more or less, n / (n + 1) < 0.85.
_LEAST = next(n for n in range(1, 100) if 100 * n >= PERCENT * (n + 1))


def linked_components(sets: list[np.ndarray], label: np.ndarray | None = None, percent: int = PERCENT) -> np.ndarray:
    """A label for each set; equal labels mean connected by links of the given similarity.

    ``label`` may hold labels that are known to be connected. Each round takes one set as a pivot and
    compares it with all; rounds end when all sets that were no pivot have one label, so every pair
    of sets with different labels was compared.
    """
    label = np.arange(len(sets)) if label is None else label.copy()
    sizes = np.array([len(s) for s in sets])
    element = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    weight = np.add.reduceat(np.bincount(element)[element], starts) / sizes
    todo = np.ones(len(sets), bool)
    mark = np.zeros(element.max() + 1, bool)
    first = True
    while True:
        rest = np.flatnonzero(todo)
        names, where, count = np.unique(label[rest], return_inverse=True, return_counts=True)
        if len(names) <= 1:
            return label
        among = rest if first else rest[where != count.argmax()]
        pivot, first = among[weight[among].argmax()], False
        todo[pivot] = False
        own = element[starts[pivot] : starts[pivot] + sizes[pivot]]
        mark[own] = True
        common = np.add.reduceat(mark[element], starts, dtype=np.int64)
        mark[own] = False
        near = 100 * common >= percent * (sizes + sizes[pivot] - common)
        if near.sum() > 1:
            joined = np.unique(label[near])
            label[np.isin(label, joined)] = joined[0]


_SKETCH = "rid long, doc_id long, h long, n long, digest binary, keys array<long>"


def _sketches(documents: DataFrame, row: str | None) -> DataFrame:
    """Sketches of all rows; ``row`` names a column of stored row keys, else rows are numbered here."""

    def sketch(batches):
        keep_only("near_dup", _worker.cache_clear)
        shingler, bands = _worker()
        for batch in batches:
            n, digest, keys = [], [], []
            for text in batch.column("text").to_pylist():
                s = shingler(text)
                n.append(len(s))
                digest.append(xxhash.xxh3_128_digest(s.tobytes()))
                keys.append(bands.keys(s) if len(s) >= _LEAST else None)
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("doc_id"), batch.column("h"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["rid", "doc_id", "h", "n", "digest", "keys"])

    rid = F.col(f"`{row}`") if row else F.monotonically_increasing_id()
    return documents.select(rid.alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text").mapInArrow(sketch, _SKETCH)


def _groups(batches, keys: tuple[str, ...]):
    """Runs of rows with equal keys, of a sorted stream of batches; each as (key, rows)."""
    now, rows = None, []
    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        at = [batch.schema.names.index(k) for k in keys]
        for row in zip(*cols, strict=True):
            key = tuple(row[i] for i in at)
            if key != now:
                if rows:
                    yield now, rows
                now, rows = key, []
            rows.append(row)
    if rows:
        yield now, rows


def _array(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint64)


def _small_clusters(members: DataFrame) -> DataFrame:
    """(v, root) of clusters (cluster, v, shingles) that one task can hold."""

    def solve(batches):
        for _, rows in _groups(batches, ("cluster",)):
            sets = dict((r[1], r[2]) for r in rows)
            ids = sorted(sets)
            label = linked_components([_array(sets[v]) for v in ids])
            root = {}
            for v, x in zip(ids, label.tolist(), strict=True):
                root.setdefault(x, v)
            out = [(v, root[x]) for v, x in zip(ids, label.tolist(), strict=True) if root[x] != v]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["v", "root"])

    dealt = members.select("cluster", "v", "shingles").repartition("cluster").sortWithinPartitions("cluster")
    return dealt.mapInArrow(solve, "v long, root long")


def _large_clusters(members: DataFrame, weights: DataFrame, block: int) -> DataFrame:
    """Links (a, b) that connect what is connected in clusters of any size (cluster, v, n, shingles)."""
    weighed = members.join(weights, "v", "left")
    pivots = weighed.groupBy("cluster").agg(F.max(F.struct(F.coalesce("weight", F.lit(0)), F.col("v")))["v"].alias("pivot"))
    pivots = pivots.join(members.select(F.col("v").alias("pivot"), F.col("shingles").alias("_pivot")), "pivot").select("cluster", "pivot", "_pivot")

    def measure(batches):
        for batch in batches:
            near = []
            for a, b in zip(batch.column("shingles").to_pylist(), batch.column("_pivot").to_pylist(), strict=True):
                a, b = _array(a), _array(b)
                common = len(np.intersect1d(a, b, assume_unique=True))
                near.append(100 * common >= PERCENT * (len(a) + len(b) - common))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(near)], ["cluster", "pivot", "v", "n", "shingles", "near"])

    # One row for each large cluster: where these are few, no cluster's members come together in one task.
    seen = members.join(small(pivots, "near-dup-pivot-sets"), "cluster").select("cluster", "pivot", "v", "n", "shingles", "_pivot")
    seen = stored(seen.mapInArrow(measure, "cluster long, pivot long, v long, n long, shingles binary, near boolean"), "near-dup-pivots")
    blocks = seen.groupBy("cluster").agg(F.ceil(F.sum("n") / block).cast("int").alias("nb"), F.ceil(F.sum(F.when(F.col("near"), 0).otherwise(F.col("n"))) / block).cast("int").alias("nr"))
    placed = seen.join(small(blocks.where(F.col("nr") > 0), "near-dup-blocks"), "cluster").withColumn("b", F.pmod(F.xxhash64("v"), F.col("nb")).cast("int")).withColumn("r", F.pmod(F.xxhash64("v", F.lit(1)), F.col("nr")).cast("int"))
    every = placed.withColumn("r", F.explode(F.sequence(F.lit(0), F.col("nr") - 1)))
    rest = placed.where(~F.col("near")).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    dealt = every.unionByName(rest).select("cluster", "r", "b", "v", "shingles", "near").repartition("cluster", "r", "b").sortWithinPartitions("cluster", "r", "b")

    def solve(batches):
        for _, rows in _groups(batches, ("cluster", "r", "b")):
            sets = {x[3]: (x[4], x[5]) for x in rows}
            ids = sorted(sets)
            label, ball = np.arange(len(ids)), [i for i, v in enumerate(ids) if sets[v][1]]
            label[ball] = ball[0] if ball else 0
            label = linked_components([_array(sets[v][0]) for v in ids], label)
            root = {}
            out = [(v, root[x]) for v, x in zip(ids, label.tolist(), strict=True) if root.setdefault(x, v) != v]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])

    return dealt.mapInArrow(solve, "a long, b long").union(seen.where("near").select("v", "pivot"))


def _placed(documents: DataFrame, task_shingles: int, broadcast_bytes: int, row: str | None = None) -> DataFrame:
    """Per document row: rid, doc_id, n, root (of its component)."""
    sketch = stored(_sketches(documents, row), "near-dup-sketches")
    classes = stored(sketch.where(F.col("n") > 0).groupBy("digest").agg(F.min("rid").alias("v"), F.count(F.lit(1)).alias("copies")), "near-dup-digests")
    own = F.coalesce("v", "rid")
    named = join_hot(sketch.where(F.col("n") > 0), classes, "digest", "copies").unionByName(sketch.where(F.col("n") == 0).withColumn("v", F.lit(None).cast("long")))
    rows = named.select("rid", "doc_id", "h", "n", own.alias("v"), F.when(own == F.col("rid"), F.col("keys")).alias("keys"), F.when(own == F.col("rid"), F.col("digest")).alias("digest"))
    rows = stored(rows, "near-dup-classes")

    buckets = rows.where(F.col("keys").isNotNull()).select("v", F.explode("keys").alias("key"))
    stars = buckets.groupBy("key").agg(F.min("v").alias("centre"), F.count(F.lit(1)).alias("m")).where(F.col("m") > 1)
    spokes = stored(buckets.join(stars, "key").groupBy("v", "centre").agg(F.sum("m").alias("m")), "near-dup-stars")
    clusters = stored(components(spokes.where(F.col("v") != F.col("centre")).select("v", "centre"), "near-dup-clusters").withColumnRenamed("root", "cluster"), "near-dup-members")

    members = rows.where(F.col("keys").isNotNull()).select("v", "doc_id", "h", "n", "digest").join(clusters, "v")
    sizes = members.groupBy("cluster").agg(F.sum("n").alias("size"))
    members = stored(members.join(sizes, "cluster").select("cluster", "size", "v", "n", "digest", F.col("doc_id").alias("_doc_id"), F.col("h").alias("_h")), "near-dup-candidates")
    totals = members.agg(F.count(F.lit(1)).alias("rows"), F.max("size").alias("largest")).first()
    probe = F.broadcast(members) if totals["rows"] * 128 <= broadcast_bytes else members

    def shingles(batches):
        keep_only("near_dup", _worker.cache_clear)
        shingler, _ = _worker()
        for batch in batches:
            sets = []
            for text, digest in zip(batch.column("text").to_pylist(), batch.column("digest").to_pylist(), strict=True):
                s = shingler(text).tobytes()
                sets.append(s if xxhash.xxh3_128_digest(s) == digest else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(sets, pa.binary())], ["cluster", "size", "v", "n", "shingles"])

    if row:
        full = documents.select(F.col(f"`{row}`").alias("v"), "text").join(probe, "v")
    else:
        # By id and text, so that rows of one id meet their own candidates alone.
        texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
        full = texts.join(probe, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("h") == F.col("_h")))
    full = full.select("cluster", "size", "v", "n", "digest", "text")
    full = full.mapInArrow(shingles, "cluster long, size long, v long, n long, shingles binary").where(F.col("shingles").isNotNull())
    roots = _small_clusters(full.where(F.col("size") <= task_shingles))
    if (totals["largest"] or 0) > task_shingles:
        large = stored(full.where(F.col("size") > task_shingles).dropDuplicates(["v"]), "near-dup-large")
        weights = spokes.groupBy("v").agg(F.sum("m").alias("weight"))
        links = _large_clusters(large.select("cluster", "v", "n", "shingles"), weights, task_shingles // 2)
        roots = roots.union(components(links, "near-dup-links").where(F.col("v") != F.col("root")))
    roots = stored(roots, "near-dup-roots")

    # Only classes with another root are in ``roots``; those of many copies are hot.
    copies = classes.select("v", "copies").join(roots, "v")
    moved = stored(copies, "near-dup-moved")
    rows = rows.select("rid", "doc_id", "n", "v")
    there = rows.join(moved.select("v"), "v", "left_anti").withColumn("root", F.col("v"))
    return there.unionByName(join_hot(rows, moved, "v", "copies")).drop("v")


def near_duplicates(documents: DataFrame, task_shingles: int = TASK_SHINGLES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per document row: doc_id, n_shingles, component_id, kept."""
    placed = stored(_placed(documents, task_shingles, broadcast_bytes), "near-dup-placed")
    least = stored(placed.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("rows")), "near-dup-least")
    return join_hot(placed, least, "root", "rows").select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(documents: DataFrame, task_shingles: int = TASK_SHINGLES) -> DataFrame:
    """One row of each component, the first by (id, row key) with null ids last, with all its columns."""
    row = unused(documents, "_near_dup_row")
    keyed = stored(documents.withColumn(row, F.monotonically_increasing_id()), "near-dup-rows")
    placed = stored(_placed(keyed, task_shingles, BROADCAST_BYTES, row), "near-dup-placed")
    first = placed.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("rid")))["rid"].alias("rid"))
    gone = placed.join(first, "rid", "left_anti").select(F.col("rid").alias(row))
    return keyed.join(small(gone, "near-dup-gone"), row, "left_anti").drop(row)
