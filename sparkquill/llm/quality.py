"""Quality classifier: supervised subword embeddings.

A text is the bag of its words. A word has a hashed vector for itself and one for each character
n-gram of ``<word>``; a word that repeats the one before it adds the vector of a repetition mark. The
document's vector is the average of all, a softmax over two classes reads it, and vectors and output
are learned together by mini-batch stochastic gradient descent in numpy (step sizes by row, after
AdaGrad).

The model is fitted on the driver on at most ``TRAIN_ROWS`` labelled rows, those with the smallest
hash of ``doc_id``; scoring then maps over all rows. As the output is linear in the average, each
bucket's vector is multiplied into its two class scores before they are sent out, and each worker
keeps the sums of the words it has met in a bounded table.

Defined results: null, empty and wordless texts score by the bias alone. Rows with a null ``doc_id``
are held out. Labels that are null or without a document teach nothing; conflicting ones both count.
Without any label every score is 0.5. Repeated rows get equal scores. Only ``text`` is an input.
"""

from __future__ import annotations

import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from sparkquill.llm.tables import keep_only, map_columns

TRAIN_ROWS = 4_000
BUCKETS, DIMENSIONS, NGRAMS = 1 << 17, 8, (3, 4)
THRESHOLD, FOLDS = 0.3, 5
_WORD_TABLE = 400_000
_REPEATED = 0  # the bucket of the repetition mark


_ODD = np.cumprod(np.full(8, 0x9E3779B97F4A7C15, np.uint64)) | np.uint64(1)


def _bucket(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h + np.uint64(salt)) * np.uint64(0xBF58476D1CE4E5B9)
    return (1 + (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) % np.uint64(BUCKETS - 1)).astype(np.int64)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of words and of their character n-grams, and which word each is of."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    codes = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    at = np.arange(len(codes)) - starts[owner]
    powers = np.cumprod(np.full(int(sizes.max()), 0x100000001B3, np.uint64))
    buckets, owners = [_bucket(np.add.reduceat(codes * powers[at], starts), 1)], [np.arange(len(words))]
    left = sizes[owner] - at
    for n in NGRAMS:
        i = np.flatnonzero(left >= n)
        buckets.append(_bucket(sum(codes[i + j] * _ODD[j] for j in range(n)), 1 + n))
        owners.append(owner[i])
    return np.concatenate(buckets), np.concatenate(owners)


def held_out(doc_id: Column) -> Column:
    """Whether a row is never trained on: crc32 of the id's text is a multiple of ``FOLDS``."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(True))


@dataclass
class Model:
    """Class scores of each bucket and of the bias; ``key`` names it in the workers' tables."""

    scores: np.ndarray
    bias: np.ndarray
    key: str

    def probability(self, total: np.ndarray) -> float:
        """Of class 1, from the summed class scores and the number of features."""
        z = total[:2] / max(total[2], 1) + self.bias
        z = np.exp(z - z.max())
        return float(z[1] / z.sum())


def _bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and each one's share of all its features."""
    words = (text or "").split()
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.float32)
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    times = np.bincount([number[w] for w in words])
    buckets, owner = features(list(number))
    repeated = sum(a == b for a, b in zip(words, words[1:], strict=False))
    distinct, where = np.unique(np.append(buckets, _REPEATED), return_inverse=True)
    count = np.bincount(where, np.append(times[owner], repeated))
    return distinct, (count / count.sum()).astype(np.float32)


def train(texts: list[str], labels: list[int], visits: int = 16_000, batch: int = 16, rate: float = 0.5, seed: int = 11) -> Model:
    """Fit vectors and output; ``visits`` is about how many documents are looked at in all."""
    bags = [_bag(x) for x in texts]
    y = np.array(labels, np.int64)
    draw = np.random.default_rng(seed)
    vectors = draw.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    output, bias = np.zeros((DIMENSIONS, 2), np.float32), np.zeros(2, np.float32)
    vector_step, output_step = np.full(BUCKETS, 1e-8, np.float32), np.full(3, 1e-8, np.float32)
    for _ in range(min(40, max(2, -(-visits // max(1, len(bags))))) if bags else 0):
        order = draw.permutation(len(bags))
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            part = part[[len(bags[i][0]) > 0 for i in part]]
            if not len(part):
                continue
            buckets = np.concatenate([bags[i][0] for i in part])
            weight = np.concatenate([bags[i][1] for i in part])
            doc = np.repeat(np.arange(len(part)), [len(bags[i][0]) for i in part])
            starts = np.flatnonzero(np.diff(doc, prepend=-1))
            mean = np.add.reduceat(vectors[buckets] * weight[:, None], starts)
            z = mean @ output + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), y[part]] -= 1
            back = (p @ output.T)[doc] * weight[:, None]
            rows, where = np.unique(buckets, return_inverse=True)
            step = np.stack([np.bincount(where, back[:, k], len(rows)) for k in range(DIMENSIONS)], 1).astype(np.float32)
            gradient = mean.T @ p / len(part)
            vector_step[rows] += (step**2).mean(1)
            output_step += np.array([(gradient**2).mean(), (p.mean(0) ** 2).mean(), 0], np.float32)
            vectors[rows] -= rate * step / np.sqrt(vector_step[rows])[:, None]
            output -= rate * gradient / np.sqrt(output_step[0])
            bias -= 0.1 * rate * p.mean(0) / np.sqrt(output_step[1])
    return Model((vectors @ output).astype(np.float32), bias, uuid.uuid4().hex)


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS) -> Model:
    """A model of the labelled rows outside the held-out fold, ``rows`` of them at most."""
    chosen = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_label"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id", "_label").limit(rows)
    found = documents.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))  # `rows` small rows at most
    got = found.orderBy(F.xxhash64("doc_id"), "doc_id", "_label", "text").select("text", "_label").limit(rows).toArrow()
    return train(got.column(0).to_pylist(), got.column(1).to_pylist())


_TABLES: dict[str, tuple[dict[str, int], list]] = {}


def _scorer(model: Model):
    """Sums of class scores by word, kept for the worker's life; one model's at a time."""
    keep_only("quality", _TABLES.clear)
    if model.key not in _TABLES:
        _TABLES.clear()
        _TABLES[model.key] = ({}, [np.zeros((1024, 3), np.float64)])
    table, (sums,) = _TABLES[model.key]
    repeated = np.append(model.scores[_REPEATED], 1).astype(np.float64)

    def learn(words: list[str]) -> None:
        nonlocal sums
        new = list(set(words).difference(table))
        if not new:
            return
        if len(table) + len(new) > _WORD_TABLE:
            table.clear()
            new = list(set(words))
        first = len(table)
        table.update(zip(new, range(first, first + len(new)), strict=True))
        while len(table) > len(sums):
            sums = np.concatenate((sums, np.zeros_like(sums)))
            _TABLES[model.key][1][0] = sums
        buckets, owner = features(new)
        order = np.argsort(owner, kind="stable")
        ends = np.cumsum(np.bincount(owner))
        scores = model.scores[buckets[order]].astype(np.float64)
        sums[first : first + len(new), :2] = np.add.reduceat(scores, np.concatenate(([0], ends[:-1])))
        sums[first : first + len(new), 2] = np.bincount(owner)

    def score(text: str | None) -> float:
        words = (text or "").split()
        try:
            at = np.fromiter(map(table.__getitem__, words), np.int64, len(words))
        except KeyError:
            learn(words)
            at = np.fromiter(map(table.__getitem__, words), np.int64, len(words))
        # Counts first: a fixed order of additions gives equal texts equal scores in every worker.
        return model.probability(sums[at].sum(0) + repeated * (at[1:] == at[:-1]).sum())

    def every(texts: list[str | None]) -> np.ndarray:
        for k in range(0, len(texts), 256):
            learn([w for x in texts[k : k + 256] for w in (x or "").split()])
        return np.array([score(x) for x in texts], np.float64)

    score.all = every
    return score


def score(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of the documents with their score and the class at the threshold, which take the place of columns so named."""
    documents = documents.drop("score", "predicted")
    at = documents.columns.index("text")
    schema = StructType([*documents.schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())])

    def scored(batches):
        of = _scorer(model)
        for batch in batches:
            values = of.all(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values), pa.array((values >= threshold).astype(np.int32))], [f"c{i}" for i in range(len(schema))])

    return map_columns(documents, scored, schema)


def quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document row: doc_id, held_out, score, predicted."""
    scored = score(documents.select("doc_id", "text"), fit(documents, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def good(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The document rows that the classifier takes for good, each by its own text, with all their columns."""
    model = fit(documents, labels)
    at = documents.columns.index("text")

    def chosen(batches):
        of = _scorer(model)
        for batch in batches:
            values = of.all(batch.column(at).to_pylist())
            yield batch.filter(pa.array(values >= threshold))

    return map_columns(documents, chosen, documents.schema)
