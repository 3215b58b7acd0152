import random
import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from sparkquill.llm import quality


def corpus(n=400):
    draw = random.Random(2)
    words = ["tion", "the", "ering", "façon", "und", "que", "these", "allons"]
    rows, labels = [], []
    for i in range(n):
        text = " ".join(draw.choice(words) for _ in range(draw.randint(5, 60)))
        bad = draw.random() < 0.3
        if bad:
            text = draw.choice((text.upper() + "!!", " ".join(w + "###" for w in text.split()), " ".join([text.split()[0]] * 40)))
        rows.append((i, text, 0.5))
        labels.append((i, int(not bad), None))
    rows += [(n, "", 0.5), (n + 1, None, 0.5), (n + 2, " \n", 0.5), (n + 3, "word " * 50_000, 0.5), (None, "the ering", 0.5), (4, rows[4][1], 0.5)]
    labels += [(None, 1, None), (9_999, 0, None), (5, None, None), (4, labels[4][1], 3)]
    return rows, labels


def test_held_out_accuracy_and_edges(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double").repartition(3)
    table = spark.createDataFrame(labels, "doc_id long, quality int, text int")
    got = quality.quality(docs, table).collect()
    assert len(got) == len(rows)
    truth = {i: q for i, q, _ in labels}
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (True if r.doc_id is None else zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    tested = [r for r in got if r.held_out and truth.get(r.doc_id) is not None and r.doc_id is not None]
    assert len(tested) > 50 and np.mean([r.predicted == truth[r.doc_id] for r in tested]) > 0.95
    empty = {r.score for r in got if r.doc_id in (400, 401, 402)}
    assert len(empty) == 1
    assert len({r.score for r in got if r.doc_id == 4}) == 1


def test_scores_are_the_plain_average_of_vectors():
    rows, labels = corpus(60)
    model = quality.train([r[1] for r in rows[:60]], [q for _, q, _ in labels[:60]], visits=200)
    scored = quality._scorer(model)
    for _, text, _ in rows[:20]:
        found, words = [], text.split()
        for k, w in enumerate(words):
            found += quality.features([w])[0].tolist() + [0] * (k > 0 and words[k - 1] == w)
        z = model.scores[found].mean(0, dtype=np.float64) + model.bias
        assert scored(text) == pytest.approx(float(np.exp(z[1]) / np.exp(z).sum()), abs=1e-6)


def test_no_labels_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [tuple(r) for r in quality.quality(docs, none).collect()] == [(1, False, 0.5, 1)]
    assert quality.quality(docs.limit(0), none).count() == 0
    assert quality.good(docs, none).columns == docs.columns
    clashing = docs.withColumns({"score": F.lit("mine"), "predicted": F.lit(-1), "a.b": F.lit(2)})
    kept = quality.good(clashing, none)
    assert kept.columns == clashing.columns and all(r.score == "mine" and r.predicted == -1 for r in kept.collect())
