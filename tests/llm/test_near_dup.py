import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkquill.llm import near_dup
from sparkquill.llm.components import components


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    n = min(5, len(words))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if words else frozenset()


def brute(rows):
    """(doc_id, n_shingles, component_id, kept) of each row, by all pairs."""
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 85 * len(sets[a] | sets[b]):
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    out = []
    for (i, _), s, x in zip(rows, sets, label, strict=True):
        ids = [r[0] for r, y in zip(rows, label, strict=True) if y == x and r[0] is not None]
        least = min(ids) if ids else None
        out.append((i, len(s), least, i == least))
    return sorted(out, key=str)


def corpus(seed=1, groups=25):
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choice("abcdeé") for _ in range(4)) for _ in range(400)]
    rows, i = [], 0
    for _ in range(groups):
        words = [draw.choice(vocabulary) for _ in range(draw.choice((3, 9, 12, 40, 150, 400)))]
        for _ in range(draw.choice((1, 2, 6, 14))):
            copy = list(words)
            for _ in range(draw.choice((0, 0, 1, 2, 3))):
                copy[draw.randrange(len(copy))] = draw.choice(vocabulary)
            text = " ".join(copy)
            rows.append((i, text.upper() if draw.random() < 0.2 and text.isascii() else text))
            i += 1
    rows += [(i, ""), (i + 1, " \n\t"), (i + 2, None), (i + 3, "one two"), (i + 4, "One\ttwo "), (i + 5, "ONE"), (None, "lost words here are only five six"), (None, None), (7, rows[7][1])]
    draw.shuffle(rows)
    return rows


def test_against_brute_force(spark):
    for seed, task in ((1, near_dup.TASK_SHINGLES), (2, 600)):  # a small task sends clusters through the blocks
        rows = corpus(seed)
        docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, v int").repartition(5)
        got = near_dup.near_duplicates(docs, task)
        assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_shuffled_candidates_and_filter(spark):
    rows = [r for r in corpus(3, 10) if r[0] is not None]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dup.near_duplicates(docs, broadcast_bytes=0)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
    kept = sorted(r[0] for r in near_dup.one_of_each(docs).collect())
    assert set(kept) == {r[0] for r in brute(rows) if r[3]}


def test_hot_groups_and_clashing_names(spark, monkeypatch):
    from sparkquill.llm import tables

    monkeypatch.setattr(tables, "HOT_ROWS", 3)
    rows = corpus(5, 12)
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, _gone int, _NEAR_dup_row int, rid int").repartition(5)
    for task in (near_dup.TASK_SHINGLES, 600):
        assert sorted(map(tuple, near_dup.near_duplicates(docs, task).collect()), key=str) == brute(rows)
        out = near_dup.one_of_each(docs, task)
        assert out.columns == docs.columns
        left = [(r.doc_id, r.text) for r in out.collect()]
        assert len({shingles(t) for _, t in left if shingles(t)}) == sum(bool(shingles(t)) for _, t in left)
        assert {r[0] for r in brute(rows) if r[3]} <= {i for i, _ in left} | {None}


def test_one_id_for_many_rows(spark):
    rows = [(None if i % 2 else 1, t) for i, (_, t) in enumerate(corpus(6, 15))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for task, limit in ((near_dup.TASK_SHINGLES, near_dup.BROADCAST_BYTES), (600, 0)):
        assert sorted(map(tuple, near_dup.near_duplicates(docs, task, limit).collect()), key=str) == brute(rows)


def test_empty_table(spark):
    assert near_dup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_linked_components_compares_across_components():
    base = np.arange(100, dtype=np.uint64)
    chain = [np.concatenate((base[k * 6 :], base[: k * 6] + np.uint64(1000))) for k in range(8)]
    chain = [np.sort(x) for x in chain]
    assert len(set(near_dup.linked_components(chain).tolist())) == 1
    assert len(set(near_dup.linked_components(chain[::3]).tolist())) == 3


def test_recall_of_bands_at_the_threshold():
    draw = np.random.default_rng(4)
    bands = near_dup.Bands()
    for n in (7, 12, 60, 300, 1500):
        common = int(np.ceil(0.85 * 2 * n / 1.85))
        met = 0
        for _ in range(200):
            pool = np.unique(draw.integers(0, 1 << 63, 3 * n, dtype=np.uint64) * np.uint64(2))
            draw.shuffle(pool)
            a, b = np.sort(pool[:n]), np.sort(np.concatenate((pool[:common], pool[n : 2 * n - common])))
            met += bool(np.intersect1d(bands.keys(a), bands.keys(b)).size)
        assert met >= 199, n


@pytest.mark.parametrize("hot", (1000, 3))
def test_components_of_paths_stars_and_loops(spark, monkeypatch, hot):
    from sparkquill.llm import tables

    monkeypatch.setattr(tables, "HOT_ROWS", hot)
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, k) for k in range(6, 40)] + [(70, 70), (80, 79), (79, 80)]
    got = {r.v: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 5 for i in range(5, 40)}, 79: 79, 80: 79}
    assert components(spark.createDataFrame([], "a long, b long")).where(F.lit(True)).count() == 0
