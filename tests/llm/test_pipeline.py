import os

import pytest

import corpus_pipeline
from sparkquill.llm import decontaminate, near_dup, pii
from sparkquill.session import stored, table

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_stages_against_what_each_promises(spark):
    docs = table(spark, DATA, "documents")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, DATA), "test-pipeline")
        seen.append((name, docs, out))
        docs = out
    rows = {name: (before.collect(), after.collect()) for name, before, after in seen}
    assert all(after.columns == columns for _, _, after in seen[:-1])
    for name, (before, after) in list(rows.items())[:3]:
        assert {r.doc_id for r in after} <= {r.doc_id for r in before} and 0 < len(after) <= len(before), name
        text = {r.doc_id: r for r in before}
        assert all(tuple(text[r.doc_id]) == tuple(r) for r in after)

    labels = {r.doc_id: r.quality for r in table(spark, DATA, "labels").collect()}
    before, after = rows["quality classifier"]
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert sum(labels.get(i) == 1 for i in gone) <= 1 and sum(labels.get(r.doc_id) == 0 for r in after) <= 3

    from tests.llm.test_near_dup import brute

    before, after = rows["MinHash near-dedup"]
    assert {r.doc_id for r in after} == {i for i, _, _, kept in brute([(r.doc_id, r.text) for r in before]) if kept}

    before, after = rows["benchmark decontamination"]
    items = [r.text for r in table(spark, DATA, "benchmark").collect()]
    import re

    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))

    grams = {tuple(w[i : i + min(10, len(w))]) for w in map(words, items) for i in range(max(1, len(w) - 9)) if w}
    sizes = {len(g) for g in grams}
    dirty = {r.doc_id for r in before if any(tuple(w[i : i + n]) in grams for w in (words(r.text),) for n in sizes for i in range(len(w) - n + 1))}
    assert {r.doc_id for r in after} == {r.doc_id for r in before} - dirty

    before, after = rows["personal data"]
    assert len(before) == len(after)
    for r in after:
        assert not pii.base_spans(r.text) and r.n_chars == len(r.text)
    clean = {r.doc_id: r.text for r in before if not pii._SIGN.search(r.text)}
    assert all(clean[r.doc_id] == r.text for r in after if r.doc_id in clean)

    before, after = rows["best-fit packing"]
    assert {r.doc_id for r in after} == {r.doc_id for r in before}
    lanes = {}
    for r in after:
        lanes.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in x) <= 1024 for x in lanes.values())


def test_stages_are_those_of_the_operators():
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    assert near_dup.PERCENT >= 80 and decontaminate.WINDOW == 10


def test_rows_without_an_id_of_their_own_are_judged_each(spark):
    import random

    draw = random.Random(2)
    prose = lambda: " ".join("".join(draw.choice("abcdefgh") for _ in range(6)) for _ in range(60))
    copied, twice, null_only, lone, other, seven = (prose() for _ in range(6))
    rows = [(1, copied), (None, copied + " end"), (None, lone), (2, twice), (2, twice), (7, copied), (7, seven), (None, null_only), (None, null_only), (None, None), (None, ""), (8, other)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = [(1, copied), (2, twice), (7, seven), (8, other), (None, ""), (None, None), (None, lone), (None, null_only)]
    for task in (near_dup.TASK_SHINGLES, 100):
        assert sorted(map(tuple, near_dup.one_of_each(docs, task).collect()), key=str) == sorted(want, key=str)

    items = spark.createDataFrame([(1, seven)], "item_id long, text string")
    rows = [(None, lone), (None, "see " + seven), (7, seven), (7, other), (8, other), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    clean = [rows[i] for i in (0, 3, 4, 5)]
    assert sorted(map(tuple, decontaminate.remove_documents(docs, items).collect()), key=str) == sorted(clean, key=str)


def test_stages_on_odd_rows_columns_and_empty_tables(spark, tmp_path):
    rows = [(1, "word " * 40, 3), (1, "word " * 40, 4), (2, None, 5), (None, "", 6), (None, "mail a@b.co now", 7), (3, "x" * 200_000, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `score.of` int")
    benchmark = spark.createDataFrame([(1, None), (2, "some benchmark passage of words that nothing else here holds at all")], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for name, df in (("benchmark", benchmark), ("labels", labels)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    for table_, n in ((docs, 6), (docs.limit(0), 0)):
        now = stored(table_, "test-odd")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = stored(stage(spark, now, str(tmp_path)), "test-odd")
            assert now.columns == docs.columns, name
        assert now.count() == max(0, n - 1)  # one of the equal rows goes
        packed = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path))
        assert packed.where("piece = 0").count() == max(0, n - 1)
