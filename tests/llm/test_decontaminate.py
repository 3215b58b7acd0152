import hashlib
import random
import re

from sparkquill.llm import decontaminate


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    grams = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            grams.setdefault(tuple(w[i : i + 10]), set()).add(item)
    out = []
    for doc_id, text in docs:
        w, hit, named = words(text), set(), set()
        for g, its in grams.items():
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i : i + len(g)]) == g:
                    hit.update(range(i, i + len(g)))
                    named |= its
        ids = sorted(str(x) for x in named if x is not None)
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return out


def corpus():
    draw = random.Random(4)
    word = lambda: draw.choice(("the", "of", "Long-word", "é", "x1", "sea", "And", "tree"))
    items = [(i, " ".join(word() for _ in range(draw.choice((0, 2, 9, 10, 11, 30))))) for i in range(30)] + [(None, "lost item of some words"), (40, None), (41, "???"), (3, "again the sea"), (3, "again the sea")]
    docs = []
    for i in range(120):
        parts = [" ".join(word() for _ in range(draw.choice((0, 3, 40))))]
        for _ in range(draw.choice((0, 0, 1, 2))):
            parts.append((draw.choice(items)[1] or "").upper())
            parts.append(" ".join(word() for _ in range(5)))
        docs.append((i, " , ".join(parts)))
    return docs + [(5, docs[5][1]), (5, "again, the SEA!"), (None, "lost item of some words"), (None, None), (200, ""), (201, "word " * 20_000)], items


def test_against_brute_force_in_one_slice_and_in_many(spark):
    docs, items = corpus()
    benchmark = spark.createDataFrame([(*x, "k") for x in items], "item_id long, text string, n_words string")
    for limit in (decontaminate.BROADCAST_BYTES, 20_000):
        for parts in (3, 7):  # rows come from a shuffle
            table = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, n_hit int").repartition(parts)
            got = decontaminate.contamination(table, benchmark, broadcast_bytes=limit).collect()
            assert sorted(map(tuple, got), key=str) == sorted(brute(docs, items), key=str)


def test_removal_keeps_columns_of_any_name_and_judges_rows(spark):
    docs, items = corpus()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    names = ("_bad", "_spans", "_DECONTAMINATE_row", "_row", "w", "_decontaminate_hits", "a.b")
    table = spark.createDataFrame([(*x, *range(7)) for x in docs], "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names)).repartition(4)
    clean = sorted(((*x, *range(7)) for x, y in zip(docs, brute(docs, items), strict=True) if not y[5]), key=str)
    out = decontaminate.remove_documents(table, benchmark)
    assert out.columns == table.columns and sorted(map(tuple, out.collect()), key=str) == clean
    out = decontaminate.remove_spans(table, benchmark)
    rows = out.collect()
    assert out.columns == table.columns and len(rows) == len(docs)
    assert sorted(len(words(r.text)) for r in rows) == sorted(y[1] - y[2] for y in brute(docs, items))
    untouched = {x for x, y in zip(docs, brute(docs, items), strict=True) if not y[5]}
    assert untouched <= {(r.doc_id, r.text) for r in rows}


def test_empty_tables(spark):
    docs, items = corpus()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    table = spark.createDataFrame(docs, "doc_id long, text string")
    assert decontaminate.contamination(table.limit(0), benchmark).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(table, benchmark.limit(0)).collect())
    assert decontaminate.remove_documents(table, benchmark.limit(0)).count() == len(docs)
