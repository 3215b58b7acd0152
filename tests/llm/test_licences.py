import hashlib
import os
import random
import re
import textwrap

import pytest

from sparkquill.llm import licences

PUBLISHED = "/usr/share/common-licenses"


def canonical(text):
    lines = []
    for line in text.lower().split("\n"):
        bare = line.lstrip(" \t\r#*/;-")
        states = re.match(r"(portions )?copyright[ \t:]*(©|\(c\)|&copy;|by\b|[\[<{(]?([0-9]{4}|yyyy|year))|©|\(c\)[ \t]*[0-9]{4}", bare)
        lines.append(" " if states or bare.strip() in ("all rights reserved", "all rights reserved.") else line)
    text = "\n".join(lines)
    body = re.sub(r"^[\W_]+", "", text)
    first, _, rest = body.partition("\n")
    if rest.strip() and re.fullmatch(r"(the )?([^\s:;]+[ \t]+){0,6}licen[cs]e([ \t]*[(v0-9].{0,20})?[ \t\r]*", first):
        text = rest.lstrip()
        text = re.sub(r"^version[ \t][0-9][^\n]{0,30}\n\s*", "", text)
        text = re.sub(r"^https?://\S+[ \t\r]*\n\s*", "", text)
    words = re.sub(r"[\W_]+", " ", text).split()
    ones = {a: b for a, b in licences.EQUIVALENT if " " not in a}
    words = [ones.get(w, w) for w in words]
    pairs = {tuple(a.split()): b.split() for a, b in licences.EQUIVALENT if " " in a}
    out = []
    while words:
        two = pairs.get(tuple(words[:2]))
        out += two or words[:1]
        words = words[2 if two else 1 :]
    return " ".join(out)


def test_scan_against_brute_force(spark):
    mit = licences.KNOWN[0][1]
    texts = ["Copyright (c) 2020 Somebody\n\n" + mit.upper().replace(",", " ,\n"), mit.replace("sublicense", "sub-licence").replace("NONINFRINGEMENT", "non-infringement"), mit + " more", "prose\nReleased under the MIT Licence\nlicensed under CC BY 4.0\nReleased under the MIT License.", "", None, "...", "© only", "word " * 40_000, "Released under the MIT license", "licence licence licence x", "sub sub licence non non commercial"]
    docs = spark.createDataFrame([(min(i, 8), t, "x") for i, t in enumerate(texts)], "doc_id long, text string, licence string").repartition(3)
    got = licences.scan(docs).collect()
    assert len(got) == len(texts)
    table = {hashlib.sha256(canonical(t).encode()).hexdigest(): i for i, t in licences.KNOWN}
    want = []
    for i, t in enumerate(texts):
        c = canonical(t or "")
        sha = hashlib.sha256(c.encode()).hexdigest() if c else None
        lines = [table.get(hashlib.sha256(canonical(x).encode()).hexdigest()) for x in (t or "").split("\n")]
        lines = [x for x in lines if x]
        want.append((min(i, 8), sha, table.get(sha), len(lines), ",".join(sorted(set(lines)))))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert [r.licence for r in got if r.doc_id in (0, 1)] == ["MIT", "MIT"]
    assert canonical("licence licence licence x") == "license license license x"
    assert licences.scan(docs.limit(0)).count() == 0


def test_files_as_people_keep_them(spark):
    draw, rows, want = random.Random(2), [], {}
    titles = {"MIT": ("MIT License", "The MIT License (MIT)"), "ISC": ("ISC License",), "BSD-3-Clause": ("BSD 3-Clause License", "The 3-Clause BSD License"), "Zlib": ("zlib License",)}
    for licence, text in licences.KNOWN:
        if licence not in titles or "\n" not in text:
            continue
        for width in (40, 60, 72, 79, 200):
            body = "\n\n".join(textwrap.fill(x, width) for x in text.split("\n"))
            owner = draw.choice(("Copyright (c) 2019 Jane Doe", "Copyright 2021-2024, The Foo Authors. All rights reserved.", "(c) 2003 X", "© Y", "Copyright (C) <year> <owner>\nAll rights reserved."))
            for file in (body, f"{owner}\n\n{body}", f"{draw.choice(titles[licence])}\n\n{owner}\n\n{body}\n", textwrap.indent(f"{owner}\n{body}", " * "), body.replace("License", "Licence").lower()):
                want[len(rows)] = licence
                rows.append((len(rows), file))
    for text in ("copyright notice and this permission notice", "MIT License", "Released under the MIT License\nand more"):
        want[len(rows)] = None
        rows.append((len(rows), text))
    got = licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.licence for r in got} == want


@pytest.mark.skipif(not os.path.isdir(PUBLISHED), reason="needs the published texts")
def test_published_texts(spark):
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "GFDL-1.3": "GFDL-1.3"}
    rows = []
    for file, name in names.items():
        with open(os.path.join(PUBLISHED, file), encoding="utf-8") as f:
            text = f.read()
        rows += [(name, text), (name, text.replace("http://", "https://").replace("\n", "\r\n")), (name, " ".join(text.split(" ")))]
    got = licences.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert all(r.licence == r.doc_id for r in got) and len(got) == len(rows)


def test_own_tables_meet_every_line(spark):
    own = licences.known(spark, (("House", "Ask before you copy."),))
    docs = spark.createDataFrame([(1, "prose\nask before you copy\nmore"), (2, "Ask, before you copy!")], "doc_id long, text string")
    got = {r.doc_id: r for r in licences.scan(docs, own).collect()}
    assert (got[1].licence, got[1].notices, got[2].licence) == (None, "House", "House")


def test_sql_is_the_same(spark):
    import duckdb

    odd = [t for _, t in licences.KNOWN] + ["licence licence x\nsub licence, sub-license non non commercial copyright owner owner\ncopyright notice\nCopyright 2020 X\n(c) 1999 b\nall rights reserved.\n", "élicence licenceé", "The X License v2\nVersion 2.0, now\nhttps://x.org/\nbody"]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(odd)))
    want = sorted(con.execute(licences.sql()).fetchall())
    docs = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    assert sorted(map(tuple, licences.scan(docs).collect())) == want


def test_known_notices_pass_the_line_filter():
    assert all(re.search(licences.NOTICE, t.lower()) for _, t in licences.KNOWN if "\n" not in t and len(t) < 120)
