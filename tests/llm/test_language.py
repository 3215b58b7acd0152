import math
import random
import re
from collections import Counter

from sparkquill.llm import language

WORDS = {"en": "the of and that with from have were which".split(), "de": "der die und nicht mit auch eine über für".split(), "fr": "le la les être avec pour dans où déjà".split()}


def text(draw, lang, n):
    return " ".join(draw.choice(WORDS[lang]) for _ in range(n))


def test_fusion(spark):
    draw = random.Random(1)
    docs = spark.createDataFrame([(i, text(draw, x, 40), x) for i, x in enumerate(list(WORDS) * 30)] + [(900, None, "en"), (901, "??", None)], "doc_id long, text string, lang string")
    rows, want = [], {}
    for i in range(120):
        lang = draw.choice(list(WORDS))
        declared = lang if draw.random() < 0.9 else draw.choice(("en", "zz"))
        rows.append((i, f"http://{lang}{draw.randint(0, 1)}.site{draw.randint(0, 2)}.example/{lang}/{i}", f'<html lang="{declared}-XX"><body><nav>{text(draw, "en", 9)}</nav><article><p>{text(draw, lang, 12)}</p></article></body></html>', "k"))
        want[i] = lang
    rows += [(200, "http://de0.site1.example/x", "<html><body><article></article></body></html>", "k"), (201, None, None, "k"), (202, "http://other.example.de/", "", "k"), (203, "http://fr1.site0.example/", '<html lang="fr"><body><p>' + text(draw, "de", 4000) + "</p></body></html>", "k"), (0, *rows[0][1:])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, lang string").repartition(3)
    got = language.identify(pages, docs).collect()
    assert len(got) == len(rows) and all(0 < r.probability <= 1 + 1e-9 for r in got)
    by = {r.page_id: r for r in got}
    assert all(by[i].lang == x for i, x in want.items())
    assert by[200].lang == "de" and by[200].text_lang is None
    assert by[202].lang == "de" and by[202].address == "de" and by[203].lang == "de"
    assert by[201].lang in WORDS and by[201].declared is None
    assert language.identify(pages.limit(0), docs).count() == 0
    assert {r.lang for r in language.identify(pages, docs.limit(0)).collect()} == {None}


def test_posteriors_against_brute_force(spark):
    draw = random.Random(9)
    docs = [(i, text(draw, x, 30), x) for i, x in enumerate(list(WORDS) * 8)] + [(3, text(draw, "en", 5), "de")]
    pages = []
    for i in range(50):
        lang = draw.choice(list(WORDS))
        says = draw.choice(("", f' lang="{lang}"', ' lang="zz"'))
        body = f"<p>{text(draw, lang, draw.choice((0, 1, 2, 30)))}</p>"
        pages.append((i, f"http://h{draw.randint(0, 3)}.s{draw.randint(0, 1)}.{draw.choice(('com', 'de'))}/{draw.choice((lang + '/', '', 'fr/'))}{i}", f"<html{says}><body>{body}</body></html>"))
    got = {r.page_id: r for r in language.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()}

    names = [x for x, _ in sorted(Counter(x for _, _, x in docs).items(), key=lambda x: (-x[1], x[0]))]
    counts = {x: Counter(b for _, t, y in docs if y == x for b in language.trigrams(t).tolist()) for x in names}
    evidence = []
    for _, url, html in pages:
        grams = language.trigrams(re.search("<p>(.*)</p>", html)[1]).tolist()
        logs = [sum(math.log((counts[x][g] + 0.5) / (counts[x].total() + 0.5 * language.BUCKETS)) for g in grams) / max(1, len(grams)) * 40 * math.log(1 + len(grams) / 40) for x in names]
        p = [math.exp(x - max(logs)) for x in logs]
        said = re.search('<html lang="(..)"', html)
        said = (said[1] if said[1] in names else "other") if said else None
        host = url.split("/")[2]
        path = re.search(r"//[^/]*/(en|de|fr)/", url)
        address = path[1] if path else "de" if host.endswith(".de") else None
        evidence.append((logs, [x / sum(p) for x in p], said, address, host, ".".join(host.split(".")[-2:])))
    total = lambda keep: ([sum(e[1][k] for e in evidence if keep(e)) for k in range(3)], sum(map(keep, evidence)))
    n, rows = total(lambda e: True)
    world = [(x + 1) / (rows + 3) for x in n]
    for (i, _, _), (logs, _, said, address, host, domain) in zip(pages, evidence, strict=True):
        n, rows = total(lambda e, d=domain: e[5] == d)
        prior = [(x + 20 * w) / (rows + 20) for x, w in zip(n, world, strict=True)]
        n, rows = total(lambda e, h=host: e[4] == h)
        prior = [(x + 5 * w) / (rows + 5) for x, w in zip(n, prior, strict=True)]
        score = [a + math.log(b) for a, b in zip(logs, prior, strict=True)]
        for at, value in ((2, said), (3, address)):
            if value is not None:
                n, _ = total(lambda e, a=at, v=value: e[a] == v)
                whole, _ = total(lambda e, a=at: e[a] is not None)
                score = [s + math.log((x + 2) / (w + 2 * 4)) for s, x, w in zip(score, n, whole, strict=True)]
        p = [math.exp(x - max(score)) for x in score]
        assert got[i].lang == names[score.index(max(score))] and (got[i].declared, got[i].address) == (said, address)
        assert abs(got[i].probability - 1 / sum(p)) < 1e-4, i
