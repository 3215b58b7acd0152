import math
import random
from collections import defaultdict

from sparkquill.llm import dom, site_style


def texts(html):
    return [b.text for b in dom.blocks(html)]


def test_reader():
    assert texts("<p>a &amp; b<br>c\n\n d<p>e</p>f") == ["a & b c d", "e", "f"]
    assert texts("<title>x</title><script>var t='</p>';</script><!-- <p>no --><div>a<b>b</b> <i>c") == ["ab c"]
    assert texts("1 < 2 <3 <a href='x>y'>z</a") == ["1 < 2 <3 z"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul></ul><table><tr><td>1<td>2</table>") == ["a", "b", "c", "1", "2"]
    assert texts(None) == texts("") == [] and texts("<div " + 'a="' * 5000) == []
    assert texts("<p>" * 3000 + "deep") == ["deep"] and len(texts("<div>" * 500 + "x")) == 1
    assert dom.blocks('<div class="post 123" id=top><p>t')[0].parents[-1].path == "div.post.0.top/p"
    deep = dom.blocks("<div>a" * 5000 + "</div>b" * 5000)
    assert [b.text for b in deep] == ["a"] * 5000 + ["b"] * 5000 and max(len(b.parents) for b in deep) == dom.MAX_DEPTH
    assert site_style.kept(deep, frozenset()) == [b.text for b in deep] and site_style.page_nodes(deep)
    assert len(dom.blocks(f"<div class='{'x' * 9000}'>t")[0].parents[0].path) < 200
    assert texts("a&nbsp;&lt;b&gt; &#233; &unknown;") == ["a <b> é &unknown;"]


PAGE = '<!DOCTYPE html><html><head><title>t</title></head><body><nav><ul><li>{n}</li></ul></nav><div class="ad-box">Buy {n}</div>{body}<div class="x">Follow us everywhere</div><footer>&copy; {n}</footer></body></html>'


def test_roles_and_repeated_branches(spark):
    draw = random.Random(1)
    word = lambda: "".join(draw.choice("abcdef") for _ in range(6))
    rows, want = [], {}
    for i in range(60):
        head, one, two = word(), word() + " &lt;" + word(), word() + "\n  " + word()
        if i % 2:
            body = f"<article><header><h1>{head}</h1></header><p>{one}</p><p>{two}<div class='comments'><p>{word()}</p></div><form><p>f</p></form><aside>s</aside></article>"
            url = f"http://a.example/{i}"
        else:
            body = f"<div class='text'><h2>{head}</h2><p>{one}<p>{two}</div>"
            url = f"https://user@b.example:80/{i}"
        rows.append((i, url, PAGE.format(n=word(), body=body), "x"))
        want[i] = "\n".join((head, one.replace("&lt;", "<"), " ".join(two.split())))
    rows += [(100, None, None, "x"), (101, "not a url", "", "x"), (102, "http://one.example/", "<p>only page</p>", "x"), (1, "http://a.example/1", rows[1][2], "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string").repartition(3)
    for limit, wide in ((site_style.BROADCAST_BYTES, site_style.WIDE), (150, site_style.WIDE), (1 << 20, 0)):
        got = site_style.main_text(pages, broadcast_bytes=limit, wide=wide).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r.text == want.get(r.page_id, {100: "", 101: "", 102: "only page"}.get(r.page_id)), r
            assert r.n_chars == len(r.text)
    assert site_style.main_text(pages.limit(0)).count() == 0


def test_importance_against_brute_force(spark):
    draw = random.Random(4)
    pages = [(i, f"http://h{i % 3}.example/x", "<html><body>" + "".join(f"<div class='c{draw.randint(0, 1)}x'><p>{draw.choice('abcd')}</p></div>" for _ in range(draw.randint(1, 3))) + "<section>same</section></body></html>") for i in range(30)]
    got = {(r.host, r.path): r for r in site_style.style_tree(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for host in {r[0] for r in got}:
        styles, features = defaultdict(lambda: defaultdict(set)), defaultdict(lambda: defaultdict(set))
        for i, url, html in pages:
            if host not in url:
                continue
            kids = defaultdict(list)
            for b in dom.blocks(html):
                for k, e in enumerate(b.parents):
                    name = b.parents[k + 1].name if k + 1 < len(b.parents) else "#text"
                    if not kids[e.path] or kids[e.path][-1] != name:
                        kids[e.path].append(name)
                    features[e.path][b.parents[-1].path, b.text].add(i)
            for path, x in kids.items():
                styles[path][tuple(x)].add(i)
        for path, by in styles.items():
            m = len(set().union(*by.values()))
            p = [len(x) / m for x in by.values()]
            presentation = -sum(x * math.log(x, m) for x in p)
            content = 1 - min(1, sum(math.log(len(x), m) for x in features[path].values()) / len(features[path]))
            want = (m * (0.1 * presentation + 0.9 * content) + 4 * 0.6) / (m + 4)
            assert got[host, path].m == m and abs(got[host, path].importance - want) < 1e-9, path


def test_copies_keep_their_article_text(spark):
    page = "<body><div class=text><p>{0} is told</p><p>and {0} goes on</p></div><div class=x>Follow us</div></body>"
    rows = [(i, "http://five.example/", page.format("one")) for i in range(5)]
    rows += [(100 + i, f"http://ten.example/{i}", page.format(f"story {i % 10}")) for i in range(600)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    got = {r.page_id: r.text for r in site_style.main_text(pages).collect()}
    assert len(got) == len(rows)
    assert all(got[i].startswith("one is told\nand one goes on") for i in range(5))
    assert all(got[100 + i] == f"story {i % 10} is told\nand story {i % 10} goes on" for i in range(600))


def test_entropies_decide_inside_landmarks_and_of_leaning_words(spark):
    draw = random.Random(6)
    word = lambda: " ".join("".join(draw.choice("abcdef") for _ in range(6)) for _ in range(4))
    rows, want, off = [], {}, {}
    for i in range(300):
        told, more, tip = word(), word(), word()
        body = f"<main><h1>{told}</h1><div class=x>Follow us</div><p>{more}</p><div class='alert box'>{tip}</div><div class=share>Share this</div><div class=comments>{word()}</div></main>"
        rows.append((i, f"http://a.example/{i}", f"<body><nav>{word()}</nav>{body}<div class=ad>{word()}</div></body>"))
        want[i] = f"{told}\n{more}\n{tip}"  # repeated blocks go, own prose under a leaning word stays
        off[i] = f"{told}\nFollow us\n{more}\n{tip}\nShare this"
    for i in range(300, 305):  # few pages do not outweigh a prior
        rows.append((i, "http://few.example/", f"<body><article><h1>{i}</h1><div class=x>Follow us</div></article><div class=alert>{i} {i}</div></body>"))
        want[i] = off[i] = f"{i}\nFollow us"
    for i in range(305, 505):  # an article copied under other menus and adverts is no boilerplate
        rows.append((i, "http://copies.example/", f"<body><nav>{i}</nav><div class=ad>{word()}</div><article><h1>One</h1><p>story</article></body>"))
        want[i] = off[i] = "One\nstory"
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    assert {r.page_id: r.text for r in site_style.main_text(pages).collect()} == want
    untreed = {i: "\n".join(site_style.kept(dom.blocks(html), frozenset())) for i, _, html in rows}
    assert {i: x for i, x in untreed.items() if i < 300} == {i: x for i, x in off.items() if i < 300}
