"""Main text of web pages by site style trees.

The DOMs of a host's pages are merged by element path (tag, class and id words without digits). Every
element of this tree has two importances from entropies to the base of its number of pages ``m``:

* presentation: the entropy of its children's arrangement over the pages;
* content: one minus the mean entropy of the text blocks below it. A block on one page only has
  entropy 0, one that every page repeats has 1.

Their composite (presentation weighs ``1 - GAMMA``) is smoothed by a prior that counts as a fixed number
of pages, so a host's pages outweigh it: high in and at landmarks such as ``article``, low where a class
word leans towards what surrounds a text (``LEANING``), else weak, and lower on a host that uses landmarks.
Branches under ``THRESHOLD`` are removed, inside landmarks too; the blocks left are the page's text.

What the main text excludes by kind is no matter of repetition: elements that say by tag or class that
they are menus, adverts, notices, forms, reader comments, ... (``ASIDE_TAGS``, ``ASIDE_WORDS``) are no part
of the tree, and go also where each page has other text in them.

The tree is made by aggregation (host, path and block hash; nothing of a host is gathered in one task).
The paths it removes go back to the pages as 64-bit hashes, by host in broadcast slices of a checked size;
pages of hosts with more than ``WIDE`` such paths meet them in a shuffle by (host, path) instead.

Defined results: null and empty pages have an empty text. A null or hostless url counts as the host
``""``. Pages of a host that have, outside the excluded kinds, the same blocks at the same paths count
once in its tree, so copies make no page boilerplate; each still has its row, as repeated ``page_id``s
have. Further columns are ignored. Text is never cut.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkquill.llm.dom import Block, Element, blocks
from sparkquill.session import stored

GAMMA, THRESHOLD = 0.9, 0.3
#: Priors and the pages they count as: of elements that say nothing, on hosts without and with landmarks;
#: of landmarks and what is in them; of those that lean aside.
PRIOR, PRIOR_BESIDE, PRIOR_PAGES = 0.6, 0.2, 4
PRIOR_WITHIN, WITHIN_PAGES = 0.9, 30
PRIOR_LEANING, LEANING_PAGES = 0.0, 100
BROADCAST_BYTES = 32 << 20
#: Removed paths of a host that its pages may carry each.
WIDE = 4096

LANDMARKS = frozenset("article main".split())
ASIDE_TAGS = frozenset("nav footer aside form head button select menu dialog noscript template svg fieldset".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored cookie cookies consent notice notices notification gdpr sidebar aside nav navbar navigation menu breadcrumb breadcrumbs footer comment comments respond replies newsletter subscribe subscription signup popup modal login pagination pager".split()
)
HEADER_WORDS = frozenset("header masthead topbar".split())
LEANING = frozenset("promo promotion banner alert share sharing social related recommended overlay search toolbar widget disclaimer".split())
#: What an element says of itself.
_NOTHING, _WITHIN, _LEANS = range(3)


def aside(element: Element, in_landmark: bool) -> bool:
    """Whether an element says that it is of an excluded kind."""
    if element.tag in LANDMARKS or element.tag in ("html", "body"):
        return False
    if element.tag in ASIDE_TAGS or element.words & ASIDE_WORDS:
        return True
    return not in_landmark and (element.tag == "header" or bool(element.words & HEADER_WORDS))


def candidates(found: list[Block]) -> list[Block]:
    """The blocks that stand in no element of an excluded kind."""
    state: dict[str, tuple[bool, bool]] = {"": (True, False)}  # path: kept, in a landmark

    def of(parents: tuple[Element, ...]) -> tuple[bool, bool]:
        if not parents:
            return state[""]
        path = parents[-1].path
        if path not in state:
            keep, inside = of(parents[:-1])
            state[path] = (keep and not aside(parents[-1], inside), inside or parents[-1].tag in LANDMARKS)
        return state[path]

    return [b for b in found if of(b.parents)[0]]


def path_hash(path: str) -> int:
    return xxhash.xxh3_64_intdigest(path.encode("utf-8", "surrogatepass")) - (1 << 63)


def kept(found: list[Block], removed: frozenset[int]) -> list[str]:
    """The texts of candidate blocks that stand in no removed branch (named by path hashes)."""
    there = candidates(found)
    if not removed:
        return [b.text for b in there]
    gone: dict[str, bool] = {}

    def cut(parents: tuple[Element, ...]) -> bool:
        if not parents:
            return False
        path = parents[-1].path
        if path not in gone:
            gone[path] = path_hash(path) in removed or cut(parents[:-1])
        return gone[path]

    return [b.text for b in there if not cut(b.parents)]


def _host(url) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", 1))


_PAGES = "host string, digest binary, landmark boolean, paths array<string>, says array<int>, styles array<boolean>, features array<int>"
_NODES = "host string, path string, landmark boolean, says int, style boolean, feature int, n long"


def page_nodes(found: list[Block]) -> list[tuple[str, int, bool, int]]:
    """(path, what it says, style, feature) of candidate blocks: arrangements and texts of elements."""
    seen = set()
    children: dict[tuple[str, int], list[str]] = {}
    for b in found:
        inside, leans = False, False
        for k, e in enumerate(b.parents):
            inside, leans = inside or e.tag in LANDMARKS, leans or bool(e.words & LEANING)
            key = (e.path, _LEANS if leans else _WITHIN if inside else _NOTHING)
            below = b.parents[k + 1].name if k + 1 < len(b.parents) else "#text"
            kids = children.setdefault(key, [])
            if not kids or kids[-1] != below:
                kids.append(below)
            if k == len(b.parents) - 1:
                seen.add((*key, False, hash_of(b.text)))
    seen.update((*key, True, hash_of("/".join(kids))) for key, kids in children.items())
    return list(seen)


def page_digest(found: list[Block]) -> bytes:
    """Names a page's blocks with their paths."""
    h = xxhash.xxh3_128()
    for b in found:
        for x in (b.parents[-1].path if b.parents else "", b.text):
            h.update(x.encode("utf-8", "surrogatepass"))
            h.update(b"\0")
    return h.digest()


def style_tree(pages: DataFrame, distinct: bool = False) -> DataFrame:
    """(host, path, m, presentation, content, importance) of every element of no excluded kind.

    ``distinct`` counts the pages of a host that have the same blocks at the same paths once.
    """

    def read(batches):
        met = set()  # copies within a task are not sent
        for batch in batches:
            rows = []
            for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                found = blocks(html)
                landmark = any(e.tag in LANDMARKS for b in found for e in b.parents)
                found = candidates(found)
                digest = page_digest(found) if distinct else None
                if distinct:
                    key = xxhash.xxh3_128_digest(digest + host.encode("utf-8", "surrogatepass"))
                    if key in met:
                        continue
                    met.add(key)
                if nodes := page_nodes(found):
                    rows.append((host, digest, landmark, *zip(*nodes, strict=True)))
            cols = zip(*rows, strict=True) if rows else [[]] * 7
            kinds = (pa.string(), pa.binary(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], ["host", "digest", "landmark", "paths", "says", "styles", "features"])

    def count(batches):
        met = set()
        for batch in batches:
            n: Counter = Counter()
            for host, digest, landmark, *nodes in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if distinct:
                    if (host, digest) in met:
                        continue
                    met.add((host, digest))
                for path, says, style, feature in zip(*nodes, strict=True):
                    n[host, path, landmark, says, style, feature] += 1
            rows = [(*k, x) for k, x in n.items()]
            cols = zip(*rows, strict=True) if rows else [[]] * 7
            kinds = (pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.bool_(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["host", "path", "landmark", "says", "style", "feature", "n"])

    each_page = pages.select(_host(F.col("url")).alias("host"), "html").mapInArrow(read, _PAGES)
    if distinct:
        each_page = each_page.repartition("host", "digest")  # all copies of a page meet in one task
    rows = each_page.mapInArrow(count, _NODES)
    each = rows.groupBy("host", "path", "style", "feature").agg(F.sum("n").alias("n"), F.max("landmark").alias("landmark"), F.max("says").alias("says"))
    own = each.groupBy("host", "path").agg(
        F.sum(F.when(F.col("style"), F.col("n")).otherwise(0)).alias("m"),
        F.sum(F.when(F.col("style"), F.col("n") * F.ln("n")).otherwise(0.0)).alias("styles"),
        F.sum(F.when(F.col("style"), 0.0).otherwise(F.ln("n"))).alias("repeats"),
        F.sum(F.when(F.col("style"), 0).otherwise(1)).alias("texts"),
        F.max("landmark").alias("landmark"),
        F.max("says").alias("says"),
    )
    # Texts of a branch are those of all elements in it.
    parts = F.split("path", "/")
    above = own.select("host", "repeats", "texts", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("path"))
    branch = above.groupBy("host", "path").agg(F.sum("repeats").alias("repeats"), F.sum("texts").alias("texts"))
    tree = own.select("host", "path", "m", "styles", "landmark", "says").join(branch, ["host", "path"])
    log_m = F.when(F.col("m") > 1, F.ln("m"))
    presentation = F.coalesce(1 - F.col("styles") / F.col("m") / log_m, F.lit(1.0))
    content = F.coalesce(1 - F.least(F.lit(1.0), F.try_divide("repeats", F.col("texts") * log_m)), F.lit(1.0))
    composite = (1 - GAMMA) * presentation + GAMMA * content
    prior = F.when(F.col("says") == _LEANS, PRIOR_LEANING).when(F.col("says") == _WITHIN, PRIOR_WITHIN).when(F.col("landmark"), PRIOR_BESIDE).otherwise(PRIOR)
    weight = F.when(F.col("says") == _LEANS, LEANING_PAGES).when(F.col("says") == _WITHIN, WITHIN_PAGES).otherwise(PRIOR_PAGES)
    return tree.select("host", "path", "m", presentation.alias("presentation"), content.alias("content"), ((F.col("m") * composite + weight * prior) / (F.col("m") + weight)).alias("importance"))


def hash_of(text: str) -> int:
    """31 bits that name a block or an arrangement within an element."""
    from zlib import crc32

    return crc32(text.encode("utf-8", "surrogatepass")) & 0x7FFFFFFF


_TEXT = "page_id long, url string, text string, n_chars long"


def main_text(pages: DataFrame, threshold: float = THRESHOLD, broadcast_bytes: int = BROADCAST_BYTES, wide: int = WIDE) -> DataFrame:
    """Per page row: page_id, url, text, n_chars."""
    tree = style_tree(pages, distinct=True).where((F.col("importance") < threshold) & ~F.col("path").isin("html", "html/body", "body"))

    def hashed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array([path_hash(x) for x in batch.column("path").to_pylist()], pa.int64())], ["host", "path"])

    low = stored(tree.select("host", "path").mapInArrow(hashed, "host string, path long"), "site-style")
    hosts = low.groupBy("host").agg(F.count(F.lit(1)).alias("paths"))
    size = hosts.agg(F.sum(F.when(F.col("paths") <= wide, 200 + F.octet_length("host") + 8 * F.col("paths"))).alias("bytes"), F.count(F.when(F.col("paths") > wide, 1)).alias("wide")).first()
    slices = -(-max(size["bytes"] or 1, 1) // broadcast_bytes)

    def text(batches):
        for batch in batches:
            out = ["\n".join(kept(blocks(html), frozenset(x or ()))) for html, x in zip(batch.column("html").to_pylist(), batch.column("removed").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    every = low
    rows, done = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", _host(F.col("url")).alias("host")), None
    if size["wide"]:
        found = stored(hosts.where(F.col("paths") > wide).select("host"), "site-style-wide")
        mine = stored(rows.join(found, "host", "left_semi").withColumn("row", F.monotonically_increasing_id()), "site-style-pages")
        rows, low = rows.join(found, "host", "left_anti"), low.join(found, "host", "left_anti")

        def paths(batches):
            for batch in batches:
                its = [sorted({path_hash(e.path) for b in candidates(blocks(html)) for e in b.parents}) for html in batch.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("host"), pa.array(its, pa.list_(pa.int64()))], ["row", "host", "paths"])

        its = mine.select("row", "host", "html").mapInArrow(paths, "row long, host string, paths array<long>").select("row", "host", F.explode("paths").alias("path"))
        its = its.join(every, ["host", "path"]).groupBy("row").agg(F.collect_list("path").alias("removed"))
        done = mine.join(its, "row", "left").select("page_id", "url", "html", "removed").mapInArrow(text, _TEXT)
    low = low.groupBy("host").agg(F.collect_list("path").alias("removed"))
    for k in range(slices):
        mine = rows if slices == 1 else rows.where(F.pmod(F.xxhash64("host"), F.lit(slices)) == k)
        part = low if slices == 1 else low.where(F.pmod(F.xxhash64("host"), F.lit(slices)) == k)
        got = mine.join(F.broadcast(part), "host", "left").select("page_id", "url", "html", "removed").mapInArrow(text, _TEXT)
        done = got if done is None else done.unionByName(got)
    return done
