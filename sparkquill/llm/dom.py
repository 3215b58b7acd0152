"""A small forgiving HTML reader: blocks of text with the path of block elements above each."""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple

import xxhash

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_BROKEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|$)")
_CLASS = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_DIGITS = re.compile(r"[0-9]+")
_PARTS = re.compile(r"[\s_-]+")

#: Elements whose content is no markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that stand within a line of text; all others bound blocks.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: An element that ends when one of these begins.
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
#: Open block elements at most; one that would be deeper stands beside the deepest, as in browsers.
MAX_DEPTH = 400
#: Class names up to this length are part of an element's name as they are, longer ones as a hash.
MAX_NAME = 120
_SCOPES = frozenset("ul ol dl table article section div main body html nav aside footer header form".split())


class Element(NamedTuple):
    """A block element: its tag, tag with class, path from the root, and class and id words."""

    tag: str
    name: str
    path: str
    words: frozenset[str]


class Block(NamedTuple):
    """Text between block boundaries; ``parents`` are the open elements, outermost first."""

    parents: tuple[Element, ...]
    text: str


def _attributes(raw: str) -> tuple[str, frozenset[str]]:
    if "=" not in raw:
        return "", frozenset()
    found = [a or b or c for a, b, c in _CLASS.findall(raw)]
    words = frozenset(w for x in found for w in _PARTS.split(x.lower()) if w)
    return ("." + ".".join(sorted(_DIGITS.sub("0", x.lower()).replace("/", "") for x in found)).replace(" ", ".") if found else ""), words


def blocks(html: str | None, attribute_sink=None) -> list[Block]:
    """All blocks with text, in page order; character references decoded, white space made single.

    ``attribute_sink(tag, raw_attributes)`` is called for every start tag and may return text that
    stands in its place.
    """
    html = html or ""
    out: list[Block] = []
    stack: list[Element] = []
    line: list[str] = []

    def flush() -> None:
        if line:
            text = "".join(line)
            line.clear()
            if "&" in text:
                text = unescape(text)
            if text := " ".join(text.split()):
                out.append(Block(tuple(stack), text))

    def close(tags: set[str] | frozenset[str], stop: frozenset[str]) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k].tag in tags:
                del stack[k:]
                return
            if stack[k].tag in stop:
                return

    at, size = 0, len(html)
    while at < size:
        lt = html.find("<", at)
        if lt < 0:
            line.append(html[at:])
            break
        if lt > at:
            line.append(html[at:lt])
        m = _TAG.match(html, lt) or _BROKEN.match(html, lt)
        if m is None:
            if html.startswith("<!--", lt):
                end = html.find("-->", lt + 4)
                at = size if end < 0 else end + 3
            elif html.startswith(("<!", "<?", "</"), lt):
                end = html.find(">", lt)
                at = size if end < 0 else end + 1
            else:
                line.append("<")
                at = lt + 1
            continue
        ends, tag, raw = m[1], m[2].lower(), m[3]
        at = m.end()
        if not ends and attribute_sink and (put := attribute_sink(tag, raw)) is not None:
            line.append(put)
        if tag in INLINE:
            if tag == "br":
                line.append(" ")
            continue
        flush()
        if ends:
            if any(e.tag == tag for e in stack):
                close({tag}, frozenset())
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}", re.IGNORECASE).search(html, at)
            gt = html.find(">", end.end()) if end else -1
            at = gt + 1 if gt >= 0 else size
            continue
        if tag in VOID:
            continue
        if tag in ENDED_BY:
            close(ENDED_BY[tag], _SCOPES)
        close({"p"}, _SCOPES)
        if raw.endswith("/"):
            continue
        name, words = _attributes(raw)
        if len(name) > MAX_NAME:
            name = f".{xxhash.xxh3_64_hexdigest(name.encode('utf-8', 'surrogatepass'))}"
        if len(stack) == MAX_DEPTH:
            stack.pop()
        stack.append(Element(tag, tag + name, (stack[-1].path + "/" if stack else "") + tag + name, words))
    flush()
    return out
