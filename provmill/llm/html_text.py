"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams a page's events.  Every block of text is
a line with the characters it has and the tags read since the line before.  The
ratios, weighted by what the elements around a line say about it, are smoothed
with a Gaussian; lines above a threshold drawn from their spread are content,
wherever they are.  The outermost article or main element that holds almost all
content, else the smallest element that does, is the article, and all its blocks
are taken, the short ones too, but for those in elements that are something
else.

An element is something else by its tag or by a whole name in its attributes.
A word that is only part of a name, or that has other meanings, halves a line's
ratio, and the threshold decides.  A name says nothing on an element that has
the page's article in it: one that holds a heading of the first order, an
article or main element, or nine tenths of the page's text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from provmill.llm.common import arrow_map, text_column, texts

#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that stand in a line of text; all others start a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter q ruby rb rp rt rtc s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that never hold the article's text.
ASIDE = frozenset("head title script style noscript template nav footer aside form button select textarea svg iframe object canvas menu dialog".split())
#: Words in class, id, role, data-role or aria-label that may mark an element as something else.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adbox sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup paywall nav navbar navigation menu menubar breadcrumb breadcrumbs toc pagination pager sidebar side rail widget widgets footer masthead comment comments commentlist respond replies reply disqus discussion social share sharing related recommended recommendations toolbar search login complementary contentinfo".split()
)
#: Those of them that alone are a name of something else; the others have other meanings too.
NAMES = frozenset("ad ads advert adverts advertisement adbox sponsored gdpr newsletter signup paywall nav navbar navigation menubar breadcrumb breadcrumbs pagination pager sidebar footer masthead comments commentlist disqus toolbar complementary contentinfo".split())
#: Words that with a mark make up a name.
PLACES = frozenset("site page main left right top bottom global primary secondary post article container wrapper box block list area section links bar buttons form".split())
#: What roles make an element something else.
ROLES = frozenset("navigation complementary contentinfo search banner menu menubar toolbar alert alertdialog dialog".split())
#: What a line's mark leaves of its ratio: nothing said, something else perhaps, something else.
WEIGHTS = (1.0, 0.5, 0.0)
#: What an open p ends before.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section table ul dd dt td th tr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_MARKED = ("class", "id", "role", "data-role", "aria-label")
_SPLIT = re.compile(r"[^a-z0-9]+")
_SPREAD = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


def _is_name(words: list[str]) -> bool:
    """Whether a whole token names something else: nothing but marks and places, and a sure mark or several."""
    marks = [w for w in words if w in MARKS]
    return bool(marks) and (len(marks) > 1 or not NAMES.isdisjoint(marks)) and all(w in MARKS or w in PLACES for w in words)


def _mark(tag: str, attrs: list[tuple[str, str | None]]) -> int:
    """2 if the element is something else, 1 if it may be, 0 if nothing says so."""
    mark = 0
    for name, value in attrs:
        if name == "hidden" or name == "style" and value and "display:none" in value.replace(" ", "").lower() or name == "aria-hidden" and value == "true":
            return 2
        if name not in _MARKED or not value:
            continue
        if name == "role" and not ROLES.isdisjoint(value.lower().split()):
            return 2
        if name == "id" and tag in HEADINGS:
            continue  # made from the heading's words
        for token in [value] if name == "aria-label" else value.split():
            words = [w for w in _SPLIT.split(_SPREAD.sub(" ", token).lower()) if w]
            if _is_name(words):
                return 2
            if not MARKS.isdisjoint(words):
                mark = 1
    return mark


class _Lines(HTMLParser):
    """Collects lines (text, characters, tags since the line before, innermost element) and the tree of elements, each with a number above its parent's."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int]] = []
        self.names, self.parent, self.marks = [""], [0], [0]  # the page itself
        self.named = [False]  # marked by a name, not by the tag
        self.stack = [0]
        self.open: Counter = Counter()
        self.data: list[str] = []
        self.tags = 0

    def flush_block(self) -> None:
        if self.data:
            text = " ".join("".join(self.data).split())
            self.data = []
            if text:
                self.lines.append((text, len(text), self.tags, self.stack[-1]))
                self.tags = 0

    def name(self, i: int) -> str:
        return self.names[self.stack[i]]

    def nearest(self, wanted: tuple[str, ...], stop) -> int:
        """Place in the stack of the innermost open element of a name, 0 if there is none before one to stop at."""
        if any(self.open[w] for w in wanted):
            for i in range(len(self.stack) - 1, 0, -1):
                if self.name(i) in wanted:
                    return i
                if stop(self.name(i)):
                    break
        return 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag == "br":
            self.data.append(" ")
            return
        if tag in ENDS_P and (i := self.nearest(("p",), lambda name: name not in INLINE)):
            self.close_to(i)
        if tag not in INLINE:
            self.flush_block()
        if tag in ("li", "dd", "dt", "td", "th", "tr", "option"):  # end tags of these may be left out
            scope = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",)}.get(tag, ("table",) if tag == "tr" else ("tr", "table"))
            same = ("dd", "dt") if tag in ("dd", "dt") else ("td", "th") if tag in ("td", "th") else (tag,)
            if i := self.nearest(same, lambda name: name in scope):
                self.close_to(i)
        if tag in VOID:
            return
        by_tag = tag in ASIDE or tag == "header" and not self.open["article"]
        mark = 2 if by_tag else 0 if tag in ("html", "body", "article", "main") else _mark(tag, attrs)
        if mark:
            self.flush_block()
        self.names.append(tag)
        self.parent.append(self.stack[-1])
        self.marks.append(mark)
        self.named.append(mark == 2 and (not by_tag or tag == "form"))
        self.stack.append(len(self.names) - 1)
        self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.name(-1) == tag:
            self.handle_endtag(tag)

    def close_to(self, i: int) -> None:
        if any(self.names[e] not in INLINE or self.marks[e] for e in self.stack[i:]):
            self.flush_block()
        for e in self.stack[i:]:
            self.open[self.names[e]] -= 1
        del self.stack[i:]

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if i := self.nearest((tag,), lambda name: tag in INLINE and name not in INLINE):
            self.close_to(i)
        elif tag not in INLINE:
            self.flush_block()

    def handle_data(self, data: str) -> None:
        if self.name(-1) not in ("script", "style", "title", "template", "noscript"):
            self.data.append(data)

    def up(self, values: list[int]) -> list[int]:
        """Of each element the sum of the values of all that it holds, itself included."""
        out = list(values)
        for e in range(len(out) - 1, 0, -1):
            out[self.parent[e]] += out[e]
        return out

    def weighed(self) -> list[int]:
        """Of each element the greatest mark of it and what it is in; names on what has the article in it don't count."""
        chars = [0] * len(self.names)
        for _, n, _, e in self.lines:
            chars[e] += n
        held, heads = self.up(chars), self.up([int(name in ("h1", "article", "main")) for name in self.names])
        out = [0] * len(self.names)
        for e in range(1, len(out)):
            about = heads[e] or self.names[e] != "form" and not self.named[e] or held[e] >= 0.9 * held[0]
            own = 0 if self.named[e] and about else self.marks[e]
            out[e] = max(out[self.parent[e]], own)
        return out


def smooth(values: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian weights within two sigma; at the ends of those that are there."""
    r = max(1, math.ceil(2 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(values, kernel)[r : r + len(values)] / np.convolve(np.ones(len(values)), kernel)[r : r + len(values)]


def main_text(html: str, share: float = 0.9, sigma: float = 1.0) -> str:
    """The article's blocks, one a line; empty if there is none."""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser.flush_block()
    lines, names, parent = parser.lines, parser.names, parser.parent
    if not lines:
        return ""
    marks = parser.weighed()
    ratio = np.array([WEIGHTS[marks[e]] * n / max(1, tags) for _, n, tags, e in lines])
    level = smooth(ratio, sigma)
    content = (level > 0.5 * level.std()) & (ratio > 0)
    if not content.any():
        content = ratio > 0
    if not content.any():
        return ""
    own = [0] * len(names)
    for i in np.flatnonzero(content).tolist():
        own[lines[i][3]] += lines[i][1]
    held = parser.up(own)

    def innermost(least: float) -> int:
        """The last element to open that holds so many characters of content."""
        return max(e for e, n in enumerate(held) if n >= least)

    outer: dict[str, int] = {}
    e = innermost(share * held[0])
    while e:
        if names[e] in ("article", "main"):
            outer[names[e]] = e
        e = parent[e]
    article = outer.get("article", outer.get("main", 0)) or innermost(share * held[0])
    if names[article] not in ("div", "section", "td", "body", "html", "main", "article"):  # a block or a list of the article
        while article and names[article] not in ("div", "section", "td", "body", "html"):
            article = parent[article]
    inside = [False] * len(names)
    for e in range(len(names)):
        inside[e] = e == article or e > 0 and inside[parent[e]]
    return "\n".join(text for (text, _, _, e), taken in zip(lines, content.tolist(), strict=True) if taken or not marks[e] and inside[e])


def extract(df: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep``, text and n_chars (code points) of each row.

    Null and empty pages, and pages without an article, have an empty text.
    Rows are neither merged nor dropped; an empty table gives an empty result.
    """
    schema = T.StructType([df.schema[k] for k in keep]).add("text", "string").add("n_chars", "long")

    def make(batch: pa.RecordBatch) -> dict:
        found = [main_text(h) for h in texts(batch, "__html")]
        return {k: batch.column(i) for i, k in enumerate(keep)} | {"text": found, "n_chars": list(map(len, found))}

    return arrow_map(df.select(*keep, text_column(df, html).alias("__html")), make, schema)
