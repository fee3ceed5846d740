"""Operator 8: main text of a web page by text-to-tag ratios over standard-library parser events.

The page is fed to the parser piece by piece, and its events are read as a stream into lines, one for each block, with the numbers of characters, of characters in links and of
tags of each. The page's lines are then judged by numbers:

1. A line's ratio is its text outside links over its tags.
2. The ratios are smoothed by a Gaussian along the page. Lines of a marked element are smoothed among themselves.
3. The score is the logarithm of the smoothed ratio times the line's weight: elements, roles and class names of menus, headers, footers, sidebars, notices, adverts, forms and reader
   comments lower it (LOWERED, or HINTED inside an article for words and ids that may have another meaning there), article and main elements raise it (RAISED).
4. The threshold that parts the scores in two groups of the least variance inside clusters the lines in high and low. Lines within NEAR of the score at which half of the text stands are high
   too, as are lines of an article that aren't lowered and have a smoothed ratio of ENOUGH, and all lines if the groups' means are less than APART apart. Text counts by its weight if that is under 1, and
   what is lowered outside of an article must have a weighed ratio of LEAST.
5. Regions run from a high line to a high line of more text than links; what is high, or is text that isn't lowered, between two such lines belongs to the region. If article or
   main elements hold the most of the high text, other regions are left out.

Only what is never text of the page is left out beforehand: scripts, styles, heads and the like, and hidden elements. Menus, footers, sidebars and all else are lines with a weight, and the
numbers decide. Of an article's own header the headings stay.

Null and empty pages, and pages without text, give the empty text. Broken markup doesn't stop the parser: an end tag closes what is open inside its element,
one without a start is passed over, and an article that starts inside an unclosed marked element ends it. Very long pages cost time in proportion. Repeated rows give equal texts;
other columns are not read but for those asked for, and one of them that is named text or n_chars is left out; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
_NEVER = frozenset("head script style noscript template svg math select option textarea iframe object title canvas audio video datalist".split())
_MARKED = frozenset("nav footer aside form button dialog menu fieldset label input".split())
_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form toolbar".split())
#: Words of class names and ids of what is no part of an article; the second kind may also name a part of one.
_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored sponsors promo nav navbar navigation menu submenu breadcrumb breadcrumbs pager pagination "
    "footer foot sidebar widget widgets recommended recommendations sharing newsletter subscribe subscription signup login popup modal overlay lightbox toast "
    "notice notices cookie cookies consent gdpr banner paywall comment comments commentlist disqus respond replies masthead topbar toolbar".split()
)
_AMBIGUOUS = frozenset("promotion aside rail related share social follow notification alert reply discussion feedback reader responses skip search form".split())
_HEADER = frozenset("header head masthead topbar".split())
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_CONTENT = frozenset(("article", "main"))
_SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_CUT = re.compile(r"<[A-Za-z/!?]")
SIGMA = 1.5
RADIUS = 5
LOWERED = 0.02
HINTED = 0.3
RAISED = 20.0
ENOUGH = 2.0
NEAR = 2.2
LEAST = 1.0
APART = 1.4
PIECE = 65_536

#: What an element's marks do to its text: leave it out; lower its score much or a little; keep only headings.
_OUT, _LOW, _HINT, _HEAD = range(1, 5)


class Line(NamedTuple):
    text: str
    linked: int
    tags: int
    weight: float
    zone: int
    content: bool


def _named(value: str, inside: bool, is_id: bool) -> int:
    """What a class or id says of its element."""
    found = 0
    for name in value.split():
        words = [w.lower() for w in _SPLIT.split(name) if w]
        sure, maybe = not _NAMES.isdisjoint(words), not _AMBIGUOUS.isdisjoint(words)
        if not inside and (sure or maybe):
            return _LOW
        if sure and (not is_id or len(words) == 1):
            return _LOW
        if sure or maybe:
            found = _HINT
        elif not found and not _HEADER.isdisjoint(words):
            found = _HEAD if inside else _LOW
    return found


class Lines(HTMLParser):
    """Collects the lines of a page, without what is never text of it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.stack: list[tuple[str, int, bool]] = []  # element, what its marks do, whether it is content
        self.count = [0] * 5
        self.zones = [0]
        self.parts: list[str] = []
        self.tags = self.content = self.headings = self.links = self.linked = self.number = 0

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                weight = LOWERED if self.count[_LOW] else HINTED if self.count[_HINT] else 1.0
                self.lines.append(Line(text, min(self.linked, len(text)), self.tags, weight * (RAISED if self.content else 1.0), 2 * self.zones[-1] + (self.content > 0), self.content > 0))
            self.parts, self.linked = [], 0
        self.tags = 0

    def _mark(self, tag: str, attrs: list[tuple[str, str | None]]) -> tuple[int, bool]:
        inside, content = self.content > 0, tag in _CONTENT
        if tag in _NEVER:
            return _OUT, False
        mark = _LOW if tag in _MARKED else 0
        if tag == "header":
            mark = _HEAD if inside else _LOW
        for name, value in attrs if tag not in ("a", "html", "body") else ():
            value = value or ""
            if name in ("class", "id") and tag not in _HEADINGS and tag not in _CONTENT:
                if got := _named(value, inside, name == "id"):
                    mark = min(mark or got, got)
            elif name == "role":
                if value.lower() in _ROLES:
                    mark = _LOW
                content = content or value.lower() in _CONTENT
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and _HIDDEN.search(value)):
                return _OUT, False
        return mark, content

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _BLOCK:
            self.flush()
        self.tags += not self.count[_OUT]
        if tag in _VOID:
            if tag == "br":
                self.parts.append(" ")
            return
        if tag == "p":
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k][0] == "p":
                    self._close(k)
                    break
                if self.stack[k][0] in _BLOCK:
                    break
        mark, content = self._mark(tag, attrs)
        if content and not self.content and (self.count[_LOW] or self.count[_HINT]) and not any(s[1] == _OUT or s[0] in ("footer", "nav", "aside") for s in self.stack):
            self.stack = [(s, 0, c) for s, _, c in self.stack]
            self.count, self.zones = [0] * 5, [0]
        self.stack.append((tag, mark, content))
        self.count[mark] += 1
        if mark in (_LOW, _HINT):
            self.number += 1
            self.zones.append(self.number)
        self.content += content
        self.headings += tag in _HEADINGS
        self.links += tag == "a"

    def _close(self, k: int) -> None:
        for tag, mark, content in self.stack[k:]:
            self.count[mark] -= 1
            if mark in (_LOW, _HINT):
                self.zones.pop()
            self.content -= content
            self.headings -= tag in _HEADINGS
            self.links -= tag == "a"
        del self.stack[k:]

    def handle_endtag(self, tag: str) -> None:
        self.tags += not self.count[_OUT]
        if tag in _BLOCK:
            self.flush()
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                self._close(k)
                return

    def handle_data(self, data: str) -> None:
        if self.count[_OUT] or (self.count[_HEAD] and not self.headings):
            return
        self.parts.append(data)
        if self.links:
            self.linked += len(data.strip())


def smoothed(x: np.ndarray) -> np.ndarray:
    """x under a Gaussian; at the ends, under the part of it that is there."""
    k = np.exp(-0.5 * (np.arange(-RADIUS, RADIUS + 1) / SIGMA) ** 2)
    pad = np.zeros(RADIUS)
    return np.convolve(np.concatenate((pad, x, pad)), k, "valid") / np.convolve(np.concatenate((pad, np.ones(len(x)), pad)), k, "valid")


def parted(x: np.ndarray) -> np.ndarray:
    """Which values are in the high one of two groups of the least variance inside; all, if the groups' means are less than APART apart."""
    s = np.sort(x)
    n = np.arange(1, len(s))
    if not len(n) or s[0] == s[-1]:
        return np.ones(len(x), bool)
    total = np.cumsum(s)
    low, high = total[:-1] / n, (total[-1] - total[:-1]) / (len(s) - n)
    gain = np.where(s[1:] == s[:-1], -1.0, (high - low) ** 2 * n * (len(s) - n))
    k = int(np.argmax(gain))
    return x >= s[k + 1] if high[k] - low[k] >= APART else np.ones(len(x), bool)


def scores(lines: list[Line]) -> np.ndarray:
    ratio = np.array([(len(x.text) - x.linked) / max(1, x.tags) for x in lines], float)
    zone = np.array([x.zone for x in lines])
    order = np.argsort(zone, kind="stable")
    edge = np.flatnonzero(np.diff(zone[order])) + 1
    out = np.empty(len(lines))
    for part in np.split(order, edge):
        out[part] = smoothed(ratio[part])
    return np.log1p(out * np.array([x.weight for x in lines]))


def selected(lines: list[Line], score: np.ndarray) -> np.ndarray:
    """Which lines are main text."""
    size = np.array([len(x.text) * min(1.0, x.weight) for x in lines])  # what is lowered counts for as much less
    order = np.argsort(-score, kind="stable")
    middle = score[order][np.searchsorted(np.cumsum(size[order]), size.sum() / 2)]  # half of the text stands in lines of this score or more
    weight = np.array([x.weight for x in lines])
    high = parted(score) | (score >= middle - NEAR) | ((weight == RAISED) & (score >= np.log1p(ENOUGH * RAISED)))
    inside = np.array([x.content for x in lines])
    high &= inside | (weight > LOWERED) | (score >= np.log1p(LEAST))
    if size[high & inside].sum() * 2 >= size[high].sum():
        high &= inside
    links = np.array([2 * x.linked > len(x.text) for x in lines])
    firm = high & ~links if (high & ~links).any() else high
    # A line between two firm ones of its kind, inside or outside: a high one of links, or a low one of text that isn't lowered.
    at = np.flatnonzero(firm)
    gap = np.zeros(len(lines) + 1, np.int64)
    for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
        if inside[i] == inside[j]:
            gap[i + 1] += 1
            gap[j] -= 1
    between = (np.cumsum(gap[:-1]) > 0) & (high | (~links & ((weight == 1.0) | (weight == RAISED))))
    return firm | (between & (inside if inside[at].all() else True))


def main_text(html: str) -> str:
    if not html:
        return ""
    parser = Lines()
    for k in range(0, len(html), PIECE):
        parser.feed(html[k : k + PIECE])
    if _CUT.match(parser.rawdata):  # a comment or tag that the page ends in
        parser.rawdata = ""
    parser.close()
    parser.flush()
    if not parser.lines:
        return ""
    return "\n".join(x.text for x, k in zip(parser.lines, selected(parser.lines, scores(parser.lines))) if k)


def extracted(df: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """keep, text and n_chars of every page."""
    kinds = dict(df.dtypes)
    keep = tuple(c for c in keep if c not in ("text", "n_chars"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = len(keep)
        for b in batches:
            for k in range(0, b.num_rows, 200):
                part = b.slice(k, 200)
                texts = [main_text(x or "") for x in part.column(m).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in range(m)), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    head = "".join(f"`{c}` {kinds[c]}, " for c in keep)
    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{html}`")).mapInArrow(run, f"{head}text string, n_chars long")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
