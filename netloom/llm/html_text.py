"""Main text of web pages by tag-path ratios.

Every run of text belongs to a block element; the block's root-to-leaf path of elements
(inline elements left out, class names kept) is its tag path. Over all blocks of a page that
share a path, characters, characters in links, and punctuation are summed. A path's
ratio is its own (unlinked) text per block; another is its punctuation per block.
Both are smoothed along the page, so that a short block between long ones is not lost, fused into one value by
multiplying, and averaged by path; a path's value falls with its share of linked text, to nothing at `LINKED`.

Markup that says what a region is gives weights: article and main elements 1; navigation, page headers and
footers, asides, forms, dialogs, hidden parts, and names for adverts, notices, sidebars and
comments next to nothing; all else 1 on pages that have no article or main element with text, and little on those that have.
Paths whose weighted value reaches a share of the page's mean (over the characters of what weighs 1) are content:
a small share within an article, which holds short lines by intent, a larger one on pages whose markup says nothing. Every page goes this way.

Character references are decoded, white space within a block becomes one space, blocks are
trimmed and joined by newlines in page order. Nothing is dropped or capped otherwise. Time is in proportion to the page.

Defined results: null or empty html, and pages without content, give the empty text; broken
markup is read as far as it goes (a new block ends an open paragraph; unknown end tags are
skipped; an unclosed script, comment or tag runs to the end); equal rows give equal rows; extra columns are not read.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
#: What stands in them is not page text.
RAW = frozenset("script style textarea title iframe noembed noframes noscript xmp template svg math object video audio canvas select".split())
#: Regions that hold no main text.
OUTSIDE = frozenset("head nav footer aside form dialog menu button datalist fieldset search".split())
NAMES = frozenset("ad ads advert adverts advertisement advertising adsense adslot banner breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies disqus discussion dropdown footer gdpr header hidden login masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pagination paywall popup promo promotion reader-comments recommended related replies reply respond search share sharing sidebar sidebars signup skip social sponsor sponsored subscribe subscription tags teaser toolbar widget widgets".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
#: A block start of these ends an open one of the same group.
ENDS = {t: frozenset(["li"]) for t in ["li"]} | {t: frozenset(["dt", "dd"]) for t in ["dt", "dd"]} | {t: frozenset(["td", "th"]) for t in ["td", "th"]} | {"tr": frozenset(["tr", "td", "th"])}
#: Beyond these no implied end is looked for.
WALLS = frozenset("ul ol dl table article section div main body blockquote".split())

#: What begins at a "<": a comment, a declaration, or a tag's name.
OPEN = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
#: The rest of a tag; quotes count where they follow "=".
REST = re.compile(r"(?>[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|[\"'=])*+>", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
PUNCTUATION = re.compile(r"[.,;:!?…。、，！？；：]")
#: Regions: named as something else, unnamed, article or main.
OTHER, PLAIN, MAIN = 0, 1, 2
#: Weight of a region that is one below the best of its page.
LESS = 1e-4
#: Share of the page's mean value that a path needs, where the best region is article or main, and where it is unnamed.
SHARE = {MAIN: 5e-4, PLAIN: 0.35}
#: Share of a path's characters in links from which on it counts nothing.
LINKED = 0.6
#: Of punctuation per block: what a block without any counts.
BASE = 0.2


class _Element:
    __slots__ = ("inside", "name", "outside", "path", "within")

    def __init__(self, name: str, path: int, outside: bool, within: bool, inside: bool):
        self.name, self.path, self.outside, self.within, self.inside = name, path, outside, within, inside


def _attributes(rest: str) -> dict[str, str]:
    return {k.lower(): x or y or z for k, x, y, z in ATTRIBUTE.findall(rest)}


def _named(attributes: dict[str, str]) -> bool:
    words = re.split(r"[^a-z0-9-]+", f"{attributes.get('class', '')} {attributes.get('id', '')}".lower())
    return any(w in NAMES or any(x in NAMES for x in re.split(r"[-_]", w)) for w in words if w)


def _hidden(attributes: dict[str, str]) -> bool:
    style = attributes.get("style", "").replace(" ", "").lower()
    return "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style


class Page:
    """blocks: of each block with text, in page order, the number of its tag path, text, characters in links, region. paths: parent's number and element of each path."""

    def __init__(self, page: str):
        self.blocks: list[tuple[int, str, int, int]] = []
        self.paths: list[tuple[int, str]] = [(-1, "")]
        self._numbers: dict[tuple[int, str], int] = {}
        self._stack = [_Element("", 0, False, False, False)]
        self._open: Counter[str] = Counter()
        self._parts: list[str] = []
        self._linked, self._links, self._owner = 0, 0, self._stack[0]
        self._read(page)
        self._flush()

    def path(self, number: int) -> str:
        steps = []
        while number > 0:
            number, step = self.paths[number]
            steps.append(step)
        return "/" + "/".join(reversed(steps))

    def _flush(self) -> None:
        text = " ".join(html_lib.unescape("".join(self._parts)).split()) if self._parts else ""
        if text:
            o = self._owner
            self.blocks.append((o.path, text, min(self._linked, len(text)), OTHER if o.outside else MAIN if o.inside else PLAIN))
        self._parts.clear()
        self._linked = 0

    def _text(self, text: str) -> None:
        if text:
            self._parts.append(text)
            if self._links:
                self._linked += len(text.strip())

    def _cut(self, k: int) -> None:
        """End all elements from the k-th open one on."""
        for e in self._stack[k:]:
            self._open[e.name] -= 1
        del self._stack[k:]

    def _read(self, page: str) -> None:
        at, endless = 0, set()

        def after_end(name: str, at: int) -> int:
            """Where the element that has begun ends; -1 if it never does."""
            if name in endless:
                return -1
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            if not end:
                endless.add(name)
            return end.end() if end else -1

        seen = 0
        while (at := page.find("<", at)) >= 0:
            m = OPEN.match(page, at)
            if not m:  # no markup
                at += 1
                continue
            self._text(page[seen:at])
            if m[1]:
                end = page.find("-->", m.end())
                at = seen = len(page) if end < 0 else end + 3
                continue
            if m[2]:
                end = page.find(">", m.end())
                if page.startswith("<![CDATA[", at):
                    end = at + 8
                at = seen = len(page) if end < 0 else end + 1
                continue
            rest = REST.match(page, m.end())
            if not rest:
                seen = len(page)
                break
            at = seen = rest.end()
            name = m[4].lower()
            if m[3]:
                self._end(name)
            elif name in RAW:
                if not (rest[0].rstrip("> ").endswith("/") and name in ("svg", "math")):
                    end = after_end(name, at)
                    at = seen = len(page) if end < 0 else end
            elif name not in BLOCKS and name not in OUTSIDE:
                if name == "br":
                    self._parts.append(" ")
                elif name == "a":
                    self._links = 1
                elif name not in VOID and any(x in rest[0] for x in ("hidden", "style")) and _hidden(_attributes(rest[0])):  # an inline part that isn't shown
                    end = after_end(name, at)
                    at = seen = at if end < 0 else end
            else:
                self._begin(name, rest[0])
        self._text(page[seen:])

    def _end(self, name: str) -> None:
        if name == "a":
            self._links = 0
        elif self._open[name] > 0:
            self._flush()
            self._cut(next(i for i in range(len(self._stack) - 1, 0, -1) if self._stack[i].name == name))
            self._owner, self._links = self._stack[-1], 0

    def _begin(self, name: str, rest: str) -> None:
        self._flush()
        if name == "hr":
            return
        ends = ENDS.get(name, ())
        if self._open["p"] > 0 or any(self._open[e] > 0 for e in ends):
            for i in range(len(self._stack) - 1, 0, -1):
                open_name = self._stack[i].name
                if open_name == "p" or open_name in ends:
                    self._cut(i)
                    if open_name != "p" and name != "tr":
                        break
                elif open_name in WALLS:
                    break
        if name == "body":  # a head that was never closed ends here
            self._cut(1)
        up = self._stack[-1]
        a = _attributes(rest) if "=" in rest or "hidden" in rest else {}
        role = a.get("role", "").lower()
        inside = up.inside or name in ("article", "main") or role in ("main", "article")
        heading = up.within and name in ("h1", "h2", "h3", "h4", "h5", "h6")
        within = name == "header" and up.inside and not up.outside  # an article's own header: its headings count
        outside = name not in ("html", "body") and ((up.outside and not heading) or name in OUTSIDE or name == "header" or role in ROLES or _hidden(a) or (name not in ("article", "main") and _named(a)))
        step = (up.path, name + ("." + a["class"].strip().lower() if a.get("class") else ""))
        number = self._numbers.setdefault(step, len(self.paths))
        if number == len(self.paths):
            self.paths.append(step)
        self._owner, self._links = _Element(name, number, outside, within or (up.within and not heading), inside), 0
        self._stack.append(self._owner)
        self._open[name] += 1


def _smooth(x: np.ndarray) -> np.ndarray:
    return (np.concatenate([x[:1], x[:-1]]) + 2 * x + np.concatenate([x[1:], x[-1:]])) / 4


def values(blocks: list[tuple[int, str, int, int]]) -> tuple[np.ndarray, float]:
    """The weighted value of each block's path, and what a path needs."""
    path = np.unique([b[0] for b in blocks], return_inverse=True)[1]
    size, linked = np.array([len(b[1]) for b in blocks], "f8"), np.array([b[2] for b in blocks], "f8")
    marks, region = np.array([len(PUNCTUATION.findall(b[1])) for b in blocks], "f8"), np.array([b[3] for b in blocks])
    total = lambda x: np.bincount(path, x)[path]
    n = total(np.ones(len(blocks)))
    fused = _smooth(total(size - linked) / n) * (BASE + _smooth(total(marks) / n))
    value = total(fused) / n * np.maximum(0, 1 - total(linked) / total(size) / LINKED)
    best = MAIN if ((region == MAIN) & (size > linked)).any() else PLAIN
    counts = region == best
    mean = (value * size)[counts].sum() / max(size[counts].sum(), 1)
    return value * np.where(region == OTHER, LESS**2, np.where(counts, 1, LESS)), SHARE[best] * mean


def main_text(page: str | None) -> str:
    found = Page(page or "").blocks
    if not found:
        return ""
    value, least = values(found)
    return "\n".join(b[1] for b, v in zip(found, value.tolist(), strict=True) if v > 0 and v >= least)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id_col, url_col, text, n_chars of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h.as_py()) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    src = pages.select(id_col, url_col, html_col)
    return src.mapInArrow(run, f"`{id_col}` {src.schema[id_col].dataType.simpleString()}, `{url_col}` {src.schema[url_col].dataType.simpleString()}, text string, n_chars long")
