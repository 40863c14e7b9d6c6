"""Main text of HTML pages by tag-path ratios.

A page becomes text nodes, each with its root-to-leaf tag path (tag names with the telling
class or id words). Per path the text length and the punctuation of all its nodes are summed
and divided by their number; a node's value is the fusion of both ratios of its path. Values
are smoothed over neighbouring nodes in page order, and a node whose own and smoothed values are
above a share of the page's mean is selected. The content root is the smallest container that holds all selected nodes. Of its
nodes the selected ones are the text, and those that stand with one: in the same article, or
else in the same container (short blocks, table cells).

Menus, scripts, hidden parts and the like are furniture by their tag or attribute. Class, id
and role words (sidebar, comments, advert, ...) and forms only weigh against an element: not
when it holds the page's largest article, or, in a page without one, when outside of such
elements there is next to no ratio mass (text length times value), and not when the word is a
state (has-sidebar, no-nav). Else its nodes carry no ratio, however long it is.

Work is linear in the page, broken ones too: paths are numbered in a tree, not copied, and tags
are found by a scan that never goes back.

Defined cases: a null or empty page, or one without text, gives the empty string; unclosed and
stray tags are tolerated; repeated rows stay; other columns pass through (one called ``main``
is replaced); an empty table gives no rows.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAMED = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
EDGE = re.compile(r"""[>"']""")
ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
NAME = re.compile(r"[a-z]+")
PUNCTUATION = re.compile(r"[.,;:!?…。，？！]")
#: Fixed values of HTML: elements without content, with raw text, that end a block, and that hold a page's parts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table
tbody td tfoot th thead tr ul caption option optgroup""".split())
#: Share of a marked element's mass that the unmarked rest must have for the element to go.
LEAST_REST = 0.05
CONTAINER = frozenset("html body main article section div td center".split())
#: An element that opens closes an open one of these, up to a container of its kind.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
          "option": ({"option"}, {"select"})}
FURNITURE_TAGS = frozenset("""nav header footer aside button select menu dialog head object applet canvas svg math
audio video input label""".split()) | RAW
FURNITURE_WORDS = frozenset("""ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner
sidebar side nav navbar navigation menu submenu breadcrumb breadcrumbs footer header masthead comment comments commentlist
reply replies disqus respond cookie cookies consent gdpr notice notices alert popup modal overlay share sharing social
related recommended recommendations newsletter subscribe subscription signup login widget toolbar pagination pager
search skip tags hidden toc copyright""".split())
STATES = frozenset("has have no not with without is show hide".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())


def tags(source: str):
    """(start, end, kept text, closes, name, attributes) of every tag, comment and declaration, in page
    order. A tag ends at the first ``>`` outside of quotes; where quotes do not close, at the first ``>``
    at all. Linear: what follows is never searched for a sign that does not come again, and tags
    that lead nowhere by their quotes may cost four times the page, then quotes count no more."""
    last, wasted, at = {c: source.rfind(c) for c in "\"'>"}, 0, 0
    while True:
        start = source.find("<", at)
        if start < 0:
            return
        at = start + 1
        if source.startswith("<!--", start):
            end = source.find("-->", start + 4)
            at = len(source) if end < 0 else end + 3
            yield start, at, None, "", "", ""
            continue
        if source.startswith("<![CDATA[", start):
            end = source.find("]]>", start)
            if end >= 0:
                at = end + 3
                yield start, at, source[start + 9:end], "", "", ""
                continue
        if start > last[">"]:
            return
        if source[at:at + 1] in ("!", "?"):
            at = source.find(">", at) + 1
            yield start, at, None, "", "", ""
            continue
        named = NAMED.match(source, at)
        if not named:
            continue
        end, place = -1, named.end()
        while wasted <= 4 * len(source):
            edge = EDGE.search(source, place)
            if not edge:
                break
            place = edge.end()
            if edge[0] == ">":
                end = edge.start()
                break
            if place > last[edge[0]]:
                break
            place = source.find(edge[0], place) + 1
        if end < 0:
            wasted += place - start
            end = source.find(">", named.end())
            if end < 0:
                continue
        at = end + 1
        yield start, at, None, named[1], named[2], source[named.end():end]


def _telling(attrs: str) -> tuple[str, bool, bool]:
    """Class and id words that name an element's part of the page; whether they or its role
    speak of furniture; whether it is hidden."""
    words, marked, hidden = [], False, False
    for name, value in ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id"):
            for token in value.split():
                parts = NAME.findall(token)
                words += parts
                marked |= any(p in FURNITURE_WORDS for p in parts) and not any(p in STATES for p in parts)
        elif name == "role":
            marked |= value in FURNITURE_ROLES
        elif name == "hidden" or name == "aria-hidden":
            hidden |= name == "hidden" or value == "true"
    return ".".join(words), marked, hidden


class Page:
    """The text nodes of one page, with elements and paths numbered in trees."""

    def __init__(self, source: str):
        self.tag, self.up, self.path = ["#"], [-1], [0]  # per element
        self.out, self.marked = [False], [False]  # furniture with all below it; words or a form weigh against it
        self.paths: dict[tuple[int, str], int] = {}
        self.nodes: list[tuple[int, int, str]] = []  # element, block, text
        self.block, stack, at = 0, [0], 0
        self.open: dict[str, int] = {}  # open elements by tag
        for start, end, kept, close, name, attrs in tags(source):
            if start < at:
                continue
            self._text(stack[-1], source[at:start])
            at = end
            if kept is not None:
                self._text(stack[-1], kept)
            if not name:
                continue
            name = name.lower()
            if name in BLOCK:
                self.block += 1
            if close:
                if self.open.get(name):
                    last = len(stack) - 1
                    while self.tag[stack[last]] != name:
                        last -= 1
                    self._close(stack, last)
                continue
            if name in VOID:
                if name == "br":
                    self._text(stack[-1], " ")
                continue
            self._implied(stack, name)
            words, marked, hidden = _telling(attrs)
            parent = stack[-1]
            key = (self.path[parent], f"{name}.{words}")
            self.tag.append(name)
            self.up.append(parent)
            self.path.append(self.paths.setdefault(key, len(self.paths) + 1))
            self.out.append(self.out[parent] or hidden and name not in ("html", "body") or name in FURNITURE_TAGS)
            self.marked.append(name == "form" or marked and name not in ("html", "body", "article", "main"))
            if attrs.rstrip().endswith("/") and name in ("svg", "path"):
                continue
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}\s*/?>", re.I).search(source, at)
                at = end.end() if end else len(source)
                continue
            stack.append(len(self.tag) - 1)
            self.open[name] = self.open.get(name, 0) + 1
        self._text(stack[-1], source[at:])

    def _implied(self, stack: list[int], name: str) -> None:
        if name in BLOCK and self.open.get("p"):
            for i in range(len(stack) - 1, 0, -1):
                if self.tag[stack[i]] == "p":
                    self._close(stack, i)
                    break
                if self.tag[stack[i]] in BLOCK:
                    break
        same, fence = CLOSES.get(name, ((), ()))
        if any(self.open.get(x) for x in same):
            for i in range(len(stack) - 1, 0, -1):
                if self.tag[stack[i]] in fence:
                    break
                if self.tag[stack[i]] in same:
                    self._close(stack, i)
                    break

    def _close(self, stack: list[int], at: int) -> None:
        for e in stack[at:]:
            self.open[self.tag[e]] -= 1
        del stack[at:]

    def _text(self, element: int, text: str) -> None:
        if text:
            self.nodes.append((element, self.block, html.unescape(text)))

    def _values(self, full: list[tuple[int, str]]) -> list[float]:
        """The fused ratios of the nodes' paths."""
        length, marks, count = {}, {}, {}
        for e, t in full:
            p = self.path[e]
            length[p] = length.get(p, 0) + len(t.strip())
            marks[p] = marks.get(p, 0) + len(PUNCTUATION.findall(t))
            count[p] = count.get(p, 0) + 1
        return [math.log1p(length[p] / count[p]) * (1 + math.log1p(marks[p] / count[p]))
                for p in (self.path[e] for e, _ in full)]

    def _below(self, each: list[float]) -> list[float]:
        """Sums over the subtrees."""
        out = list(each)
        for e in range(len(out) - 1, 0, -1):  # an element comes after its parent
            out[self.up[e]] += out[e]
        return out

    def _furniture(self) -> list[bool]:
        """Per element: it or one around it is furniture, marks weighed against ratio mass."""
        full = [(e, t) for e, _, t in self.nodes if t.strip() and not self.out[e]]
        mass = [0.0] * len(self.tag)
        for (e, t), v in zip(full, self._values(full), strict=True):
            mass[e] += v * len(t.strip())
        mass = self._below(mass)
        articles = [e for e in range(len(self.tag)) if self.tag[e] in ("article", "main") and mass[e] > 0]
        spared, e = set(), max(articles, key=mass.__getitem__, default=0)
        while e > 0:
            spared.add(e)
            e = self.up[e]
        if not spared:
            spared = self._holders(mass)
        out = list(self.out)
        for e in range(1, len(out)):
            out[e] = out[e] or out[self.up[e]] or self.marked[e] and e not in spared
        return out

    def _holders(self, mass: list[float]) -> set[int]:
        """Marked elements that hold the page nevertheless: the largest, if next to nothing stands
        outside of marked ones; within it the same again."""
        around, inner = [0] * len(self.tag), {}  # nearest marked element; marked elements by it
        for e in range(1, len(self.tag)):
            up = self.up[e]
            around[e] = up if self.marked[up] else around[up]
            if self.marked[e] and mass[e] > 0:
                inner.setdefault(around[e], []).append(e)
        out, scope = set(), 0
        while scope in inner:
            largest = max(inner[scope], key=mass.__getitem__)
            if mass[scope] - sum(mass[e] for e in inner[scope]) >= LEAST_REST * mass[largest]:
                break
            out.add(largest)
            scope = largest
        return out

    def main_text(self, radius: int = 1, share: float = 0.3) -> str:
        furniture = self._furniture()
        content = [(e, b, t) for e, b, t in self.nodes if not furniture[e]]
        full = [(e, t) for e, _, t in content if t.strip()]
        if not full:
            return ""
        value = self._values(full)
        kernel = [math.exp(-(d * d) / 2) for d in range(-radius, radius + 1)]
        smooth = []
        for i in range(len(value)):
            near = [(value[i + d], k) for d, k in zip(range(-radius, radius + 1), kernel, strict=True)
                    if 0 <= i + d < len(value)]
            smooth.append(sum(v * k for v, k in near) / sum(k for _, k in near))
        limit = share * sum(smooth) / len(smooth)
        chosen = [0] * len(self.tag)
        for (e, _), v, s in zip(full, value, smooth, strict=True):
            chosen[e] += min(v, s) >= limit
        chosen = self._below(chosen)
        holder, inside, root = [0], [True], 0  # an article, or else the container; whether in the root
        for e in range(1, len(self.tag)):
            up = self.up[e]
            if inside[up] and chosen[e] == chosen[0] and self.tag[e] in CONTAINER:
                root = e
            inside.append(inside[up] and chosen[e] == chosen[0])
            whole = self.tag[holder[up]] in ("article", "main")
            holder.append(e if not whole and self.tag[e] in CONTAINER and self.tag[e] != "td" else holder[up])
        inside = [e == root for e in range(len(self.tag))]
        for e in range(1, len(self.tag)):
            inside[e] = inside[e] or inside[self.up[e]]
        blocks: dict[int, list[str]] = {}
        for e, b, t in content:
            if inside[e] and chosen[holder[e]]:
                blocks.setdefault(b, []).append(t)
        lines = (" ".join("".join(parts).split()) for parts in blocks.values())
        return "\n".join(x for x in lines if x)


def main_text(source: str | None) -> str:
    return Page(source).main_text() if source else ""


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` (its column ``html``) plus ``main``, in one narrow stage."""

    def run(batches):
        for batch in batches:
            field = batch.schema.field("main")
            made = pa.array([main_text(h.as_py()) for h in batch.column("html")], field.type)
            yield batch.set_column(batch.schema.get_field_index("main"), field, made)

    out = pages.drop("main").withColumn("main", F.lit(None).cast("string"))
    return out.mapInArrow(run, out.schema)
