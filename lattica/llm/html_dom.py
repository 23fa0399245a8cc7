"""Tolerant HTML reading: block elements and runs of text as nodes, with the features that tell main text from the rest."""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from typing import NamedTuple

import numpy as np

MARKUP = re.compile(r"<(?:!--|(/?)([a-zA-Z][a-zA-Z0-9:-]*)|[!?/])")
MARKED = re.compile(r"""\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
LABEL = re.compile(r'data-main="([01])"')
#: Their content is never text of a page.
SKIPPED = frozenset("script style noscript template svg math iframe object textarea select option button canvas audio video head title".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset(["hr"])
#: A start tag ends open elements of the first set, searched up to one of the second.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}), "tr": ({"tr"}, {"table"})}
#: What class, id and role tokens speak of.
HINTS = [re.compile(x) for x in (
    r"nav|menu|breadcrumb|crumbs|pager|pagination|toc\b|skip", r"\bad\b|\bads\b|\bad-|advert|sponsor|promo|banner|adsense", r"comment|disqus|discussion|respon[ds]|reply|replies",
    r"footer|foot\b|copyright|colophon|contentinfo", r"header|masthead|topbar|branding|logo|\bbanner", r"cookie|notice|consent|gdpr|alert|popup|modal|overlay|warning",
    r"sidebar|aside|widget|related|recommend|share|social|follow|tags|popular|trending|author-box|complementary", r"form|search|login|signup|subscribe|newsletter|contact",
    r"article|content|main|post|entry|story|body|text\b|blog",
)]
TAG_GROUPS = ("p", "h1 h2 h3 h4 h5 h6", "li dd dt", "ul ol dl menu", "div center details fieldset", "section", "article", "main", "nav", "header", "footer", "aside dialog", "form", "table tbody thead tfoot tr td th caption", "figure figcaption", "blockquote pre", "body html", "#text", "address summary legend hgroup")
GROUP = {t: k for k, names in enumerate(TAG_GROUPS) for t in names.split()}
PUNCTUATION = re.compile(r"[.,;:!?]")


class Page(NamedTuple):
    tag: list[str]
    hint: list[int]  # bit set of HINTS
    parent: list[int]
    texts: list[list[str]]  # runs of an element, in order with its children as None
    links: list[int]  # characters inside links, own runs only
    label: list[int]  # -1 unknown


class TagEnds:
    """Where tags of a page end: at the first ``>`` outside quotes, or if quotes never close, at the first one.

    Every question takes constant time or looks only at the tag, but for one pass over the page's quotes when they are mixed.
    """

    def __init__(self, source: str):
        self.source = source
        self.at: list[int] | None = None

    def find(self, start: int) -> int:
        """The place of the ``>`` that ends the tag whose name ends before ``start``; -1 if the page has no more of them."""
        first = self.source.find(">", start)
        if first < 0:
            return -1
        double, single = self.source.count('"', start, first), self.source.count("'", start, first)
        if not (double and single) and (double + single) % 2 == 0:
            return first
        if self.at is None:
            self._prepare()
        end = self.end[bisect_left(self.at, start)]
        return first if end < 0 else end

    def _prepare(self) -> None:
        self.at = [m.start() for m in re.finditer("[>\"']", self.source)]
        n = len(self.at)
        self.end = [-1] * (n + 2)
        after = {'"': -1, "'": -1}  # the next quote of each kind
        for k in range(n - 1, -1, -1):
            kind = self.source[self.at[k]]
            if kind == ">":
                self.end[k] = self.at[k]
            else:
                self.end[k] = self.end[after[kind] + 1] if after[kind] >= 0 else -1
                after[kind] = k


class Stack:
    """Open elements, and where those of each tag lie among them."""

    def __init__(self):
        self.nodes, self.tags = [0], ["html"]
        self.places: dict[str, list[int]] = defaultdict(list)

    def push(self, node: int, tag: str) -> None:
        self.places[tag].append(len(self.nodes))
        self.nodes.append(node)
        self.tags.append(tag)

    def cut(self, place: int) -> None:
        """Close everything from ``place`` up."""
        while len(self.nodes) > place:
            self.nodes.pop()
            self.places[self.tags.pop()].pop()

    def top(self, tags: set[str]) -> int:
        return max((self.places[t][-1] for t in tags if self.places[t]), default=0)

    def end_before(self, ended: set[str], upto: set[str]) -> None:
        """Close the innermost of ``ended``, and paragraphs, that lie above the innermost of ``upto``."""
        bound, found = self.top(upto), self.top(ended)
        if found > bound:
            self.cut(found)
            return
        open_paragraphs = self.places["p"]
        lowest = bisect_right(open_paragraphs, bound)
        if lowest < len(open_paragraphs):
            self.cut(open_paragraphs[lowest])


def parse(source: str) -> Page:
    """The page's blocks and runs of text; every step looks only at what it consumes, so hostile markup costs no more than its length."""
    page = Page(["html"], [0], [-1], [[]], [0], [-1])
    stack, run, in_link, pos, end = Stack(), [], False, 0, len(source)
    ends, missing = TagEnds(source), set()

    def flush() -> None:
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            run.clear()
            if text:
                node = stack.nodes[-1]
                page.tag.append("#text")
                page.hint.append(0)
                page.parent.append(node)
                page.texts.append([text])
                page.links.append(linked[0])
                page.label.append(page.label[node])
        linked[0] = 0

    linked = [0]
    while pos < end:
        m = MARKUP.search(source, pos)
        close = -1
        if m and m[0] != "<!--":
            close = ends.find(m.end()) if m[2] else source.find(">", m.end())
            if close < 0:  # no tag ends from here on, but a comment may begin
                at = source.find("<!--", m.start())
                m = MARKUP.match(source, at) if at >= 0 else None
        text = source[pos : m.start() if m else end]
        if text:
            run.append(text)
            if in_link:
                linked[0] += len(text)
        if not m:
            break
        if m[0] == "<!--":
            close = source.find("-->", m.end())
            pos = close + 3 if close >= 0 else end
            continue
        attributes, pos = source[m.end() : close], close + 1
        name = (m[2] or "").lower()
        if not name:
            continue
        closing = bool(m[1])
        if name in SKIPPED:
            if not closing and not source.startswith("/>", pos - 2):
                stop = None if name in missing else re.compile(f"</{re.escape(name)}\\s*>", re.I).search(source, pos)
                if name == "head" and not stop:
                    missing.add(name)
                    stop = None if "body" in missing else re.compile(r"(?=<body)", re.I).search(source, pos)
                    if not stop:
                        missing.add("body")
                pos = stop.end() if stop else (pos if name == "head" else end)
            continue
        if name not in BLOCKS:
            if name == "a":
                in_link = not closing
            elif name == "br":
                run.append("\n")
            continue
        if closing:
            if stack.places[name]:
                flush()
                stack.cut(stack.places[name][-1])
            continue
        flush()
        if name in ("html", "body") and len(stack.nodes) > 1 and (name == "html" or stack.places[name]):
            continue
        stack.end_before(*ENDS.get(name, ({"p"}, {"td", "th"})))
        hint = 0
        if "=" in attributes:
            said = " ".join(a or b or c for a, b, c in MARKED.findall(attributes)).lower().replace("_", "-")
            if said:
                for k, pattern in enumerate(HINTS):
                    if pattern.search(said):
                        hint |= 1 << k
        if name in VOID:
            continue
        page.tag.append(name)
        page.hint.append(hint)
        page.parent.append(stack.nodes[-1])
        page.texts.append([])
        page.links.append(0)
        known = LABEL.search(attributes)
        page.label.append(int(known[1]) if known else page.label[stack.nodes[-1]])
        stack.push(len(page.tag) - 1, name)
    flush()
    return page


#: Features beside the tag groups and the hints of a node and of what is above it.
NUMBERS = 17
WIDTH = len(TAG_GROUPS) + 2 * len(HINTS) + len(TAG_GROUPS) + NUMBERS


def features(page: Page) -> list[tuple]:
    """A row for each node: tag and attribute tokens of itself and above, subtree density, depth, sibling statistics; see ``matrix``."""
    n = len(page.tag)
    chars, links, marks, words, tags = [0] * n, [0] * n, [0] * n, [0] * n, [1] * n
    children: list[list[int]] = [[] for _ in range(n)]
    for i in range(n - 1, -1, -1):
        if page.texts[i]:
            text = page.texts[i][0]
            chars[i], links[i], marks[i], words[i], tags[i] = len(text), min(page.links[i], len(text)), len(PUNCTUATION.findall(text)), text.count(" ") + 1, 0
        p = page.parent[i]
        if p >= 0:
            chars[p] += chars[i]
            links[p] += links[i]
            marks[p] += marks[i]
            words[p] += words[i]
            tags[p] += tags[i]
            children[p].append(i)
    total = max(chars[0], 1)
    depth, before, group_above, hint_above = [0] * n, [0] * n, [0] * n, [0] * n
    place, same, around = [0] * n, [0] * n, [(0, 0)] * n
    for i in range(n):
        kids = children[i][::-1]
        at, counts = before[i], {}
        for k in kids:
            counts[page.tag[k]] = counts.get(page.tag[k], 0) + 1
        g, h, d = group_above[i] | 1 << GROUP[page.tag[i]], hint_above[i] | page.hint[i], depth[i] + 1
        for k, kid in enumerate(kids):
            before[kid], depth[kid], group_above[kid], hint_above[kid], place[kid], same[kid] = at, d, g, h, k, counts[page.tag[kid]]
            around[kid] = (chars[kids[k - 1]] if k else 0, chars[kids[k + 1]] if k + 1 < len(kids) else 0)
            at += chars[kid]
    log = math.log1p
    rows = []
    for i in range(n):
        c, p = chars[i], page.parent[i]
        siblings, whole = (len(children[p]), chars[p]) if p >= 0 else (1, c)
        rows.append((
            GROUP[page.tag[i]], page.hint[i], hint_above[i], group_above[i], log(c), links[i] / max(c, 1), marks[i] / max(words[i], 1), c / max(words[i], 1), log(tags[i]), c / (tags[i] + 1),
            depth[i], before[i] / total, c / total, c / max(whole, 1), place[i], siblings, same[i] / max(siblings, 1), log(around[i][0]), log(around[i][1]), log(words[i]), len(children[i]),
        ))
    return rows


def matrix(rows: list[tuple]) -> np.ndarray:
    """The rows of any number of pages with tags and hints as one column each."""
    raw = np.array(rows, dtype=np.float64)
    code, hint, above, groups = (raw[:, k].astype(np.int64) for k in range(4))
    bits = lambda x, m: (x[:, None] >> np.arange(m)) & 1
    return np.concatenate([code[:, None] == np.arange(len(TAG_GROUPS)), bits(hint, len(HINTS)), bits(above, len(HINTS)), bits(groups, len(TAG_GROUPS)), raw[:, 4:]], axis=1).astype(np.float32)


def decode(page: Page, score: np.ndarray) -> list[str]:
    """The kept runs of text in page order.

    A node may stay only if all above it stay; of all such choices the one with the largest sum of scores is taken.
    """
    n = len(page.tag)
    best = score.tolist()
    for i in range(n - 1, 0, -1):
        if best[i] > 0:
            best[page.parent[i]] += best[i]
    kept, out = [False] * n, []
    for i in range(n):
        kept[i] = best[i] > 0 and (i == 0 or kept[page.parent[i]])
        if kept[i] and page.texts[i]:
            out.append(page.texts[i][0])
    return out
