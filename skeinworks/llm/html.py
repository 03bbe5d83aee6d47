"""Main text of web pages by composite text density.

For every node of the DOM: C characters, T tags, LC characters in links, LT link tags of its subtree. Its composite
density is C / T times the logarithm, to a base that grows with the share of link text, of
(C / LC) * (T / LT); a zero count stands as 1. The node with the greatest sum of its children's densities
is the main subtree; the least density on its path to the body is the threshold, and other subtrees
under the body that reach it give their own best subtree. The tree holds all but scripts and form controls. Where elements or
their classes name a part of a page (a nav, an aside, comments), its density counts a part only, so it must be so much
denser to hold the main subtree; named parts beside the main subtree's path go, but for those that may hold the article as
well, which stay if their density sums are a share of the main one's.
An article is more than its densest subtree: what is found brings all of the article or main that it is in;
on pages without these, all but blocks of links of the ancestor whose link-free text is mostly found. So where a page
names its parts, menus, adverts and footers are left out by name, and densities decide only where it doesn't.
All steps take time in proportion to the page.
"""

from __future__ import annotations

import html
import math
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinworks.plans.stage import bounded_batches

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg object select".split())
BLOCK = frozenset(
    "address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul caption summary".split()
)
#: Form controls, and elements that name a part of a page that no article has.
CONTROLS = frozenset("button datalist option optgroup".split())
ASIDE = frozenset("nav footer aside menu dialog".split())
#: Words of class, id or role that mark boilerplate.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner banners cookie cookies consent notice notices sidebar sidebars menu menus nav navbar navigation "
    "breadcrumb breadcrumbs footer header masthead comment comments disqus reply replies promo promos promotion sponsor sponsored social share sharing newsletter subscribe "
    "signup login popup modal related widget widgets pagination toolbar copyright disclaimer contentinfo complementary search".split()
)
#: Marks of what may hold the article as well (a layout's name), so the share of text decides, and those that say nothing within an article.
WEAK = frozenset("banner banners notice notices sidebar sidebars header masthead promo promos promotion social login popup modal widget widgets toolbar copyright disclaimer search".split())
NOT_INSIDE = frozenset("banner banners notice notices header masthead widget widgets copyright disclaimer search contentinfo complementary".split())
#: Marks of what readers or other pages say: more text than the article's doesn't make it the article.
TALK = frozenset("comment comments disqus reply replies related".split())
#: Marks that any name may follow (ad-top), names of parts that say no more than the mark before them (share-buttons), words that make a
#: name a layout's (with-sidebar), and those whose header is the article's (post-header).
LEADS = frozenset("ad ads adv advert adverts advertisement sponsored disqus breadcrumb breadcrumbs navbar nav sidebar comment comments newsletter".split())
PARTS = frozenset("area bar block box btn button buttons container form icons inner item items links list module outer panel posts articles stories section slot top bottom left right wrap wrapper unit overlay".split())
LAYOUT = frozenset("with without has have no not is layout".split())
OWN = frozenset("post entry article content story page section chapter doc title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
HARD, STRONG, SOFT = 1, 2, 3
#: What a named part's density counts, and the share of the main subtree's density sum that keeps one.
COUNTS = {0: 1.0, HARD: 0.0, STRONG: 0.25, SOFT: 0.5}
SHARE = 0.25
HOMES = {"article": 1, "main": 2}
CLOSES_P = BLOCK - frozenset("head html body".split())
#: A start tag that ends an open element of these kinds.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?>=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)(?:>|\Z)""", re.S)
_MARK = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[^-_]+")


def mark_of(token: str) -> str | None:
    """The mark that a whole class, id or role names: by itself or as the head of a compound; None if it names none."""
    parts = [x for x in (y.rstrip("0123456789") for y in _PART.findall(token.lower())) if x]
    if len(parts) > 1:
        if not LAYOUT.isdisjoint(parts):
            return None
        if parts[0] in LEADS:
            return parts[0]
        while len(parts) > 1 and parts[-1] in PARTS:
            parts.pop()
        if len(parts) > 1 and (parts[-1].startswith("widget") or (parts[-1] in ("header", "banner", "notice") and not OWN.isdisjoint(parts))):
            return None
    return parts[-1] if parts and parts[-1] in MARKS else None


class Tree:
    """Nodes in page order: tag, parent, off (scripts and controls), kind of named part, within an article; texts as (node, block number, string)."""

    def __init__(self, page: str):
        self.tag, self.parent, self.off = ["#root"], [-1], [False]
        self.kind, self.home, self.inside = [0], [0], [False]  # home: 1 for an article, 2 for main; inside: one of them or below
        self.texts: list[tuple[int, int, str]] = []
        self.block, self.body = 0, 0
        self.open: dict[str, int] = {}  # open elements by tag
        self._parse(page)

    def _close_to(self, stack: list[int], depth: int) -> None:
        while len(stack) > depth:
            name = self.tag[stack.pop()]
            self.open[name] -= 1
            self.block += name in BLOCK

    def _marked(self, name: str, attrs: str, up: int) -> tuple[int, int]:
        """(kind by class, id and role; whether role makes it an article, 1, or main, 2)."""
        marks, home, section = set(), 0, name == "section"
        for m in _MARK.finditer(attrs):
            for token in (m[2] or m[3] or m[4] or "").split():
                if m[1].lower() == "role":
                    home = max(home, HOMES.get(token.lower(), 0))
                section = section or (m[1].lower() == "class" and token.lower() == "section")
                marks.add(mark_of(token))
        marks.discard(None)
        if self.inside[up]:
            marks = set() if section else marks - NOT_INSIDE
        if not marks or home or name in ("html", "body", "article", "main") or name in HEADINGS or self.tag[up] in HEADINGS:
            return 0, home
        return SOFT if marks <= WEAK or (self.inside[up] and marks.isdisjoint(TALK)) else STRONG, home

    def _add(self, name: str, up: int, kind: int, home: int) -> int:
        self.tag.append(name)
        self.parent.append(up)
        self.kind.append(kind)
        self.home.append(home)
        self.inside.append(home > 0 or self.inside[up])
        self.off.append(kind == HARD or self.off[up])
        return len(self.tag) - 1

    def _parse(self, page: str) -> None:
        stack, at, n = [0], 0, len(page)
        while at < n:
            m = _TAG.search(page, at)
            if m is None or m.start() > at:
                self.texts.append((stack[-1], self.block, page[at : m.start() if m else n]))
            if m is None:
                break
            at = m.end()
            if not m[2]:
                continue
            name = m[2].lower()
            if m[1]:
                if self.open.get(name):
                    self._close_to(stack, next(k for k in range(len(stack) - 1, 0, -1) if self.tag[stack[k]] == name))
                else:
                    self.block += name in BLOCK
                continue
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at) if not m[3].endswith("/") else None
                self._add(name, stack[-1], HARD, 0)
                if not m[3].endswith("/"):
                    at = end.end() if end else n
                continue
            if name in ("html", "head", "body") and self.open.get(name):
                continue
            if name == "body" and self.open.get("head"):
                self._close_to(stack, next(k for k, x in enumerate(stack) if self.tag[x] == "head"))
            close = None
            if name in CLOSES_P and self.open.get("p"):
                close = next((k for k in range(len(stack) - 1, 0, -1) if self.tag[stack[k]] == "p"), None)
            if name in ENDS and any(self.open.get(x) for x in ENDS[name]):
                for k in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[k]] in ("ul", "ol", "dl", "table"):
                        break
                    if self.tag[stack[k]] in ENDS[name]:
                        close = k if close is None else min(k, close)
                        break
            if close:
                self._close_to(stack, close)
            if name in BLOCK:
                self.block += 1
            elif name == "br":
                self.texts.append((stack[-1], self.block, " "))
            up = stack[-1]
            kind, home = self._marked(name, m[3], up) if m[3] else (0, 0)
            if name in CONTROLS or name == "head":
                kind = HARD
            elif name in ASIDE:
                kind = STRONG
            elif name == "form" or (name == "header" and not self.inside[up]):
                kind = kind or SOFT
            node = self._add(name, up, kind, max(home, HOMES.get(name, 0)))
            if name == "body":
                self.body = node
            if name not in VOID and not m[3].endswith("/"):
                stack.append(node)
                self.open[name] = self.open.get(name, 0) + 1
        if self.body == 0:
            self.body = next((k for k, t in enumerate(self.tag) if t == "html"), 0)


def densities(tree: Tree) -> tuple[list[float], list[float], list[int], list[int]]:
    """(composite density, sum of the children's, characters, those in links) of every node."""
    n = len(tree.tag)
    c, t, lc, lt, link, counts = [0] * n, [0] * n, [0] * n, [0] * n, [False] * n, [1.0] * n
    for k in range(1, n):
        link[k] = tree.tag[k] == "a" or link[tree.parent[k]]
        counts[k] = min(COUNTS[tree.kind[k]], counts[tree.parent[k]])
    for k, _, s in tree.texts:
        if not tree.off[k]:
            size = len("".join(s.split()))
            c[k] += size
            lc[k] += size if link[k] else 0
    for k in range(n - 1, 0, -1):
        if not tree.off[k]:
            p = tree.parent[k]
            c[p] += c[k]
            lc[p] += lc[k]
            t[p] += t[k] + 1
            lt[p] += lt[k] + (tree.tag[k] == "a")
    body_c, body_lc = max(1, c[tree.body]), lc[tree.body]
    density, total = [0.0] * n, [0.0] * n
    for k in range(n - 1, -1, -1):
        if not tree.off[k] and c[k]:
            plain = max(1, c[k] - lc[k])
            base = math.log(c[k] / plain * lc[k] + body_lc / body_c * c[k] + math.e)
            x = c[k] / max(1, lc[k]) * (max(1, t[k]) / max(1, lt[k]))
            density[k] = c[k] / max(1, t[k]) * math.log(max(x, 1.0)) / math.log(max(base, 1.0 + 1e-9)) if base > 1 + 1e-9 else c[k] / max(1, t[k]) * math.log(max(x, 1.0) + 1)
            density[k] *= counts[k]
        if k and tree.tag[k] in BLOCK:  # inline markup is a part of its block's text, not a block beside others
            total[tree.parent[k]] += density[k]
    return density, total, c, lc


def drop_parts(tree: Tree, best: int, total: list[float], c: list[int], lc: list[int]) -> None:
    """Named parts that don't hold the main subtree go, but for those (a form, a banner) that density says are of weight, and comments never."""
    path, k = set(), best
    while k >= 0:
        path.add(k)
        k = tree.parent[k]
    weight = total[:]  # the greatest density sum in a subtree
    for k in range(len(weight) - 1, 0, -1):
        weight[tree.parent[k]] = max(weight[tree.parent[k]], weight[k])
    for k in range(1, len(tree.tag)):
        if tree.off[tree.parent[k]]:
            tree.off[k] = True
        elif k not in path and tree.kind[k] in (STRONG, SOFT):
            heavy = weight[k] >= SHARE * total[best] > 0 and 2 * lc[k] < c[k]
            tree.off[k] = tree.kind[k] == STRONG or not heavy


def widen(tree: Tree, kids: list[list[int]], chosen: list[bool], best: int, c: list[int], lc: list[int]) -> set[int]:
    """Adds to chosen what belongs to the article around the chosen subtrees; returns the text numbers to keep beside them."""
    n = len(tree.tag)
    near = [0] * n
    for k in range(1, n):
        near[k] = k if tree.home[k] else near[tree.parent[k]]
        if chosen[k] and near[k] and not tree.off[k]:
            chosen[near[k]] = True
    kept, got, up = chosen[:], [0] * n, [best]
    for k in range(1, n):
        kept[k] = kept[k] or kept[tree.parent[k]]
    for k, _, s in tree.texts:
        got[k] += len("".join(s.split())) if kept[k] and not tree.off[k] else 0
    link = [False] * n
    for k in range(1, n):
        link[k] = tree.tag[k] == "a" or link[tree.parent[k]]
        got[k] = 0 if link[k] else got[k]
    for k in range(n - 1, 0, -1):
        got[tree.parent[k]] += got[k]
    while up[-1] != tree.body:
        up.append(tree.parent[up[-1]])
    most = [k for k in up if 2 * got[k] >= c[k] - lc[k]]
    if near[best]:
        hold = next((k for k in reversed(most) if tree.home[k]), near[best])
        chosen[hold] = True
        if not any(tree.tag[k] == "h1" and not tree.off[k] and (kept[k] or near[k] == hold) for k in range(n)):  # the title may stand before the article
            title = next((k for k in range(hold - 1, tree.body, -1) if tree.tag[k] == "h1" and (not tree.off[k] or tree.tag[tree.parent[k]] == "header")), None)
            if title:
                chosen[title] = True
                tree.off[title] = False
                for k in range(title + 1, hold):
                    tree.off[k] = tree.off[k] and (tree.kind[k] == HARD or tree.off[tree.parent[k]])
        return set()
    top = most[-1] if most else best
    path, loose = set(up[: up.index(top) + 1]), set()
    todo = [] if top == best else [top]
    while todo:
        x = todo.pop()
        loose.add(x)
        for y in kids[x]:
            if chosen[y]:
                continue
            if y in path or tree.tag[y] not in BLOCK:
                todo.append(y)
            elif tree.tag[y] in HEADINGS or 2 * lc[y] <= c[y]:
                chosen[y] = True
            else:  # a block of links, but for a title and paragraphs
                deep = [y]
                while deep:
                    z = deep.pop()
                    if tree.tag[z] == "h1" or (tree.tag[z] == "p" and 2 * lc[z] <= c[z]):
                        chosen[z] = True
                    else:
                        deep += kids[z]
    runs: dict[int, list[tuple[int, int, bool]]] = {}
    for i, (k, block, s) in enumerate(tree.texts):
        if k in loose:
            runs.setdefault(block, []).append((i, len("".join(s.split())), link[k]))
    return {i for run in runs.values() if 2 * sum(m for _, m, a in run if a) <= sum(m for _, m, _ in run) for i, _, _ in run}


def main_text(page: str | None) -> str:
    """The article's blocks joined by \\n; '' if there is none."""
    if not page:
        return ""
    tree = Tree(page)
    density, total, c, lc = densities(tree)
    n = len(tree.tag)
    under = [False] * n
    for k in range(tree.body, n):
        under[k] = k == tree.body or (k > 0 and under[tree.parent[k]])
    inside = [k for k in range(n) if under[k] and not tree.off[k]]
    if not inside:
        return ""
    aside = [False] * n
    for k in range(1, n):
        aside[k] = aside[tree.parent[k]] or tree.kind[k] == STRONG
    # Comments and the like hold the main subtree only if nothing else has text in blocks and they have an article.
    best = max(inside, key=lambda k: (total[k] if not aside[k] else 0, total[k] if tree.inside[k] else 0, -k))
    homes = [k for k in inside if tree.home[k] and not aside[k]]
    if homes and not tree.inside[best]:  # on short pages the body outweighs its article
        heavy = max(homes, key=lambda k: (total[k], -k))
        best = heavy if total[heavy] >= SHARE * total[best] else best
    threshold, k = density[best], best
    while k != tree.body:
        k = tree.parent[k]
        threshold = min(threshold, density[k])
    if total[best] <= 0:
        best = tree.body
    drop_parts(tree, best, total, c, lc)
    kids: list[list[int]] = [[] for _ in range(n)]
    for k in range(1, n):
        if not tree.off[k]:
            kids[tree.parent[k]].append(k)
    branch = list(range(n))  # the node of the greatest density sum in a subtree
    for k in range(n - 1, 0, -1):
        if not tree.off[k] and total[branch[k]] >= total[branch[tree.parent[k]]] and total[branch[k]] > total[tree.parent[k]]:
            branch[tree.parent[k]] = branch[k]
    chosen, todo = [False] * n, [tree.body]
    chosen[best] = True
    while todo:
        k = todo.pop()
        if density[k] < threshold or (chosen[k] and k != tree.body):
            continue
        # A leaf of text has no children to sum: it stands for itself. What is beside the path must have weight of its own.
        weight = total[branch[k]] or density[k]
        if k != tree.body and (branch[k] == best or weight >= SHARE * total[best]):
            chosen[branch[k] if total[branch[k]] > 0 else k] = True
        todo += kids[k]
    beside = widen(tree, kids, chosen, best, c, lc)
    for k in range(1, n):
        chosen[k] = chosen[k] or chosen[tree.parent[k]]
    blocks: dict[int, list[str]] = {}
    for i, (k, block, s) in enumerate(tree.texts):
        if (chosen[k] or i in beside) and not tree.off[k]:
            blocks.setdefault(block, []).append(s)
    lines = (" ".join(html.unescape("".join(x)).split()) for _, x in sorted(blocks.items()))
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with text and n_chars added (in place of columns of these names).

    Each row is parsed by itself, whole; null or empty HTML, and a page without text in its body, give an
    empty text. Unclosed and truncated markup is read as a browser would: open elements end with the page.
    """
    out = pages.drop("text", "n_chars") if html_col != "text" else pages.drop("n_chars").withColumnRenamed("text", "html")
    col = "html" if html_col == "text" else html_col

    bounded_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def text_of(pages: pd.Series) -> pd.Series:
        return pages.map(main_text)

    return out.withColumn("text", text_of(F.col(col))).withColumn("n_chars", F.char_length("text").cast("long"))
