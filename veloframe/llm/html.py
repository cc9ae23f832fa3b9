"""Main text of web pages by a minimum cut between content and boilerplate.

A page is split into blocks at block-level tags; scripts, styles, comments and other
parts that show no text are skipped.  Each block is a node.  A classifier's cost of calling
the block boilerplate, and of calling it content, are its capacities to the two terminals.
Neighbours on the page, and blocks of the same parent or with a close common ancestor, are
tied by smoothness edges.  The maximum flow gives the labelling with the smallest sum of
costs and cut edges; blocks on the source's side are the main text.

The classifier is a logistic regression on the block's own tags, the tags and names around
it, link density and length.  It is trained here on at most ``TRAIN`` pages, the smallest by
a hash of page_id, whose blocks inside an article or main element, and outside parts
named as menus and the like, are content; each is also seen with the
article and main tags hidden, so that other features carry pages without them, and content
blocks as boilerplate under a bad name or tag.

Text keeps the order of the page.  White space in a block becomes one space, and kept
blocks are joined by one.  Character references are decoded.  An unclosed tag closes with
its parent, as browsers do.  Null or empty pages, and pages without a content block, give
the empty text.  Repeated rows give repeated results.  Pages are worked on one by one where
they lie, so nothing is shuffled.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

TRAIN = 400
SMOOTH = 0.35
NEAR = 0.6

#: Elements by what they do.
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset "
                  "figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol "
                  "optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIP = frozenset("script style head title template iframe svg canvas audio video select textarea "
                 "button datalist".split())
RAW = frozenset("script style textarea title".split())
CLOSES = {"p": frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 "
                         "header hr main menu nav ol p pre section table ul li".split())}
SAME = frozenset("li dd dt tr td th option".split())
BAD_TAGS = frozenset("nav footer aside form menu dialog header fieldset".split())
#: Words in class, id and role that name parts beside the main text.
BAD_NAMES = re.compile(r"(?<![a-z])(ads?|advert\w*|banner|promo\w*|sponsor\w*|nav\w*|menu\w*|side-?bar|foot\w*|head(er)?|masthead|"
                       r"breadcrumbs?|comment\w*|disqus|discussion|repl(y|ies)|respond|social|share|sharing|related|recommend\w*|"
                       r"widget\w*|popup|modal|overlay|cookies?|consent|gdpr|notice|newsletter|subscri\w*|login|sign-?(in|up)|search|"
                       r"toolbar|pagination|pager|copyright|legal|complementary|contentinfo|navigation|alert\w*|skip\w*|toc|tags?|"
                       r"byline|author-?bio|feedback|reader\w*|reviews?)(?![a-z])", re.I)
GOOD_NAMES = re.compile(r"(?<![a-z])(article\w*|content|main|post(-?(body|content|text))?|entry\w*|story\w*|text|body)(?![a-z])", re.I)
PARTS = (r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)(", r")>|([^<]+|<)")
TOKEN = re.compile(PARTS[0] + r"""(?:[^>"']|"[^"]*"|'[^']*')*+|[^>]*""" + PARTS[1], re.S)
PLAIN = re.compile(PARTS[0] + r"[^>]*" + PARTS[1], re.S)
DEPTH = 32
NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
#: A cheap test before attributes are told apart.
HIDDEN = re.compile(r"hidden|display\s*:\s*none", re.I)
ATTRIBUTE = re.compile(r"""([^\s"'=/>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")


def is_hidden(attrs: str) -> bool:
    """Whether an attribute hides the element; words in other attributes' values do not."""
    for name, value in ATTRIBUTE.findall(attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return False


class Block:
    __slots__ = ("parts", "size", "linked", "tags", "path", "bad", "worst", "good", "strong")

    def __init__(self, path, tags, bad, worst, good, strong):
        self.parts: list[str] = []
        self.size = self.linked = 0
        self.path, self.tags = path, tags
        self.bad, self.worst, self.good, self.strong = bad, worst, good, strong


def blocks_of(page: str) -> list[Block]:
    """Blocks that hold text, in page order."""
    out: list[Block] = []
    # each open element: tag, number, boilerplate tag, boilerplate name, good name, article, link
    stack: list[tuple] = [("", 0, False, False, False, False, False)]
    opened: Counter[str] = Counter()  # so that an end tag without a start costs nothing

    def cut(k: int) -> None:
        opened.subtract(e[0] for e in stack[k:])
        del stack[k:]

    made, skip_to = 0, -1
    current: Block | None = None
    at, end, last = 0, len(page), page.rfind(">")
    token = TOKEN
    while at < end:
        if at > last:  # no tag ends any more: text from here on
            closing = tag = None
            m_text, at = page[at:], end
        else:
            m = token.match(page, at)
            at = m.end()
            closing, tag, attrs, m_text = m.groups()
            if tag is None and m_text is None:
                continue  # comment or declaration
            if tag and (attrs.count('"') % 2 or attrs.count("'") % 2):
                token = PLAIN  # a quote that never closes: from now on tags end at the next sign
        if tag is None:
            if skip_to >= 0:
                continue
            if current is None:
                if m_text.isspace():
                    continue
                top = stack[-1]
                current = Block(tuple(e[1] for e in stack[-DEPTH:]), tuple(e[0] for e in stack[-3:]), top[2], top[3], top[4], top[5])
                out.append(current)
            current.parts.append(m_text)
            n = len(m_text)
            current.size += n
            if stack[-1][6]:
                current.linked += n
            continue
        tag = tag.lower()
        if not closing:
            if tag in BLOCK:
                closes = None
                if stack[-1][0] == "p" and tag in CLOSES["p"] or tag in SAME and stack[-1][0] == tag:
                    closes = len(stack) - 1
                elif tag in CLOSES["p"]:  # an inline element may stand open inside the paragraph
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] == "p":
                            closes = k
                            break
                        if stack[k][0] in BLOCK or stack[k][0] in SKIP or stack[k][0] == "object":
                            break
                if closes:
                    cut(closes)
                    if skip_to >= len(stack):
                        skip_to = -1  # the end of a hidden element may be implied, too
                if skip_to < 0:
                    current = None
            if tag in VOID or attrs.endswith("/") and tag not in BLOCK and tag not in RAW:
                continue
            if tag in RAW:
                stop = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                at = stop.end() if stop else end
                continue
            made += 1
            _, _, bad, worst, good, strong, link = stack[-1]
            if tag in ("article", "main"):
                worst = False  # a name around the whole page does not condemn its article
            if attrs and tag not in ("html", "body"):
                names = " ".join(NAMES.findall(attrs))
                if names:
                    worst = worst or bool(BAD_NAMES.search(names))
                    good = good or bool(GOOD_NAMES.search(names))
                if skip_to < 0 and HIDDEN.search(attrs) and is_hidden(attrs):
                    skip_to = len(stack)
            # the header of an article is a part of it
            bad = bad or tag in BAD_TAGS and not (tag == "header" and strong)
            stack.append((tag, made, bad, worst, good, strong or tag in ("article", "main"), link or tag == "a"))
            opened[tag] += 1
            if tag in SKIP and skip_to < 0:
                skip_to = len(stack) - 1
        else:
            for k in range(len(stack) - 1 if opened[tag] else 0, 0, -1):
                if stack[k][0] == tag:
                    cut(k)
                    if skip_to >= len(stack):
                        skip_to = -1
                    break
            if tag in BLOCK and skip_to < 0:
                current = None
    return [b for b in out if not all(p.isspace() for p in b.parts)]


def features(b: Block, hide: bool = False, named: bool = False, tagged: bool = False) -> list[float]:
    """Of a block as it is, or as it were without article tags, under a bad name, under a bad tag."""
    strong, bad, worst = b.strong and not hide, b.bad or tagged, b.worst or named
    tag = b.tags[-1]
    return [1.0, strong, bad, worst, b.good, b.linked / max(b.size, 1), math.log1p(b.size) / 8, b.size < 25,
            "p" in b.tags, tag in ("li", "td", "option", "label"), tag in ("h1", "h2", "h3", "h4"),
            strong and not bad and not worst]


N_FEATURES = 12


class Classifier:
    def __init__(self, weights: np.ndarray):
        self.weights = weights

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, steps: int = 400, rate: float = 1.0, ridge: float = 1e-3) -> Classifier:
        """Logistic regression by gradient descent; without rows, weights that follow the names alone."""
        start = np.array([0.0, 2, -4, -4, 1, -3, 1, -0.5, 1, -0.5, 0.5, 1])
        if not len(y) or y.min() == y.max():
            return cls(start)
        w = start.copy()
        balance = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            w -= rate * (x.T @ ((p - y) * balance) / len(y) + ridge * (w - start))
        return cls(w)

    def costs(self, blocks: Iterable[Block]) -> list[float]:
        """Log odds of content."""
        return (np.array([features(b) for b in blocks], np.float64) @ self.weights).clip(-12, 12).tolist()


def min_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for nodes on the source's side of the minimum cut (Dinic's maximum flow).

    A node with odds above 0 is tied to the source by them, others to the sink."""
    n = len(odds)
    source, sink = n, n + 1
    to: list[int] = []
    cap: list[float] = []
    links: list[list[int]] = [[] for _ in range(n + 2)]

    def add(a: int, b: int, forth: float, back: float) -> None:
        links[a].append(len(to))
        to.append(b)
        cap.append(forth)
        links[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i, o in enumerate(odds):
        if o > 0:
            add(source, i, o, 0.0)
        elif o < 0:
            add(i, sink, -o, 0.0)
    for a, b, c in edges:
        add(a, b, c, c)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in links[a]:
                if cap[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        nxt = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                first = next(k for k, e in enumerate(path) if cap[e] <= tiny)
                a = to[path[first] ^ 1]
                del path[first:]
            own = links[a]
            while nxt[a] < len(own):
                e = own[nxt[a]]
                if cap[e] > tiny and level[to[e]] == level[a] + 1:
                    break
                nxt[a] += 1
            if nxt[a] < len(own):
                path.append(own[nxt[a]])
                a = to[path[-1]]
            elif a == source:
                break
            else:
                level[a] = -1
                a = to[path.pop() ^ 1]


def smoothness(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Edges between neighbours, by how much of their paths they share, and along each parent."""
    edges, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            p, q = blocks[i - 1].path, b.path
            edges.append((i - 1, i, SMOOTH * len(set(p) & set(q)) / max(len(p), len(q))))
        parent = b.path[-2:-1]
        if parent in last and last[parent] != i - 1:
            edges.append((last[parent], i, NEAR * SMOOTH))
        last[parent] = i
    return edges


def main_text(page: str | None, classifier: Classifier) -> str:
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    odds = classifier.costs(blocks)
    if min(odds) > 0 or max(odds) < 0:
        keep = [o > 0 for o in odds]  # no cut is needed: the flow saturates one terminal only
    else:
        keep = min_cut(odds, smoothness(blocks))
    texts = [" ".join(html.unescape("".join(b.parts)).split()) for b, k in zip(blocks, keep) if k]
    return " ".join(t for t in texts if t)


def fit_classifier(pages: DataFrame, train: int = TRAIN) -> Classifier:
    """From at most ``train`` pages; only features of their blocks reach the driver."""
    sample = pages.select("page_id", F.col("html").cast("string").alias("html")).where("html is not null").orderBy(
        F.xxhash64("page_id"), "page_id").limit(train).select("html")

    def make():
        def rows(page):
            blocks = blocks_of(page)
            if not any(b.strong for b in blocks):
                return []
            step = max(1, len(blocks) // 200)
            out = []
            for b in blocks[::step]:
                y = int(b.strong and not b.bad and not b.worst)
                out += [(features(b), y), (features(b, hide=True), y)]
                if y:  # the same block in a part named or tagged as boilerplate
                    out += [(features(b, named=True), 0), (features(b, tagged=True), 0)]
            return out

        return rows

    got = sorted((tuple(r.x), r.y) for r in map_rows(sample, make, "x array<double>, y int").collect())
    return Classifier.fit(np.array([x for x, _ in got], np.float64).reshape(-1, N_FEATURES), np.array([y for _, y in got], np.float64))


def extract(pages: DataFrame, train: int = TRAIN) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages``."""
    classifier = fit_classifier(pages, train)

    def make():
        def row(page_id, url, page):
            text = main_text(page, classifier)
            return [(page_id, url, text, len(text))]

        return row

    return map_rows(pages.select("page_id", "url", F.col("html").cast("string").alias("html")), make,
                    "page_id long, url string, text string, n_chars long")
