"""HTML extraction: a minimum cut labels the blocks of a page as main text or boilerplate.

A page is cut into blocks of text at block-level tags. A small linear classifier over a block's tags, class and id words,
length, sentence marks and link share gives a log-odds of being main text; its size is the capacity to the source or the
sink. Neighbouring blocks are joined by an edge that is weaker the farther apart they lie in the element tree, and a
block is joined to the previous block of the same parent. The minimum cut of that graph is the cheapest labelling. Blocks
whose own capacity outweighs all their edges are settled first, which does not change the cut; augmenting paths do the rest.

Each page is handled alone, without a shuffle.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixloom.llm.common import pieces

# Fixed values of the HTML language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg math iframe object textarea select title canvas audio video".split())
# Their content is never markup, so one without an end lasts to the end of the page.
UNREAD = frozenset("script style textarea title".split())
BLOCK = frozenset(("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form "
                   "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody tfoot thead tr ul").split())
CLOSES_P = BLOCK - {"button", "option", "legend", "summary"}

# Words of class and id names and what they say; layout words are ignored on what encloses an article.
LAYOUT = frozenset("sidebar side menu nav navbar navigation topbar toolbar header masthead footer foot bottom rail".split())
OTHER = frozenset(("ad ads adv advert advertisement adverts advertising adsense sponsor sponsored sponsors banner promo promotion cookie cookies consent gdpr "
                   "notice notices notification alert breadcrumb breadcrumbs comment comments commentlist disqus respond reply replies share sharing social "
                   "related recommended recommendations newsletter subscribe subscription signup login popup modal overlay widget pagination pager "
                   "skip legal copyright disclaimer search form tags metadata outbrain taboola").split())
MAIN = frozenset("article content main post entry hentry story text body articlebody maincontent".split())
COMMENT = frozenset("comment comments commentlist".split())
# First words of names that state something about an element or its subject, not what it is.
STATES = frozenset("has no not is with without category tag type format status".split())
TITLED = frozenset("section p h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog menu menubar form".split())
AWAY = frozenset("nav aside footer form menu button dialog fieldset label".split())

STRONG, NEXT, SIBLING = 9.0, 0.9, 0.4

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"']|[\"'](?=[^\"']*(?:>|\Z)))*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SENTENCE_END = re.compile(r"[.!?…。][\"'”’)\]]*$")
_SMALL_PRINT = re.compile(r"©|all rights reserved|cookie", re.I)


class _Element:
    __slots__ = ("tag", "depth", "parent", "holder", "article", "main", "away", "layout", "link")

    def __init__(self, tag: str, attributes: str, parent: _Element | None):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        self.holder: _Element = self if tag in BLOCK or parent is None else parent.holder
        inside = (parent.article, parent.main, parent.away, parent.layout, parent.link) if parent else (False, False, False, False, False)
        self.article, self.main, self.away, self.layout, self.link = inside
        if tag in ("article", "main"):
            self.article, self.layout = True, False
        self.link |= tag == "a"
        self.away |= tag in AWAY or tag == "header" and not self.article
        if attributes and tag not in ("html", "body"):
            words: set[str] = set()
            said: list[set[str]] = []
            for name, *values in _ATTRIBUTE.findall(attributes):
                name, value = name.lower(), next((v for v in values if v), "")
                if name in ("class", "id"):
                    for one in value.split():
                        parts = [w.lower() for w in _WORD.findall(one)]
                        words.update(parts)
                        # Ids of parts of an article are made from their titles.
                        titled = name == "id" and self.article and tag in TITLED and not OTHER.issuperset(parts)
                        if parts and parts[0] not in STATES and not titled:
                            said.append(set(parts))
                elif name == "role":
                    self.away |= value.lower() in ROLES
                elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and "display:none" in value.lower().replace(" ", ""):
                    self.away = True
            # Where the tag or a whole name says main text, a word in a longer name does not outweigh it; comments can be articles too.
            named = any(w <= MAIN for w in said)
            if named or tag in ("article", "main"):
                self.away |= any(w <= OTHER or not named and w & COMMENT for w in said)
            else:
                self.away |= any(w & OTHER for w in said)
            self.layout |= bool(words & LAYOUT) and not words & MAIN
            self.main |= bool(words & MAIN)


class _Block:
    __slots__ = ("element", "tag", "parts", "link_chars", "chars", "text")

    def __init__(self, element: _Element | None):
        self.element, self.tag = element, element.tag if element else ""
        self.parts: list[str] = []
        self.link_chars = self.chars = 0
        self.text = ""


def page_blocks(page: str) -> list[_Block]:
    """Blocks with text, in page order."""
    at, stack, out = 0, [], []
    opened: Counter[str] = Counter()
    unclosed: set[str] = set()
    block: _Block | None = None

    def took(text: str) -> None:
        nonlocal block
        if not text:
            return
        if block is None:
            if text.isspace():
                return
            block = _Block(stack[-1].holder if stack else None)
        block.parts.append(text)
        size = len(text) - text.count(" ")
        block.chars += size
        if stack and stack[-1].link:
            block.link_chars += size

    def ended() -> None:
        nonlocal block
        if block is not None:
            block.text = " ".join(html.unescape("".join(block.parts)).split())
            if block.text:
                out.append(block)
            block = None

    def shut(depth: int) -> None:
        opened.subtract(e.tag for e in stack[depth:])
        del stack[depth:]

    find = _MARKUP.search
    while (m := find(page, at)) is not None:
        took(page[at:m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag in BLOCK:
                ended()
            elif tag in ("td", "th"):
                took(" ")
            if opened[tag]:
                shut(next(i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == tag))
            continue
        if tag in RAW:
            if not m[3].endswith("/") and tag not in unclosed:
                close = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                if close:
                    at = close.end()
                elif tag in UNREAD:
                    at = len(page)
                else:
                    unclosed.add(tag)
            continue
        if tag in BLOCK:
            ended()
            if tag in CLOSES_P:
                shut(_closed(stack, "p", ("td", "th")) if opened["p"] else len(stack))
            if tag == "li":
                shut(_closed(stack, "li", ("ul", "ol", "menu")) if opened["li"] else len(stack))
        elif tag in ("br", "td", "th"):
            took(" ")
        if tag not in VOID:
            stack.append(_Element(tag, m[3], stack[-1] if stack else None))
            opened[tag] += 1
    took(page[at:])
    ended()
    return out


def _closed(stack: list[_Element], tag: str, bounds: tuple[str, ...]) -> int:
    """Depth of the open element of this name that ends here; that of the whole stack if none is inside the nearest bound."""
    for i in range(len(stack) - 1, -1, -1):
        if stack[i].tag == tag:
            return i
        if stack[i].tag in bounds or stack[i].tag in BLOCK and stack[i].tag != "p" and tag == "p":
            break
    return len(stack)


def log_odds(block: _Block, has_article: bool = False) -> float:
    """The classifier: positive for main text. has_article: the page marks an article, so what lies outside is less likely."""
    e, n = block.element, block.text.count(" ") + 1
    score = -0.6 - 2.0 * (has_article and not (e and e.article))
    if e is not None:
        score += 3.0 * e.article + 1.5 * e.main - STRONG * e.away - STRONG * e.layout
    score += {"p": 1.2, "blockquote": 1.0, "pre": 1.0, "li": -0.2}.get(block.tag, 0.8 if block.tag[:1] == "h" and block.tag[1:].isdigit() else 0.0)
    score += 1.8 if n >= 12 else -0.6 if n < 4 else 0.2
    score += 0.6 if _SENTENCE_END.search(block.text) else 0.0
    if block.chars and block.link_chars > 0.5 * block.chars:
        score -= 2.0
    if n < 30 and not (e and e.article) and _SMALL_PRINT.search(block.text):
        score -= 2.0
    return score


def _distance(a: _Element | None, b: _Element | None) -> int:
    steps = 0
    while a is not b:
        if b is None or a is not None and a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def edges_of(blocks: list[_Block]) -> dict[int, dict[int, float]]:
    near: dict[int, dict[int, float]] = {i: {} for i in range(len(blocks))}
    last: dict[int, int] = {}

    def joined(i: int, j: int, c: float) -> None:
        near[i][j] = near[j][i] = near[i].get(j, 0.0) + c

    for i, b in enumerate(blocks):
        if i:
            joined(i - 1, i, NEXT / (1 + _distance(blocks[i - 1].element, b.element)) ** 0.5)
        parent = id(b.element.parent) if b.element and b.element.parent else None
        if parent in last:
            joined(last[parent], i, SIBLING)
        last[parent] = i
    return near


def minimum_cut(costs: list[float], near: dict[int, dict[int, float]]) -> list[bool]:
    """True on the source side: costs are capacities to the source (positive) or the sink (negative)."""
    costs, near = list(costs), {i: dict(x) for i, x in near.items()}
    label: dict[int, bool] = {}
    todo = list(near)
    while todo:  # settled blocks hand their edges on as capacities
        i = todo.pop()
        if i in label or abs(costs[i]) < sum(near[i].values()):
            continue
        label[i] = costs[i] > 0
        for j, c in near.pop(i).items():
            del near[j][i]
            costs[j] += c if label[i] else -c
            todo.append(j)
    # Shortest augmenting paths on what is left; -1 is the source, -2 the sink.
    left: dict[int, dict[int, float]] = {i: dict(x) for i, x in near.items()}
    left[-1], left[-2] = {}, {}
    for i in near:
        a, b = (-1, i) if costs[i] > 0 else (i, -2)
        left[a][b] = abs(costs[i])
        left[b].setdefault(a, 0.0)
    while True:
        back, queue = {-1: -1}, [-1]
        for u in queue:
            for v, c in left[u].items():
                if c > 1e-12 and v not in back:
                    back[v] = u
                    queue.append(v)
            if -2 in back:
                break
        if -2 not in back:
            break
        path, v = [], -2
        while v != -1:
            path.append((back[v], v))
            v = back[v]
        flow = min(left[u][v] for u, v in path)
        for u, v in path:
            left[u][v] -= flow
            left[v][u] = left[v].get(u, 0.0) + flow
    label.update({i: i in back for i in near})
    return [label[i] for i in range(len(costs))]


def main_text(page: str) -> str:
    found = page_blocks(page)
    has_article = any(b.element and b.element.article for b in found)
    kept = minimum_cut([log_odds(b, has_article) for b in found], edges_of(found))
    return "\n".join(b.text for b, keep in zip(found, kept) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars; one row per page.

    Null or empty html, or a page without main text, gives an empty text. Broken markup ends where the page ends. Repeated
    rows and null ids stay as they are; other columns are not read.
    """

    @F.arrow_udf("string")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in pieces(batches):
            yield pa.array([main_text(p.as_py() or "") for p in column], pa.string())

    text = of.asNondeterministic()(F.col("html"))
    return pages.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
