"""Main text of web pages by minimum cut.

A page is read once into text blocks (text between block-level borders). A classifier gives each block the evidence that it is
content; that becomes its terminal capacity. Blocks that follow each other, and blocks under the same parent, are
tied by smoothness edges that weaken with their distance in the document tree. The minimum cut of this graph labels all blocks at once.

Evidence against an element (its tag, or a class, id, role or label) is inherited by all below it, but what it holds counts against it:
a ``main``, an article and long unlinked prose, unless the page has as much of it elsewhere (``relieved``).

Most blocks are settled exactly before any flow is sent: where the evidence outweighs all ties to open neighbours, no minimum
cut can label it otherwise. Only what is left goes through maximum flow.

Pages are independent: no shuffle, and memory follows the largest page.

Results: null or empty html, or a page without content, gives an empty text; unclosed tags, stray ends and bare
``<`` are read as a browser would, roughly; repeated rows repeat; a null id or url stays null; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import over_batches

NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
SPECIAL = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

# fixed values: HTML elements by their part in a page
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html label legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
UNSEEN = frozenset("script style noscript template svg head title iframe object canvas audio video map datalist".split())
RAW = frozenset("script style title textarea noscript iframe".split())
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
IN_HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LISTS = frozenset("ul ol dl table".split())
# fixed values: evidence, in the classifier's log-odds, of tags and of words in class, id and role
TAG_EVIDENCE = {"article": 3, "main": 2, "nav": -9, "aside": -9, "footer": -9, "form": -7, "button": -8, "select": -8, "menu": -8, "dialog": -9, "textarea": -9, "label": -4}
GOOD_NAMES = {"article": 2, "content": 2, "post": 1, "entry": 1, "story": 2, "main": 2, "body": 1, "text": 1}
BAD_NAMES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navigation navbar menu breadcrumb breadcrumbs sidebar aside footer comment comments reply replies discussion disqus respond cookie cookies consent gdpr notice notices alert popup modal overlay share sharing social related recommended recommendations newsletter subscribe subscription signup login search pagination pager toolbar widget widgets masthead copyright legal skip outbrain taboola".split())
BAD_EVIDENCE = -9
# fixed values: words that make a name one of a state ("has-sidebar", "comments-open"), of a frame around others, and that end the subject of a label
STATES = frozenset("has have with without no not is are open opened closed enabled disabled on off".split())
FRAMES = frozenset("wrap wrapper layout container grid row inner outer".split())
JOINTS = frozenset("about and at by for from in of on that this to with".split())
# fixed values: tags and words that an article beside them, or within, does not make less likely
FIRM = frozenset("nav navigation navbar menu aside sidebar footer dialog comment comments reply replies discussion disqus respond related recommended recommendations breadcrumb breadcrumbs pagination pager".split())
#: Evidence of what an element holds: a ``main``, an article, a name of content, and each long unlinked block.
HOLDS = {"main": 9.0, "article": 6.0, "content": 3.0, "": 0.0}
PROSE = 1.5
UNIT = 1000  # capacities are whole numbers
ADJACENT, SIBLING = 0.6, 0.4
PLAIN = 0.7


class Marks:
    """The marks of a page, one after another. Only forward, and a quote that leads nowhere is given up once, so a page takes time in proportion to its length."""

    def __init__(self, html: str):
        self.html, self.lost = html, set()  # quotes from which no end of a tag is reached
        self.last = {q: html.rfind(q) for q in "\"'"}
        self.close = html.find(">")

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """(start, end, whether it is an end tag, tag, attributes) of the first mark from ``at`` on; a comment or declaration has no tag."""
        html, i = self.html, self.html.find("<", at)
        while i >= 0:
            if html.startswith("<!--", i):
                end = html.find("-->", i + 4)
                return i, end + 3 if end >= 0 else len(html), False, "", ""
            if 0 <= self.close < i:
                self.close = html.find(">", i)
            if self.close >= 0:
                if html[i + 1] in "!?":
                    return i, self.close + 1, False, "", ""
                if name := NAME.match(html, i):
                    end = self._end(name.end())
                    return i, end + 1, bool(name[1]), name[2].lower(), html[name.end():end]
            i = html.find("<", i + 1)
        return None

    def _end(self, at: int) -> int:
        """The ``>`` that ends a tag: the first outside quotes or, if there is none, the first."""
        html, tried = self.html, []
        while found := SPECIAL.search(html, at):
            at = found.start()
            if html[at] == ">":
                return at
            if at in self.lost:
                break
            tried.append(at)
            if self.last[html[at]] <= at:
                break
            at = html.find(html[at], at + 1) + 1
        self.lost.update(tried)
        return self.close


class Trail:
    """What speaks for or against an element, linked to that of the elements around it."""

    __slots__ = ("above", "own", "reason", "holds", "seen", "prior")

    def __init__(self, above: Trail | None, own: float, reason: frozenset[str], holds: str):
        self.above, self.own, self.reason, self.holds = above, own, reason, holds
        self.seen = self.prior = None  # (reasons from here up, best that is held below the last of them), evidence after relief

    def unread(self, field: str) -> list[Trail]:
        """This and the trails around it whose ``field`` is not yet known, outermost first."""
        out, at = [], self
        while at is not None and getattr(at, field) is None:
            out.append(at)
            at = at.above
        return out[::-1]


class Block:
    __slots__ = ("linked", "parent", "depth", "parts", "prior", "tag", "trail")

    def __init__(self, prior: float, parent: int, depth: int, tag: str, trail: Trail | None = None):
        self.parts: list[str] = []
        self.linked, self.prior, self.parent, self.depth, self.tag, self.trail = 0, prior, parent, depth, tag, trail

    def text(self) -> str:
        return " ".join(unescape("".join(self.parts)).split())


NO_REASON: frozenset[str] = frozenset()


@lru_cache(1 << 12)
def _judged(name: str, phrase: bool) -> tuple[float, frozenset[str]]:
    """(evidence for content, bad words) of one whole name, or of a label that is a phrase: its subject, and of that the last known word, decides."""
    words = re.findall(r"[a-z]+", name)
    if phrase:
        words = words[:next((i for i, w in enumerate(words) if w in JOINTS), len(words))]
    known = [w for w in words if w in BAD_NAMES or w in GOOD_NAMES]
    bad, good = frozenset(w for w in known if w in BAD_NAMES), max((GOOD_NAMES.get(w, 0) for w in known), default=0)
    if not bad or not STATES.isdisjoint(words):
        return good, NO_REASON
    if good and (known[-1] in GOOD_NAMES or words[-1] in FRAMES):
        return 0, NO_REASON
    return 0, bad


def _names(attributes: str) -> tuple[float, bool, frozenset[str], bool]:
    """(evidence of the class, id, role and label of an element, whether it is hidden, its bad words, whether its role is main)."""
    good, bad, hidden, main = 0.0, NO_REASON, False, False
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            hidden = True
        elif name in ("class", "id", "role", "aria-label"):
            for whole in [value] if name == "aria-label" else value.split():
                better, worse = _judged(whole, name == "aria-label")
                good, bad = max(good, better), bad | worse
            main |= name == "role" and value.strip() == "main"
    if bad and good and bad.isdisjoint(FIRM):
        return 0.0, hidden, NO_REASON, main  # names that contradict each other say nothing
    return (BAD_EVIDENCE if bad else good), hidden, bad, main


def _inherited(prior: float, own: float) -> float:
    """Evidence below an element with ``own`` evidence: what speaks against adds up, and nothing below it speaks for."""
    return min(prior, 0) + own if own < 0 else (prior + own if prior >= 0 else prior)


def blocks_of(html: str) -> list[Block]:
    """The text blocks of a page in reading order; blocks without text are left out."""
    out: list[Block] = []
    stack: list[tuple[str, float, bool, int, Trail | None]] = []  # tag, evidence so far, unseen, number, trail so far
    framed: list[int] = []  # places of block elements in the stack
    open_tags: Counter[str] = Counter()
    trail: Trail | None = None
    prior, unseen, number, links = 0.0, 0, 0, 0
    block: Block | None = None
    at = 0

    def say(text: str) -> None:
        nonlocal block
        if stack and stack[-1][0] == "head" and text and not text.isspace():
            pop_to(len(stack) - 1)  # text ends a head, as in a browser
        if unseen or not text:
            return
        if block is None:
            if text.isspace():
                return
            block = Block(prior, stack[framed[-1]][3] if framed else 0, len(stack), stack[-1][0] if stack else "", trail)
            out.append(block)
        block.parts.append(text)
        if links:
            block.linked += len(text)

    def pop_to(depth: int) -> None:
        nonlocal prior, unseen, links, block, trail
        while len(stack) > depth:
            tag, prior, hid, _, trail = stack.pop()
            open_tags[tag] -= 1
            unseen -= hid
            links -= tag == "a"
            if tag in BLOCKS:
                block = None
                framed.pop()

    def last(tag: str) -> int | None:
        return next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag) if open_tags[tag] else None

    marks = Marks(html)
    while mark := marks.next(at):
        start, end, closing, tag, attributes = mark
        say(html[at:start])
        at = end
        if not tag:
            continue
        if closing:
            depth = last(tag)
            if depth is not None:
                pop_to(depth)
            elif tag in BLOCKS:
                block = None
            continue
        if tag == "body":
            while open_tags["head"]:  # a head that is still open ends here, whatever was left open in it
                pop_to(last("head"))
        elif stack and stack[-1][0] == "head" and tag not in IN_HEAD:
            pop_to(len(stack) - 1)
        if tag in VOID:
            if tag == "br":
                say(" ")
            elif tag in BLOCKS:
                block = None
            continue
        shut = CLOSES.get(tag) or ({"p"} if tag in BLOCKS else None)
        if shut:
            for i in reversed(framed):
                if stack[i][0] in shut:
                    pop_to(i)
                    break
                if stack[i][0] in LISTS or tag not in CLOSES or stack[i][0] not in ("p", "li", "dd", "dt", "td", "th"):
                    break
        named, hidden, bad, main = _names(attributes) if attributes.strip() else (0.0, False, NO_REASON, False)
        if tag in ("html", "body"):  # their names tell of the page and its states, not of what is in it
            named, bad, main = 0.0, NO_REASON, False
        own = TAG_EVIDENCE.get(tag, 0) + named
        against = bad | {tag} if TAG_EVIDENCE.get(tag, 0) < 0 else bad
        if tag == "header" and not open_tags["article"] and not open_tags["main"]:
            own += TAG_EVIDENCE["nav"]
            against |= {tag}
        hid = hidden or tag in UNSEEN
        number += 1
        stack.append((tag, prior, hid, number, trail))
        open_tags[tag] += 1
        if own or main:
            trail = Trail(trail, own, against if own < 0 else NO_REASON, "main" if main or tag == "main" else tag if tag == "article" else "content" if named >= 2 else "")
        prior = _inherited(prior, own)
        unseen += hid
        links += tag == "a"
        if tag in BLOCKS:
            block = None
            framed.append(len(stack) - 1)
        if tag in RAW and not attributes.rstrip().endswith("/"):
            # nothing is markup in here but the element's own end tag; without one it goes on to the end of the page
            end = RAW_END[tag].search(html, at)
            if end is None:
                return out
            say(html[at:end.start()])
            at = end.start()
    say(html[at:])
    return out


def relieved(read: list[tuple[Block, str]]) -> None:
    """Sets the priors of blocks below elements that something speaks against, counting what those elements hold against it.

    All elements of a page against which the same words speak share a verdict. Where the rest of the page has prose of its own, only a ``main`` or,
    for words that are not ``FIRM``, more prose and articles than in the rest counts.
    """
    held: dict[frozenset, tuple[float, str]] = {}  # by the reasons over a block: prose, and the best that lies below the last of them
    for b, t in read:
        for step in b.trail.unread("seen") if b.trail else ():
            reasons, holds = step.above.seen if step.above else (frozenset(), "")
            if step.own < 0:
                reasons, holds = reasons if step.reason in reasons else reasons | {step.reason}, ""
            step.seen = reasons, max(holds, step.holds, key=HOLDS.get)
        reasons, holds = b.trail.seen if b.trail else (frozenset(), "")
        if len(t) > 80 and 10 * b.linked <= 3 * len(t) or holds == "main":
            prose, best = held.get(reasons, (0.0, ""))
            held[reasons] = prose + PROSE * (len(t) > 80), max(best, holds, key=HOLDS.get)
    relief: dict[frozenset[str], float] = {}
    while True:
        done = relief.keys()
        rest = sum(prose for s, (prose, _) in held.items() if s <= done)

        def rank(s: frozenset) -> tuple:
            return len(s - done), held[s][1] != "main", any(not x.isdisjoint(FIRM) for x in s - done), -held[s][0]

        for wanted in sorted((s for s in held if not s <= done), key=rank):
            inside = [x for s, x in held.items() if s <= wanted | done and not s <= done]
            prose, best = sum(x[0] for x in inside), max((x[1] for x in inside), key=HOLDS.get)
            words = frozenset().union(*(wanted - done))
            firm = not words.isdisjoint(FIRM)
            worth = prose + (0.0 if firm and best != "main" else HOLDS[best])
            if best == "main" or not rest or not firm and worth > rest:
                for reason in wanted - done:
                    relief[reason] = max(worth, -TAG_EVIDENCE["form"]) if reason == {"form"} else worth
                break
        else:
            break
    if relief:
        for b, _ in read:
            for step in b.trail.unread("prior") if b.trail else ():
                own = min(0.0, step.own + relief.get(step.reason, 0.0)) if step.own < 0 else step.own
                step.prior = _inherited(step.above.prior if step.above else 0.0, own)
            b.prior = b.trail.prior if b.trail else 0.0


def evidence(block: Block, text: str) -> float:
    """Log-odds that a block is content."""
    score = block.prior - 0.6
    share = min(1.0, block.linked / max(1, len(text)))
    score -= 3.0 * share if block.prior < 3 else 1.5 * share
    if len(text) > 80:
        score += 1.0
    if len(text) > 200:
        score += 0.8
    if block.tag in ("p", "blockquote", "pre") or block.tag[:1] == "h" and block.tag[1:].isdigit():
        score += 0.8
    if text[-1:] in ".!?。":
        score += 0.4
    return score


def minimum_cut(unary: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Labels (True: source side) of least cost: a node pays ``|unary|`` for the side it speaks against, an edge its weight when cut.

    A node without evidence and ties is on the sink side.
    """
    n = len(unary)
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for a, b, w in edges:
        if a != b and w > 0:
            near[a][b] = near[a].get(b, 0) + w
            near[b][a] = near[b].get(a, 0) + w
    value, label = list(unary), [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is not None or abs(value[i]) < sum(near[i].values()):
            continue
        label[i] = value[i] > 0
        for j, w in near[i].items():
            value[j] += w if label[i] else -w
            del near[j][i]
            todo.append(j)
        near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if not rest:
        return label
    source, sink = n, n + 1
    cap: dict[int, dict[int, int]] = {i: dict(near[i]) for i in rest}
    cap[source], cap[sink] = {}, {}
    for i in rest:
        if value[i] > 0:
            cap[source][i], cap[i][source] = value[i], 0
        elif value[i] < 0:
            cap[i][sink], cap[sink][i] = -value[i], 0
    while True:
        level, wave = {source: 0}, deque([source])
        while wave:
            u = wave.popleft()
            for v, c in cap[u].items():
                if c > 0 and v not in level:
                    level[v] = level[u] + 1
                    wave.append(v)
        if sink not in level:
            break
        ways = {u: iter(cap[u]) for u in level}
        path = [source]
        while path:
            u = path[-1]
            if u == sink:
                push = min(cap[a][b] for a, b in zip(path, path[1:]))
                for a, b in zip(path, path[1:]):
                    cap[a][b] -= push
                    cap[b][a] = cap[b].get(a, 0) + push
                cut = next(k for k, (a, b) in enumerate(zip(path, path[1:])) if cap[a][b] == 0)
                del path[cut + 1:]
                ways[path[-1]] = iter(list(cap[path[-1]]))
                continue
            for v in ways[u]:
                if cap[u][v] > 0 and level.get(v) == level[u] + 1:
                    path.append(v)
                    break
            else:
                level[u] = -1
                path.pop()
    for i in rest:
        label[i] = i in level
    return label


def main_text(html: str) -> str:
    """The content blocks of a page, one per line."""
    read = [(b, t) for b in blocks_of(html) if (t := b.text())]
    if not read:
        return ""
    if any(b.prior < 0 for b, _ in read):
        relieved(read)
    # a page on which nothing is linked or spoken against has no boilerplate to tell from
    lean = PLAIN if not any(b.prior < 0 or b.linked for b, _ in read) else 0.0
    unary = [round(UNIT * (evidence(b, t) + lean)) for b, t in read]
    edges, last = [], {}
    for i, (b, _) in enumerate(read):
        if i:
            before = read[i - 1][0]
            apart = 0 if before.parent == b.parent else 1 + abs(before.depth - b.depth)
            edges.append((i - 1, i, round(UNIT * ADJACENT / (1 + apart))))
        if b.parent in last:
            edges.append((last[b.parent], i, round(UNIT * SIBLING)))
        last[b.parent] = i
    return "\n".join(t for (_, t), keep in zip(read, minimum_cut(unary, edges)) if keep)


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text) per row of ``pages``."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    kinds = dict(rows.dtypes)
    return over_batches(rows, read, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
