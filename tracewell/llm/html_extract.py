"""Main text of web pages by wrapper induction.

Pages of a host come from a few templates. Pages with the same skeleton (their upper containers) are of one kind, and the kinds with most
text give the host its reference pages, at most REFERENCES, never one without text. Every page is aligned with the reference of its kind, or
else with the first, by simple tree matching over trees of block elements, and counts are kept per reference node: how often it was met, how often with the same text, and how
much text stood there. Nodes that stay the same are template; nodes that vary are slots. The region of a reference is the
deepest node that holds most of the varying text. A page's content are its slots in the region.

A check by markup follows: menus, page headers, footers, asides, forms, adverts, notices and comments
(by tag, role, or a word of class or id) are never content, though their text may vary; but a word alone doesn't rule out what holds the
page's marked articles, the induced region, or, without marks, most of the text. And the elements that a page marks as its
article (article, main, role=main, itemprop=articleBody) are held against the induced region and template: marked text outside the
region is content too, and a template that takes most of the marked text (copies of one article) is not applied.

The counts of all pages are sums with a row per task and node; only the reference pages travel, broadcast when
their measured size allows it, else by a join whose hot hosts are salted.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import materialize

#: Fixed values of the format.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup header".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul button caption".split())
SCOPE = BLOCK - frozenset("p li dt dd option tr td th thead tbody tfoot h1 h2 h3 h4 h5 h6".split())
#: A start tag ends an open element of these kinds, if no element of SCOPE lies between.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}

#: What is never content: tags, roles, and words of class or id.
SKIP_TAGS = frozenset("nav footer aside form script style noscript template iframe object svg canvas button select textarea dialog search menu head title".split())
SKIP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
SKIP_WORDS = frozenset("ad ads advert adverts advertisement adsense sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs sidebar footer cookie cookies consent gdpr notice notices alert alerts paywall popup modal overlay newsletter subscribe subscription share sharing social related recommended comment comments disqus respond reply replies widget toolbar pagination pager login signup masthead topbar".split())

_TOKEN = re.compile(r"<!--(?:.*?-->|.*\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^<>]*+)>", re.S)
_ATTR = re.compile(r"""(class|id|role|hidden|style|itemprop|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_OPEN = re.compile(r"<[a-zA-Z/!?]")
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")  # of class and id: adBox is ad and box
_HOST = r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)"

#: A node is template from so many met pages and so large a share of equal texts on.
MIN_PAGES, SAME = 3, 0.9
REGION = 0.6
#: Reference pages of a host, what a page's text counts for its kind at most, and what makes a skeleton: tags, down to a depth, in counts up to 3.
REFERENCES, KIND_CHARS = 3, 2000
SKELETON, DEPTH = frozenset("html body div main article section nav header footer aside form center table".split()), 5
#: Reference pages up to so many bytes in all are broadcast.
BROADCAST_BYTES = 32 << 20
#: Characters of reference pages that a task holds before it sends them on.
HELD_CHARS = 16 << 20
#: Pairs of blocks in a grid in memory, and for which two lists are matched exactly.
MAX_GRID, MAX_EXACT = 40_000, 1_000_000
#: Kinds of marks, in Block.main.
ARTICLE, MAIN = 1, 2
#: A template that takes more than this share of the marked text is not applied to it; a block with more of the page's text than this is no side matter.
MOST = 0.5


class Block:
    """A block element: its tag, whether markup rules it out (worded: only a word of class or id does) or marks it, and its items: runs of text and blocks, in order."""

    __slots__ = ("tag", "skip", "worded", "main", "items", "parent", "shape", "number", "size", "own", "kids")

    def __init__(self, tag: str, parent: Block | None = None):
        self.tag, self.parent = tag, parent
        self.skip, self.worded, self.main = False, False, 0
        self.items: list = []
        self.shape = self.number = self.size = -1
        self.own: str | None = None
        self.kids: list[Block] | None = None

    def blocks(self) -> list[Block]:
        """The blocks among the items, found once: items don't change after parsing."""
        if (kids := self.kids) is None:
            kids = self.kids = [x for x in self.items if type(x) is Block]
        return kids

    def text(self) -> str:
        """The block's own text, without the blocks in it."""
        if (own := self.own) is None:
            own = self.own = "\n".join([t for x in self.items if type(x) is not Block and (t := clean(x))])
        return own


def clean(run: list[str]) -> str:
    s = run[0] if len(run) == 1 else "".join(run)
    return " ".join((unescape(s) if "&" in s else s).split())


def _rules(tag: str, attrs: str, inside_main: bool) -> tuple[bool, bool, int]:
    """(ruled out by tag or attribute, by a word of class or id, marked as ARTICLE or MAIN)."""
    some = whole = False
    skip, main = tag in SKIP_TAGS, {"article": ARTICLE, "main": MAIN}.get(tag, 0)
    if tag == "header" and not inside_main:
        skip = True
    if attrs and not attrs.isspace():
        for name, a, b, c in _ATTR.findall(attrs):
            name, exact = name.lower(), a or b or c
            value = exact.lower()
            if name == "role":
                skip, main = skip or value in SKIP_ROLES, main or MAIN * (value == "main")
            elif name == "itemprop":
                main = main or ARTICLE * (value == "articlebody")
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
                skip = True
            elif name in ("class", "id"):
                words = {w.lower() for w in _WORD.findall(exact)}
                if words & SKIP_WORDS or "header" in words and not inside_main:
                    some = True
                    whole = whole or any(own and all(w in SKIP_WORDS or w.isdigit() for w in own) for own in ([w.lower() for w in _WORD.findall(name)] for name in exact.split()))
    # of a mark's own names only one made of such words alone counts: comment, but not no-comments
    return skip, (whole if main else some) and tag not in ("html", "body"), main


class _Open:
    """The open elements: inline ones with the block they are in. Each question about them is answered from the tops of short lists, however deep the page."""

    __slots__ = ("stack", "at", "blocks", "scopes", "mains")

    def __init__(self, root: Block):
        self.stack: list[tuple] = [("#page", root, False, False, False)]  # tag, block, whether it is its own, in BLOCK, in SCOPE
        self.at: dict[str, list[int]] = {}  # of each tag, where it is open
        self.blocks, self.scopes = [0], [0]  # where elements of BLOCK and SCOPE are open
        self.mains = 0

    def push(self, tag: str, block: Block, own: bool, is_block: bool, is_scope: bool) -> None:
        k = len(self.stack)
        self.stack.append((tag, block, own, is_block, is_scope))
        if (places := self.at.get(tag)) is None:
            self.at[tag] = [k]
        else:
            places.append(k)
        if is_block:
            self.blocks.append(k)
            if is_scope:
                self.scopes.append(k)
        if own and block.main:
            self.mains += 1

    def close(self, depth: int) -> bool:
        """Ends all elements from depth on; whether a block was among them."""
        ended, stack, at = False, self.stack, self.at
        while len(stack) > depth:
            tag, block, own, is_block, is_scope = stack.pop()
            at[tag].pop()
            if is_block:
                self.blocks.pop()
                if is_scope:
                    self.scopes.pop()
            if own or is_block:
                ended = True
                if own and block.main:
                    self.mains -= 1
        return ended

    def last(self, tags) -> int:
        """Where the innermost open element of one of the tags is; -1 if there is none."""
        k = -1
        for t in tags:
            if (places := self.at.get(t)) and places[-1] > k:
                k = places[-1]
        return k

    def end(self, tag: str, is_block: bool) -> bool:
        """An end tag: ends its element and what is in it. An inline one doesn't reach out of its block, and stray ones end nothing."""
        if not (places := self.at.get(tag)):
            return False
        return (is_block or places[-1] > self.blocks[-1]) and self.close(places[-1])

    def begin(self, tag: str, ends: frozenset) -> bool:
        """A block's start tag: ends the open elements that it implies the end of, within its scope."""
        ended = False
        while (k := self.last(ends)) > self.scopes[-1]:
            ended = self.close(k) or ended
            if tag in ("li", "dt", "dd", "option") or self.stack[-1][0] not in ends:
                break
        return ended


def _raw_end(tag: str, known: dict = {t: re.compile(f"</{t}", re.I | re.A) for t in RAW}) -> re.Pattern:
    return known[tag]


#: What a tag is to the parser.
START, END, RAWTEXT, SPACE, NOTHING = range(5)
#: Tags remembered, by their text, and the longest text of one.
MAX_TAGS, MAX_TAG = 5_000, 100
_NO_ENDS, _ENDS = frozenset(), {t: frozenset(ENDS.get(t, set()) | ({"p"} if t not in ("option", "button") else set())) for t in BLOCK}


def _tag(m: re.Match) -> tuple:
    """Of a tag's match, and told from its text alone: what it is, its name, whether in BLOCK and in SCOPE, the names it ends, whether it stays open, and its rules outside and inside of a main."""
    end, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
    tag = tag.lower()
    kind = END if end else RAWTEXT if tag in RAW else SPACE if tag == "br" else NOTHING if tag in VOID and tag != "hr" else START
    if kind != START:
        return kind, tag, tag in BLOCK, False, _NO_ENDS, False, (), ()
    inside = _rules(tag, attrs, True)
    outside = _rules(tag, attrs, False) if tag == "header" or "header" in attrs.lower() else inside
    stays = tag != "hr" and (not attrs.endswith("/") or tag in BLOCK)
    return kind, tag, tag in BLOCK, tag in SCOPE, _ENDS.get(tag, _NO_ENDS), stays, outside, inside


def parse(page: str | None, release: bool = True, known: dict[str, tuple] = {}) -> Block:
    """The page as a tree of blocks. Any text is a page: unclosed and stray tags are mended as browsers mend the usual ones.

    Without release all worded blocks stay ruled out; the tree and its texts are the same. known: the tags met, on all pages.
    """
    root = Block("#page")
    page = page or ""
    open_ = _Open(root)
    stack, begin, ended, push = open_.stack, open_.begin, open_.end, open_.push
    run: list | None = None
    worded: list[Block] = []
    marks: list[Block] = []
    at = 0
    for_token = _TOKEN.search
    while m := for_token(page, at):
        start, stop = m.span()
        if start > at:
            if run is None:
                stack[-1][1].items.append(run := [page[at:start]])
            else:
                run.append(page[at:start])
        at = stop
        text = m[0]
        found = known.get(text)
        if found is None:
            if m.lastindex is None:  # a comment or declaration
                if text.startswith("<![CDATA["):
                    if run is None:
                        stack[-1][1].items.append(run := [])
                    run.append(text[9:-3])
                continue
            found = _tag(m)
            if len(text) <= MAX_TAG:
                if len(known) >= MAX_TAGS:
                    known.clear()
                known[text] = found
        kind, tag, is_block, is_scope, ends, stays, outside, inside = found
        if kind == START:
            if is_block and begin(tag, ends):
                run = None
            skip, word, main = inside if open_.mains else outside
            block = stack[-1][1]
            own = bool(is_block or skip or word or main)
            if own:
                block.items.append(block := Block(tag, block))
                if skip or word:
                    block.skip = True
                    if not skip:
                        block.worded = True
                        worded.append(block)
                if main:
                    block.main = main
                    marks.append(block)
                run = None
            if stays:
                push(tag, block, own, is_block, is_scope)
        elif kind == END:
            if ended(tag, is_block) or tag == "p":  # a stray </p> is an empty paragraph
                run = None
        elif kind == RAWTEXT:
            close = _raw_end(tag).search(page, at)
            at = len(page) if close is None else (page.find(">", close.end()) + 1 or len(page))
        elif kind == SPACE:
            if run is None:
                stack[-1][1].items.append(run := [])
            run.append(" ")
    if at < len(page):
        cut = _OPEN.search(page, at)  # a tag that the page's end cuts off is no text
        if run is None:
            stack[-1][1].items.append(run := [])
        run.append(page[at : cut.start() if cut else len(page)])
    if worded and release:
        _release(root, worded, marks)
    return root


def _release(root: Block, worded: list[Block], marks: list[Block]) -> None:
    """Lets the blocks of worded count again that hold all marked articles that count, or, without any, most of the page's text."""
    order = _walk(root)
    firm, out = _held(order, [b for b in order if b.skip and not b.worded]), _ruled_out(order)
    live = [m for m in marks if m not in firm]
    if live:
        if all(m in out for m in live):  # else those in a block of comments or related pages stay out
            for b in _with_above(live):
                b.skip = b.skip and not b.worded
        return
    order, sizes = [root], {}
    for b in order:
        order += [c for c in b.blocks() if not c.skip or c.worded]
    for b in reversed(order):
        sizes[b] = len(b.text()) + sum(sizes.get(c, 0) for c in b.blocks())
    for b in worded:
        if sizes.get(b, 0) > MOST * sizes[root]:
            b.skip = False


def number(root: Block, shapes: dict) -> list[Block]:
    """The blocks in page order, with numbers, sizes (blocks in them, and themselves), and shapes: equal where tags agree all the way down."""
    order, todo = [], [root]
    while todo:
        b = todo.pop()
        b.number = len(order)
        order.append(b)
        if held := b.blocks():
            todo += held[::-1]
    for b in reversed(order):
        size, key = 1, [b.tag]
        for c in b.kids:
            size += c.size
            key.append(c.shape)
        b.size, b.shape = size, shapes.setdefault(tuple(key), len(shapes))
    return order


def align(one: Block, two: Block, memo: dict) -> list[tuple[Block, Block]]:
    """Simple tree matching: the pairs of a largest order- and parent-keeping match of blocks with equal tags."""
    missing: list[tuple[Block, Block]] = []

    def weight(a: Block, b: Block) -> int:
        """The size of a largest match of a and b, by shape; one not known yet is noted in missing and counts 0."""
        if a.tag != b.tag:
            return 0
        if a.shape == b.shape:
            return a.size
        known = memo.get((a.shape, b.shape))
        if known is None:
            missing.append((a, b))
        return known or 0

    def weigh(a: Block, b: Block) -> None:
        """Puts the weights that the match of the children of a and b needs into memo, from the leaves up and without recursion."""
        todo = [(a, b)]
        while todo:
            x, y = todo[-1]
            if (x.shape, y.shape) in memo:
                todo.pop()
                continue
            missing.clear()
            total = 1 + sum(weight(c, d) for c, d in children(x.blocks(), y.blocks()))
            if missing:
                todo += {(c.shape, d.shape): (c, d) for c, d in missing}.values()
            else:
                memo[x.shape, y.shape] = total
                todo.pop()

    def children(p: list[Block], q: list[Block], texts: bool = False) -> list[tuple[Block, Block]]:
        head, tail, most = 0, 0, min(len(p), len(q))
        while head < most and p[head].shape == q[head].shape:
            head += 1
        most -= head
        while tail < most and p[-1 - tail].shape == q[-1 - tail].shape:
            tail += 1
        out = list(zip(p[:head], q[:head], strict=True))
        if tail < most:
            out += middle(p[head : len(p) - tail], q[head : len(q) - tail], texts)
        if tail:
            out += zip(p[-tail:], q[-tail:], strict=True)
        return out

    def middle(p: list[Block], q: list[Block], texts: bool) -> list[tuple[Block, Block]]:
        if len(p) * len(q) <= MAX_EXACT:
            return split(p, q)
        # lists too long for an exact match are cut at blocks with equal shapes and texts, or else at their middles
        cuts = anchors(p, q) if texts else []
        out, i, j = [], 0, 0
        for k, m in cuts or [(len(p) // 2, len(q) // 2)]:
            out += children(p[i:k], q[j:m], texts) + [(p[k], q[m])] * bool(cuts)
            i, j = k + bool(cuts), m + bool(cuts)
        return out + children(p[i:], q[j:], texts)

    def split(p: list[Block], q: list[Block]) -> list[tuple[Block, Block]]:
        """A largest match in linear memory (Hirschberg): p is halved, and q cut where both halves weigh most."""
        if len(p) * len(q) <= MAX_GRID:
            return grid(p, q)
        if len(p) == 1:
            b = max(q, key=lambda b: weight(p[0], b))
            return [(p[0], b)] if weight(p[0], b) else []
        i = len(p) // 2
        up, down = last_row(p[:i], q), last_row(p[i:][::-1], q[::-1])[::-1]
        j = max(range(len(q) + 1), key=lambda j: up[j] + down[j])
        return split(p[:i], q[:j]) + split(p[i:], q[j:])

    def last_row(p: list[Block], q: list[Block]) -> list[int]:
        """The weights of a largest match of p with each beginning of q."""
        row = [0] * (len(q) + 1)
        for a in p:
            left = corner = 0
            for j, b in enumerate(q, 1):
                above = row[j]
                row[j] = left = max(left, above, corner + weight(a, b))
                corner = above
        return row

    def grid(p: list[Block], q: list[Block]) -> list[tuple[Block, Block]]:
        best = [[0] * (len(q) + 1) for _ in range(len(p) + 1)]
        for i, a in enumerate(p, 1):
            row, above = best[i], best[i - 1]
            for j, b in enumerate(q, 1):
                row[j] = max(row[j - 1], above[j], above[j - 1] + weight(a, b))
        out, i, j = [], len(p), len(q)
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                out.append((p[i - 1], q[j - 1]))
                i, j = i - 1, j - 1
        return out[::-1]

    pairs, todo = [], [(one, two)]
    while todo:
        a, b = todo.pop()
        if a.tag == b.tag:
            pairs.append((a, b))
            p, q = a.blocks(), b.blocks()
            if not p or not q:
                continue
            if a.shape == b.shape:
                todo += zip(p, q, strict=True)
                continue
            while True:
                missing.clear()
                found = children(p, q, True)
                if not missing:
                    break
                for c, d in {(c.shape, d.shape): (c, d) for c, d in missing}.values():
                    weigh(c, d)
            todo += found
    return pairs


def anchors(p: list[Block], q: list[Block]) -> list[tuple[int, int]]:
    """Positions in p and q, both rising, of blocks with an equal shape and text that both have once; as many as can be."""

    def once(blocks: list[Block]) -> dict:
        at: dict = {}
        for k, b in enumerate(blocks):
            key = (b.shape, tuple(_texts(b)))
            at[key] = -1 if key in at else k
        return {key: k for key, k in at.items() if k >= 0 and key[1]}

    one, two = once(p), once(q)
    ends, rows, before = [], [], []  # ends of the best rising rows by length; each pair with the one before it
    for k, m in ((k, two[key]) for key, k in one.items() if key in two):
        n = bisect_left(ends, m)
        before.append((k, m, rows[n - 1] if n else -1))
        ends[n : n + 1], rows[n : n + 1] = [m], [len(before) - 1]
    out, at = [], rows[-1] if rows else -1
    while at >= 0:
        k, m, at = before[at]
        out.append((k, m))
    return out[::-1]


def _texts(b: Block) -> list[str]:
    out, todo = [], [b]
    while todo:
        x = todo.pop()
        if t := x.text():
            out.append(t)
        todo += x.blocks()
    return out


def _walk(root: Block) -> list[Block]:
    """All blocks, parents before what they hold."""
    order = [root]
    for b in order:
        order += b.blocks()
    return order


def _held(order: list[Block], ones: list[Block]) -> set[Block]:
    """The blocks of order, parents first, that are among ones, or lie in one."""
    found = set(ones)
    if found:
        for b in order:
            if b.parent in found:
                found.add(b)
    return found


def _ruled_out(order: list[Block]) -> set[Block]:
    return _held(order, [b for b in order if b.skip])


def _with_above(blocks: list[Block]) -> set[Block]:
    """blocks and all that hold them."""
    found: set[Block] = set()
    for b in blocks:
        while b is not None and b not in found:
            found.add(b)
            b = b.parent
    return found


def _size(b: Block, template: set[int] = frozenset()) -> int:
    """Characters of text in b that are neither ruled out nor of the template."""
    size, todo = 0, [b]
    while todo:
        x = todo.pop()
        if not x.skip:
            size += len(x.text()) if x.number not in template else 0
            todo += x.blocks()
    return size


def marked_articles(order: list[Block], out: set[Block]) -> list[Block]:
    """The elements that the page marks as its article, outermost and in page order, with the headings and leads that their main holds before them. out: the blocks ruled out."""
    marks = [b for b in order if b.main and b not in out]
    if not any(b.tag == "article" for b in marks):
        return _outermost(order, marks)
    found = [b for b in marks if b.main != MAIN]
    last = max(b.number for b in found)
    above = _with_above([b.parent for b in found])
    mains = {b for b in marks if b.main == MAIN and b in above}
    if mains:
        inside = _held(order, list(mains)) - mains
        found += [b for b in order[:last] if b in inside and b not in out and (b.tag in HEADINGS or b.tag == "p" and b.parent in mains)]
    return _outermost(order, found)


def _outermost(order: list[Block], blocks: list[Block]) -> list[Block]:
    """Those of blocks that lie in no other, in page order."""
    if len(blocks) < 2:
        return blocks
    own = set(blocks)
    inside = _held(order, [b for b in order if b.parent in own])
    return [b for b in order if b in own and b not in inside]


def region_of(reference: list[Block], counts: dict[int, tuple[int, int, int]]) -> int:
    """The number of the deepest reference node that holds REGION of the varying text; 0 is the whole page."""
    mass = [0] * len(reference)
    out = _ruled_out(reference)
    for b in reversed(reference):
        met, same, chars = counts.get(b.number, (0, 0, 0))
        if b not in out and not is_template(met, same):
            mass[b.number] += chars
        if b.parent is not None:
            mass[b.parent.number] += mass[b.number]
    at = reference[0]
    while mass[0] and (down := next((c for c in at.blocks() if mass[c.number] >= REGION * mass[0]), None)):
        if not down.blocks():
            break
        at = down
    return at.number


def is_template(met: int, same: int) -> bool:
    return met >= MIN_PAGES and same >= SAME * met


def extract(page: str | None, reference: list[Block] | None, counts: dict[int, tuple[int, int, int]], region: int, shapes: dict, memo: dict) -> str:
    """The page's content lines; reference, counts and region are its host's, None if the host has no reference."""
    root = parse(page)
    return content(root, number(root, shapes), reference, counts, region, memo)


def content(root: Block, order: list[Block], reference: list[Block] | None, counts: dict[int, tuple[int, int, int]], region: int, memo: dict) -> str:
    template: set[int] = set()
    top = root
    if reference:
        for a, b in align(reference[0], root, memo):
            if is_template(*counts.get(a.number, (0, 0, 0))[:2]) and a.text() == b.text():
                template.add(b.number)
            if a.number == region:
                top = b
        for b in _with_above([top]):
            b.skip = b.skip and not b.worded
    tops, out = [top], _ruled_out(order)
    if marks := marked_articles(order, out):
        # no region (all of the page), or marked text outside it: the marks are the region
        if top.tag in ("#page", "html", "body") or any(not top.number <= m.number < top.number + top.size for m in marks):
            tops = marks
        if any(not template.isdisjoint(range(m.number, m.number + m.size)) for m in marks) and sum(_size(m, template) for m in marks) < (1 - MOST) * sum(map(_size, marks)):
            template = set()
    lines = _lines(out, tops, template)
    if not lines and (template or tops != [root]):  # copies of one page have no varying text, and a page may differ from its host's others
        lines = _lines(out, tops, set()) or _lines(out, [root], template) or _lines(out, [root], set())
    return "\n".join(lines)


def _lines(ruled_out: set[Block], tops: list[Block], template: set[int]) -> list[str]:
    out: list[str] = []
    todo: list = [top for top in reversed(tops) if top not in ruled_out]
    while todo:
        x = todo.pop()
        if type(x) is not Block:
            if line := clean(x[1]):
                out.append(line)
        elif not x.skip:
            keep = x.number not in template
            todo += [i if type(i) is Block else (x, i) for i in reversed(x.items) if type(i) is Block or keep]
    return out


def _hosts(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")), _HOST, 1))
    return pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"), host.alias("host"))


def skeleton(root: Block) -> int:
    """Equal for pages with the same upper containers: a hash of their paths and counts."""
    found: dict[str, int] = {}
    todo = [(root, "", 0)]
    while todo:
        b, path, depth = todo.pop()
        for c in b.blocks() if depth < DEPTH else ():
            if c.tag in SKELETON:
                down = f"{path}/{c.tag}"
                found[down] = min(3, found.get(down, 0) + 1)
                todo.append((c, down, depth + 1))
    return int.from_bytes(hashlib.blake2b(repr(sorted(found.items())).encode(), digest_size=8).digest(), "big", signed=True)


def _references(pages: DataFrame) -> DataFrame:
    """host and refs (array of n, kind, ref): a page of each of the host's kinds with most text; a task sends one page per host and kind on."""

    def run(batches):
        best: dict = {}
        held = 0
        for b in batches:
            for host, page, html in zip(*(b.column(k) for k in range(3)), strict=True):
                h, p, text = host.as_py(), page.as_py(), html.as_py() or ""
                root = parse(text, release=False)
                if chars := _length(root, KIND_CHARS):
                    rank = (p is None, p or 0, text)
                    old = best.setdefault((h, skeleton(root)), [0, rank])
                    held += len(text) if old[1] is rank else 0
                    old[0] += chars
                    old[1] = min(old[1], rank)
                if len(best) > 500 or held > HELD_CHARS:
                    yield send(best)
                    best, held = {}, 0
        if best:
            yield send(best)

    def send(best):
        keys, values = list(best), list(best.values())
        cols = [pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys], pa.int64()), pa.array([v[0] for v in values], pa.int64())]
        cols += [pa.array([None if v[1][0] else v[1][1] for v in values], pa.int64()), pa.array([v[1][2] for v in values])]
        return pa.RecordBatch.from_arrays(cols, names=["host", "kind", "chars", "page", "ref"])

    some = pages.where("host <> ''").select("host", F.col("page").cast("long"), "html").mapInArrow(run, "host string, kind long, chars long, page long, ref string")
    first = F.struct(F.col("page").isNull(), F.col("page"), F.xxhash64("ref"))
    kinds = some.groupBy("host", "kind").agg(F.sum("chars").alias("chars"), F.min_by("ref", first).alias("ref"))
    kinds = kinds.withColumn("n", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("chars"), "kind"))).where(F.col("n") <= REFERENCES)
    return kinds.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("n", "kind", "ref"))).alias("refs"), F.sum(F.length("ref") + 200).alias("size"))


def _length(root: Block, most: int) -> int:
    """Characters of the page's text, counted up to most."""
    size, todo = 0, [root]
    while todo and size < most:
        x = todo.pop()
        size += len(x.text())
        todo += x.blocks()
    return min(size, most)


def _with_host_rows(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """pages with the columns of their host's row. hosts is broadcast if it was measured to be small; else a third of all pages may be one host's, so the join is salted."""
    size = hosts.agg(F.sum(F.col("size") + 40 * (F.size("counts") if "counts" in hosts.columns else F.lit(0)))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return pages.join(F.broadcast(hosts), "host", "left")
    salts = 64
    left = pages.withColumn("salt", F.pmod(F.xxhash64("page"), F.lit(salts)).cast("int"))
    right = hosts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, ["host", "salt"], "left").drop("salt")


class _Reference:
    """A parsed reference page, its counts per node and its region."""

    def __init__(self, ref, shapes: dict, counts):
        self.html, self.kind = ref["ref"], ref["kind"]
        self.order = number(parse(self.html), shapes)
        self.table = {c["node"]: (c["met"], c["same"], c["chars"]) for c in counts or [] if c["n"] == ref["n"]}
        self.region = region_of(self.order, self.table)
        self.n = ref["n"]


class _Hosts:
    """Parsed references, those of the last hundred hosts."""

    def __init__(self):
        self.known: dict = {}

    def get(self, host: str, refs: pa.Scalar, counts: pa.Scalar | None = None) -> tuple[list[_Reference], dict, dict]:
        """The host's references, shapes and memo; refs and counts are only converted for a host that is not known."""
        if host not in self.known:
            if len(self.known) >= 100:
                self.known.clear()
            shapes: dict = {}
            nodes = counts.as_py() if counts is not None else None
            self.known[host] = ([_Reference(r, shapes, nodes) for r in refs.as_py()], shapes, {})
        return self.known[host]


def _of_kind(root: Block, refs: list[_Reference]) -> _Reference:
    kind = skeleton(root) if len(refs) > 1 else None
    return next((r for r in refs if r.kind == kind), refs[0])


def _count(batches):
    """Rows host, html, refs: sums per reference and node of what the aligned pages have there."""
    hosts, sums = _Hosts(), {}

    def send():
        keys = list(sums)
        cols = [pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.int64())]
        return pa.RecordBatch.from_arrays(cols + [pa.array([sums[k][i] for k in keys], pa.int64()) for i in range(3)], names=["host", "n", "node", "met", "same", "chars"])

    for b in batches:
        for host, html, refs in zip(*(b.column(k) for k in range(3)), strict=True):
            host, html = host.as_py(), html.as_py() or ""
            known, shapes, memo = hosts.get(host, refs)
            if any(html == r.html for r in known):
                continue  # a reference and its copies agree with it everywhere
            root = parse(html, release=False)
            ref = _of_kind(root, known)
            number(root, shapes)
            for x, y in align(ref.order[0], root, memo):
                one, two = x.text(), y.text()
                if one or two:
                    s = sums.setdefault((host, ref.n, x.number), [0, 0, 0])
                    s[0] += 1
                    s[1] += one == two
                    s[2] += len(two)
        if len(sums) > 100_000:
            yield send()
            sums = {}
    if sums:
        yield send()


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: id, url, text (lines joined by one newline, empty if none), n_chars.

    A null page is empty. Pages without a url or host, and hosts with one page, have no template: markup alone decides. Null and
    repeated ids pass through; other columns are not read. An empty table gives an empty result.
    """

    def run(batches):
        hosts = _Hosts()
        for b in batches:
            texts = []
            for host, html, refs, counts in zip(*(b.column(k) for k in range(2, 6)), strict=True):
                html = html.as_py()
                if not refs.is_valid:
                    texts.append(extract(html, None, {}, 0, {}, {}))
                    continue
                known, shapes, memo = hosts.get(host.as_py(), refs, counts)
                if len(memo) > 200_000:
                    memo.clear()
                root = parse(html)
                ref = _of_kind(root, known)
                texts.append(content(root, number(root, shapes), ref.order, ref.table, ref.region, memo))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    own = _hosts(pages, id_col, url_col, html_col)
    refs = materialize(_references(own), "references")
    found = _with_host_rows(own.where("host <> ''").select("host", "page", "html"), refs).where("refs is not null").select("host", "html", "refs").mapInArrow(_count, "host string, n int, node long, met long, same long, chars long")
    sums = found.groupBy("host", "n", "node").agg(*(F.sum(c).alias(c) for c in ("met", "same", "chars")))
    tables = sums.groupBy("host").agg(F.collect_list(F.struct("n", "node", "met", "same", "chars")).alias("counts"))
    hosts = materialize(refs.join(tables, "host", "left"), "hosts")
    rows = _with_host_rows(own, hosts).select("page", "url", "host", "html", "refs", "counts")
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return rows.mapInArrow(run, f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars long")
