"""Main text of HTML pages by consensus paths of each host.

Three steps. Every page is parsed and its containers are scored by the running
text that they hold; the best container votes, with its score, for its path:
tags and classes from the body down, with digits generalised. Votes are summed
per host and path, and each host's winner is staged. Then every page is parsed
again and its text is taken from the containers on the host's winning path,
widened to the ancestor that holds headings or text beside them; a page without
such a container uses its own best one.

An article or main element is a vote of its own beside those of the containers.

Boilerplate subtrees (navigation, advertising, forms, comments and so on, told
by tag, role or class words) neither score nor appear in the text. Class words
don't count on a container that holds the page's article or main element, or
most of its running text, and marked blocks are taken when nothing else is left.
A word such as `related` or `notice` marks a name only if the name's other words
are generic, and an inline element is left out by its class only if nothing else
stands in its block.

Parsing takes time in proportion to the page, also with deeply nested, unclosed
elements: containers are a tree of labels, and paths are written out only for the
few that votes and winners need.

Rows: null html gives an empty text; a null url is a host of its own. Repeated
rows vote and are extracted like any others. Truncated pages, unclosed tags and
cut character references are taken as a browser takes them. Of equal scores the
path nearest to the body is taken, of equal votes the first by name. An empty table gives an
empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

# HTML's element kinds, as far as text extraction needs them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe template xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "tbody": "tr td th tbody thead", "tfoot": "tr td th tbody thead"}
SCOPE = {"li": "ul ol menu dir", "dt": "dl", "dd": "dl", "tr": "table", "td": "table", "th": "table", "tbody": "table", "tfoot": "table", "option": "select"}
DROPPED = frozenset("nav footer aside form head select dialog button menu svg object search".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Words of class and id names that mark boilerplate.
DROPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert sidebar sidebars "
    "menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead share sharing social related recommended recommendations newsletter subscribe subscription "
    "comment comments commentlist disqus reply replies popup modal overlay widget widgets login signup search pager pagination toolbar".split()
)
DROPPED_NAMES = frozenset("header site-header page-header siteheader pageheader top-header topbar".split())

#: Marks of a page's layout, which wrappers carry too; those of what others wrote, or of what lies elsewhere, which may hold articles.
LAYOUT = DROPPED_NAMES | frozenset("banner notice notices sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead widget widgets search pager pagination toolbar".split())
OF_OTHERS = frozenset("comment comments commentlist disqus reply replies related recommended recommendations".split())
#: Words that mark a name only beside other marks or generic words: 'related-posts' does, 'related-work' and 'notice-of-award' don't.
AMBIGUOUS = frozenset("related recommended recommendations notice notices alert share sharing social search login signup subscribe reply replies promotion consent overlay footer masthead pager".split())
GENERIC = frozenset(
    "box bar block area container wrapper wrap inner outer list links link item items post posts article articles story stories news content section panel pane button buttons btn "
    "icon icons form site page main top bottom left right header title media icons tools tool group row col column block widget module component js container fluid".split()
)
#: In a class name before a mark: it tells what the page has, not what the element is.
DENIED = frozenset("has no not with without".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LEAVES = HEADINGS | frozenset("p pre blockquote li td dd dt".split())

_TAG = re.compile(r"""<!--.*?(?:--!?>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[A-Za-z]+")
_SPACE = re.compile(r"\s+")


class Block(NamedTuple):
    text: str
    linked: int  # characters in links
    element: _Open  # its innermost container


class _Open:
    """An element: its label, its parent, its depth and why it may be boilerplate."""

    __slots__ = ("tag", "label", "above", "order", "depth", "main", "hard", "words", "text", "path", "article")

    def __init__(self, tag: str, label: str, above: _Open | None, order: int, main: bool = False, hard: bool = False, words: frozenset = frozenset()):
        self.tag, self.label, self.above, self.order = tag, label, above, order
        self.depth = 0 if above is None else above.depth + 1
        self.main, self.hard, self.words = main, hard, words  # article or main; dropped by tag or role; marks among the class words
        self.text = 0  # running text below
        self.path = 0  # number of its path
        self.article: _Open | None = None  # the outermost article or main around it, itself included


class Page:
    """The text blocks of a page that aren't boilerplate, in order, and the numbers of their containers' paths."""

    def __init__(self, blocks: list[Block], elements: list[_Open]):
        self.blocks = blocks
        self.numbers: dict[tuple[int, str], int] = {}
        self.of_number: list[_Open] = []
        for e in elements:
            key = (-1, "") if e.above is None else (e.above.path, e.label)
            e.path = self.numbers.setdefault(key, len(self.numbers))
            if e.path == len(self.of_number):
                self.of_number.append(e)

    def written(self, number: int) -> str:
        return "".join(reversed([e.label for e in _chain(self.of_number[number])]))

    def number(self, path: str) -> int | None:
        """The number of a path, if the page has it. A class may hold a '/', so labels are joined until one is known."""
        at, label = 0, ""
        for part in path.split("/")[1:]:
            label += f"/{part}"
            if (at, label) in self.numbers:
                at, label = self.numbers[at, label], ""
        return None if label else at


def _raw_end(name: str, text: str, at: int) -> int:
    m = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(text, at)
    return m.end() if m else len(text)


def _marks(names: str) -> frozenset[str]:
    """The boilerplate words of class and id names; 'no-sidebar' and 'has-menu' speak of other elements and mark nothing."""
    found = set(DROPPED_NAMES.intersection(names.split()))
    for name in names.split():
        words = _WORDS.findall(name)
        for k, w in enumerate(words):
            if w in DROPPED_WORDS and DENIED.isdisjoint(words[:k]):
                if w not in AMBIGUOUS or all(o in DROPPED_WORDS or o in GENERIC for o in words):
                    found.add(w)
    return frozenset(found)


def parsed(page: str) -> Page:
    found, elements = _parsed(page)
    return Page(_kept(found, elements), elements)


def _parsed(page: str) -> tuple[list[Block], list[_Open]]:
    """The text blocks that no tag or role rules out, and the elements, both in order."""
    out: list[Block] = []
    stack = [_Open("body", "", None, 0)]
    elements = stack[:]
    counts: dict[str, int] = defaultdict(int)  # open elements by tag
    buffer: list[tuple[str, bool, bool]] = []  # text, in a link, in a marked inline element
    inline: list[str] = []  # open marked inline elements
    in_link, at, n = False, 0, len(page)

    def flush() -> None:
        if buffer:
            if not stack[-1].hard and not all(marked or not t.strip() for t, _, marked in buffer):
                text = _SPACE.sub(" ", entities.unescape("".join(t for t, _, _ in buffer))).strip()
                if text:
                    out.append(Block(text, sum(len(t.strip()) for t, link, _ in buffer if link), stack[-1]))
            buffer.clear()

    def pop_to(k: int) -> None:
        flush()
        for e in stack[k:]:
            counts[e.tag] -= 1
        del stack[k:]

    def innermost(tags: tuple[str, ...], fence: tuple[str, ...]) -> int:
        """The place of the innermost open element of these tags, or 0 if there is none or a fence is nearer."""
        if any(counts[t] for t in tags):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in tags:
                    return k
                if stack[k].tag in fence:
                    break
        return 0

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            buffer.append((page[at:], in_link, bool(inline)))
            break
        if lt > at:
            buffer.append((page[at:lt], in_link, bool(inline)))
        m = _TAG.match(page, lt)
        if not m:
            buffer.append(("<", in_link, bool(inline)))
            at = lt + 1
            continue
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        attrs = m[3] if m[2] else m[6]
        if m[1] or m[4]:
            if tag == "a":
                in_link = False
            if tag in inline:
                inline.remove(tag)
            if counts[tag]:
                pop_to(innermost((tag,), ()))
            elif tag in BLOCK:
                flush()
            continue
        if tag in VOID:
            if tag == "br":
                buffer.append((" ", in_link, bool(inline)))
            elif tag == "hr":
                flush()
            continue
        if tag in RAW:
            at = _raw_end(tag, page, at)
            continue
        if tag in ("html", "body"):
            flush()
            if counts["head"]:  # a body ends the head, closed or not
                pop_to(next(k for k, e in enumerate(stack) if e.tag == "head"))
            continue
        named = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(attrs)} if attrs and "=" in attrs else {}
        names = f"{named.get('class', '')} {named.get('id', '')}".lower()
        role = named.get("role", "").lower()
        marks = _marks(names) if names != " " else frozenset()
        if tag not in BLOCK and not (role in DROPPED_ROLES or tag in DROPPED):
            if tag == "a":
                in_link = True
            if marks:
                inline.append(tag)
            continue
        if tag in BLOCK:
            if tag != "option" and (k := innermost(("p",), ("td", "th", "button", "object"))):  # an open paragraph ends before any block
                pop_to(k)
            if tag in CLOSES:
                while k := innermost(tuple(CLOSES[tag].split()), tuple(SCOPE[tag].split())):
                    pop_to(k)
            if tag in HEADINGS and stack[-1].tag in HEADINGS:
                pop_to(len(stack) - 1)
            inline.clear()
        flush()
        above = stack[-1]
        classes = ".".join(sorted(re.sub(r"\d+", "#", named.get("class", "").lower()).split()))
        if tag != "p":
            in_link = False
        main = tag in ("article", "main") or role in ("main", "article")
        stack.append(_Open(tag, f"/{tag}" + (f".{classes}" if classes else ""), above, len(elements), main, above.hard or role in DROPPED_ROLES or tag in DROPPED, marks))
        elements.append(stack[-1])
        counts[tag] += 1
    flush()
    return out, elements


def _chain(e: _Open | None) -> Iterator[_Open]:
    while e is not None:
        yield e
        e = e.above


def _unmark(found: list[Block], elements: list[_Open]) -> None:
    """Class words don't count on containers that hold the page's article or main, or most of its running text."""
    marked = [e for e in elements if e.words and not e.hard]
    if not marked:
        return
    layout = [True] * len(elements)  # no mark but those of the layout from the body down
    around: list[_Open | None] = [None] * len(elements)  # the nearest marked element, itself included
    for e in elements[1:]:
        layout[e.order] = layout[e.above.order] and e.words <= LAYOUT
        around[e.order] = e if e.words else around[e.above.order]
    for b in found:
        if layout[b.element.order]:
            b.element.text += max(0, len(b.text) - b.linked)
    for e in reversed(elements[1:]):
        e.above.text += e.text
    # Below each element: a main; an article or main without marks. Right inside each marked one: articles and mains.
    has_main, has_plain, direct = ([0] * len(elements) for _ in range(3))
    clear = 0  # articles and mains with no marked element around them
    for e in reversed(elements):
        if e.main and not e.hard:
            has_main[e.order] |= e.tag == "main"
            has_plain[e.order] |= not e.words
            if around[e.order] is None:
                clear += 1
            else:
                direct[around[e.order].order] += 1
        if e.above is not None:
            has_main[e.above.order] |= has_main[e.order]
            has_plain[e.above.order] |= has_plain[e.order]
    shut: set[int] = set()  # marked elements that stay, or lie in one that does
    for e in sorted(marked, key=lambda e: (e.depth, -e.text, e.order)):
        article = (has_plain[e.order] or e.main) and not e.words & OF_OTHERS
        most = e.words <= LAYOUT and 2 * e.text > elements[0].text
        outer = around[e.above.order] if e.above is not None else None
        if has_main[e.order] or not clear and (article or most):
            e.words = frozenset()
        if e.words or outer is not None and outer.order in shut:
            shut.add(e.order)
        else:
            clear += direct[e.order]


def _kept(found: list[Block], elements: list[_Open]) -> list[Block]:
    _unmark(found, elements)
    dropped = [False] * len(elements)

    def resolve(trusting: bool) -> list[Block]:
        for e in elements:
            if e.above is not None:
                above = e.above
                dropped[e.order] = dropped[above.order] or e.hard or bool(trusting and e.words) or e.tag == "header" and above.article is None
                e.article = above.article or (e if e.main and not dropped[e.order] else None)
        return [b for b in found if not dropped[b.element.order]]

    return resolve(True) or resolve(False)  # marked blocks are taken when nothing else is left


def _holder(b: Block) -> _Open:
    """The container that holds a block: the one above its own paragraph, item or heading."""
    return b.element.above if b.element.tag in LEAVES else b.element


def scores(page: Page) -> dict[int, float]:
    """Containers by path number: a block's running text counts in full for the container that holds it, by half for the
    next one, and in full once more for the outermost article or main around it.
    """
    total: dict[int, float] = defaultdict(float)
    for b in page.blocks:
        worth = max(0, len(b.text) - b.linked)
        holder = _holder(b)
        total[holder.path] += worth
        if holder.above is not None:
            total[holder.above.path] += worth / 2
        if b.element.article is not None:
            total[b.element.article.path] += worth
    return total


def best_path(page: Page) -> tuple[str | None, float]:
    """The path with the highest score; of equal ones the one that is nearest to the body, then the first of the page."""
    best = min(((-s, page.of_number[p].depth, p) for p, s in scores(page).items() if s > 0), default=None)
    return (None, 0.0) if best is None else (page.written(best[2]), -best[0])


def text_on_path(page: Page, path: str | None) -> tuple[str, str]:
    """The text of the containers on a path, widened, and the path that it was taken from.

    A container inside an article or main is widened to that. Another is widened to its outermost ancestor that holds text
    of its own beside it: a heading or a paragraph that isn't mostly links, another section beside a section, or, below the
    body, the first heading if it has none. If what that adds is mostly links, only its headings and running text are added.
    """
    number = page.number(path) if path is not None else None
    if number is None:
        return "", ""
    at = page.of_number[number].depth
    # For each element: the container on the path that it lies in, and its deepest ancestor that holds such a container.
    inside: dict[int, _Open | None] = {}
    found: list[tuple[Block, _Open | None]] = []
    for b in page.blocks:
        trail, e = [], b.element
        while e is not None and e.order not in inside and e.path != number:
            trail.append(e)
            e = e.above if e.depth > at else None
        home = None if e is None else e if e.path == number else inside[e.order]
        for t in trail:
            inside[t.order] = home
        found.append((b, home))
    own = [b for b, home in found if home is not None]
    if not own or at == 0:
        return "\n\n".join(b.text for b in own), path or ""
    if any(b.element.article is not None for b in own):
        homes = {b.element.article.order for b in own if b.element.article is not None}
        whole = [b for b, home in found if home is not None or b.element.article is not None and b.element.article.order in homes]
        first = next(b.element.article for b in own if b.element.article is not None)
        return "\n\n".join(b.text for b in whole), page.written(first.path if first.depth < at else number)
    holding: set[int] = {e.order for home in {home.order: home for _, home in found if home is not None}.values() for e in _chain(home)}
    first = next(home for _, home in found if home is not None)
    below = list(_chain(first))[::-1]  # by depth
    titled = any(_level(b) == 1 for b in own)
    widest = at
    shared_of: dict[int, _Open] = {}
    branches: list[tuple[Block, _Open]] = []  # block, its deepest ancestor that holds a winner
    for b, home in found:
        if home is None:
            trail, e = [], b.element
            while e.order not in holding and e.order not in shared_of:
                trail.append(e)
                e = e.above
            shared = shared_of.get(e.order, e)
            for t in trail:
                shared_of[t.order] = shared
            branches.append((b, shared))
    child_of: dict[int, _Open] = {}

    def branch(b: Block, shared: _Open) -> _Open | None:
        """The element right below shared that a block lies in."""
        if b.element.order not in child_of:
            trail = []
            e = b.element
            while e is not shared and e.order not in child_of:
                trail.append(e)
                if e.above is shared or e.above is None:
                    break
                e = e.above
            top = child_of.get(e.order, e)
            for t in trail:
                child_of[t.order] = top
        return child_of.get(b.element.order)

    for b, shared in branches:
        if not _is_prose(b) or shared.depth >= widest:
            continue
        beside = branch(b, shared)
        sections = shared.depth + 1 < len(below) and beside is not None and beside is not shared and [beside.tag, below[shared.depth + 1].tag] == ["section", "section"]
        if _holder(b) is shared or sections or shared.depth and _level(b) == 1 and not titled:
            widest = shared.depth
    if widest == at:
        return "\n\n".join(b.text for b in own), path
    more = [b for b, shared in branches if shared.depth >= widest]
    linked = 2 * sum(b.linked for b in more) > sum(len(b.text) for b in more)
    added = {id(b) for b in more if not linked or _is_prose(b)}
    return "\n\n".join(b.text for b, home in found if home is not None or id(b) in added), page.written(below[widest].path)


def _level(b: Block) -> int:
    """A heading's level, else 0."""
    return int(b.element.tag[1]) if b.element.tag in HEADINGS else 0


def _is_prose(b: Block) -> bool:
    return _level(b) > 0 or 2 * b.linked <= len(b.text)


def extract(page: str | None, host_path: str | None) -> tuple[str, str]:
    """The main text and the path that it was taken from."""
    found = parsed(page or "")
    for path in (host_path, best_path(found)[0], ""):
        text, taken = text_on_path(found, path)
        if text:
            return text, taken
    return "", ""


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _votes(page: Column) -> Column:
    """The page's vote, or none."""

    @F.pandas_udf("array<struct<path:string,score:double>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([[vote] if (vote := best_path(parsed(p or "")))[0] is not None else [] for p in batch], dtype=object)

    return run.asNondeterministic()(page)  # else a filter inferred from the explode runs it a second time


def _extracted(page: Column, path: Column) -> Column:
    @F.pandas_udf("text string, path string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for pages, paths in batches:
            yield pd.DataFrame([extract(p, h if isinstance(h, str) else None) for p, h in zip(pages, paths)], columns=["text", "path"])

    return run(page, path)


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path): the path with the most votes of each host; of equal ones the first by name."""
    votes = pages.select(host_of(F.col(f"`{url_col}`")).alias("host"), _votes(F.col(f"`{html_col}`")).alias("v")).select("host", F.inline("v"))
    tally = votes.groupBy("host", "path").agg(F.sum(F.round("score").cast("long")).alias("score"))
    return tally.groupBy("host").agg(F.min_by("path", F.struct((-F.col("score")).alias("s"), F.col("path"))).alias("path"))


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text, n_chars, path."""
    winners = staged(host_paths(pages, url_col, html_col), "host-paths")
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"), host_of(F.col(f"`{url_col}`")).alias("host"))
    found = rows.join(winners, "host", "left").select("page_id", "url", _extracted(F.col("html"), F.col("path")).alias("x"))
    return found.select("page_id", "url", "x.text", F.length("x.text").cast("long").alias("n_chars"), "x.path")
