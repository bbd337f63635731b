"""HTML extraction (method: tree scoring).

A page is read into a tree of elements.  Each paragraph passes points (one,
one for each comma, one for each hundred characters up to three) to the
container it stands in, half of them to the next one up and less to those
above; a container's points are discounted by its link density.  The container
with the most points is kept, with those siblings that score alike or are
plain text paragraphs.  Points go ``LEVELS`` containers up.  Menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles and reader comments
are taken out by element, role and class name before, with the articles in them
(comments, teaser cards); only one that misses its end tag ends where an article
begins.  A class that says what a page has or hasn't (``has-sidebar``,
``no-comments``) is no such name.  A form that holds most of the page's text
stays, and where no paragraph would be left, so do the named elements with an
article or the main heading in them (one named after comments only if all text
of the page is in it).

The text of a page is its kept blocks in page order: character references
decoded, white space inside a block one space, trimmed, joined by newlines.
The work is per page, so nothing is shuffled.

Defined cases: a null or empty html has an empty text; unclosed or stray tags
and comments never stop the reader; a page without any scored paragraph keeps
its article, or else its body; repeated rows get a row each; an empty table
gives no rows; other columns are ignored; long pages are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

# Names of elements, roles and classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
DROPPED = frozenset("head nav footer aside form button select option dialog menu svg math object canvas audio video "
                    "script style textarea title noscript iframe xmp noembed noframes template".split())
CONTAINERS = frozenset("html body main article section div td th li blockquote figure details center fieldset dd".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var br wbr img".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
DROPPED_NAMES = frozenset("ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar "
                          "menu nav navbar navigation breadcrumb breadcrumbs footer cookie cookies consent gdpr notice alert "
                          "popup modal overlay newsletter subscribe subscription signup share sharing social related "
                          "recommended recommendations comment comments commentlist discussion disqus respond reply replies "
                          "widget toolbar login paywall pagination pager skip hidden".split())
COMMENT_NAMES = frozenset("comment comments commentlist discussion disqus respond reply replies".split())
ARTICLE_HOLDERS = COMMENT_NAMES | frozenset("sidebar social related recommended recommendations promo promotion sponsor sponsored widget".split())
COMMENT_ARTICLES = frozenset("comment comment-body reply".split())     # whole classes of an article
HEADER_NAMES = frozenset("header masthead topbar".split())
KEPT_WHOLE = frozenset("html body main article".split())
WORDS_OF_FRAMES = frozenset("has have with no not non without hide hides is".split())    # class names that begin so describe the page
MIN_PARAGRAPH = 25
LEVELS = 8

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>"']|"[^"]*"|'[^']*')*+)>|<[!?/][^>]*>""", re.S)
_ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_HEART = frozenset(("article", "main", "h1"))
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/><]*)[^<>]*>")


class Page:
    """The elements of a page in order, and its blocks of text."""

    def __init__(self) -> None:
        self.tag: list[str] = []
        self.parent: list[int] = []
        self.place: list[int] = []                      # where an element's start tag stands in the html
        self.frames: list[int] = []                     # elements left out that may be the page's frame
        self.left_out = 0                               # characters in those
        self.blocks: list[tuple[int, str, int]] = []    # element, text, characters of it inside links


def attributes(source: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'") for k, v in _ATTR.findall(source)}


def names(a: dict[str, str]) -> set[str]:
    found: set[str] = set()
    for token in (a.get("class", "") + " " + a.get("id", "")).split():
        words = [w.lower() for w in _WORD.findall(token)]
        if not words or words[0] not in WORDS_OF_FRAMES:
            found.update(words)
    return found


def ended(html: str) -> tuple[set[int], set[str]]:
    """Where the elements begin that have an end tag of their own, and the names of those left open."""
    closed: set[int] = set()
    still: dict[str, list[int]] = {}
    pos = 0
    while m := _TAG.search(html, pos):
        pos = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if still.get(name):
                closed.add(still[name].pop())
        elif not m[3].endswith("/"):
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(html, pos)
                pos = end.end() if end else len(html)
            else:
                still.setdefault(name, []).append(m.start())
    return closed, {name for name, at in still.items() if at}


def dropped(tag: str, source: str, in_article: bool) -> bool:
    """Whether an element and all in it are no main text."""
    if tag in DROPPED or tag == "header" and not in_article:
        return True
    if not source or source.isspace():
        return False
    if tag in KEPT_WHOLE:
        return tag == "article" and bool(COMMENT_ARTICLES & set(attributes(source).get("class", "").lower().split()))
    a = attributes(source)
    if a.get("role", "").lower() in DROPPED_ROLES or "hidden" in a or a.get("aria-hidden") == "true" \
            or "display:none" in a.get("style", "").replace(" ", "").lower():
        return True
    words = names(a)
    return bool(words & DROPPED_NAMES) or not in_article and bool(words & HEADER_NAMES)


def may_be_frame(tag: str, source: str) -> bool:
    """Whether an element that is left out is so for its class name only, or a form."""
    a = attributes(source)
    return tag == "form" or tag not in DROPPED and tag != "header" and a.get("role", "").lower() not in DROPPED_ROLES \
        and "hidden" not in a and a.get("aria-hidden") != "true" and "style" not in a


def read(html: str, spared: frozenset[int] = frozenset(), whole: bool = False) -> Page:
    """The tree of a page without the elements left out, but for those at the places ``spared``; or the whole tree."""
    page, pos, n = Page(), 0, len(html)
    tags, parents = page.tag, page.parent
    tags.append("#page")
    parents.append(-1)
    page.place.append(-1)
    opened: dict[str, int] = {}     # how many elements of a name are open
    stack = [0]                 # open block elements
    inline: list[str] = []      # open links only
    skip = 0                    # stack length at which a dropped element stands; 0: none
    drop = ("", "", 0)          # the dropped element's name, attributes and place
    ends_of = None              # what ``ended`` says, once it is needed
    articles = 0
    pieces: list[str] = []
    linked = 0

    def left_open() -> bool:
        """Whether the dropped element misses its end tag, so that an article after it isn't part of it."""
        nonlocal ends_of
        tag, source, place = drop
        words = names(attributes(source))
        if words & COMMENT_NAMES or tag == "article":
            return False
        ends_of = ends_of or ended(html)
        if tag == "aside" or words & ARTICLE_HOLDERS:
            return place not in ends_of[0]
        return tag in ends_of[1]        # an outer element's end tag may have been taken for its own

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(unescape("".join(pieces)).split())
            if text:
                page.blocks.append((stack[-1], text, min(linked, len(text))))
            pieces.clear()
        linked = 0

    def close(depth: int) -> None:
        nonlocal skip, articles
        while len(stack) > depth:
            name = tags[stack.pop()]
            opened[name] -= 1
            articles -= name in ("article", "main")
            if skip and len(stack) < skip:
                skip = 0
        inline.clear()

    while pos < n:
        m = _TAG.search(html, pos)
        lt = html.find("<", pos, m.start() if m else n) if m is None or m.start() > pos else -1
        if lt >= 0:             # a tag with a broken quote, else a plain '<'
            loose = _LOOSE.match(html, lt)
            m = loose or m
        at = m.start() if m else n
        if at > pos:
            if not skip:
                pieces.append(html[pos:at])
                if inline:
                    linked += at - pos
            elif page.frames:
                page.left_out += at - pos
        if m is None:
            break
        pos = m.end()
        groups = m.groups()
        name = groups[1]
        if name is None:
            continue
        name, ends, source = name.lower(), groups[0], groups[2] if len(groups) > 2 else ""
        if ends:
            if name in INLINE:
                if name == "a" and inline:
                    inline.pop()
                continue
            flush() if not skip else None
            if opened.get(name):
                depth = len(stack) - 1
                while tags[stack[depth]] != name:
                    depth -= 1
                close(depth)
            continue
        if name in RAW and not (source or "").endswith("/"):
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(html, pos)
            pos = end.end() if end else n
            continue
        if name in INLINE:
            if not skip:
                if name in ("br", "wbr", "img"):
                    pieces.append(" " if name == "br" else "")
                elif name == "a":
                    inline.append(name)
            continue
        if name in ("article", "main") and skip and left_open():
            close(skip)         # a dropped element that was never closed ends where the article begins
            close(len(stack) - 1)
        if not skip:
            flush()
        if tags[stack[-1]] == "p" and not skip:
            close(len(stack) - 1)
        if name in ("li", "td", "th", "dd", "dt", "option") and tags[stack[-1]] == name and not skip:
            close(len(stack) - 1)
        if name in VOID or (source or "").endswith("/"):
            continue
        tags.append(name)
        parents.append(stack[-1])
        page.place.append(at)
        stack.append(len(tags) - 1)
        opened[name] = opened.get(name, 0) + 1
        articles += name in ("article", "main")
        if not skip and at not in spared and dropped(name, source or "", articles > 0):
            frame = name not in KEPT_WHOLE and may_be_frame(name, source or "")
            if frame:
                page.frames.append(len(tags) - 1)
            if not whole or not frame:
                skip, drop = len(stack), (name, source or "", at)
    if not skip:
        flush()
    return page


def frames(html: str, empty: bool) -> frozenset[int]:
    """Places of the elements that are the page's frame, though they are forms or, in a page that is ``empty`` without
    them, have names of what is left out."""
    page = read(html, whole=True)
    n = len(page.tag)
    chars, heart = [0] * n, [t in _HEART for t in page.tag]
    for e, text, _ in page.blocks:
        chars[e] += len(text)
    for e in range(n - 1, 0, -1):
        chars[page.parent[e]] += chars[e]
        heart[page.parent[e]] |= heart[e]
    named = {m.start(): m[3] or "" for m in _TAG.finditer(html) if m[2] is not None and not m[1]}
    out = set()
    for e in page.frames:
        of_comments = bool(names(attributes(named.get(page.place[e], ""))) & COMMENT_NAMES)
        if 2 * chars[e] > chars[0] if page.tag[e] == "form" else empty and heart[e] and (not of_comments or chars[e] == chars[0]):
            out.add(page.place[e])
    return frozenset(out)


def main_text(html: str | None) -> str:
    if not html:
        return ""
    page = read(html)
    if page.left_out > sum(len(text) for _, text, _ in page.blocks):
        spared = frames(html, not any(len(text) >= MIN_PARAGRAPH for _, text, _ in page.blocks))
        if spared:
            page = read(html, spared)
    tag, parent, n = page.tag, page.parent, len(page.tag)
    points, chars, links = [0.0] * n, [0] * n, [0] * n
    holder = [0] * n            # the nearest container, the element itself included
    for e in range(1, n):
        holder[e] = e if tag[e] in CONTAINERS else holder[parent[e]]
    for e, text, linked in page.blocks:
        chars[e] += len(text)
        links[e] += linked
        if len(text) < MIN_PARAGRAPH:
            continue
        gain = 1 + text.count(",") + min(3, len(text) // 100)
        level, up = 0, holder[e]
        while up > 0 and level < LEVELS:
            points[up] += gain if level == 0 else gain / 2 if level == 1 else gain / (3 * level)
            level += 1
            up = holder[parent[up]]
    for e in range(n - 1, 0, -1):
        chars[parent[e]] += chars[e]
        links[parent[e]] += links[e]
    density = [k / c if c else 0.0 for k, c in zip(links, chars)]
    score = [p * (1 - d) for p, d in zip(points, density)]
    best = max(range(n), key=lambda e: (score[e], -e))
    if score[best] <= 0:
        best = next((e for e in range(n) if tag[e] in ("article", "main")), next((e for e in range(n) if tag[e] == "body"), 0))
    up = best
    while up > 0:               # the whole article, where the page marks it
        if tag[up] in ("article", "main"):
            best = up
            break
        up = parent[up]
    limit = max(10.0, 0.2 * score[best])
    kept = [False] * n
    for e in range(n):
        above = parent[e]
        if e == best or above >= 0 and kept[above]:
            kept[e] = not (tag[e] in ("ul", "ol", "div", "section", "table") and density[e] > 0.6)
        elif above >= 0 and above == parent[best] and tag[best] != "body":
            kept[e] = score[e] >= limit or tag[e] == "p" and chars[e] > 80 and density[e] < 0.25
    kept[best] = True
    return "\n".join(text for e, text, _ in page.blocks if kept[e])


def extract(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """page_id, url, text, n_chars."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
