"""Main text of web pages by tree scoring.

A page becomes a tree of elements and a list of text blocks. Scripts, styles,
menus, forms and the like are left out by element, role or the words of class
and id. Every paragraph passes points (one, one per comma, up to three for
length) to its container and, shrinking, to the containers around it; a
container's points are discounted by the share of its text inside links. The
best container is kept with those of its siblings that score well, read like
prose, or are headings, lists, quotes, code or tables with few links, and its
blocks are joined in page order.

A name is a hint only. An element left out by its name, or a form, is taken
back and the page read again if it holds the main element or the article with
the most prose, if it is a prose paragraph marked by a weak name like "notice",
or if it (or all elements of that name) holds most of the page's prose and far
more than was found. Names of other people's text, like "comments", are
overruled by prose only where nothing else is found.

Pages are independent, so the job is one pass without a shuffle; a page is read
a bounded number of times, and work and memory are linear in the page, whatever
its nesting. Annotations of formulas, which no browser shows, are left out.

Defined results: a null, empty or textless page gives an empty text; repeated
rows give equal results; an empty table gives no rows. Columns are carried; a
column called like the new one is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

# Element kinds of HTML.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes", "noscript", "template"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl",
    "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup",
    "hr", "html", "head", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary",
    "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
# Elements that end an open one of the same kind, and how far the search for it goes.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPS = {"ul", "ol", "menu", "dl", "table", "html", "body", "article", "section", "div", "td", "th"}
LEAVES = {"p", "li", "dd", "dt", "pre", "blockquote", "figcaption", "h1", "h2", "h3", "h4", "h5", "h6", "summary", "caption"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# What is never part of an article.
NEVER = {"nav", "footer", "aside", "menu", "button", "select", "datalist", "dialog", "object", "embed", "svg", "annotation", "annotation-xml", "canvas", "audio", "video", "map", "head", "search"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar"}
NAMES = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "alert", "alerts", "banner", "breadcrumb",
    "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "copyright", "disclaimer", "discussion", "disqus",
    "footer", "gdpr", "hidden", "invisible", "legal", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation",
    "newsletter", "notice", "notices", "offscreen", "overlay", "pager", "pagination", "popup", "promo", "promoted", "reactions",
    "recommended", "related", "replies", "respond", "responses", "share", "sharing", "sidebar", "signup", "skiplink", "social",
    "sponsor", "sponsored", "subscribe", "toolbar", "trending", "widget",
}
PAGE_HEADS = {"header", "topbar"}
# Names that authors also give to paragraphs of an article.
WEAK = {"alert", "alerts", "disclaimer", "discussion", "legal", "notice", "notices", "share", "sharing"}
# Names of text that is not the page's own, however long.
OTHERS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "comment", "comments", "consent", "cookie", "cookies",
    "disqus", "gdpr", "reactions", "recommended", "related", "replies", "respond", "responses", "sponsor", "sponsored", "trending",
}
# Kept beside the best container where links are few.
BESIDE = {"ul", "ol", "dl", "pre", "blockquote", "table", "figure", "math"}
PLAIN = {"has", "with", "no", "without"}  # "has-sidebar" names the page, not a sidebar

_TAG = re.compile(
    r"<!--(?:.*?--!?>|.*)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>|</?[a-zA-Z][^>]*\Z|<[!?/][^>]*\Z",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[a-z0-9]+")
_HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_COMMA = re.compile(r"[,،、，;；]")
LEVELS = 5
SHORT = 25
FEW_LINKS = 0.25
RUN = 3  # paragraphs of one holder that read like an article
# Headings of reader comments.
_COMMENTS = re.compile(
    r"\W*(?:\d+\s+)?(?:(?:all|reader|readers'?|user|view|recent|latest)\s+)?"
    r"(?:comments?|responses?|replies|reactions|discussion|leave a (?:reply|comment)|join the (?:discussion|conversation)|add a comment|"
    r"kommentare?|commentaires?|comentarios?)(?:\s*\(?\d*\)?)?\W*",
    re.IGNORECASE,
)


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)} if raw.strip(" /") else {}


def _left_out(name: str, attrs: dict[str, str], in_article: bool) -> bool:
    if name in NEVER:
        return True
    if not attrs or name in ("html", "body", "article", "main"):
        return False
    if attrs.get("role", "").lower() in ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true":
        return True
    return "display:none" in attrs.get("style", "").replace(" ", "").lower()


def _named(name: str, attrs: dict[str, str], in_article: bool) -> tuple[frozenset[str], bool]:
    """The words by which an element is left out as long as nothing speaks against it, and whether a whole name is of OTHERS."""
    whole = False
    found = {name} if name == "form" or name == "header" and not in_article else set()
    if attrs.get("role", "").lower() == "form":
        found.add("form")
    if name not in ("html", "body", "article", "main"):
        for text in (attrs.get("class", ""), attrs.get("id", "")):
            for token in text.split():
                words = set(_WORD.findall(_HUMP.sub("-", token).lower()))
                if not words & PLAIN:
                    found |= words & NAMES
                    whole |= len(words) == 1 and bool(words & OTHERS)
                    if not in_article:
                        found |= words & PAGE_HEADS
    return frozenset(found), whole


class _Page:
    """Elements as parallel lists (a parent comes before its children), and blocks of text in page order."""

    def __init__(self, html: str, spared: frozenset[int] = frozenset()) -> None:
        self.name, self.parent, self.out, self.article = ["html"], [-1], [False], [False]
        self.never = [False]  # out for another reason than a name
        self.named: dict[int, frozenset[str]] = {}  # left out by these words
        self.foreign: set[int] = set()  # of them, those whose whole name says that the text is another's
        self.lost: dict[int, list] = {}  # characters left out by a name, those inside links, and the last one, by element
        self._spared = spared
        self.blocks: list[tuple[int, str, int]] = []  # owner, text, characters inside links
        self._pieces: list[str] = []
        self._linked = 0
        self._owner = 0
        self._parse(html)

    def _flush(self) -> None:
        if self._pieces:
            text = " ".join("".join(self._pieces).split())
            if text:
                self.blocks.append((self._owner, text, min(self._linked, len(text))))
            self._pieces, self._linked = [], 0

    def _parse(self, html: str) -> None:
        stack, holders, links, at, end = [0], [0], 0, 0, len(html)
        paragraphs = 0  # open p elements
        depths: dict[str, list[int]] = {}  # places in the stack of open elements by name
        floors = [0]  # places of open blocks

        def pop() -> None:
            nonlocal links, paragraphs
            i = stack.pop()
            name = self.name[i]
            depths[name].pop()
            if name in BLOCK:
                self._flush()
                holders.pop()
                floors.pop()
            links -= name == "a"
            paragraphs -= name == "p"

        def pop_to(depth: int) -> None:
            while len(stack) > depth:
                pop()

        def deepest(names: set[str]) -> int:
            return max((depths[n][-1] for n in names if depths.get(n)), default=0)

        def close_paragraph() -> None:
            while paragraphs:
                pop()

        while at < end:
            m = _TAG.search(html, at)
            stop = m.start() if m else end
            if stop > at and not self.out[stack[-1]]:
                piece = html[at:stop]
                piece = unescape(piece) if "&" in piece else piece
                self._owner = holders[-1]
                self._pieces.append(piece)
                if links:
                    self._linked += len(piece)
            elif stop > at and not self.never[stack[-1]]:
                piece = " ".join(html[at:stop].split())
                if piece:
                    lost = self.lost.setdefault(stack[-1], [0, 0, ""])
                    lost[0] += len(piece)
                    lost[1] += len(piece) if links else 0
                    lost[2] = piece[-1]
            if not m:
                break
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            name, closing = name.lower(), bool(m[1] or m[4])
            if closing:
                if name == "p" and not paragraphs:
                    self._flush()
                elif name in ("html", "body"):
                    self._flush()
                else:
                    depth = deepest({name})
                    # An inline end does not close blocks.
                    if depth and (name in BLOCK or depth > floors[-1]):
                        pop_to(depth)
                continue
            if name == "br":
                self._pieces.append(" ")
                continue
            if name in RAW:
                found = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(html, at)
                at = found.end() if found else end
                continue
            if name in ("html", "body"):
                self._flush()
                continue
            if name in VOID:
                if name == "hr":
                    close_paragraph()
                    self._flush()
                continue
            if name in BLOCK:
                if paragraphs:
                    close_paragraph()
                self._flush()
            if name in CLOSES:
                depth = deepest(CLOSES[name])
                if depth and depth >= deepest(STOPS):
                    pop_to(depth)
            up = stack[-1]
            raw = m[3] if m[3] is not None else m[6] or ""
            self.name.append(name)
            self.parent.append(up)
            self.article.append(self.article[up] or name in ("article", "main"))
            attrs = _attributes(raw)
            i = len(self.name) - 1
            self.never.append(self.never[up] or _left_out(name, attrs, self.article[up]))
            words, foreign = (frozenset(), False) if self.never[i] or i in self._spared else _named(name, attrs, self.article[up])
            if words:
                self.named[i] = words
            if foreign:
                self.foreign.add(i)
            self.out.append(self.out[up] or self.never[i] or bool(words))
            depths.setdefault(name, []).append(len(stack))
            if name in BLOCK:
                holders.append(i)
                floors.append(len(stack))
            stack.append(i)
            links += name == "a"
            paragraphs += name == "p"
        self._flush()


def main_text(html: str | None) -> str:
    """The blocks of the article, two line ends between them."""
    if not html:
        return ""
    spared: frozenset[int] = frozenset()
    while True:
        page = _Page(html, spared)
        text = _article(page)
        more = _taken_back(page, text) if page.lost else set()
        if not more:
            return text
        spared |= more


def _taken_back(page: _Page, text: str) -> set[int]:
    """Elements that should not have been left out by their names."""
    n, parent, name = len(page.name), page.parent, page.name
    lost, linked, kept, last = [0] * n, [0] * n, [0] * n, [""] * n
    for i, (size, inside, end) in page.lost.items():
        lost[i], linked[i], last[i] = size, inside, end
    for owner, block, inside in page.blocks:
        kept[owner] += len(block) - inside
    for i in range(n - 1, 0, -1):
        lost[parent[i]] += lost[i]
        linked[parent[i]] += linked[i]
        kept[parent[i]] += kept[i]
        last[parent[i]] = last[parent[i]] or last[i]
    prose = [lost[i] - linked[i] for i in range(n)]
    back: set[int] = set()
    # The main element, and the article with the most prose.
    holders = [i for i in range(n) if name[i] in ("article", "main") and not page.never[i]]
    most = max((kept[i] + prose[i] for i in holders if name[i] == "article"), default=0)
    if any(page.out[i] for i in holders):
        for i in holders:
            if page.out[i] and prose[i] and (name[i] == "main" or prose[i] >= most):
                while i:
                    i = parent[i]
                    if i in page.named:
                        back.add(i)
    for i, words in page.named.items():
        if words <= WEAK and not page.out[parent[i]] and (name[i] in LEAVES or page.article[i]) and linked[i] < FEW_LINKS * lost[i]:
            if lost[i] > 80 or lost[i] >= SHORT and last[i] in ".!?…。！？":
                back.add(i)
    if back:
        return back
    # Runs of paragraphs of one holder: how many, and the largest below each element.
    count, run, longest = [0] * n, [0] * n, [0] * n
    for i in range(n - 1, 0, -1):
        if name[i] == "p" and prose[i] >= SHORT:
            count[parent[i]] += 1
            run[parent[i]] += prose[i]
    for i in range(n - 1, 0, -1):
        longest[i] = max(longest[i], run[i] if count[i] >= RUN else 0)
        longest[parent[i]] = max(longest[parent[i]], longest[i])

    def others(i: int) -> bool:
        """Whether the text below is to be taken for someone else's."""
        return i in page.foreign or bool(page.named[i] & OTHERS) and 2 * longest[i] <= prose[i]

    # Most of the page's prose, in one element or in all of a name.
    whole, outer, words_of = kept[0] + prose[0], {}, {}
    for i, words in page.named.items():
        if not page.out[parent[i]] and prose[i] and not (text and others(i)):
            outer[i] = prose[i]
            for w in words:
                words_of.setdefault(w, []).append(i)
    groups = [[i] for i in outer] + list(words_of.values())
    sizes = [sum(outer[i] for i in g) for g in groups]
    for group, size in zip(groups, sizes, strict=True):
        if 2 * size > whole and size > 3 * len(text):
            return _with_inner(page, group, prose)
    if not text and groups:
        return _with_inner(page, groups[max(range(len(groups)), key=sizes.__getitem__)], prose)
    return set()


def _with_inner(page: _Page, group: list[int], prose: list[int]) -> set[int]:
    """``group`` and the named elements inside that hold most of the prose of their outer one, however deep."""
    back, most = set(group), {i: prose[i] for i in group}
    inside: dict[int, int] = {i: i for i in group}
    for i in range(1, len(page.name)):
        outer = inside.get(i) or inside.get(page.parent[i])
        if outer is not None:
            inside[i] = outer
            if i in page.named and i not in page.foreign and 2 * prose[i] > most[outer]:
                back.add(i)
    return back


def _article(page: _Page) -> str:
    n, parent, name, blocks = len(page.name), page.parent, page.name, page.blocks
    length, linked = [0] * n, [0] * n
    for owner, text, inside in blocks:
        length[owner] += len(text)
        linked[owner] += inside
    for i in range(n - 1, 0, -1):
        length[parent[i]] += length[i]
        linked[parent[i]] += linked[i]
    score = [0.0] * n
    for least in (SHORT, 1):
        for owner, text, inside in blocks:
            if len(text) < least or name[owner] in HEADINGS:
                continue
            points = (1 + len(_COMMA.findall(text)) + min(len(text) / 100, 3)) * (1 - inside / len(text))
            holder = parent[owner] if name[owner] in LEAVES and owner else owner
            for level in range(LEVELS):
                if holder < 0:
                    break
                score[holder] += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
                holder = parent[holder]
        if any(score):
            break
    density = [linked[i] / length[i] if length[i] else 0.0 for i in range(n)]
    final = [score[i] * (1 - density[i]) for i in range(n)]
    best = max(range(n), key=lambda i: (final[i], -i))
    if final[best] <= 0:
        return ""
    # Inside an article element, the whole article is the container.
    top = i = best
    while i > 0:
        if name[i] in ("article", "main"):
            top = i
            if name[i] == "article":
                break
        i = parent[i]
    keep = [False] * n
    keep[top] = True
    if top:
        heads = [0] * n
        for owner, text, _ in blocks:
            heads[owner] += len(text) if name[owner] in HEADINGS else 0
        for i in range(n - 1, 0, -1):
            heads[parent[i]] += heads[i]
        ended = {owner for owner, text, _ in blocks if text[-1] in ".!?…。！？"}
        follows = False  # whether the next sibling with text, headings aside, is kept
        beside = [i for i in range(1, n) if parent[i] == parent[top] and not page.out[i] and length[i]]
        comments = _under_comments(page, beside, heads, length)
        for i in reversed(beside):
            few = density[i] < FEW_LINKS
            if i == top:
                pass
            elif i in comments:
                continue
            elif heads[i] == length[i]:  # a heading goes with what it heads
                keep[i] = few and (follows or name[i] == "h1")
                continue
            elif final[i] >= 0.2 * final[best]:
                keep[i] = True
            elif name[i] in BESIDE:
                keep[i] = few
            elif name[i] == "p" or name[i] in ("div", "section", "dd", "td", "center", "details"):
                long = length[i] > 80 and few
                keep[i] = long or density[i] == 0 and length[i] >= SHORT and name[i] == "p" and i in ended
            follows = keep[i]
    for i in range(1, n):
        keep[i] = keep[i] or keep[parent[i]]
    return "\n\n".join(text for owner, text, _ in blocks if keep[owner])


def _under_comments(page: _Page, beside: list[int], heads: list[int], length: list[int]) -> set[int]:
    """Elements of ``beside`` under a heading that names reader comments: those that begin with one, or follow one."""
    first: dict[int, tuple[int, str]] = {}
    for owner, text, _ in page.blocks:
        i = owner
        while i > 0 and i not in first:
            first[i] = (owner, text)
            i = page.parent[i]
    found, below = set(), None
    for i in beside:
        owner, text = first[i]
        is_head = page.name[owner] in HEADINGS
        named = is_head and len(text) <= 60 and _COMMENTS.fullmatch(text) is not None
        if heads[i] == length[i]:
            # A heading ends what a heading of its rank or below began.
            if named:
                below = page.name[owner]
            elif below is not None and page.name[owner] <= below:
                below = None
        if named or below is not None:
            found.add(i)
    return found


def extract(pages: DataFrame, html: str = "html", into: str = "text") -> DataFrame:
    """The input rows with the main text of ``html`` in ``into``; the html column goes."""
    carried = [c for c in pages.columns if c not in (html, into)]
    packed = pages.select(F.struct(*carried).alias("row"), F.col(html).cast("string").alias("html")) if carried else pages.select(
        F.struct(F.lit(1).alias("_")).alias("row"), F.col(html).cast("string").alias("html")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                texts = [main_text(h) for h in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["row", "text"])

    schema = T.StructType().add("row", packed.schema["row"].dataType).add("text", "string")
    out = packed.mapInArrow(run, schema)
    return out.select(*[F.col("row").getField(c).alias(c) for c in carried], F.col("text").alias(into))
