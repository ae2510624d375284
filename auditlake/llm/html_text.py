"""HTML extraction by a maximum-scoring subsequence.

A page is a sequence of words and tags. Each gets a score by its kind: how much likelier it is
inside main text than outside, as counted on labelled pages, so that words score positive and
tags negative, and words in menus, notices, adverts, forms or comments strongly negative. A
linear scan finds the contiguous stretch with the greatest sum: the main content. A stretch that
has most of the words of the page's main article is widened to the article's ends, so that a last
line of links is not lost.

Whether a block is furniture is a matter of scores too. The words of its class, id and role have
weights learned on the same pages, by whether they are the whole name or a part and whether an
article is open: "header" weighs against a block beside an article and for one inside, "share" as
the whole name against it, while in "share-price" the block's own words decide. A block whose
name and words together score below zero is left out of the text, as are elements that are
furniture by their own name; an element around the main article, or without one around most of
the page's words, is none. Furniture that its page leaves open ends where running text begins.

The pages learned from are made from a seed, in the layouts and with the names that public pages
use: no labelled pages come with the tables, and the test pages have one layout only. They are
held against pages written by hand in the tests.

A stretch of furniture takes off what its words weigh, but at most ``GAP``, as a gap in an
alignment does: beside the text it ends the stretch, between two long parts of it it doesn't.

Scale: one pass over the rows, no shuffle; the scores are some hundred numbers.

Defined cases: a null html counts as empty and has an empty text; text without any tag is all main
text; unclosed and stray tags, comments without end and unknown references don't fail; a page
whose best score isn't positive has an empty text; null page_ids are kept; repeated rows get equal
results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import bounded_batches

#: Elements whose content is no text.
RAW = ("script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "select", "object", "canvas")
#: Elements without content.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that don't end a word or block.
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd",
    "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var",
    "wbr"}
#: Elements that are page furniture as such.
FURNITURE = {"nav", "footer", "aside", "form", "button", "menu", "dialog", "fieldset", "head"}
#: Words of names by kind; only whole words count, since "relative" or "sharp" say nothing.
_KINDS = {
    "advert": "ads?|adbox|adsense|adverts?|advertis(?:ing|ements?)", "sponsor": "sponsors?|sponsored|sponsoring",
    "promo": "promos?|promotions?|promotional", "banner": "banners?", "cookie": "cookies?|cookiebar|cookienotice",
    "consent": "consent", "gdpr": "gdpr", "notice": "notices?", "alert": "alerts?", "popup": "popups?",
    "modal": "modals?", "newsletter": "newsletters?", "subscribe": "subscribe|subscriptions?", "signup": "signup",
    "nav": "navs?|navbars?|navigation|navmenu|navlinks?|navlist", "menu": "menus?|menubar|menuitems?|submenu",
    "breadcrumb": "breadcrumbs?", "header": "headers?", "footer": "foot|footers?", "masthead": "masthead",
    "sidebar": "sidebars?", "aside": "asides?", "widget": "widgets?", "related": "related",
    "recommend": "recommend|recommended|recommendations?", "share": "shares?|sharing|sharebar|sharebuttons?",
    "social": "socials?|socialmedia|sociallinks?", "comment": "comments?|commentlist|commentform", "disqus": "disqus",
    "respond": "respond", "reply": "reply|replies", "login": "login", "search": "search|searchbox|searchform",
    "pagination": "pagination|paginator", "pager": "pagers?", "toolbar": "toolbars?", "contentinfo": "contentinfo",
    "complementary": "complementary",
}
_KIND_OF = re.compile("|".join(f"(?P<{kind}>{words})" for kind, words in _KINDS.items()))
_SPLIT = re.compile(r"[^a-z0-9]+")


def _stem(word: str) -> str | None:
    m = _KIND_OF.fullmatch(word)
    return m.lastgroup if m else None


def _name_words(attributes: dict[str, str]) -> list[tuple[str, bool]]:
    """(stem, whether it is the whole name) of the words of class, id and role."""
    out = []
    apart = re.compile(r"(?<=[a-z])(?=[A-Z])")
    for name in " ".join(apart.sub("-", attributes.get(k, "")) for k in ("class", "id", "role")).lower().split():
        parts = [p for p in _SPLIT.split(name) if p]
        out += [(stem, len(parts) == 1) for p in parts if (stem := _stem(p))]
    return out


_PIECE = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Share of a page's words that a marked block outside articles may hold and still be furniture: by a word of its own ("sidebar") or a part of one ("has-sidebar").
MOST, MOST_OF_PART = 0.75, 0.5
_END = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in RAW}
#: Of these, those that only hide what they close: without an end tag the rest of the page is text.
_MAY_STAY_OPEN = {"noscript", "template", "svg", "select", "object", "canvas"}
#: Score that one stretch of furniture takes off, at most.
GAP = -60.0
#: Score that a block's own words can set against its name, at most.
PROSE = 2.0
#: Elements that running text begins with.
_RUNNING = {"p", "h1", "h2", "h3", "article", "main", "section", "blockquote"}
#: Elements that a page may leave open; an outer end tag closes them.
_OPEN_ENDED = {"p", "li", "dt", "dd", "tr", "td", "th", "thead", "tbody", "option", "b", "i", "em", "strong", "u",
    "span", "a", "font"}


#: Elements that marks say nothing about: text, and what names an article.
_UNMARKED = INLINE | {"html", "body", "article", "main", "p", "h1", "h2", "h3", "h4", "h5", "h6"}
#: Furniture by name that on some sites wraps a whole page.
_WRAPPERS = {"form", "fieldset"}


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), "".join(values))
    return out


def _hidden(attributes: dict[str, str]) -> bool:
    if "hidden" in attributes or attributes.get("aria-hidden", "").strip().lower() == "true":
        return True
    style = [[x.strip() for x in d.split("!")[0].lower().partition(":")[::2]]
        for d in attributes.get("style", "").split(";")]
    return ["display", "none"] in style or ["visibility", "hidden"] in style


class _Element:
    """An element from the event of its start to that of its end, with the number of words, and of such in links, before and in it."""

    __slots__ = ("name", "start", "end", "words", "links", "hidden", "names", "closed")

    def __init__(self, name: str, start: int, words: int, links: int, attributes: dict[str, str]):
        self.name, self.start, self.end, self.words, self.links, self.closed = name, start, start, words, links, False
        self.hidden = name not in ("html", "body") and _hidden(attributes)
        self.names = _name_words(attributes) if attributes else []

    @property
    def marked(self) -> bool:
        return bool(self.names)

    @property
    def by_part(self) -> bool:
        return bool(self.names) and not any(whole for _, whole in self.names)


def _parse(page: str) -> tuple[list[tuple[str, str, _Element | None]], list[_Element], int]:
    """((kind, text, block that a link's text stands in) of the events, elements in order of their start, number of words)."""
    found: list[tuple[str, str, _Element | None]] = []
    elements: list[_Element] = []
    stack: list[_Element] = []
    at, n, words, links = 0, len(page), 0, 0

    def text(t: str) -> None:
        nonlocal words, links
        link = any(e.name == "a" for e in stack[-3:])
        k = 0 if any(e.name == "head" for e in stack[:2]) else len(t.split())
        words, links = words + k, links + k * link
        found.append(("link", t, next((e for e in reversed(stack) if e.name not in INLINE), None)) if link
            else ("word", t, None))

    def close(gone: list[_Element]) -> None:
        for e in gone:
            e.end, e.words, e.links = len(found), words - e.words, links - e.links

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            text(page[at:lt])
            at = lt
            continue
        m = _PIECE.match(page, at)
        if not m:
            found.append(("word", "<", None))
            at += 1
            continue
        at = m.end()
        if m.group(2) is None:
            if page.startswith("<![CDATA[", m.start()):
                text(page[m.start() + 9 : at].removesuffix("]]>"))
            continue
        name, attributes = m.group(2).lower(), m.group(3)
        if m.group(1):
            where = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].name == name), None)
            # an inline end tag without its start, or across a block, closes nothing
            if where is not None and (name not in INLINE
                    or all(s.name in _OPEN_ENDED or s.name in INLINE for s in stack[where:])):
                stack[where].closed = True
                close(stack[where:])
                del stack[where:]
            found.append(("/" + name, "", None))
            continue
        closed = attributes.rstrip().endswith("/")
        if name in _END and not (name == "svg" and closed):
            end = _END[name].search(page, at)
            at = end.end() if end else at if name in _MAY_STAY_OPEN else n
            found.append((f"<{name}", "", None))
            continue
        if name == "body":  # the head ends here, closed or not
            close(stack)
            stack.clear()
        element = _Element(name, len(found), words, links, _attributes(attributes) if attributes.strip() else {})
        found.append((f"<{name}", "", None))
        if name not in VOID and not closed:
            stack.append(element)
        else:
            element.closed = True
            close([element])
        elements.append(element)
    close(stack)
    return found, elements, words


#: Weights of names: (stem, whole name, inside an article) -> score.
Names = dict[tuple[str, bool, bool], float]


def _name_score(e: _Element, inside: bool, names: Names) -> float:
    """What the element's name says: its most telling word's weight."""
    return min((names.get((stem, whole, inside), names.get((stem, False, inside), 0.0)) for stem, whole in e.names),
        default=0.0)


def events(page: str, scores: dict[str, float], names: Names, bounds: list[int]
        | None = None) -> Iterator[tuple[str, str, int]]:
    """(kind, text, furniture): kind is 'word' or in links 'link' for text, else the tag with its slash; furniture is 0 outside page furniture, 1 in it, 2 in such inside an article. bounds gets the main article's first and last event."""
    found, elements, words = _parse(page)
    # comments and teasers may be articles, but such with names or shorter ones
    articles = [e for e in elements if e.name in ("article", "main") and not e.marked and not e.hidden]
    text = max(articles, key=lambda e: (e.name == "main", e.words), default=None)

    if bounds is not None and text is not None:
        bounds[:] = text.start, text.end

    def holds_the_text(e: _Element) -> bool:
        if text is not None:
            return e.start <= text.start and text.end <= e.end
        return e.words > words * (MOST_OF_PART if e.by_part or e.name in _WRAPPERS and not e.marked else MOST)

    def left_open_until(e: _Element) -> int:
        """Where running text begins in furniture that has no end tag, else its end."""
        if e.closed or e.hidden or not (holds_the_text(e) or e.words * 2 > words):
            return e.end
        return next((x.start for x in elements if e.start < x.start < e.end and x.name in _RUNNING), e.end)

    furniture, sections = [0] * (len(found) + 1), [0] * (len(found) + 1)  # changes of the open ones at each event
    inside = open_sections = 0
    starts = {e.start: e for e in elements}
    for i, (kind, piece, block) in enumerate(found):
        inside += furniture[i]
        open_sections += sections[i]
        state = (1 + (open_sections > 0)) if inside else 0
        e = starts.get(i)
        if e is not None:
            by_name = e.name in FURNITURE or e.name == "header" and not open_sections
            end = left_open_until(e) if by_name or e.marked else e.end
            is_furniture = e.hidden or by_name and (end < e.end or not (e.name in _WRAPPERS and holds_the_text(e)))
            if not is_furniture and e.marked and e.name not in _UNMARKED and (end < e.end or not holds_the_text(e)):
                prose = min(PROSE, scores["word"] * (e.words - e.links) + scores["link"] * e.links)
                is_furniture = _name_score(e, open_sections > 0, names) + prose < 0
            state = state or (1 + (open_sections > 0) if is_furniture else 0)
            if e.end > i + 1:
                furniture[i + 1] += is_furniture
                furniture[max(i + 1, end)] -= is_furniture
                if e.name in ("article", "main"):
                    sections[i + 1] += 1
                    sections[e.end] -= 1
        # a link in running text is text; one among links is not
        running = block is not None and block.links * (1 if block.name in _RUNNING else 2) < block.words
        yield "word" if running else kind, piece, state


_TEXT = ("word", "link")


def _kind(kind: str, furniture: int) -> str:
    if kind in _TEXT:
        return "furniture word" if furniture else kind
    name = kind.lstrip("</")
    return "furniture tag" if furniture else "inline tag" if name in INLINE else "block tag" if name in _CONTENT else "other tag"


#: Block tags of running text.
_CONTENT = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "ul", "ol", "li", "table", "tr", "td", "th",
    "tbody", "thead", "dl", "dt", "dd", "figure", "figcaption", "br", "hr", "section", "article", "main", "div", "img"}


#: Names of blocks beside the text, of blocks inside an article that are none of its text, and of such that are.
_BESIDE = (
    "ad", "ads", "ad-slot", "advert", "advertisement", "adsense", "adbox", "sponsor", "sponsored", "sponsor-box",
    "promo", "promo-box", "promotion", "banner", "top-banner", "cookie-notice", "cookie-bar", "cookies", "consent",
    "consent-dialog", "gdpr",
    "notice", "site-notice", "alert", "alert-bar", "popup", "modal", "modal-dialog", "newsletter", "newsletter-signup",
    "subscribe", "signup", "nav", "main-nav", "navbar", "navigation", "menu", "menu-main", "breadcrumb", "breadcrumbs",
    "header", "site-header",
    "page-header", "footer", "site-footer", "foot", "masthead", "sidebar", "left-sidebar", "aside", "aside-box",
    "widget", "widget-area", "related", "related-posts", "recommended", "recommend-box", "share", "share-buttons",
    "social", "social-links", "comments", "comment-list",
    "disqus", "respond", "reply-form", "replies", "login", "login-box", "search", "search-form", "pagination",
    "page-pagination", "pager", "toolbar", "contentinfo", "complementary",
)
_INSIDE_NONE = (
    "ad", "ads", "ad-slot", "advert", "advertisement", "adbox", "sponsor", "sponsored", "sponsor-note", "promo",
    "promo-box", "banner", "banner-box", "cookie-notice", "cookies", "consent", "consent-note", "gdpr", "notice",
    "notice", "notice-bar", "alert", "popup", "modal", "newsletter",
    "newsletter-box", "subscribe", "subscribe-box", "signup", "nav", "nav-links", "menu", "menu-box", "breadcrumbs",
    "footer-links", "foot", "sidebar", "sidebar-box", "aside", "aside-box", "widget", "widget-box", "related",
    "related-posts", "recommended", "recommended-posts", "share", "social",
    "social-links", "comments", "comment-list", "disqus", "respond", "replies", "reply", "login", "login-box", "search",
    "pagination", "pagination-links", "pager", "toolbar",
)
_INSIDE_TEXT = (
    "header", "header", "post-header", "entry-header", "article-header", "story-header", "header-title", "share-price",
    "market-share", "share-count-table", "notice-board", "notice-period", "search-results", "search-method",
    "alert-level", "alert-example", "reply-text", "reply-text",
)


def labelled_pages(n: int = 300, seed: int = 5) -> list[tuple[str, list[tuple[str, bool]]]]:
    """Made pages of several layouts as parts (html, whether it is main text): the labels the scores are learned from."""
    r = random.Random(seed)
    words = lambda a, b: " ".join("".join(r.choice(("ra", "to", "mi", "sel", "en", "du", "ko"))
            for _ in range(r.randint(1, 4))) for _ in range(r.randint(a, b)))
    pages = []
    for k in range(n):
        links = lambda: "".join(f'<li><a href="/{words(1, 1)}">{words(1, 3)}</a></li>' for _ in range(r.randint(2, 9)))
        filling = lambda: r.choice((f"<ul>{links()}</ul>", words(3, 20), f"<p>{words(5, 25)}</p>",
                f"{words(2, 8)} <button>{words(1, 2)}</button>"))
        named = lambda names: f'<div {r.choice(("class", "class", "id"))}="{r.choice(names)}">{filling()}</div>'
        parts = [(f"<html><head><title>{words(3, 8)}</title></head><body>", False)]
        furniture = [
            lambda: f"<nav><ul>{links()}</ul></nav>", lambda: f"<header><div>{words(1, 5)}</div></header>",
            lambda: named(_BESIDE), lambda: named(_BESIDE), lambda: named(_BESIDE), lambda: f"<ul>{links()}</ul>",
            lambda: f"<form>{words(1, 4)}<input></form>",
        ]
        parts += [(r.choice(furniture)(), False) for _ in range(r.randint(1, 4))]
        opening, closing = r.choice((("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"),
                ('<div class="content">', "</div>"), ("<div><div>", "</div></div>")))
        parts.append((f"{opening}<h1>{words(3, 9)}</h1>", True))
        for _ in range(r.randint(1, 12)):
            parts.append((f"<p>{words(8, 90)} <b>{words(1, 5)}</b> {words(2, 30)}" + (f' <a href="/x">{words(1, 3)}</a>'
                        if r.random() < 0.2 else "") + "</p>" + ("<br>" if r.random() < 0.2 else ""), True))
            if "article" in opening or "main" in opening:
                if r.random() < 0.25:
                    parts.append((named(_INSIDE_NONE), False))
                if r.random() < 0.2:
                    parts.append((f'<div class="{r.choice(_INSIDE_TEXT)}"><p>{words(6, 40)}</p></div>', True))
        parts.append((closing, True))
        parts += [(r.choice([*furniture, lambda: named(("comments", "comment-list", "related-posts"))])(), False)
            for _ in range(r.randint(0, 3))]
        parts.append((f"<footer>{words(3, 15)}</footer></body></html>", False))
        pages.append((f"page {k}", parts))
    return pages


def learn_names(pages: list[tuple[str, list[tuple[str, bool]]]]) -> Names:
    """Weights of names: the log of how much oftener blocks with one are main text than not, one of each added."""
    seen: dict[tuple[str, bool, bool], list[int]] = {}
    for _, parts in pages:
        inside = False
        for part, main in parts:
            inside = inside or part.startswith(("<article", "<main"))
            for e in _parse(part)[1]:
                for stem, whole in e.names:
                    seen.setdefault((stem, whole, inside), [0, 0])[not main] += 1
            inside = inside and not part.startswith(("</article", "</main"))
    return {key: math.log((a + 1) / (b + 1)) * (1.0 if a else 3.0) for key, (a, b) in seen.items()}


def learn(pages: list[tuple[str, list[tuple[str, bool]]]]) -> tuple[dict[str, float], Names]:
    """(scores by kind, weights of names): the log of how much likelier each is in main text than outside."""
    names = learn_names(pages)
    scores = {"word": 0.1, "link": -0.1}
    inside, outside = Counter(), Counter()
    for _, parts in pages:
        # each part's events by its length in pieces of text and tags, which parts don't share
        labels = [main for part, main in parts for _ in _parse(part)[0]]
        for (kind, text, furniture), main in zip(events("".join(p for p, _ in parts), scores, names), labels):
            (inside if main else outside)[_kind(kind, furniture)] += max(1, len(text.split())) if kind in _TEXT else 1
    kinds = {"word", "link", "furniture word", "furniture tag", "inline tag", "block tag", "other tag"}
    a, b = (sum(x.values()) + len(kinds) for x in (inside, outside))
    found = {k: math.log((inside[k] + 1) / a) - math.log((outside[k] + 1) / b) for k in kinds}
    # the method's signs: running words for, tags and furniture against
    found["word"] = max(found["word"], 0.1)
    for k in ("link", "inline tag", "block tag", "other tag"):
        found[k] = min(found[k], -0.1)
    for k in ("furniture word", "furniture tag"):
        found[k] = min(found[k], -1.0)
    return found, names


_learned: list[tuple[dict[str, float], Names]] = []
_BLANK = re.compile(r"\s+")


def learned() -> tuple[dict[str, float], Names]:
    """The scores of the made pages, learned once in a process."""
    if not _learned:
        _learned.append(learn(labelled_pages()))
    return _learned[0]


def extract(page: str, model: tuple[dict[str, float], Names] | None = None) -> str:
    """The main text: blocks in page order, joined by one space."""
    scores, names = model or learned()
    bounds: list[int] = []
    found = list(events(page, scores, names, bounds))
    best, best_from, best_to = 0.0, 0, 0
    total, start, owed = 0.0, 0, GAP
    for i, (kind, text, furniture) in enumerate(found):
        s = scores[_kind(kind, furniture)]
        if kind in _TEXT:
            s *= len(text.split())
        if furniture:  # its text is left out anyway; an advert must not cut an article in two
            s = max(s, owed) if furniture == 1 else 0.0
            owed -= s
        elif kind in _TEXT and s:
            owed = GAP
        total += s
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, best_from, best_to = total, start, i + 1
    if bounds and best:
        # a stretch that has most of the main article's words goes to the article's ends
        weigh = lambda a, b: sum(len(t.split()) for k, t, f in found[a:b] if k in _TEXT and not f)
        if 2 * weigh(max(best_from, bounds[0]), min(best_to, bounds[1])) > weigh(*bounds):
            best_from, best_to = min(best_from, bounds[0]), max(best_to, bounds[1])
    out = []
    for kind, text, furniture in found[best_from:best_to]:
        if kind not in _TEXT:
            if kind.lstrip("</") not in INLINE:
                out.append(" ")
        elif not furniture:
            out.append(text)
    return _BLANK.sub(" ", html.unescape("".join(out))).strip()


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages."""
    bounded_batches(pages.sparkSession)
    model = learned()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(t.as_py() or "", model) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long"
    return pages.select("page_id", F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html")).mapInArrow(run, schema)
