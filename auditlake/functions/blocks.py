"""The containers and text blocks of a page, and the blocks that are its content.

Tags come in page order. Open containers lie on a stack, with the places of each name on it, so an
end tag finds its element at once and everything above it closes with it; a tag that browsers close
by implication (an item by the next item, a cell by the next cell) is closed the same way. Each
container is opened and closed once, so the work is linear in the number of tags. Blocks lie in
page order, and a container's blocks are a range of them.

Content of a page without article or main, in three steps. Links: a block, and a container, of
which links hold the larger part is navigation; a heading that is all link, with few words after
it, is a teaser. Prose: blocks of some words that are left weigh by their words, and from the root
on the container that holds three quarters of the weight leads to the text. What is left of that
container's blocks is the content, without headings that stand over nothing. A page without prose
gives all blocks that are left, one of links alone gives nothing.
"""

from __future__ import annotations

import html
import re

#: Elements that are nodes of the tree (fixed values).
CONTAINERS = {"body", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form", "ul", "ol", "dl", "li",
    "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "blockquote", "figure", "fieldset", "details", "center"}
#: Elements at which a block ends.
BREAKS = (CONTAINERS - {"td", "th"}) | {"p", "br", "hr", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "caption", "figcaption",
    "summary", "address"}
FURNITURE = {"nav", "header", "footer", "aside", "form"}
HEADINGS = {"h1": 1, "h2": 2, "h3": 3, "h4": 4, "h5": 5, "h6": 6}
#: Elements whose start closes an open one of the second set, unless one of the third was opened since.
_IMPLIED = {
    "li": (("li",), ("ul", "ol")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("tr",), ("table",)),
    "tbody": (("thead", "tbody", "tfoot"), ("table",)), "thead": (("thead", "tbody", "tfoot"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot"), ("table",)),
}
#: End tags don't reach out of these, but for those of tables' own parts.
_SCOPE, _PARTS = {"td", "th", "table"}, {"table", "thead", "tbody", "tfoot", "tr", "td", "th"}
#: Marks of containers that are no content: roles, and whole words of class or id (fixed values).
_ROLES = {"navigation", "banner", "contentinfo", "search", "complementary", "dialog", "alertdialog", "menu", "menubar"}
_NAMES = {"ad", "ads", "advert", "advertisement", "comments", "comment", "sidebar", "breadcrumb", "breadcrumbs"}
_MARKED = re.compile(r"role|hidden|display|class|id|itemprop", re.I)
_MARK = re.compile(r"""(role|class|id|itemprop|style|aria-hidden)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|(?<![-\w])(hidden)(?![-\w])""", re.I)
_SPACE = re.compile(r"\s+")
#: Share of links from which a block or container is navigation, and a heading one of a teaser.
LINKED, HEADING_LINKED = 0.5, 0.8
#: Words of a block from which it is prose, and words after a linked heading up to which it is a teaser.
PROSE_WORDS, TEASER_WORDS = 8, 60
#: Share of a container's prose that leads to one of its children.
LEADING = 0.75


class Tree:
    """Containers by number, 0 the root: parent, name, and the range of its blocks; blocks: (container, heading's level or 0, text, characters in links)."""

    def __init__(self):
        self.parent, self.name, self.first, self.end = [-1], ["root"], [0], [0]
        self.blocks: list[tuple[int, int, str, int]] = []
        self._stack, self._at, self._scopes = [0], {}, [0]
        self._outside: set[int] = set()  # open containers that are no content
        self._pieces: list[str] = []
        self._linked = self._level = self._pre = 0
        self._article = self._main = -1

    def text(self, text: str, linked: bool) -> None:
        if self._outside:
            return
        if self._pre and "\n" in text:
            for line in text.split("\n"):
                self._flush()
                self._pieces.append(line)
            return
        self._pieces.append(text)
        if linked:
            self._linked += len(text.strip())

    def _flush(self) -> None:
        if self._pieces:
            text = _SPACE.sub(" ", "".join(self._pieces)).strip()
            if text:
                self.blocks.append((self._stack[-1], self._level, text, min(len(text), self._linked)))
            self._pieces = []
        self._linked = 0

    def open(self, name: str, rest: str) -> None:
        if name not in BREAKS:
            if name not in ("td", "th"):
                return
            # a row is a line
            self._pieces.append(" ")
        else:
            self._flush()
        if name in HEADINGS:
            self._level = HEADINGS[name]
        elif name == "pre":
            self._pre += 1
        elif name in CONTAINERS:
            if name == "body" and "body" in self._at:
                return
            if name in _IMPLIED:
                ended, since = _IMPLIED[name]
                last = max((self._at[n][-1] for n in ended if self._at.get(n)), default=-1)
                if last > max((self._at[n][-1] for n in since if self._at.get(n)), default=-1):
                    self._pop(last)
            self._push(name, rest)

    def _push(self, name: str, rest: str) -> None:
        node = len(self.parent)
        self.parent.append(self._stack[-1])
        self.name.append(name)
        self.first.append(len(self.blocks))
        self.end.append(-1)
        self._at.setdefault(name, []).append(len(self._stack))
        if name in _SCOPE:
            self._scopes.append(len(self._stack))
        self._stack.append(node)
        if name in FURNITURE or name not in ("body", "article", "main") and rest and _MARKED.search(rest) and _no_content(rest):
            self._outside.add(node)
        if name == "article" and self._article < 0:
            self._article = node
        elif self._main < 0 and (name == "main" or rest and "main" in rest and re.search(r"role\s*=\s*[\"']?main\b", rest)):
            self._main = node

    def close(self, name: str) -> None:
        if name in BREAKS and name not in CONTAINERS:
            self._flush()
        if name in HEADINGS:
            self._level = 0
        elif name == "pre":
            self._pre = max(0, self._pre - 1)
        elif self._at.get(name) and name != "body":
            place = self._at[name][-1]
            barrier = (self._at.get("table") or [0])[-1] if name in _PARTS and name != "table" else self._scopes[-1]
            if name == "table" or place > barrier:
                self._pop(place)

    def _pop(self, place: int) -> None:
        """Close the container at that place of the stack and all above it. A cell's end ends no line."""
        if len(self._stack) == place + 1 and self.name[self._stack[-1]] in ("td", "th"):
            self._pieces.append(" ")
        else:
            self._flush()
        while len(self._stack) > place:
            node = self._stack.pop()
            self.end[node] = len(self.blocks)
            name = self.name[node]
            self._at[name].pop()
            if name in _SCOPE:
                self._scopes.pop()
            self._outside.discard(node)
        self._level = 0

    def finish(self) -> None:
        self._flush()
        self._pop(1)
        self.end[0] = len(self.blocks)

    def main(self) -> list[str]:
        """The lines of the main text."""
        for node in (self._article, self._main):
            if node >= 0 and (found := [b[2] for b in self.blocks[self.first[node] : self.end[node]]]):
                return found
        return self._content()

    def _content(self) -> list[str]:
        words = [len(b[2].split()) for b in self.blocks]
        left = self._without_navigation(words)
        weight = [0] * (len(self.blocks) + 1)
        for k, (_, level, _, _) in enumerate(self.blocks):
            prose = left[k] and not level and words[k] >= PROSE_WORDS
            weight[k + 1] = weight[k] + prose * words[k]
        of = lambda node: weight[self.end[node]] - weight[self.first[node]]
        children: list[list[int]] = [[] for _ in self.parent]
        for node in range(1, len(self.parent)):
            children[self.parent[node]].append(node)
        at = 0
        while of(at) and children[at]:
            best = max(children[at], key=of)
            if of(best) < LEADING * of(at):
                break
            at = best
        return self._with_something_below([k for k in range(self.first[at], self.end[at]) if left[k]])

    def _without_navigation(self, words: list[int]) -> list[bool]:
        """For each block, whether it is left when navigation and teasers go."""
        n = len(self.blocks)
        change, chars, linked = [0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        for k, (_, _, text, links) in enumerate(self.blocks):
            chars[k + 1], linked[k + 1] = chars[k] + len(text), linked[k] + links

        def drop(first: int, end: int) -> None:
            change[first] += 1
            change[end] -= 1

        for k, (_, _, text, links) in enumerate(self.blocks):
            if links > LINKED * len(text):
                drop(k, k + 1)
        for node in range(1, len(self.parent)):
            if self.name[node] != "body":
                first, end = self.first[node], self.end[node]
                if linked[end] - linked[first] > LINKED * (chars[end] - chars[first]):
                    drop(first, end)
        total = [0] * (n + 1)
        for k in range(n):
            total[k + 1] = total[k] + words[k]
        heading = n  # the next heading after k
        for k in range(n - 1, -1, -1):
            node, level, text, links = self.blocks[k]
            if not level:
                continue
            if links >= HEADING_LINKED * len(text):
                # the container that holds more than the heading
                while self.parent[node] > 0 and self.end[node] - self.first[node] == 1:
                    node = self.parent[node]
                end = min(heading, self.end[node])
                if total[end] - total[k + 1] <= TEASER_WORDS:
                    drop(k, end)
            heading = k
        left, depth = [], 0
        for k in range(n):
            depth += change[k]
            left.append(depth == 0)
        return left

    def _with_something_below(self, kept: list[int]) -> list[str]:
        """The blocks' texts, without headings after which no text comes before the next heading of their level or a higher one."""
        found, highest = [], 0  # the highest level among the headings before the next text; 7: none, 0: no text comes
        for k in reversed(kept):
            level, text = self.blocks[k][1:3]
            if not level:
                highest = 7
            elif level >= highest:
                continue
            else:
                highest = level
            found.append(text)
        return found[::-1]


def _no_content(rest: str) -> bool:
    """Whether attributes mark a container that is no content: hidden, of a role of furniture, an advert, comments."""
    for key, a, b, c, hidden in _MARK.findall(rest):
        value = html.unescape(a or b or c).lower()
        key = key.lower()
        if hidden or key == "role" and value in _ROLES or key == "aria-hidden" and value == "true":
            return True
        if key == "style" and "display:none" in value.replace(" ", ""):
            return True
        if key in ("class", "id", "itemprop") and not _NAMES.isdisjoint(value.split()):
            return True
    return False
