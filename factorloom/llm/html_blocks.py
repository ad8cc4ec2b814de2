"""Blocks of text of a web page, and how far each is from the article.

One forward pass over the page: every search begins where the last one ended, a quote or tag that is never
closed is looked for once, and open elements are found by name, so that the time follows the length of
the page, however broken it is.
"""

from __future__ import annotations

import re
from html import unescape

#: Elements whose text is never the article's.
SKIPPED = frozenset(
    "head script style noscript template nav footer aside form menu dialog button select textarea option "
    "iframe object svg canvas audio video map datalist".split()
)
#: Their content is text up to their own end tag.
RAW = frozenset("script style textarea title iframe noscript xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol optgroup option p pre section "
    "summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = (BLOCKS | SKIPPED) - {"hr"}
#: Words of class, id and role that mark parts around the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr "
    "notice alert popup modal overlay nav navbar navigation menu submenu breadcrumb breadcrumbs header masthead "
    "topbar footer sidebar complementary contentinfo related recommended share sharing social comment comments "
    "disqus respond reply replies subscribe newsletter signup login search form dialog pagination pager toolbar "
    "widget skip".split()
)
#: Words that a name may hold beside marks and still mean such a part; with any other word it may mean something else.
BESIDE = frozenset(
    "area articles bar block bottom box buttons container count has icons inner inside item items layout left link links list main "
    "outer page panel popular posts primary right section secondary site slot stories sticky strip text top unit widgets wrap "
    "wrapper x".split()
)
#: Those of them that may also name a layout around the article or, in a main part, its own head.
LAYOUT = frozenset("nav navbar navigation menu header masthead topbar sidebar banner toolbar".split())
HEADS = frozenset("header masthead topbar banner".split())
#: A new article ends these where their end tag is missing.
LEFT_OPEN = ("nav", "header")
#: Their end tag may be left out before one of the same name.
REPEATED = frozenset("li td th tr dt dd option".split())

_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*+")
_EDGE = re.compile(r"[\"'>]")
_ATTRIBUTE = re.compile(r"(?<![a-zA-Z-])([a-zA-Z-]++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*+=\s*+[\"']?true|display\s*+:\s*+none", re.I)
_RAW_END = {tag: re.compile(rf"</{tag}\s*+>", re.I) for tag in RAW}
#: A number of a character reference beyond any character.
_LONG_NUMBER = re.compile(r"&#(?:0*+[1-9][0-9]{8,}+|[xX]0*+[1-9a-fA-F][0-9a-fA-F]{7,}+);?")


def _marks(tag: str, rest: str) -> tuple[frozenset[str], bool]:
    """Which marks an element's attributes carry, and whether they declare it the main part."""
    if not rest or tag in ("body", "html"):
        return frozenset(), False
    names: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(rest):
        names.setdefault(m[1].lower(), (m[2] or m[3] or m[4] or "").lower())
    if names.get("role") == "main":
        return frozenset(), True
    found: set[str] = set()
    for name in " ".join(names.get(k, "") for k in ("class", "id", "role")).split():
        words = set(re.split(r"[^a-z]+", name)) - {""}
        marks = words & MARKS
        if words <= marks | BESIDE:
            found |= marks
    return frozenset(found) | ({"hidden"} if _HIDDEN.search(rest) else frozenset()), False


class _Tags:
    """Comments, declarations and tags of a page from left to right."""

    def __init__(self, html: str):
        self.html, self.quotes = html, True
        #: Quote characters that no further one can close.
        self.dead: set[str] = set()

    def _end(self, at: int) -> int:
        """Place behind the tag whose attributes begin at `at`, -1 if it is never closed."""
        html = self.html
        if self.quotes:
            while m := _EDGE.search(html, at):
                if m[0] == ">":
                    return m.end()
                at = m.end()
                if m[0] not in self.dead:
                    close = html.find(m[0], at)
                    if close < 0:
                        self.dead.add(m[0])
                    else:
                        at = close + 1
            # From here on no tag's quotes are trusted: the search that failed is not repeated.
            self.quotes = False
            return -1
        return html.find(">", at) + 1 or -1

    def tokens(self):
        """(text before, tag or "" for none, whether it ends an element, attributes)."""
        html, at, begin, size = self.html, 0, 0, len(self.html)
        last = html.rfind(">")
        while (open_ := html.find("<", at)) >= 0:
            after = html[open_ + 1 : open_ + 2]
            if after == "!" and html.startswith("<!--", open_):
                end = html.find("-->", open_ + 4)
                yield html[begin:open_], "", False, ""
                at = begin = size if end < 0 else end + 3
                continue
            if open_ > last:  # no tag ends any more; a comment may still begin
                comment = html.find("<!--", open_)
                size = size if comment < 0 else comment
                break
            name = _NAME.match(html, open_ + 1 + (after == "/"))
            if name is None and after not in ("!", "?", "/"):
                at = open_ + 1
                continue
            end = self._end(name.end()) if name else html.find(">", open_) + 1 or -1
            if end < 0:
                at = open_ + 1
                continue
            tag = name[0].lower() if name else ""
            closing = after == "/"
            rest = html[name.end() : end - 1] if name else ""
            if tag in RAW and not closing:
                done = _RAW_END[tag].search(html, end)
                end = done.end() if done else size
                tag = ""
            yield html[begin:open_], tag, closing, rest
            at = begin = end
        if begin < size:
            yield html[begin:size], "", False, ""


class _Open:
    """Open elements: (tag, distance, main), with the places of each name."""

    def __init__(self):
        self.stack: list[tuple[str, int, bool]] = []
        self.places: dict[str, list[int]] = {}

    def push(self, tag: str, distance: int, main: bool) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, distance, main))

    def cut(self, depth: int) -> None:
        while len(self.stack) > depth:
            self.places[self.stack.pop()[0]].pop()

    def end(self, tag: str) -> None:
        if self.places.get(tag):
            self.cut(self.places[tag][-1])

    def top(self) -> str | None:
        return self.stack[-1][0] if self.stack else None

    def state(self) -> tuple[int, bool]:
        return self.stack[-1][1:] if self.stack else (OPEN, False)


#: How far an element's text is from the article's: it may be, only in an article inside, never.
OPEN, LAID_OUT, AWAY = 0, 1, 2
AROUND, BODY, MAIN = 0, 1, 2


def blocks(html: str) -> list[tuple[int, str]]:
    """(kind, text) of every block in page order: AROUND the article, in the BODY, in a declared MAIN part."""
    out: list[tuple[int, str]] = []
    parts: list[str] = []
    open_ = _Open()
    skipped, main = OPEN, False

    def close() -> None:
        if parts:
            text = " ".join(unescape(_LONG_NUMBER.sub("�", "".join(parts))).split())
            if text:
                out.append((AROUND if skipped else MAIN if main else BODY, text))
            parts.clear()

    for before, tag, ends, rest in _Tags(html).tokens():
        if before:
            parts.append(before)
        if not tag:  # a comment, a declaration or an element of raw text
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCKS or tag in SKIPPED:
            close()
        if tag not in CONTAINERS:
            continue
        if ends:
            open_.end(tag)
        elif not rest.endswith("/") or tag in BLOCKS:
            if open_.top() == "p":
                open_.cut(len(open_.stack) - 1)  # a block ends an open paragraph
            if tag in ("article", "main"):
                left = [open_.places[name][0] for name in LEFT_OPEN if open_.places.get(name)]
                if left:
                    open_.cut(min(left))
            elif tag in REPEATED and open_.top() == tag:
                open_.cut(len(open_.stack) - 1)
            skipped, main = open_.state()
            marks, declared = _marks(tag, rest)
            if main:
                marks -= HEADS
            if tag in ("article", "main") and skipped <= (AWAY if tag == "main" else LAID_OUT) and not marks:
                skipped, declared = OPEN, True
            if tag in SKIPPED or (tag == "header" and not main) or marks - LAYOUT:
                skipped = AWAY
            elif marks:
                skipped = max(skipped, LAID_OUT if tag in ("div", "section") else AWAY)
            open_.push(tag, skipped, main or declared)
        skipped, main = open_.state()
    close()
    return out
