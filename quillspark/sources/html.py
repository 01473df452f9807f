"""Visible text and head metadata of HTML, in one pass over the parser's events.

Tags are not closed implicitly: an end tag closes everything up to its start tag, a stray one nothing.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

# Elements without visible text, elements on lines of their own, empty elements, names of dates.
HIDDEN = frozenset("script style noscript template svg head".split())
BLOCK = frozenset(
    "address article aside blockquote dd div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DATE_NAMES = frozenset(("date", "dc.date", "dcterms.created", "article:published_time"))
ISO_DATE = re.compile(r"\d{4}-\d{2}-\d{2}")


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.open: list[str] = []
        self.hidden = 0
        #: For each open list item without its marker yet: depth, and the blanks that came first.
        self.items: list[tuple[int, list[str]]] = []
        self.meta: dict[str, str] = {}
        self.title: list[str] | None = None
        self.title_done = self.title_mixed = False

    def _marker(self, inside_block: bool) -> str:
        """The marker of an item whose first child begins now, if one waits for it here."""
        if not self.items or self.items[-1][0] != len(self.open):
            return ""
        blanks = "".join(self.items.pop()[1])
        if inside_block:
            self.out.append(blanks)
            return "- "
        self.out.append("- " + blanks)
        return ""

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "meta":
            self._note(dict(attrs))
        if tag == "title" and not self.title_done and self.title is None:
            self.title = []
        elif self.title is not None and not self.title_done:
            self.title_mixed = True
        if tag == "br":
            self.handle_data("\n", made=True)
            return
        if tag in HIDDEN:
            self.hidden += 1
        elif not self.hidden:
            marker = self._marker(tag in BLOCK)
            self.out.append("\n" if tag in BLOCK else "")
            self.out.append("```\n" if tag == "pre" else "")
            self.out.append(marker)
            if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
                self.out.append("#" * int(tag[1]) + " ")
        self.open.append(tag)
        if tag == "li" and not self.hidden:
            self.items.append((len(self.open), []))
        if tag in VOID:
            self._close()

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _close(self) -> None:
        if not self.hidden:
            self._marker(False)
        tag = self.open.pop()
        if tag == "title" and self.title is not None:
            self.title_done = True
        if tag in HIDDEN:
            self.hidden -= 1
        elif not self.hidden:
            self.out.append("\n```" if tag == "pre" else "")
            self.out.append("\n" if tag in BLOCK else " | " if tag in ("td", "th") else "")

    def handle_endtag(self, tag: str) -> None:
        if tag in self.open:
            while self.open[-1] != tag:
                self._close()
            self._close()

    def handle_data(self, data: str, made: bool = False) -> None:
        if self.title is not None and not self.title_done:
            self.title.append(data)
        if self.hidden or (not made and self.open and self.open[-1] == "tr" and not data.strip()):
            return
        if not data.strip() and self.items and self.items[-1][0] == len(self.open):
            self.items[-1][1].append(data)
            return
        self._marker(False)
        self.out.append(data)

    def handle_comment(self, data: str) -> None:
        if not self.hidden and data.strip():
            self._marker(False)

    def _note(self, attrs: dict[str, str | None]) -> None:
        name = (attrs.get("name") or attrs.get("property") or "").strip().lower()
        content = (attrs.get("content") or "").strip()
        if content and name == "author":
            self.meta["author"] = content
        elif content and name in DATE_NAMES and ISO_DATE.match(content):
            self.meta.setdefault("date", content[:10])

    def finish(self) -> None:
        self.close()
        while self.open:
            self._close()


def read_html(html: str) -> tuple[str, dict[str, str]]:
    """The visible text, one block element a line, and title, author and date."""
    reader = _Reader()
    reader.feed(html)
    reader.finish()
    lines = (re.sub(r"[ \t]+", " ", line).strip().rstrip("|").strip() for line in "".join(reader.out).splitlines())
    title = "".join(reader.title or []).strip()
    meta = ({"title": title} if title and not reader.title_mixed else {}) | reader.meta
    return "\n".join(line for line in lines if line), meta


def first_heading(html: str) -> str | None:
    found = re.search(r"<h1>(.*?)</h1>", html, re.DOTALL)
    if not found:
        return None
    text = "".join(part.strip() for part in re.split(r"<[^>]*>", found[1]))
    return re.sub(r"&(amp|lt|gt|quot);", lambda m: {"amp": "&", "lt": "<", "gt": ">", "quot": '"'}[m[1]], text) or None
