"""Markdown to HTML for the usual constructs; what isn't known passes through as text.

Known: headings, paragraphs, block quotes, lists (tight and loose, nested), fenced and indented code, pipe
tables, rules, raw HTML lines, emphasis, code spans, links, images, hard breaks and escapes. Not known:
reference links, footnotes and HTML blocks that end in the middle of a line.
"""

from __future__ import annotations

import html
import re

FRONT = re.compile(r"\A---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\Z)", re.DOTALL)
FRONT_FIELDS = frozenset(("title", "author", "date"))
_ITEM = re.compile(r"( {0,3})([-*+]|\d{1,9}[.)])( +|$)")
_RULE = re.compile(r" {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
_DASHES = re.compile(r"\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$")
_INLINE = [
    (re.compile(r"!\[([^\]]*)\]\([^)]*\)"), ""), (re.compile(r"\[([^\]]*)\]\([^)]*\)"), r"<a>\1</a>"), (re.compile(r"&lt;((?:https?://|mailto:)[^\s&]+)&gt;"), r"<a>\1</a>"),
    (re.compile(r"(\*\*|__)(?=\S)(.+?)(?<=\S)\1", re.DOTALL), r"<strong>\2</strong>"), (re.compile(r"(?<![\w*])\*(?=\S)(.+?)(?<=\S)\*(?![\w*])|(?<!\w)_(?=\S)(.+?)(?<=\S)_(?!\w)", re.DOTALL), lambda m: f"<em>{m[1] or m[2]}</em>"),
]


def split_front_matter(text: str) -> tuple[dict[str, str], str]:
    """Title, author and date of a leading ``---`` block, and the rest."""
    found = FRONT.match(text)
    if not found:
        return {}, text
    pairs = (line.partition(":") for line in found[1].splitlines())
    meta = {k.strip().lower(): v.strip().strip("\"'") for k, colon, v in pairs if colon}
    meta = {k: v for k, v in meta.items() if k in FRONT_FIELDS and v}
    if "date" in meta:
        date = re.match(r"\d{4}-\d{2}-\d{2}", meta.pop("date"))
        meta |= {"date": date[0]} if date else {}
    return meta, text[found.end() :]


def inline(text: str) -> str:
    """Inline marks of one block."""
    kept: list[str] = []

    def keep(made: str) -> str:
        kept.append(made)
        return f"\x00{len(kept) - 1}\x00"

    text = re.sub(r"(`+)(?!`)(.+?)(?<!`)\1(?!`)", lambda m: keep("<code>" + html.escape(m[2].replace("\n", " ").strip() or m[2], False) + "</code>"), text, flags=re.DOTALL)
    text = re.sub(r"\\([!-/:-@\[-`{-~])", lambda m: keep(html.escape(m[1], False)), text)
    text = re.sub(r"</?[A-Za-z][^<>]*>", lambda m: keep(m[0]), text)
    text = html.escape(html.unescape(text), False)
    for pattern, made in _INLINE:
        text = pattern.sub(made, text)
    text = re.sub(r"(?: {2,}|\\)\n", "<br>\n", text)
    while "\x00" in text and re.search(r"\x00(\d+)\x00", text):
        text = re.sub(r"\x00(\d+)\x00", lambda m: kept[int(m[1])], text)
    return text


def _cells(line: str) -> list[str]:
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", line.strip().removeprefix("|").removesuffix("|"))]


def _starts(line: str) -> bool:
    """Does this line end a paragraph before it?"""
    return bool(not line.strip() or re.match(r" {0,3}#{1,6}(\s|$)", line) or _FENCE.match(line) or _RULE.match(line) or re.match(r" {0,3}>", line) or re.match(r" {0,3}([-*+]|1[.)]) +\S", line))


def render(text: str) -> str:
    return "\n".join(_blocks(text.replace("\r\n", "\n").replace("\r", "\n").expandtabs(4).split("\n")))


def _blocks(lines: list[str], tight: bool = False) -> list[str]:
    out: list[str] = []
    at, n = 0, len(lines)
    while at < n:
        line = lines[at]
        if not line.strip():
            at += 1
        elif fence := _FENCE.match(line):
            end = next((i for i in range(at + 1, n) if re.match(rf" {{0,3}}{re.escape(fence[1])}[{fence[1][0]}]*\s*$", lines[i])), n)
            out.append("<pre><code>" + html.escape("".join(x + "\n" for x in lines[at + 1 : end]), False) + "</code></pre>")
            at = end + 1
        elif head := re.match(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$", line):
            out.append(f"<h{len(head[1])}>{inline(head[2] or '')}</h{len(head[1])}>")
            at += 1
        elif _RULE.match(line):
            out.append("<hr>")
            at += 1
        elif line.startswith("    "):
            end = at
            while end < n and (lines[end].startswith("    ") or not lines[end].strip()):
                end += 1
            out.append("<pre><code>" + html.escape("\n".join(x[4:] for x in lines[at:end]).rstrip("\n") + "\n", False) + "</code></pre>")
            at = end
        elif re.match(r" {0,3}>", line):
            end = at
            while end < n and lines[end].strip() and (re.match(r" {0,3}>", lines[end]) or not _starts(lines[end])):
                end += 1
            out += ["<blockquote>", *_blocks([re.sub(r"^ {0,3}> ?", "", x) for x in lines[at:end]]), "</blockquote>"]
            at = end
        elif _ITEM.match(line):
            made, at = _list(lines, at)
            out += made
        elif "|" in line and at + 1 < n and "-" in lines[at + 1] and _DASHES.match(lines[at + 1]) and len(_cells(line)) == len(_cells(lines[at + 1])):
            end, width = at + 2, len(_cells(line))
            while end < n and lines[end].strip() and not _starts(lines[end]):
                end += 1
            rows = [(_cells(x) + [""] * width)[:width] for x in lines[at + 2 : end]]
            out += ["<table>", "<thead>", "<tr>", *(f"<th>{inline(c)}</th>" for c in _cells(line)), "</tr>", "</thead>", "<tbody>"]
            out += [x for r in rows for x in ("<tr>", *(f"<td>{inline(c)}</td>" for c in r), "</tr>")] + ["</tbody>", "</table>"]
            at = end
        else:
            end, level = at + 1, 0
            while end < n and not level and not _starts(lines[end]):
                level = 1 if re.match(r" {0,3}=+\s*$", lines[end]) else 2 if re.match(r" {0,3}-+\s*$", lines[end]) else 0
                end += 1
            if not level and end < n and re.match(r" {0,3}-+\s*$", lines[end]):
                level, end = 2, end + 1
            body = "\n".join(x.lstrip() for x in lines[at : end - bool(level)]).rstrip()
            raw = re.match(r"</?[A-Za-z!][^<]*", body) and not level and re.match(r"<(/?[a-z][a-z0-9]*[\s/>]|!--)", body, re.I)
            made = body if raw else inline(body)
            out.append(f"<h{level}>{made}</h{level}>" if level else made if tight or raw else f"<p>{made}</p>")
            at = end
    return out


def _list(lines: list[str], at: int) -> tuple[list[str], int]:
    """The list that begins here, and the line after it."""
    first = _ITEM.match(lines[at])
    kind, items, loose, gap = first[2][-1], [], False, False
    while at < len(lines):
        mark = _ITEM.match(lines[at])
        if not mark or mark[2][-1] != kind or _RULE.match(lines[at]):
            break
        loose |= gap and bool(items)
        width = len(mark[0]) if mark[3] and len(mark[3]) < 5 else len(mark[1]) + len(mark[2]) + 1
        body, at, gap = [lines[at][width:]], at + 1, False
        while at < len(lines):
            line = lines[at]
            if not line.strip():
                gap = True
            elif line.startswith(" " * width):
                loose |= gap and not _ITEM.match(line[width:])
                gap = False
            elif gap or _starts(line) or _ITEM.match(line):
                break
            body.append(line[width:] if line.startswith(" " * width) else line.lstrip())
            at += 1
        items.append(body)
    tag = "ul" if kind in "-*+" else "ol"
    out = [f"<{tag}>"]
    for body in items:
        inner = _blocks(body, not loose)
        out.append("<li>" + ("\n" if loose else "") + "\n".join(inner) + ("\n" if loose else "") + "</li>")
    return [*out, f"</{tag}>"], at
