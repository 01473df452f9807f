"""Parsers: bytes of one file to sections of text and what its format records. Run inside kernels."""

from __future__ import annotations

import codecs
import csv
import io
import json
import re
import zipfile
import zlib
from collections.abc import Callable
from itertools import groupby
from xml.etree import ElementTree

from .html import first_heading, read_html
from .markdown import render, split_front_matter

#: Sections as (text, page number or None), and metadata.
Parsed = tuple[list[tuple[str, int | None]], dict]
Parser = Callable[[bytes], Parsed]


def read_text(data: bytes) -> tuple[str, str]:
    """Text and the encoding it was read with; the last one never fails."""
    for mark, name in ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")):
        if data.startswith(mark):
            return data.decode(name), name
    for name in ("utf-8", "cp1252"):
        try:
            return data.decode(name), name
        except UnicodeDecodeError:
            continue
    return data.decode("latin-1"), "latin-1"


def parse_text(data: bytes) -> Parsed:
    text, encoding = read_text(data)
    return [(text, None)], {"encoding": encoding}


def parse_csv(data: bytes) -> Parsed:
    text, encoding = read_text(data)
    try:
        dialect: object = csv.Sniffer().sniff(text[:8192], delimiters=",;\t|")
    except csv.Error:
        dialect = csv.excel
    rows = [cells for row in csv.reader(text.splitlines(), dialect) if any(cells := [c.strip() for c in row])]
    if not rows:
        return [("", None)], {"encoding": encoding}
    width = max(map(len, rows))
    names = [(rows[0][i] if i < len(rows[0]) else "") or f"column_{i + 1}" for i in range(width)]
    lines = ["Columns: " + ", ".join(names[: len(rows[0])])]
    lines += [" | ".join(f"{n}: {v}" for n, v in zip(names, row, strict=False) if v) for row in rows[1:]]
    return [("\n".join(lines), None)], {"encoding": encoding, "row_count": len(rows) - 1, "column_count": len(rows[0])}


def leaves(value: object, path: str = "") -> list[str]:
    """One ``path: value`` line for each leaf, in document order."""
    if isinstance(value, dict):
        inner = [(f"{path}.{k}" if path else str(k), v) for k, v in value.items()]
    elif isinstance(value, list):
        inner = [(f"{path}[{i}]", v) for i, v in enumerate(value)]
    else:
        said = value if isinstance(value, str) else json.dumps(value)
        return [f"{path}: {said}" if path else said]
    return [line for p, v in inner for line in leaves(v, p)]


def parse_json(data: bytes) -> Parsed:
    text, encoding = read_text(data)
    return [("\n".join(leaves(json.loads(text))), None)], {"encoding": encoding}


def parse_html(data: bytes) -> Parsed:
    source, encoding = read_text(data)
    text, meta = read_html(source)
    return [(text, None)], meta | {"encoding": encoding}


def parse_markdown(data: bytes) -> Parsed:
    source, encoding = read_text(data)
    meta, body = split_front_matter(source)
    page = render(body)
    if "title" not in meta and (title := first_heading(page)):
        meta["title"] = title
    return [(read_html(page)[0], None)], meta | {"encoding": encoding}


# XML namespaces of the DOCX format.
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_DC = "{http://purl.org/dc/elements/1.1/}"
_TERMS = "{http://purl.org/dc/terms/}"


def _said(node: ElementTree.Element) -> str:
    """A paragraph's text: runs, tabs and breaks."""
    marks = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}
    return "".join((x.text or "") if x.tag == f"{_W}t" else marks.get(x.tag, "") for x in node.iter() if x.tag == f"{_W}t" or x.tag in marks)


def _style_mark(name: str) -> str:
    if name == "Title":
        return "# "
    level = name.removeprefix("Heading ")
    if level != name and level.isdigit():
        return "#" * min(int(level), 6) + " "
    return "- " if name.startswith("List") else ""


def parse_docx(data: bytes) -> Parsed:
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        names = set(archive.namelist())
        tree = lambda n: ElementTree.fromstring(archive.read(n)) if n in names else None
        body, styles, core = tree("word/document.xml").find(f"{_W}body"), tree("word/styles.xml"), tree("docProps/core.xml")
    style_names = {s.get(f"{_W}styleId"): s.find(f"{_W}name").get(f"{_W}val", "") for s in ([] if styles is None else styles.iter(f"{_W}style")) if s.find(f"{_W}name") is not None}
    lines = []
    for block in body:
        if block.tag == f"{_W}p" and _said(block).strip():
            style = block.find(f"{_W}pPr/{_W}pStyle")
            key = "" if style is None else style.get(f"{_W}val", "")
            name = style_names.get(key, re.sub(r"(?<=[a-z])(?=\d)", " ", key))
            lines.append(_style_mark(re.sub(r"^heading ", "Heading ", name)) + _said(block))
        elif block.tag == f"{_W}tbl":
            for row in block.iter(f"{_W}tr"):
                cells = [c for cell in row.findall(f"{_W}tc") if (c := "\n".join(_said(p) for p in cell.findall(f"{_W}p")).strip())]
                if cells:
                    lines.append(" | ".join(c for c, _ in groupby(cells)))
    meta = {}
    if core is not None:
        for key, tag in (("author", f"{_DC}creator"), ("title", f"{_DC}title")):
            if (core.findtext(tag) or "").strip():
                meta[key] = core.findtext(tag).strip()
        if re.match(r"\d{4}-\d{2}-\d{2}", created := core.findtext(f"{_TERMS}created") or ""):
            meta["date"] = created[:10]
    return [("\n".join(lines), None)], meta


_OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\b(.*?)endobj", re.DOTALL)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.DOTALL)
_SHOWN = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|\bT[dDmJj*]\b|\bET\b|['\"]|-?\d+\.?\d*|\[|\]", re.DOTALL)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _pdf_string(raw: bytes) -> str:
    if raw[:1] == b"<":
        digits = re.sub(rb"\s", b"", raw[1:-1])
        data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        data = re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1] in b"01234567" else b"" if m[1][-1:] == b"\n" else _ESCAPES.get(m[1], m[1]), raw[1:-1], flags=re.DOTALL)
    return data.decode("utf-16-be", "replace")[1:] if data[:2] == b"\xfe\xff" else data.decode("cp1252", "replace")


def _pdf_content(stream: bytes) -> str:
    lines: list[str] = [""]
    said: list[str] = []
    for token in _SHOWN.findall(stream):
        if token[:1] in b"(<":
            said.append(_pdf_string(token))
        elif token in (b"Tj", b"TJ", b"'", b'"'):
            lines += [""] if token in b"'\"" and lines[-1] else []
            lines[-1] += "".join(said)
            said = []
        elif token in (b"Td", b"TD", b"T*", b"Tm", b"ET") and lines[-1]:
            lines.append("")
    return "\n".join(lines).strip()


def parse_pdf(data: bytes) -> Parsed:
    """Pages in order. With pypdf installed it does the work; otherwise plain and deflated content streams are read."""
    try:
        import pypdf
    except ImportError:
        return _parse_plain_pdf(data)
    reader = pypdf.PdfReader(io.BytesIO(data))
    if reader.is_encrypted:
        reader.decrypt("")
    meta = {"page_count": len(reader.pages)}
    if reader.metadata and (reader.metadata.author or "").strip():
        meta["author"] = reader.metadata.author.strip()
    try:
        if reader.metadata and reader.metadata.creation_date:
            meta["date"] = reader.metadata.creation_date.date().isoformat()
    except ValueError:
        pass
    return [(page.extract_text() or "", n) for n, page in enumerate(reader.pages, 1)], meta


def _parse_plain_pdf(data: bytes) -> Parsed:
    if b"/Encrypt" in data:
        raise ValueError("encrypted PDF files need pypdf")
    objects = {int(n): body for n, _, body in _OBJECT.findall(data)}
    for body in list(objects.values()):
        if b"/ObjStm" in body and (found := _STREAM.search(body)):
            packed, count = zlib.decompress(found[1]), int(re.search(rb"/N\s+(\d+)", body)[1])
            first, head = int(re.search(rb"/First\s+(\d+)", body)[1]), packed.split()
            places = [(int(head[2 * i]), int(head[2 * i + 1])) for i in range(count)] + [(0, len(packed) - first)]
            objects |= {n: packed[first + a : first + b] for (n, a), (_, b) in zip(places, places[1:], strict=False)}

    def content(body: bytes) -> bytes:
        found = _STREAM.search(body)
        if not found:
            return b""
        return zlib.decompress(found[1]) if b"FlateDecode" in body[: found.start()] else found[1]

    def pages(number: int, seen: frozenset[int] = frozenset()) -> list[int]:
        body = objects.get(number, b"")
        kids = re.search(rb"/Kids\s*\[(.*?)\]", body, re.DOTALL)
        if not kids or number in seen:
            return [number] if re.search(rb"/Type\s*/Page\b", body) else []
        return [p for k in re.findall(rb"(\d+)\s+\d+\s+R", kids[1]) for p in pages(int(k), seen | {number})]

    root = next((int(m[1]) for b in objects.values() if re.search(rb"/Type\s*/Catalog", b) and (m := re.search(rb"/Pages\s+(\d+)", b))), 0)
    order = pages(root) or sorted(n for n, b in objects.items() if re.search(rb"/Type\s*/Page\b", b))
    if not order:
        raise ValueError("no pages were found")
    sections = []
    for n, number in enumerate(order, 1):
        refs = re.search(rb"/Contents\s*(\[.*?\]|\d+\s+\d+\s+R)", objects[number], re.DOTALL)
        streams = [content(objects.get(int(r), b"")) for r in re.findall(rb"(\d+)\s+\d+\s+R", refs[1])] if refs else []
        sections.append((_pdf_content(b"\n".join(streams)), n))
    meta: dict = {"page_count": len(order)}
    info = next((objects.get(int(m[1]), b"") for m in re.finditer(rb"/Info\s+(\d+)\s+\d+\s+R", data)), b"")
    if (found := re.search(rb"/Author\s*(\((?:\\.|[^\\()])*\)|<[^>]*>)", info)) and (author := _pdf_string(found[1]).strip()):
        meta["author"] = author
    if found := re.search(rb"/CreationDate\s*\(D:(\d{4})(\d{2})(\d{2})", info):
        meta["date"] = b"-".join(found.groups()).decode()
    return sections, meta


_parsers: dict[str, Parser] = {"txt": parse_text, "csv": parse_csv, "json": parse_json, "html": parse_html, "markdown": parse_markdown, "docx": parse_docx, "pdf": parse_pdf}


def register_parser(file_type: str, parser: Parser) -> None:
    """Add a parser, or replace one."""
    _parsers[file_type] = parser


def parsers() -> dict[str, Parser]:
    """A copy of the registry, to be sent along with a kernel."""
    return dict(_parsers)
