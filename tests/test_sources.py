"""Files to documents: parsers, and a folder end to end."""

from __future__ import annotations

import io
import json
import zipfile
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillspark.sources import files
from quillspark.sources import parsers as P
from quillspark.sources.files import ingest, load_questions, supported_extensions


def pdf(pages: list[str], pack: bool = False) -> bytes:
    body = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [%s] /Count %d >>" % (b" ".join(b"%d 0 R" % (3 + 2 * i) for i in range(len(pages))), len(pages))]
    for i, text in enumerate(pages):
        stream = b"BT /F1 12 Tf 72 700 Td (%s) Tj ET" % text.replace("(", r"\(").replace(")", r"\)").encode()
        data = zlib.compress(stream) if pack else stream
        body += [b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (4 + 2 * i), b"<< /Length %d%s >>\nstream\n%s\nendstream" % (len(data), b" /Filter /FlateDecode" if pack else b"", data)]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, b) for n, b in enumerate(body, 1)) + b"trailer << /Root 1 0 R >>\n"


def docx() -> bytes:
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    para = lambda t, s="": f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{s}{chr(34)}/></w:pPr>" if s else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    cell = lambda t: f"<w:tc>{para(t)}</w:tc>"
    body = para("Plan", "Heading1") + para("Sow early.") + f"<w:tbl><w:tr>{cell('a')}{cell('a')}{cell('b')}</w:tr></w:tbl>" + para("weed", "ListBullet") + para(" ")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
        z.writestr("word/styles.xml", f'<w:styles xmlns:w="{w}"><w:style w:styleId="Heading1"><w:name w:val="heading 1"/></w:style><w:style w:styleId="ListBullet"><w:name w:val="List Bullet"/></w:style></w:styles>')
        z.writestr("docProps/core.xml", '<c xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:t="http://purl.org/dc/terms/"><dc:creator> Ann </dc:creator><t:created>2024-05-06T07:08:09Z</t:created></c>')
    return out.getvalue()


def test_encodings():
    assert P.read_text("é".encode()) == ("é", "utf-8")
    assert P.read_text("﻿é".encode()) == ("é", "utf-8-sig")
    assert P.read_text("é".encode("utf-16"))[0] == "é"
    assert P.read_text(b"\x93a\x94") == ("“a”", "cp1252")
    assert P.read_text(b"\x81")[1] == "latin-1"


def test_csv():
    text, meta = P.parse_csv(b"name;size;\nbean;\"2\";x;extra\n;;\npea;;\n")
    assert text[0][0] == "Columns: name, size, column_3\nname: bean | size: 2 | column_3: x | column_4: extra\nname: pea"
    assert (meta["row_count"], meta["column_count"]) == (2, 3)
    assert P.parse_csv(b"\n") == ([("", None)], {"encoding": "utf-8"})


def test_json():
    text, _ = P.parse_json(b'{"a": {"b": [1, null, true, "x"]}, "c": {}, "d": 1.5}')
    assert text[0][0].split("\n") == ["a.b[0]: 1", "a.b[1]: null", "a.b[2]: true", "a.b[3]: x", "d: 1.5"]
    assert P.parse_json(b'"top"')[0][0][0] == "top"


def test_html():
    page = '<html><head><title> T </title><meta name="author" content="A"><meta name="author" content="B"><meta property="article:published_time" content="2024-01-02T03"><style>p{}</style></head><body><h2>Hi</h2><p>One<br>two &amp; three</p><ul><li>a<li><p>b</p></li></ul><table><tr>\n<th>x</th>\n<th>y</th>\n</tr></table><pre>code</pre><script>"</p>"</script></body></html>'
    text, meta = P.parse_html(page.encode())
    assert text[0][0].split("\n") == ["## Hi", "One", "two & three", "- a", "- b", "x | y", "```", "code", "```"]
    assert meta == {"title": "T", "author": "B", "date": "2024-01-02", "encoding": "utf-8"}


def test_markdown():
    source = "---\ntitle: 'Beds'\ndate: 2024-02-03 x\nother: y\n---\n# Head *one*\n\nSome **bold** [link](http://a.b) and `code`.\n\n- one\n- two\n\n1. first\n\n2. second\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n```\nx = 1\n```\n"
    text, meta = P.parse_markdown(source.encode())
    assert text[0][0].split("\n") == ["# Head one", "Some bold link and code.", "- one", "- two", "- first", "- second", "a | b", "1 | 2", "```", "x = 1", "```"]
    assert meta["title"] == "Beds" and meta["date"] == "2024-02-03"
    assert P.parse_markdown(b"# Only\n")[1]["title"] == "Only"


def test_docx_and_pdf():
    text, meta = P.parse_docx(docx())
    assert text[0][0].split("\n") == ["# Plan", "Sow early.", "a | b", "- weed"]
    assert meta == {"author": "Ann", "date": "2024-05-06"}
    for pack in (False, True):
        sections, meta = P.parse_pdf(pdf(["First (page)", "", "Third"], pack))
        assert [s for s, _ in sections] == ["First (page)", "", "Third"] and [n for _, n in sections] == [1, 2, 3]
        assert meta["page_count"] == 3


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("files")
    (top / "a.txt").write_bytes(b"Plain\r\n  text\x07")
    (top / "b.md").write_text("# Soil\n\nLoam drains well.")
    (top / "c.pdf").write_bytes(pdf(["One", "", "Three"]))
    (top / "d.docx").write_bytes(docx())
    (top / "empty.txt").write_bytes(b"")
    (top / "big.txt").write_bytes(b"x" * 5000)
    (top / "bad.pdf").write_bytes(b"nothing")
    (top / "nul.txt").write_bytes(b"a\x00b")
    (top / "odd.xyz").write_bytes(b"?")
    (top / "broken.json").write_bytes(b"{")
    (top / ".hidden.txt").write_bytes(b"no")
    (top / "a.meta.json").write_text(json.dumps({"department": "HR", "title": "Side", "tenant_id": "t1"}))
    (top / "b.meta.json").write_text(json.dumps({"colour": "red"}))
    (top / "sub").mkdir()
    (top / "sub" / "z.txt").write_text("inner")
    return str(top)


def test_ingest(spark, folder):
    documents, log = ingest(spark, folder, max_bytes=4000)
    docs = {(r.filename, r.page): r for r in documents.collect()}
    assert set(docs) == {("a.txt", None), ("c.pdf", 1), ("c.pdf", 3), ("d.docx", None)}
    assert docs["a.txt", None].text == "Plain\n text"
    assert (docs["a.txt", None].department, docs["a.txt", None].title, docs["a.txt", None].tenant_id) == ("HR", "Side", "t1")
    assert docs["c.pdf", 3].document_id.endswith("-3") and docs["c.pdf", 3].page_count == 3
    errors = {r.name: r.error for r in log.collect()}
    assert errors["a.txt"] is None and errors["empty.txt"] == "empty.txt is empty."
    assert "not a valid PDF" in errors["bad.pdf"] and "binary" in errors["nul.txt"] and "Unsupported" in errors["odd.xyz"]
    assert "limit is 0.0 MB" in errors["big.txt"] and "Could not read broken.json" in errors["broken.json"] and "colour" in errors["b.md"]
    assert ".hidden.txt" not in errors and "z.txt" not in errors and "a.meta.json" not in errors
    assert len(supported_extensions()) == 10


def test_names_with_an_underscore(spark, folder, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "COPY_BYTES", 8)  # several blocks
    for name in ("a.txt", "b.md", "big.txt", "empty.txt", "nul.txt", "a.meta.json", "b.meta.json"):
        (tmp_path / f"_{name}").write_bytes(Path(folder, name).read_bytes())
    (tmp_path / "plain.txt").write_text("Seen by Spark")
    documents, log = ingest(spark, str(tmp_path), max_bytes=4000)
    assert {(r.filename, r.text, r.department, r.tenant_id) for r in documents.collect()} == {("plain.txt", "Seen by Spark", None, None), ("_a.txt", "Plain\n text", "HR", "t1")}
    errors = {r.name: r.error for r in log.collect()}
    assert set(errors) == {"plain.txt", "_a.txt", "_b.md", "_big.txt", "_empty.txt", "_nul.txt"} and errors["_a.txt"] is None
    assert "colour" in errors["_b.md"] and "limit" in errors["_big.txt"] and errors["_empty.txt"] == "_empty.txt is empty." and "binary" in errors["_nul.txt"]


def test_questions(spark, tmp_path):
    path = tmp_path / "q.json"
    path.write_text(json.dumps({"questions": [{"id": "q1", "question": "?", "document": "a.txt", "evidence": ["x", "y"]}]}))
    assert load_questions(spark, str(path)).count() == 2
    path.write_text(json.dumps({"questions": [{"id": "q1", "question": "?", "document": "a", "evidence": ["x"]}] * 2}))
    with pytest.raises(ValueError, match="twice"):
        load_questions(spark, str(path))


def test_sizes_are_printed_as_c_prints_them(spark):
    """31.25 MB is 31.2 and 31.75 MB is 31.8: halves of a tenth go to the even digit."""
    sizes = [0, 1, 5_000_001, 8192 * 4000, 8323 * 4000, *(round(m * 1_048_576) for m in (4.9499, 6.25, 6.75, 9.95, 9.96875, 99.984375, 123456.75))]
    rows = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", files.size_error(F.lit("f"), F.col("n"), 5_000_000).alias("e")).collect()
    assert {r.n: r.e for r in rows} == {n: "f is empty." if n == 0 else f"f is {n / 1_048_576:.1f} MB; the limit is 4.8 MB." if n > 5_000_000 else None for n in sizes}
