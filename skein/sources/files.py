"""Text of files: plain text, RTF, HTML, word-processing, spreadsheet, presentation and mail files.

Files are read with ``binaryFile``; each row keeps its path and an ``error`` where
nothing could be read, so no file is dropped.  Formats that need an outside
program (PDF, HWP streams, images) take a function as a plug-in.
"""

from __future__ import annotations

import email
import email.policy
import io
import re
import struct
import zipfile
import zlib
from collections.abc import Callable
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import filetypes

#: Encodings tried in order.
ENCODINGS = ["utf-8-sig", "cp949", "cp1252", "latin-1"]
#: Largest file that is read, in bytes, and most bytes that a part of an archive may unpack to.
MOST_BYTES, MOST_UNPACKED = 104_857_600, 1 << 30
OUT = "struct<text:string,tables:array<array<array<string>>>,error:string>"
Extracted = tuple[str, list[list[list[str]]]]


def decode(raw: bytes) -> str:
    """Text of any encoding: by its mark, else the first encoding that fits."""
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return raw.decode("utf-16", "replace")
    for name in ENCODINGS:
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            continue
    return raw.decode("utf-8", "replace")


def _local(node: ElementTree.Element) -> str:
    return node.tag.rpartition("}")[2]


def _part(archive: zipfile.ZipFile, name: str) -> ElementTree.Element:
    if archive.getinfo(name).file_size > MOST_UNPACKED:
        raise ValueError(f"{name} unpacks to more than {MOST_UNPACKED} bytes")
    return ElementTree.fromstring(archive.read(name))


def _said(node: ElementTree.Element) -> str:
    return "".join(x.text or "" if _local(x) == "t" else "\t" if _local(x) == "tab" else "" for x in node.iter())


def word_file(raw: bytes) -> Extracted:
    """Paragraphs, and tables as rows joined by bars."""
    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
        body = next(x for x in _part(archive, "word/document.xml") if _local(x) == "body")
    lines, tables = [], []
    for node in body:
        if _local(node) == "p":
            said = _said(node).strip()
            if said:
                listed = any(_local(x) == "numPr" for x in node.iter())
                lines.append(f"• {said}" if listed else said)
        elif _local(node) == "tbl":
            rows = [[" ".join(_said(p) for p in cell.iter() if _local(p) == "p").strip() for cell in row if _local(cell) == "tc"] for row in node if _local(row) == "tr"]
            tables.append(rows)
            lines += ["=== TABLE ===", *(" | ".join(r) for r in rows)]
    return "\n".join(lines), tables


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return max(0, n - 1)


def sheet_file(raw: bytes) -> Extracted:
    """Sheets by name, the cells of a row that hold something joined by tabs."""
    lines, tables = [], []
    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
        names = archive.namelist()
        shared = [_said(x) for x in _part(archive, "xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in names else []
        book = _part(archive, "xl/workbook.xml")
        links = {x.get("Id"): x.get("Target", "") for x in _part(archive, "xl/_rels/workbook.xml.rels")} if "xl/_rels/workbook.xml.rels" in names else {}
        sheets = [(x.get("name", ""), next((v for k, v in x.attrib.items() if k.endswith("}id")), None)) for x in book.iter() if _local(x) == "sheet"]
        for at, (name, link) in enumerate(sheets, 1):
            path = "xl/" + links.get(link, f"worksheets/sheet{at}.xml").lstrip("/").removeprefix("xl/")
            if path not in names:
                continue
            rows: list[list[str]] = []
            for row in (x for x in _part(archive, path).iter() if _local(x) == "row"):
                cells: list[str] = []
                for cell in (x for x in row if _local(x) == "c"):
                    value = next((x.text or "" for x in cell if _local(x) == "v"), "")
                    kind = cell.get("t", "")
                    said = shared[int(value)] if kind == "s" and value else _said(cell) if kind == "inlineStr" else value
                    place = _column(cell.get("r", "")) if cell.get("r") else len(cells)
                    cells += [""] * (min(place, 16_383) + 1 - len(cells))
                    cells[place] = said
                if any(cells):
                    rows.append(cells)
            lines += [f"=== Sheet: {name} ===", *("\t".join(c for c in r if c) for r in rows)]
            if rows:
                tables.append(rows)
    return "\n".join(lines), tables


def slide_file(raw: bytes) -> Extracted:
    """Slides in order, a line for each paragraph."""
    lines, tables = [], []
    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
        found = sorted((int(m[1]), n) for n in archive.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        for number, name in found:
            slide = _part(archive, name)
            lines.append(f"=== Slide {number} ===")
            lines += [s for p in slide.iter() if _local(p) == "p" and (s := _said(p).strip())]
            tables += [[[_said(c).strip() for c in r if _local(c) == "tc"] for r in t if _local(r) == "tr"] for t in slide.iter() if _local(t) == "tbl"]
    return "\n".join(lines), tables


def rtf_file(raw: bytes) -> Extracted:
    text = re.sub(r"\\[a-z]+\d*\s?", " ", raw.decode("latin-1"))
    text = re.sub(r"[{}]", "", re.sub(r"\\[^a-z\s]", "", text))
    return " ".join(text.split()).replace("\\", ""), []


def html_file(raw: bytes) -> Extracted:
    """One line per block element, and the tables of the page."""
    from html.parser import HTMLParser

    blocks = {"p", "div", "li", "ul", "ol", "tr", "table", "br", "section", "article", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "title"}

    class Reader(HTMLParser):
        def __init__(self) -> None:
            super().__init__()
            self.lines, self.line, self.mute, self.tables, self.open = [], [], 0, [], []

        def end_line(self) -> None:
            said = " ".join("".join(self.line).split())
            self.lines += [said] if said else []
            self.line = []

        def handle_starttag(self, tag, attrs) -> None:
            self.mute += tag in ("script", "style")
            if tag in blocks:
                self.end_line()
            if tag == "table":
                self.tables.append([])
                self.open.append(self.tables[-1])
            elif tag == "tr" and self.open:
                self.open[-1].append([])
            elif tag in ("td", "th") and self.open and self.open[-1]:
                self.open[-1][-1].append("")
                self.line.append(" ")

        def handle_endtag(self, tag) -> None:
            self.mute -= tag in ("script", "style") and self.mute > 0
            if tag in blocks:
                self.end_line()
            if tag == "table" and self.open:
                self.open.pop()

        def handle_data(self, data) -> None:
            if not self.mute:
                self.line.append(data)
                if self.open and self.open[-1] and self.open[-1][-1]:
                    self.open[-1][-1][-1] = " ".join((self.open[-1][-1][-1] + " " + data).split())

    reader = Reader()
    reader.feed(decode(raw))
    reader.close()
    reader.end_line()
    return "\n".join(reader.lines), reader.tables


def mail_file(raw: bytes) -> Extracted:
    """Subject, plain body (else the HTML one) and the text of attachments that can be read."""
    message = email.message_from_bytes(raw, policy=email.policy.default)
    body = message.get_body(("plain", "html"))
    lines = [str(message["subject"])] if message["subject"] else []
    tables: list[list[list[str]]] = []
    if body is not None:
        said = body.get_content()
        lines.append(html_file(said.encode())[0] if body.get_content_type() == "text/html" else said.strip())
    for part in message.iter_attachments():
        name, data = part.get_filename() or "", part.get_payload(decode=True) or b""
        reader = READERS.get(name.rpartition(".")[2].lower())
        lines.append(f"=== Attachment: {name} ===")
        if reader:
            text, more = reader(data)
            lines.append(text)
            tables += more
        else:
            lines.append("[unsupported attachment]")
    return "\n".join(lines), tables


def hwp_section(raw: bytes) -> str:
    """Text records (type 67) of a body section stream, packed by raw deflate or not."""
    try:
        raw = zlib.decompressobj(-15).decompress(raw, MOST_UNPACKED)
    except zlib.error:
        pass
    out, at = [], 0
    while at + 4 <= len(raw):
        head = struct.unpack_from("<I", raw, at)[0]
        kind, size = head & 0x3FF, head >> 20 & 0xFFF
        at += 4
        if size == 0xFFF and at + 4 <= len(raw):
            size = struct.unpack_from("<I", raw, at)[0]
            at += 4
        if kind == 67:
            said = raw[at : at + size].decode("utf-16-le", "ignore")
            out.append("".join(c for c in said if c in "\n\t" or c >= " "))
        at += size
    return "\n".join(x for x in out if x.strip())


READERS: dict[str, Callable[[bytes], Extracted]] = {
    **dict.fromkeys(("txt", "md", "csv", "log", "conf", "ini", "cfg"), lambda raw: (decode(raw), [])),
    "rtf": rtf_file, "html": html_file, "htm": html_file, "docx": word_file, "xlsx": sheet_file, "xlsm": sheet_file, "pptx": slide_file, "ppsx": slide_file, "eml": mail_file, "hwpsection": lambda raw: (hwp_section(raw), []),
}


def extract(raw: bytes | None, name: str, plugins: dict[str, Callable[[bytes], Extracted]] | None = None) -> dict:
    """``{text, tables, error}`` of a file; an error instead of a text where it cannot be read."""
    ext = name.split("?")[0].rpartition(".")[2].lower()
    reader = (plugins or {}).get(ext) or READERS.get(ext)
    if raw is None:
        return {"text": None, "tables": [], "error": "no content"}
    if len(raw) > MOST_BYTES:
        return {"text": None, "tables": [], "error": "too large"}
    if reader is None:
        return {"text": None, "tables": [], "error": f"unsupported type {ext}"}
    try:
        text, tables = reader(raw)
        return {"text": text, "tables": tables, "error": None}
    except Exception as problem:  # a broken file is a row with an error, never a failed job
        return {"text": None, "tables": [], "error": f"{type(problem).__name__}: {problem}"[:300]}


def read_files(spark: SparkSession, path: str, glob: str = "*", plugins: dict[str, Callable[[bytes], Extracted]] | None = None) -> DataFrame:
    """``(path, length, modificationTime, file_type, text, tables, error)`` of all files below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return with_text(files, plugins=plugins).drop("content")


def with_text(files: DataFrame, name: str = "path", content: str = "content", plugins: dict[str, Callable[[bytes], Extracted]] | None = None) -> DataFrame:
    kind = pa.struct([("text", pa.string()), ("tables", pa.list_(pa.list_(pa.list_(pa.string())))), ("error", pa.string())])

    def run(contents: pa.Array, names: pa.Array) -> pa.Array:
        return pa.array([extract(c, n or "", plugins) for c, n in zip(contents.to_pylist(), names.to_pylist())], kind)

    plain = files.drop("text", "tables", "error", "file_type")
    rows = plain.withColumn("_x", F.arrow_udf(run, OUT)(content, name)).withColumn("file_type", filetypes.type_by_extension(F.col(name)))
    return rows.select(*plain.columns, "file_type", "_x.*")
