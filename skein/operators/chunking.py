"""Structure-aware chunking of texts into overlapping, classified pieces.

A text with clear structure is cut at its separators, headings and numbered
titles; any other is packed paragraph by paragraph.  Every chunk carries its
class, confidence and structure markers, and repeats the end of the one before.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .spread import spread

CHUNKS_TYPE = "array<struct<text:string,chunk_type:string,confidence:double,structure_markers:array<string>,has_overlap:boolean>>"
#: Where a structured text may be cut; the boundary itself stays with the text.
BOUNDARIES = [r"\n\s*={3,}\s*\n", r"\n\s*-{3,}\s*\n", r"\n\s*#{1,3}\s+[^#\n]+\n", r"\n\s*\d+\.\s*[A-Z][^\n]{10,}\n", r"\n\s*[A-Z][^.!?\n]{20,}:\s*\n"]
#: Share of structured lines from which a text counts as structured, shortest section, longest paragraph left whole.
CLEAR, SECTION, PARAGRAPH = 0.3, 30, 500

_GROUPS = {name: re.compile("|".join(f"(?:{p})" for p in patterns), re.I | re.M) for name, patterns in tx.STRUCTURE.items()}
_CUT = re.compile("|".join(f"({p})" for p in BOUNDARIES), re.M)
_STEPS = [(re.compile(r"\n\s*\n\s*\n+"), "\n\n"), (re.compile(r"[ \t]+"), " "), (re.compile(r"[^\S\n]{3,}"), " "), (re.compile(r"([.!?])\s*([A-Z])"), r"\1 \2"), (re.compile(r"\n\s*(?:Page|페이지)\s*\d+\s*\n", re.I), "\n"), (re.compile(r"\n+([.,:;!?])"), r"\1")]


def tidy(text: str) -> str:
    for pattern, by in _STEPS:
        text = pattern.sub(by, text)
    return text.strip()


def markers(text: str) -> list[str]:
    return [name for name, pattern in _GROUPS.items() if pattern.search(text)]


def structured(text: str) -> bool:
    lines = [x for x in text.split("\n") if x.strip()]
    return bool(lines) and sum(bool(p.search(x)) for x in lines for p in _GROUPS.values()) > CLEAR * len(lines)


def classify(text: str) -> tuple[str, float]:
    low = text.lower()
    if any(w in low for w in tx.ERROR_WORDS):
        return "error_log", 0.9
    if any(w in low for w in tx.PROCEDURE_WORDS):
        return "procedure", 0.8
    if markers(text):
        return "structured_content", 0.8
    if any(s in text for s in tx.TECHNICAL_SIGNS):
        return "technical_content", 0.7
    return ("summary", 0.6) if len(text.split()) < 50 else ("general_content", 0.5)


def sentences(text: str) -> list[str]:
    found = [s.strip() for s in re.split(r"(?<=[.!?])\s+(?=[A-Z])", text) if len(s.strip()) > 10]
    return found or [text]


def _paragraphs(text: str) -> Iterator[str]:
    for part in filter(None, map(str.strip, text.split("\n\n"))):
        pieces = sentences(part) if len(part) > PARAGRAPH else [part]
        yield from pieces if len(pieces) > 1 else [part]


def pack(text: str, size: int) -> list[tuple[str, list[str]]]:
    """Paragraphs put together while the sum stays within ``size``, with the markers of each."""
    out: list[tuple[str, list[str]]] = []
    body, marks = "", []
    for part in _paragraphs(text):
        if len(body) + len(part) > size:
            if body:
                out.append((body, marks))
            body, marks = part, markers(part)
        else:
            body, marks = f"{body}\n\n{part}" if body else part, [*marks, *markers(part)]
    return [*out, (body, marks)] if body else out


def tail(text: str, size: int) -> str:
    """The end of a text that the next chunk repeats."""
    if len(text) <= size:
        return text
    end = text[-size:]
    stop = max(end.rfind(m) for m in (". ", "! ", "? "))
    for at, skip, least in ((stop, 2, 0.3), (end.rfind("\n\n"), 2, 0.2), (end.rfind(" "), 1, 0.1)):
        if at > least * size:
            return end[at + skip :]
    return end


def chunk_text(text: str | None, size: int = 1000, overlap: int = 200) -> list[dict]:
    """Chunks of one text; none for null and blank texts, one for a short text."""
    if not text or not text.strip():
        return []
    text = tidy(text)
    if len(text) <= size:
        return [{"text": text, "chunk_type": "single_chunk", "confidence": 1.0, "structure_markers": [], "has_overlap": False}]
    if structured(text):
        parts = [s.strip() for s in _CUT.split(text) if s and len(s.strip()) > SECTION] or [text]
        bodies = [b for p in parts for b in ([p] if len(p) <= size else [x for x, _ in pack(p, size)])]
        found = [(b, *classify(b), markers(b)) for b in bodies]
    else:
        found = [(b, "unstructured_content", 0.7, m) for b, m in pack(text, size)]
    out = []
    for k, (body, kind, sure, marks) in enumerate(found):
        more = ""
        if k and overlap > 0:
            before = found[k - 1]
            both = kind == before[1] == "procedure"
            more = tail(before[0], min(int(overlap * 1.5), 300) if both else overlap)
            if more and more in body[: len(more) + 50]:
                more = ""
        out.append({"text": f"{more}\n{body}" if more else body, "chunk_type": kind, "confidence": sure, "structure_markers": marks, "has_overlap": bool(more)})
    return out


def chunk_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 1000, overlap: int = 200) -> DataFrame:
    """``(<key>, chunk_index, chunk_count, text, chunk_type, confidence, structure_markers, has_overlap)``."""
    kind = pa.list_(pa.struct([("text", pa.string()), ("chunk_type", pa.string()), ("confidence", pa.float64()), ("structure_markers", pa.list_(pa.string())), ("has_overlap", pa.bool_())]))

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([chunk_text(t, size, overlap) for t in texts.to_pylist()], kind)

    rows = spread(docs.select(key, text)).select(key, F.arrow_udf(run, CHUNKS_TYPE)(text).alias("_c")).select(key, F.size("_c").alias("chunk_count"), F.posexplode("_c").alias("chunk_index", "_x"))
    return rows.select(key, "chunk_index", "chunk_count", "_x.*")


def chunk_rollup(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document: chunks, classes and markers found, mean confidence."""
    marks = chunks.select(key, F.explode("structure_markers").alias("m")).groupBy(key).agg(F.sort_array(F.collect_set("m")).alias("markers"))
    base = chunks.groupBy(key).agg(F.count("*").alias("chunks"), F.sort_array(F.collect_set("chunk_type")).alias("chunk_types"), F.avg("confidence").alias("avg_confidence"))
    return base.join(marks, key, "left")
