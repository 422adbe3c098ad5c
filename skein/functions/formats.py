"""How texts, results and files are shown, and how their images are read, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as tx

#: Extensions that get a label, and the word behind it.
LABELLED, LABEL = ["xlsx", "xls", "pdf", "docx", "doc", "txt", "log", "html", "kb"], "파일"
#: Phrases before an extracted text that only announce it.
ANNOUNCEMENTS = [
    "Here's the text from the image:", "The text in the image reads:", "The image contains the following text:", "Text extracted from the image:", "The text visible in the image is:", "I can see the following text in the image:",
    "Text content:", "Extracted text:", "The text says:", "Here is the text in the image:", "The image shows:", "Here is the exact text from the image:",
]
#: Words that tell what the images of a file show, by file type, the first that fits.
CONTEXTS = {
    "pdf": [("handwritten", ["handwritten", "손글씨", "필기", "note"]), ("error_message", ["error", "exception", "traceback"]), ("diagram", ["diagram", "figure", "chart"]), ("korean_text", ["한글", "한국어"])],
    "docx": [("handwritten", ["handwritten", "손글씨", "필기", "note", "signature"]), ("error_message", ["error", "exception", "traceback", "오류"]), ("diagram", ["diagram", "figure", "chart", "도표", "그림"]), ("screenshot", ["screenshot", "스크린샷", "capture"]), ("korean_text", ["한글", "한국어", "가나다"])],
    "html": [("handwritten", ["handwritten", "손글씨", "signature", "note"]), ("error_message", ["error", "exception", "traceback", "오류"]), ("screenshot", ["screenshot", "스크린샷", "capture"]), ("diagram", ["diagram", "chart", "도표", "graph"]), ("korean_text", ["한글", "한국어", "korean"])],
}
#: Below how many characters (or units: characters a page, slide or sheet; images for HTML) a file's images are read in a mode.
STRATEGIES = {
    "docx": [("full", 500, None), ("selective", 2000, None), ("minimal", 5000, None)],
    "xlsx": [("selective", 200, None), ("minimal", 1000, None)],
    "pptx": [("full", 500, None), ("selective", 2000, 200), ("minimal", 5000, None)],
    "pdf": [("full_legacy", 100, None), ("full_smart", 500, None), ("selective", 3000, 500), ("minimal", 8000, None)],
    "html": [("full", 200, None), ("selective", 1000, None), ("minimal", 3000, None)],
}
HTML_IMAGES = 3


def truncated(text: Column, most: int = 500) -> Column:
    """A text cut to ``most`` characters, with dots where something is left out."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def file_label(name: Column, kind: Column | None = None) -> Column:
    """The file type, or of a name without one its extension in capitals as a label; empty if it has none that is known."""
    ext = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    label = F.when(ext.isin(*LABELLED), F.concat(F.upper(ext), F.lit(f" {LABEL}"))).otherwise(F.lit(""))
    return label if kind is None else F.when(F.coalesce(kind, F.lit("")) != "", kind).otherwise(label)


def web_results(results: Column) -> Column:
    """Results ``(url, title, content)`` as one text."""
    one = lambda r: F.concat(F.lit("SOURCE: "), F.coalesce(r["url"], F.lit("Unknown source")), F.lit("\nTITLE: "), F.coalesce(r["title"], F.lit("No title")), F.lit("\nCONTENT: "), F.coalesce(r["content"], F.lit("No content")))
    return F.when(F.coalesce(F.size(results), F.lit(0)) < 1, F.lit("No relevant information found on the web.")).otherwise(F.array_join(F.transform(results, one), "\n\n"))


def image_context(text: Column, kind: str) -> Column:
    """What the images of a file show, told by words of its text; ``general`` if none fits, and for null."""
    low = F.lower(text)
    out = F.lit("general")
    for name, words in reversed(CONTEXTS[kind]):
        out = F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)), F.lit(name)).otherwise(out)
    return F.when(text.isNull(), F.lit("general")).otherwise(out)


def strategy(kind: Column, chars: Column, units: Column) -> Column:
    """How thoroughly the images of a file are read, by its type: ``skip`` for long texts and unlisted types."""
    density = chars / F.nullif(units, F.lit(0))
    out = F.lit("skip")
    for name, steps in STRATEGIES.items():
        one = F.lit("skip")
        for mode, below, dense in reversed(steps):
            fits = chars < below
            if dense is not None:
                fits = fits | (F.coalesce(density, F.lit(0.0)) < dense)
            if name == "html" and mode == "selective":
                fits = fits | (units > HTML_IMAGES)
            one = F.when(fits, F.lit(mode)).otherwise(one)
        out = F.when(kind == name, one).otherwise(out)
    return out


def meaningful_words(text: Column, least: float = 0.3) -> Column:
    """Recognised text without single characters (digits, ``a`` and ``I`` stay); empty if too little of it is letters and digits, and for null."""
    words = F.filter(F.split(tx.squeeze(text), " "), lambda w: (F.length(w) > 1) | w.rlike(r"^(\p{Nd}|a|I)$"))
    kept = F.array_join(words, " ")
    solid = F.length(F.regexp_replace(kept, r"[^\p{L}\p{N}]", ""))
    return F.coalesce(F.when(solid < least * F.length(kept), F.lit("")).otherwise(kept), F.lit(""))


def readable_lines(text: Column) -> Column:
    """Recognised text without blank lines and lines of signs, with characters that are often misread put right; empty for null.

    The digit 0 becomes the letter O everywhere, so numbers are lost; use it where there are none.
    """
    lines = F.filter(F.split(text, "\n"), lambda x: ~x.rlike(r"^[ .\-=_|\s]*$"))
    out = F.array_join(lines, "\n")
    for seen, meant in (("|", "I"), ("1l", "II"), ("0", "O"), ("《", "<"), ("》", ">")):
        out = F.replace(out, F.lit(seen), F.lit(meant))
    return F.coalesce(out, F.lit(""))


def screenshot_line(text: Column, table: bool) -> Column:
    """Recognised text of a screenshot on one line; of a table, nothing if it is only rules.  Empty for null."""
    line = tx.squeeze(text)
    return F.coalesce(F.when(F.lit(table) & line.rlike(r"^[-+|]*$"), F.lit("")).otherwise(line), F.lit(""))


def announced(text: Column) -> Column:
    """A model's answer without phrases that announce it."""
    out = text
    for phrase in ANNOUNCEMENTS:
        out = F.regexp_replace(out, rf"(?i)^\Q{phrase}\E\s*", "")
    return out


def document_lines(text: Column) -> Column:
    """Lines of a document: control signs gone, list items indented, ``key: value`` evenly spaced, one blank line in a row.  Empty for null."""

    def one(line: Column) -> Column:
        plain = F.trim(F.regexp_replace(line, r"[\x00-\x09\x0B-\x1F\x7F-\xFF]", ""))
        item = plain.rlike(r"^([1-4]\.|->|-|ㅇ)")
        pair = F.concat(F.trim(F.substring_index(plain, ":", 1)), F.lit(": "), F.trim(F.substring(plain, F.instr(plain, ":") + 1, F.length(plain))))
        return F.when(item, F.concat(F.lit("    "), plain)).when(F.contains(plain, F.lit(":")), pair).otherwise(plain)

    joined = F.array_join(F.transform(F.split(text, r"\r\n|\r|\n"), one), "\n")
    return F.coalesce(F.regexp_replace(F.regexp_replace(F.regexp_replace(joined, r"\n{3,}", "\n\n"), r"^\n+", "\n"), r"\n+$", "\n"), F.lit(""))


def misread_signs(text: Column) -> Column:
    """Extracted text with blank lines gone, blanks outside Hangul single, and signs that are often misread put right, step by step."""
    steps = [(r"\n\s*\n", "\n"), (r"(?<![가-힣])\s{2,}(?![가-힣])", " "), ("0l|Ol", "01"), ('[“”"]', '"'), ("[‘’']", "'"), ("1l", "11"), (r"(?<!\d)1(?!\d)", "I"), ("rn|m", "m"), (r"(?<=\d)O|o(?=\d)", "0")]
    out = text
    for pattern, by in steps:
        out = F.regexp_replace(out, F.lit(pattern), F.lit(by))
    return F.btrim(out, F.lit(" \t\n\r"))


def embeddable(cleaned: Column, least: int = 10) -> Column:
    """Whether a cleaned text is long enough to get a vector."""
    return F.coalesce(F.length(F.trim(cleaned)) >= least, F.lit(False))


def shown_tokens(tokens: Column, hidden: tuple[str, ...] = ("<think>", "###")) -> Column:
    """Tokens of an answer without empty ones and those with marks that are not shown."""
    return F.filter(tokens, lambda t: (t != "") & ~F.exists(F.array(*map(F.lit, hidden)), lambda h: F.contains(t, h)))


#: How a text names a status code.
CODE_PHRASES = ["Status Code ", "Status Code: ", "Code ", "ErrorCode "]


def mentions_code(text: Column, code: Column) -> Column:
    """Whether a text names a status code in one of ``CODE_PHRASES``."""
    return F.coalesce(F.exists(F.array(*map(F.lit, CODE_PHRASES)), lambda p: F.contains(text, F.concat(p, code))), F.lit(False))
