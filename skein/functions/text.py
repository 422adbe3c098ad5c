"""Text rules as column expressions.  A null text gives null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that a short query is cleaned of, common words that are no term, and openings of a question.
BASIC_STOPS = ["a", "an", "the", "is", "are", "was", "were"]
COMMON_WORDS = ["this", "that", "with", "from", "they", "have", "been", "will", "are", "was", "were"]
OPENINGS = r"(?i)^(what is|what are|how do|how to|explain|tell me|can you)\s+"
#: Keywords of the chunk classes, in order of precedence.
ERROR_WORDS = ["error", "exception", "failed", "warning", "오류", "실패"]
PROCEDURE_WORDS = ["step", "procedure", "install", "configure", "단계", "절차"]
TECHNICAL_SIGNS = ["|", "---", "===", "```"]
#: Patterns of structure, by group; a line counts once for each group that it matches.
STRUCTURE = {
    "table_like": [r"^\s*\|.*\|\s*$", r"^\s*[\d\w]+\s+[\d\w]+\s+[\d\w]+.*$", r"^\s*[-=]{3,}\s*$"],
    "list_items": [r"^\s*[•·▪▫◦‣⁃]\s+", r"^\s*[\da-zA-Z][\.\)]\s+", r"^\s*[-*+]\s+"],
    "headers": [r"^\s*#{1,6}\s+.*$", r"^\s*[A-Z][^.!?]*:?\s*$", r"^\s*\d+\.?\s*[A-Z][^.]*$"],
    "code_or_technical": [r"[{}()\[\]<>]", r"[=:]{2,}", r"\b(function|class|def|var|int|string)\b"],
    "metadata_lines": [r"^\s*(Page|페이지)\s*\d+", r"^\s*(Date|날짜|작성일)[:：]\s*", r"^\s*(File|파일|문서)[:：]\s*"],
}
#: Python's blanks, which Java's ``\s`` leaves out in part.
BLANK = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{85}\x{1C}-\x{1F}]"


def _sub(text: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(text, F.lit(pattern), F.lit(by))


def squeeze(text: Column) -> Column:
    """Blanks of any kind and number become one space; none is left at the ends."""
    return F.trim(_sub(text, BLANK + "+", " "))


def clean_text(text: Column) -> Column:
    """Plain printable ASCII on one line; empty for page and image markers, and for null."""
    plain = squeeze(_sub(_sub(text, "—", "-"), "•", "*"))
    marker = text.startswith("=== Page") | text.startswith("Image ")
    return F.when(text.isNull() | marker, F.lit("")).otherwise(_sub(plain, r"[^\x20-\x7E]", ""))


def clean_for_embedding(text: Column, aggressive: bool = False, most: int = 6000) -> Column:
    """Text as it is embedded; ``aggressive`` also drops options, paths, versions and brackets. Null gives empty."""
    out = text
    for sign, by in (("—", "-"), ("•", "*"), ("…", "...")):
        out = F.replace(out, F.lit(sign), F.lit(by))
    for marker in (r"===\s*Page\s+\d+\s*===", r"===\s*IMAGE TEXTS\s*===", r"Image\s+\d+:"):
        out = _sub(out, marker, " ")
    out = squeeze(_sub(_sub(out, r"[^\x20-\x7E\n]", ""), r"\n+", " "))
    if aggressive:
        for pattern in (r"-\w+\s+[\w\-_]+", r"\[\w+[\]\:]", r"/\w+", r"\|\s*\w+", r"\w+\.\w+\.\w+", r"\([^)]*\)"):
            out = _sub(out, pattern, " ")
        out = _sub(_sub(out, "mm/dd/yyyy", "date"), "hh:mm:ss", "time")
        out = F.substring(squeeze(_sub(out, r"[^\w\s.,;:?!]", " ")), 1, most)
    return F.coalesce(F.trim(out), F.lit(""))


def preprocess(text: Column) -> Column:
    """At most one blank line in a row, single spaces, no page marks, no line break before a sign."""
    out = _sub(text, r"\n\s*\n\s*\n+", "\n\n")
    out = _sub(_sub(out, r"[ \t]+", " "), r"[^\S\n]{3,}", " ")
    out = _sub(out, r"([.!?])\s*([A-Z])", "$1 $2")
    out = _sub(out, r"(?i)\n\s*(Page|페이지)\s*\d+\s*\n", "\n")
    return F.btrim(_sub(out, r"\n+([.,:;!?])", "$1"), F.lit(" \t\n\r"))


def strip_page_lines(text: Column) -> Column:
    """Text without the lines that only say ``Page n``."""
    return _sub(text, r"(?m)^\s*Page\s+\d+\s*$", "")


def join_hyphens(text: Column) -> Column:
    return _sub(text, r"(?U)(\w)-\s+(\w)", "$1$2")


def join_lines(text: Column) -> Column:
    """Single line breaks become spaces; blank lines stay."""
    return _sub(text, r"(?<!\n)\n(?!\n)", " ")


def rtf_plain(text: Column) -> Column:
    """RTF without control words, control symbols, braces and backslashes."""
    out = _sub(_sub(text, r"\\[a-z]+\d*\s?", " "), r"\\[^a-z\s]", "")
    return F.trim(F.replace(squeeze(_sub(out, r"[{}]", "")), F.lit("\\"), F.lit("")))


def collapse_repeats(text: Column) -> Column:
    """A word said several times in a row is said once."""
    return _sub(text, r"(?U)(\b\w+\b)(\s+\1\b)+", "$1")


def split_sentences(text: Column, shortest: int = 11) -> Column:
    """Sentences of at least ``shortest`` characters; the whole text if there is none."""
    parts = F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+(?=[A-Z])"), F.trim), lambda s: F.length(s) >= shortest)
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(text))


def for_analysis(text: Column, most_words: int = 1000, most_chars: int = 5000) -> Column:
    """Words of two characters and more that are no number and hold only letters, digits, ``_ . -``; tags go."""
    words = F.slice(F.split(squeeze(_sub(text, "<[^>]+>", " ")), " "), 1, most_words)
    kept = F.filter(words, lambda w: (F.length(w) >= 2) & ~w.rlike(r"^\d+$") & w.rlike("^[a-zA-Z가-힣0-9_.-]+$"))
    return F.coalesce(F.substring(F.array_join(kept, " "), 1, most_chars), F.lit(""))


def clean_query(query: Column) -> Column:
    """A query of more than three words without the commonest ones, if others are left."""
    words = F.split(squeeze(query), " ")
    kept = F.filter(words, lambda w: ~F.lower(w).isin(*BASIC_STOPS))
    return F.when((F.size(words) > 3) & (F.size(kept) > 0), F.array_join(kept, " ")).otherwise(squeeze(query))


def title(query: Column, most: int = 50) -> Column:
    """A title made of a query: no opening question word, cut at a word, first letter large."""
    body = _sub(F.trim(query), OPENINGS, "")
    cut = F.substring(body, 1, most)
    short = F.when(F.length(body) > most, F.concat(_sub(cut, r" [^ ]*$", ""), F.lit("..."))).otherwise(body)
    return F.when(F.coalesce(F.length(body), F.lit(0)) == 0, F.lit("New Chat")).otherwise(F.concat(F.upper(F.substring(short, 1, 1)), F.substring(short, 2, most + 3)))


def snippet(text: Column, query: Column, most: int = 500, before: int = 200, after: int = 300) -> Column:
    """The surroundings of the first query word, cut at spaces, with dots where text is left out."""
    head = F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)
    low = F.lower(text)
    terms = F.filter(F.split(F.lower(squeeze(query)), " "), lambda t: t != "")
    pos = F.array_min(F.filter(F.transform(terms, lambda t: F.instr(low, t) - 1), lambda p: p >= 0))
    start = F.greatest(F.lit(0), pos - before)
    left = F.substring(text, F.lit(1), start)
    last_blank = F.length(left) - F.instr(F.reverse(left), " ") + 1
    start = F.when((start > 0) & (F.instr(left, " ") > 0), last_blank).otherwise(start)
    end = F.least(F.length(text), pos + after)
    next_blank = F.locate(" ", F.substring(text, end + 1, F.length(text)))
    end = F.when((end < F.length(text)) & (next_blank > 0), end + next_blank - 1).otherwise(end)
    body = F.substring(text, start + 1, end - start)
    dots = lambda c: F.when(c, F.lit("...")).otherwise(F.lit(""))
    return F.when(pos.isNull(), head).otherwise(F.concat(dots(start > 0), body, dots(end < F.length(text))))


def korean_share(text: Column) -> Column:
    """Share of Hangul syllables among the characters; null for a blank text."""
    return F.try_divide(F.length(_sub(text, "[^가-힣]", "")), F.length(F.trim(text)))


def keep_legible(text: Column, least: float = 0.3) -> Column:
    """The text if letters and digits make up ``least`` of it, else empty."""
    return F.when(F.length(_sub(text, r"[^\p{L}\p{N}]", "")) < least * F.length(text), F.lit("")).otherwise(text)


def structure_markers(text: Column) -> Column:
    """Names of the groups of structure found anywhere in a text."""
    named = [F.when(text.rlike("(?imU)" + "|".join(f"(?:{p})" for p in patterns)), F.lit(name)) for name, patterns in STRUCTURE.items()]
    return F.filter(F.array(*named), lambda m: m.isNotNull())


def structure_ratio(text: Column) -> Column:
    """Matches of groups by lines, per line that is not blank."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    one = lambda x: sum((x.rlike("(?iU)" + "|".join(f"(?:{p})" for p in ps)).cast("int") for ps in STRUCTURE.values()), F.lit(0))
    return F.try_divide(F.aggregate(F.transform(lines, one), F.lit(0), lambda a, n: a + n), F.size(lines))


def chunk_class(text: Column) -> Column:
    """``(chunk_type, confidence)`` of a chunk, by the first class that fits."""
    low = F.lower(text)
    has = lambda c, words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(c, w))
    kind = lambda name, sure: F.struct(F.lit(name).alias("chunk_type"), F.lit(sure).alias("confidence"))
    words = F.size(F.filter(F.split(squeeze(text), " "), lambda w: w != ""))
    return (
        F.when(has(low, ERROR_WORDS), kind("error_log", 0.9))
        .when(has(low, PROCEDURE_WORDS), kind("procedure", 0.8))
        .when(F.size(structure_markers(text)) > 0, kind("structured_content", 0.8))
        .when(has(text, TECHNICAL_SIGNS), kind("technical_content", 0.7))
        .when(words < 50, kind("summary", 0.6))
        .otherwise(kind("general_content", 0.5))
    )


def overlap_tail(text: Column, size: int = 200) -> Column:
    """The end of a text that the next chunk repeats: from a sentence, else a paragraph, else a word on."""
    tail = F.when(F.length(text) <= size, text).otherwise(F.right(text, F.lit(size)))
    last = lambda mark: F.length(tail) - F.instr(F.reverse(tail), mark[::-1]) + 1 - len(mark)
    at = lambda mark: F.when(F.instr(tail, mark) > 0, last(mark)).otherwise(-1)
    stop = F.greatest(at(". "), at("! "), at("? "))
    n = F.length(tail)
    cut = F.when(stop > 0.3 * n, stop + 2).when(at("\n\n") > 0.2 * n, at("\n\n") + 2).when(at(" ") > 0.1 * n, at(" ") + 1).otherwise(0)
    return F.when(F.length(text) <= size, text).otherwise(F.substring(tail, cut + 1, F.length(tail)))


def segments(text: Column, most_words: int = 200) -> Column:
    """Sentences put together in order while they have at most ``most_words`` words; a longer sentence stands alone."""
    size = lambda s: F.size(F.filter(F.split(squeeze(s), " "), lambda w: w != ""))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("n"))

    def step(acc: Column, s: Column) -> Column:
        fits = (acc["n"] == 0) | (acc["n"] + size(s) <= most_words)
        done = F.when(fits, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"])))
        body = F.when(fits & (acc["n"] > 0), F.concat_ws(" ", acc["open"], s)).otherwise(s)
        return F.struct(done.alias("done"), body.alias("open"), F.when(fits, acc["n"] + size(s)).otherwise(size(s)).alias("n"))

    close = lambda acc: F.when(acc["n"] > 0, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"])
    return F.aggregate(split_sentences(text, 1), start, step, close)


def section_between(text: Column, start: str, end: str) -> Column:
    """What stands between two marks, trimmed; up to the end without the second mark, null without the first."""
    at = F.instr(text, start)
    rest = F.substring(text, at + len(start), F.length(text))
    stop = F.instr(rest, end)
    return F.when(at > 0, F.btrim(F.when(stop > 0, F.substring(rest, F.lit(1), stop - 1)).otherwise(rest), F.lit(" \t\n\r")))
