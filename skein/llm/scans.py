"""Repair text read from page images.

The lines of a page are strung into one stream of words and decoded together by
dynamic programming: a word may stand as it is, be a known word with misread characters, be broken
over two lines, be torn apart by a blank or have swallowed one.  What is known
comes from the corpus itself: the words that all pages share.  Running headers
are lines that a file repeats at the edges of its pages.  Paragraphs are cut by
dynamic programming over the lines that are left.
"""

from __future__ import annotations

import bisect
import itertools
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.spread import spread
from .durable import durable

#: How characters are misread (as read: as printed).
MISREAD = [
    ("@", "a"), ("1", "i"), ("1", "l"), ("|", "l"), ("|", "i"), ("I", "l"), ("l", "I"), ("0", "o"), ("0", "O"), ("5", "s"), ("5", "S"), ("6", "b"), ("9", "g"), ("2", "z"), ("2", "Z"), ("8", "B"),
    ("c", "e"), ("c", "é"), ("f", "t"), ("b", "h"), ("u", "v"), ("ri", "n"), ("rn", "m"), ("m", "in"), ("m", "rn"), ("cl", "d"), ("ii", "u"), ("ii", "ü"), ("vv", "w"), ("VV", "W"), ("li", "h"), ("nn", "m"),
]
#: Signs that break a word at the end of a line.
BREAK_SIGNS = "-‐‑­¬"
#: Words beside a page's number.
PAGE_WORDS = "page pages pag pág p pp seite blatt página pagina folio feuillet 페이지 쪽 면 頁 ページ of von de sur 중 no nr nº"
#: A word is known from so many occurrences on, however many words there are.
KNOWN_LEAST = 2
#: Pages on which a header stands at least; pages of a file put in order in one task.
HEADER_PAGES, PAGE_BLOCK = 3, 512
#: A line on at least so many of its file's pages needs no other evidence to be a header; pages between which a header is near.
HEADER_SHARE, HEADER_NEAR = 0.125, 2
#: How much more frequent a word is than its misreadings, at least.
RATIO = 40
#: Costs of a reading, in natural logarithms of its chance: a misread sign, a blank put in, a blank lost, an unknown word, each of its letters and each of its Hangul syllables.
MISREAD_COST, TORN_COST, LOST_COST, UNKNOWN_COST, LETTER_COST, SYLLABLE_COST = 3.0, 4.0, 12.0, 10.0, 2.5, 5.0

#: Distinct words that a worker counts before it passes them on.
COUNTED_WORDS = 200_000
#: Known words that are sent to all workers at most.
LEXICON_WORDS = 1_000_000
FOUND_TYPE = "array<struct<word:string,n:bigint,longer:bigint,hyphened:bigint>>"
NOISE_TYPE = "array<struct<line_no:int,noise:string>>"
LINES_TYPE = "array<struct<line_no:int,skeleton:bigint,place:int,rest:int,head:string,broken:boolean,outer:boolean>>"

_TRIM = "".join(c for c in ".,;:!?()[]{}<>\"'“”„«»「」『』…·*")
_DIGITS = str.maketrans("lIi|oOsSbBgzZ", "1111005568922")
_ROMAN = re.compile(r"m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})")
_WORDS = re.compile(r"[^\s.,;:!?()\[\]{}<>\"“”„«»「」『』…*=/\\_]+")


def is_code(chunk: str) -> bool:
    """A path, address, number, time or identifier, which has no misread words."""
    if any(c in "/\\_=<>#$" for c in chunk):
        return True
    digits = sum(c.isdigit() for c in chunk)
    letters = sum(c.isalpha() for c in chunk)
    if letters == 0 or digits > 2 and digits >= letters / 2:
        return True
    return "-" in chunk and digits > 0 and any(part.isdigit() for part in chunk.strip(_TRIM).split("-"))


def page_number(line: str, page_no: int | None) -> bool:
    """Whether a line gives only the number of its page, in any form."""
    body = line.strip().casefold()
    if not body:
        return False
    parts = [p for p in _PARTED.split(body, 7) if p]
    if not 1 <= len(parts) <= 4:
        return False
    named, values = False, []
    for part in parts:
        if part in PAGE_WORDS.split() or part.translate(_LETTERS) in PAGE_WORDS.split():
            named = True
            continue
        roman = _ROMAN.fullmatch(part)
        number = part.translate(_DIGITS)
        stuck = re.fullmatch(r"(\d+)(?:쪽|면|페이지|頁|ページ)", number)
        if number.isdigit() and (any(c.isdigit() for c in part) or int(number) == page_no):
            values.append(int(number))
        elif stuck:
            values.append(int(stuck[1]))
            named = True
        elif roman and part:
            values.append(_roman(part))
        elif part in ("l", "ll", "|") or number.isdigit():
            values.append(int(number))
        else:
            return False
    if not values or len(values) > 2:
        return False
    if page_no is None:
        return named
    return page_no in values[:1] or named or len(values) == 2 and values[0] <= values[1] and page_no in values


_LETTERS = str.maketrans({"9": "g", "@": "a", "1": "i", "5": "s", "0": "o", "|": "l", "6": "b", "á": "a"})


def _roman(text: str) -> int:
    value = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
    digits = [value[c] for c in text]
    return sum(-a if a < b else a for a, b in zip(digits, [*digits[1:], 0]))


_SAME = str.maketrans({"@": "a", "1": "l", "i": "l", "|": "l", "0": "o", "5": "s", "6": "b", "h": "b", "9": "g", "e": "c", "f": "t", "v": "u", "2": "z", "8": "b"})


_PARTED = re.compile(r"[\s\-–—./|()\[\]:,·*~]+")
_NOT_LETTER, _NUMBERED, _ACCENTS = re.compile(r"[\W\d_]+"), re.compile(r"\S*\d\S*"), re.compile("[\u0300-\u036f]+")
_DIGIT = re.compile(r"\d")
#: Characters that come apart into plain ones: accented letters, combining marks, compatibility and wide forms.
_APART = re.compile("[\u00a8-\u024f\u0300-\u036f\u1e00-\u218f\u2460-\u24ff\u3000\u3131-\u33ff\uf900-\uffef]")
_SAME_BYTES = bytes(ord(chr(k).lower().translate(_SAME)) if k < 128 else k for k in range(256))
_NO_LETTERS = bytes(k for k in range(128) if not chr(k).lower().translate(_SAME).isalpha())
_FOLDS = [("rn", "m"), ("rl", "n"), ("ln", "m"), ("cl", "d"), ("ll", "u"), ("uu", "w"), ("nn", "m")]


def _no_number(match: re.Match) -> str:
    """Nothing for a chunk that is mostly a number; a word with a misread digit stays."""
    core = match[0].strip(_TRIM)
    letters = sum(c.isalpha() for c in core)
    return core if letters and sum(c.isdigit() for c in core) <= letters / 2 else ""


def skeleton(line: str) -> str:
    """A line without case, numbers and blanks, in which characters that are misread for each other are one."""
    text = _NUMBERED.sub(_no_number, line) if _DIGIT.search(line) else line
    if text.isascii():
        text = text.encode().translate(_SAME_BYTES, _NO_LETTERS).decode()
    else:
        text = text.casefold()
        if _APART.search(text):
            text = _ACCENTS.sub("", unicodedata.normalize("NFKD", text))
        text = _NOT_LETTER.sub("", text.translate(_SAME))
    before = ""
    while text != before:
        before = text
        for seen, one in _FOLDS:
            if seen in text:
                text = text.replace(seen, one)
    return text


def _ends_broken(line: str) -> bool:
    end = line.rstrip()[-2:]
    return len(end) == 2 and end[1] in BREAK_SIGNS and end[0].isalnum()


def number_lines(lines: list[tuple[int, str]], page_no: int | None) -> list[bool]:
    """Which of the lines ``(line_no, text)`` that are not blank give only the page's number: one of the three outermost at either end."""
    return [(k < 3 or k >= len(lines) - 3) and page_number(x, page_no) for k, (_, x) in enumerate(lines)]


def page_lines(content: str, page_no: int | None) -> list[tuple[int, int | None, int, int, str, bool, bool]]:
    """``(line_no, skeleton, place, rest, head, broken, outer)`` of the lines that are not blank and no page number.

    ``skeleton`` is a hash of the line's skeleton, null for a line without letters.
    ``place`` lines stand before a line and ``rest`` after it.  ``head`` is its first
    chunk; ``broken`` tells whether it ends in a hyphen, ``outer`` whether it is the
    first or the last line of the page with its skeleton.
    """
    lines = [(k + 1, x) for k, x in enumerate(content.split("\n")) if x.strip()]
    lines = [x for x, number in zip(lines, number_lines(lines, page_no)) if not number]
    bones = [skeleton(x) for _, x in lines]
    first = {x: k for k, x in reversed([*enumerate(bones)])}
    last = {x: k for k, x in enumerate(bones)}
    return [
        (no, xxhash.xxh64_intdigest(bone) - (1 << 63) if bone else None, k, len(lines) - 1 - k, x.split(None, 1)[0], _ends_broken(x), k in (first[bone], last[bone]))
        for k, ((no, x), bone) in enumerate(zip(lines, bones))
    ]


class Lexicon:
    """Known words with their counts, and the words that a misreading stands for."""

    def __init__(self, counts: dict[str, int], total: int | None = None, longest: int | None = None) -> None:
        self.counts = counts
        self.sorted = sorted(counts)
        self.before = [0, *itertools.accumulate(counts[w] for w in self.sorted)]
        self.compound: dict[str, int] = {}
        for w, n in counts.items():
            at = w.find("-", 1)
            while at > 0:
                self.compound[w[:at]] = self.compound.get(w[:at], 0) + n
                at = w.find("-", at + 1)
        self.total = max(1, sum(counts.values())) if total is None else max(1, total)
        self.longest = max(map(len, counts), default=0) if longest is None else longest
        self._remember()

    def _remember(self) -> None:
        self.meant = lru_cache(maxsize=300_000)(self._meant)
        self.fixed = lru_cache(maxsize=300_000)(self._fixed)
        self.reading = lru_cache(maxsize=300_000)(self._reading)
        self.simple: dict[str, tuple[str, bool] | None] = {}

    def known(self, word: str) -> int:
        """How often a word stands in the corpus; a capital at its start does not matter."""
        n = self.count(word)
        if word[:1].isupper():
            n = max(n, self.count(word[:1].lower() + word[1:]))
            if word.isupper():
                n = max(n, self.count(word.lower()), self.count(word.capitalize()))
        return n

    def count(self, word: str) -> int:
        """How often a word stands in the corpus exactly so."""
        return self.counts.get(word, 0)

    def hyphened(self, part: str) -> int:
        """How many words go on with a hyphen after ``part``."""
        return self.compound.get(part, 0)

    def beginning(self, part: str) -> int:
        """How many words begin with ``part`` and go on, without a hyphen there."""
        a, b = bisect.bisect_right(self.sorted, part), bisect.bisect_right(self.sorted, part + "\U0010ffff")
        return self.before[b] - self.before[a] - self.hyphened(part)

    def _variants(self, word: str) -> set[str]:
        out = set()
        for seen, printed in MISREAD:
            at = word.find(seen)
            while at >= 0:
                out.add(word[:at] + printed + word[at + len(seen) :])
                at = word.find(seen, at + 1)
        return out

    def _meant(self, word: str) -> str | None:
        """The known word that ``word`` is a misreading of, if it is one."""
        letters = sum(c.isalpha() for c in word)
        if len(word) < 2 or letters < 1 or len(word) > self.longest + 2:  # two misread signs are two letters more at most
            return None
        own = self.known(word)
        odd = any(c in "@|" or c.isdigit() for c in word) or any(a.islower() and b == "I" for a, b in zip(word, word[1:]))
        need = max(KNOWN_LEAST, 3 * own) if odd else max(3, RATIO * own if own >= KNOWN_LEAST else 0)
        first = self._variants(word)
        best = max(first, key=lambda w: (self.known(w), w), default=None)
        if best and self.known(best) >= need and not any(c.isdigit() for c in best):
            return best
        if own < KNOWN_LEAST and len(word) >= 5:
            second = {w for v in first for w in self._variants(v)}
            best = max(second, key=lambda w: (self.known(w), w), default=None)
            if best and self.known(best) >= max(3, need) and not any(c.isdigit() for c in best):
                return best
        if "-" in word and own < KNOWN_LEAST:
            parts = [(p, self.meant(p) if p else None) for p in word.split("-")]
            if any(m for _, m in parts) and all(m or self.known(p) >= KNOWN_LEAST or not p for p, m in parts):
                return "-".join(m or p for p, m in parts)
        for sign in "'’":
            if sign in word and own < KNOWN_LEAST:
                head, _, tail = word.partition(sign)
                meant_head, meant_tail = self.meant(head) if len(head) > 1 else None, self.meant(tail) if tail else None
                if (meant_head or meant_tail) and (meant_tail or self.known(tail) >= KNOWN_LEAST):
                    return (meant_head or head) + sign + (meant_tail or tail)
        return None

    def _fixed(self, chunk: str) -> str:
        """A chunk with its misread word restored."""
        if is_code(chunk):
            return chunk
        at, core = _core(chunk)
        if len(core) < 2:
            return chunk
        meant = self.meant(core)
        return chunk[:at] + meant + chunk[at + len(core) :] if meant else chunk

    def cost(self, word: str) -> float:
        """What a word costs: little if it is common, more for each letter if it is unknown."""
        n = self.known(word)
        return math.log(self.total / n) if n else UNKNOWN_COST + sum(SYLLABLE_COST if "가" <= c <= "힣" else LETTER_COST for c in word)

    def divided(self, word: str) -> tuple[str, float, int] | None:
        """An unknown word as the words that ran together in it: these, their cost, and the place of the first misread sign or -1.

        The cheapest division of the characters into common words, as they stand or
        with a misread part; None if leaving the word whole is cheaper.  Scripts
        written without blanks are not divided.
        """
        if len(word) < 4 or any("\u3040" <= c <= "\u30ff" or "\u3400" <= c <= "\u9fff" for c in word):
            return None
        best: list[tuple[float, str, int]] = [(0.0, "", -1), *[(math.inf, "", -1)] * len(word)]
        for end in range(1, len(word) + 1):
            for begin in range(max(0, end - self.longest - 1), end):
                if best[begin][0] == math.inf or end - begin == len(word):
                    continue
                part, misread = word[begin:end], -1
                meant = part
                if self.known(part) < RATIO:
                    meant = max(self._variants(part), key=lambda w: (self.known(w), w), default=part) if len(part) > 1 else part
                    if self.known(meant) < RATIO or any(c.isdigit() for c in meant):
                        continue
                    misread = begin + next((k for k, (x, y) in enumerate(zip(part, meant)) if x != y), 0)
                before, words, first = best[begin]
                cost = before + self.cost(meant) + (LOST_COST if begin else 0.0) + (MISREAD_COST if misread >= 0 else 0.0)
                if cost < best[end][0]:
                    best[end] = (cost, f"{words} {meant}" if begin else meant, first if first >= 0 else misread)
        cost, words, first = best[-1]
        return (words, cost, first) if cost < self.cost(word) else None

    def _reading(self, chunk: str, whole: bool) -> tuple[str, float, bool]:
        """The cheapest reading of a chunk by itself, its cost, and whether it was misread; ``whole``: it did not lose its beginning or end."""
        fixed = self.fixed(chunk)
        at, core = _core(fixed)
        cost = self.cost(core)
        if fixed != chunk:
            return fixed, cost + MISREAD_COST, True
        if whole and self.known(core) < KNOWN_LEAST and not is_code(chunk):
            parts = self.divided(core)
            if parts:
                return fixed[:at] + parts[0] + fixed[at + len(core) :], parts[1], parts[2] >= 0
        return fixed, cost, False

    def alone(self, chunk: str) -> tuple[str, bool] | None:
        """The only reading of a chunk and whether it was misread; None if it may also be the beginning of a torn word."""
        if chunk not in self.simple:
            if len(self.simple) >= 300_000:
                self.simple.clear()
            words, _, wrong = self.reading(chunk, chunk[-1] not in BREAK_SIGNS)
            self.simple[chunk] = None if self.may_be_torn(chunk) else (words, wrong)
        return self.simple[chunk]

    def may_be_torn(self, chunk: str) -> bool:
        """Whether a chunk is no word that is known or can be restored, so that a blank may have torn it off."""
        return not (self.count(chunk) or len(chunk) < 2 or _core(chunk)[1] != chunk or self.known(chunk) >= KNOWN_LEAST or is_code(chunk) or self.fixed(chunk) != chunk)

    def joined(self, left: str, right: str) -> str | None:
        """The word that was broken into ``left`` and ``right`` at the end of a line; None if the hyphen is its own."""
        if not left or not right or not left[-1].isalpha() or not right[0].isalpha() and right[0] not in "@|0156":
            return None
        if not any(c.isalpha() for c in right):
            return None
        whole, apart = left + right, f"{left}-{right}"
        a, b = self.known(whole), self.known(apart)
        if a or b:
            return whole if a >= b else None
        meant, meant_apart = self.meant(whole), self.meant(apart)
        if meant_apart and (not meant or self.known(meant_apart) > self.known(meant)):
            return None
        if meant:
            return meant
        if is_code(left) or right[:1].isupper() and not whole.isupper() or left.isupper() and right.isupper() and len(left) > 1:
            return None
        if self.hyphened(left) > 4 * self.beginning(left):
            return None
        apart_cost = self.cost(left) + self.cost(right) + LOST_COST
        return None if len(left) > 3 and len(right) > 3 and apart_cost < self.cost(whole) else whole

    def open_end(self, left: str) -> bool:
        """Whether a page that ends with ``left`` and a hyphen ends inside a broken word, the next page being lost."""
        return len(left) > 1 and left[-1].isalpha() and not is_code(left) and self.beginning(left) >= self.hyphened(left)


class PageLexicon(Lexicon):
    """The commonest words, and those of the others that a page has asked for; what it asks for besides is noted in ``asked``."""

    def __init__(self, common: Lexicon, found: dict[str, tuple[int, int, int]]) -> None:
        self.common, self.found, self.asked = common, found, set()
        self.total, self.longest = common.total, common.longest
        self._remember()

    def _found(self, word: str) -> tuple[int, int, int]:
        if word not in self.found:
            self.asked.add(word)
        return self.found.get(word, (0, 0, 0))

    def count(self, word: str) -> int:
        return self.common.counts.get(word) or (self._found(word)[0] if 0 < len(word) <= self.longest else 0)

    def hyphened(self, part: str) -> int:
        return self.common.hyphened(part) + self._found(part)[2]

    def beginning(self, part: str) -> int:
        _, longer, hyphened = self._found(part)
        return self.common.beginning(part) + longer - hyphened


def _core(chunk: str) -> tuple[int, str]:
    """Where the word of a chunk begins, and the word without the signs around it."""
    left = len(chunk) - len(chunk.lstrip(_TRIM))
    return left, chunk[left:].rstrip(_TRIM)


def decode(content: str, headers: set[int], next_head: str | None, page_no: int | None, lexicon: Lexicon, has_next: bool = True) -> tuple[list[tuple[int, str]], list[tuple[int, str, bool]]]:
    """Noise ``(line_no, kind)`` of a page, and its lines of running text ``(line_no, repaired, joined to the next)``.

    The words of the running text are taken as one stream.  Each chunk may stand as
    it is, be misread, be several words that ran together, be joined to the chunks
    after it that a blank tore off, or be broken at the end of its line; of all ways
    through the stream the one with the least total cost is chosen.
    """
    noise: list[tuple[int, str]] = []
    every = content.split("\n")
    full = [(no, x) for no, x in enumerate(every, 1) if x.strip()]
    numbers = {no for (no, _), number in zip(full, number_lines(full, page_no)) if number}
    lines = []
    for no, line in enumerate(every, 1):
        if no in headers:
            noise.append((no, "header"))
        elif no in numbers:
            noise.append((no, "page_number"))
        else:
            lines.append((no, line))
    chunks = [line.split() for _, line in lines]
    out = [""] * len(lines)
    glued, broken, misread = [False] * len(lines), set(), set()
    filled = [k for k, x in enumerate(chunks) if x]
    begin = 0
    while begin < len(filled):
        # Readings go over the end of a line only where it ends in a break sign: lines up to the next one that does not are decoded together.
        end = begin + 1
        while end < len(filled) and chunks[filled[end - 1]][-1][-1] in BREAK_SIGNS:
            end += 1
        part = filled[begin:end]
        alone = [lexicon.alone(x) for x in chunks[part[0]]] if len(part) == 1 else [None]
        if None in alone or begin == 0 and chunks[part[0]][0][0].islower() or chunks[part[0]][-1][-1] in BREAK_SIGNS:
            _decode_together([(k, x) for k in part for x in chunks[k]], begin == 0, next_head if end == len(filled) else None, end == len(filled), lexicon, out, glued, broken, misread)
        else:  # each chunk has one reading
            out[part[0]] = " ".join(x for x, _ in alone)
            if any(wrong for _, wrong in alone):
                misread.add(part[0])
        begin = end
    noise += [(lines[k][0], "hyphen") for k in sorted(broken)] + [(lines[k][0], "misread") for k in sorted(misread)]
    return noise, [(no, words, joined) for (no, _), words, joined in zip(lines, out, glued)]


def _decode_together(stream: list[tuple[int, str]], first: bool, next_head: str | None, last: bool, lexicon: Lexicon, out: list[str], glued: list[bool], broken: set[int], misread: set[int]) -> None:
    """The cheapest way through the chunks ``(line, chunk)`` of some lines, entered into ``out``, ``glued``, ``broken`` and ``misread``."""
    best, back = [0.0, *[math.inf] * len(stream)], [None] * (len(stream) + 1)
    for i in range(len(stream)):
        if best[i] == math.inf:
            continue
        for reading in _readings(stream, i, first, next_head, last, lexicon):
            cost = best[i] + reading[1]
            if cost < best[reading[0]]:
                best[reading[0]], back[reading[0]] = cost, (i, reading)
    words_of: dict[int, list[str]] = {}
    i = len(stream)
    while i:
        i, (_, _, words, hyphen, glue, wrong) = back[i]
        k = stream[i][0]
        words_of.setdefault(k, []).append(words)
        glued[k] |= glue
        if hyphen:
            broken.add(k)
        if wrong is not None:
            misread.add(wrong)
    for k, words in words_of.items():
        out[k] = " ".join(reversed(words))


def _readings(stream: list[tuple[int, str]], i: int, first: bool, next_head: str | None, last: bool, lexicon: Lexicon) -> list[tuple[int, float, str, bool, bool, int | None]]:
    """Readings of the chunk at ``i``: ``(next place, cost, words, broken, joined to the next line, misread line)``; ``first``, ``last``: the page begins or ends with these lines."""
    k, chunk = stream[i]
    last_of_line = i + 1 == len(stream) or stream[i + 1][0] != k
    if last_of_line and len(chunk) > 1 and chunk[-1] in BREAK_SIGNS and chunk[-2].isalnum():
        at, left = _core(chunk[:-1])
        if i + 1 < len(stream):
            found = _broken(stream, i, at, left, lexicon)
            if found:
                return found
        elif next_head:
            tail_at, right = _core(next_head.split()[0])
            whole = lexicon.joined(left, right) if tail_at == 0 else None
            hyphen = whole is not None or chunk[-1] in "­¬"
            meant = (whole if whole and whole != left + right else lexicon.meant(left + right)) if hyphen else None
            wrong = k if meant and any(x != y for x, y in zip(left, meant)) else None
            return [(i + 1, 0.0, chunk, hyphen, hyphen, wrong)]
        elif last and (lexicon.open_end(left) or chunk[-1] in "­¬"):
            return [(i + 1, 0.0, chunk, True, False, None)]
    # A chunk after a hyphen, or the first of a page, may be the rest of a word.
    rest = i == 0 and first and chunk[:1].islower() or i > 0 and stream[i - 1][0] != k and stream[i - 1][1][-1] in BREAK_SIGNS
    words, cost, wrong = lexicon.reading(chunk, not rest and chunk[-1] not in BREAK_SIGNS)
    return [(i + 1, cost, words, False, False, k if wrong else None), *_torn(stream, i, lexicon)]


def _broken(stream: list[tuple[int, str]], i: int, at: int, left: str, lexicon: Lexicon) -> list[tuple[int, float, str, bool, bool, int | None]]:
    """Readings of a chunk that a line's end broke, with the next chunk or with the pieces that a blank tore that one into."""
    k, chunk = stream[i]
    n, found, following, j = stream[i + 1][0], [], "", i + 1
    while j < len(stream) and stream[j][0] == n:
        piece_at, piece = _core(stream[j][1])
        if following and (piece_at or len(piece) < 2 or lexicon.known(piece) >= RATIO * max(1, lexicon.known(left + following + piece)) or lexicon.known(left + following + piece) < 3):
            break
        following += stream[j][1]
        tail_at, right = _core(following)
        whole = lexicon.joined(left, right) if tail_at == 0 else None
        if whole is None and chunk[-1] in "­¬" and right:
            whole = left + right
        if whole is not None:
            plain = left + right
            meant = whole if whole != plain else lexicon.meant(plain) or plain
            cost, wrong = lexicon.cost(meant) + (j - i - 1) * TORN_COST, None
            if meant != plain:
                first = next((p for p, (x, y) in enumerate(zip(plain, meant)) if x != y), min(len(plain), len(meant)))
                cost, wrong = cost + MISREAD_COST, k if first < len(left) else n
            elif lexicon.known(plain) < KNOWN_LEAST and not is_code(plain) and (parts := lexicon.divided(plain)):
                meant, cost = parts[0], parts[1] + (j - i - 1) * TORN_COST
                wrong = None if parts[2] < 0 else k if parts[2] < len(left) else n
            found.append((j + 1, cost, chunk[:at] + meant + following[len(right) :], True, True, wrong))
        if right != following:
            break
        j += 1
    return found


def _torn(stream: list[tuple[int, str]], i: int, lexicon: Lexicon) -> list[tuple[int, float, str, bool, bool, int | None]]:
    """Readings of chunks of one line as one word, if none of them is known but all together are."""
    k, chunk = stream[i]
    if not lexicon.may_be_torn(chunk):
        return []
    found, word, j = [], chunk, i + 1
    while j < len(stream) and stream[j][0] == k and len(word) <= lexicon.longest:
        at, right = _core(stream[j][1])
        if at or len(right) < 2 or lexicon.known(right) >= KNOWN_LEAST:
            break
        if lexicon.known(word + right) >= 3:
            found.append((j + 1, lexicon.cost(word + right) + (j - i) * TORN_COST, word + stream[j][1], False, False, None))
        if right != stream[j][1]:
            break
        word += right
        j += 1
    return found


def paragraphs(lines: list[tuple[int, str, bool]]) -> list[list[tuple[int, str, bool]]]:
    """Lines of running text as paragraphs, at the least total cost.

    A paragraph costs a little for being one, more if it ends in the middle of a
    sentence or line or begins with a small letter, and for each blank or short
    finished line that it runs over.
    """
    kept = [(x, k > 0 and not lines[k - 1][1].strip()) for k, x in enumerate(lines) if x[1].strip()]
    if not kept:
        return []
    width = sorted(len(x[1]) for x, _ in kept)[len(kept) * 3 // 4]

    def at(k: int) -> float:
        """Cost of a cut before line k, less that of none."""
        (_, text, joined), (_, following, _) = kept[k - 1][0], kept[k][0]
        ended = text.rstrip("\"”’»」』)")[-1:] in ".!?。！？:"
        short = len(text) < 0.8 * width
        cost = 2.0 if not kept[k][1] else -4.0
        cost += -1.0 if ended else 2.5
        cost += -1.5 if ended and short else 0.0
        cost += 1.5 if following[:1].islower() else -0.5
        return cost + (100.0 if joined else 0.0)

    best, back = [0.0, *[math.inf] * len(kept)], [0] * (len(kept) + 1)
    gains = [0.0, *(at(k) for k in range(1, len(kept)))]
    least, start = math.inf, 0  # the cheapest cut so far: what follows it costs the same wherever it ends
    for end in range(1, len(kept) + 1):
        if best[end - 1] + gains[end - 1] < least:
            least, start = best[end - 1] + gains[end - 1], end - 1
        best[end], back[end] = least + 0.5, start
    cuts, end = [], len(kept)
    while end:
        cuts.append((back[end], end))
        end = back[end]
    return [[x for x, _ in kept[a:b]] for a, b in reversed(cuts)]


def page_words(content: str) -> list[str]:
    """Words of a page; both parts of words broken at a line's end are left out."""
    kept, drop = [], False
    for line in content.split("\n"):
        if drop and line.strip():
            line, drop = line.split(None, 1)[1] if len(line.split(None, 1)) > 1 else "", False
        if len(line) > 1 and line[-1] in BREAK_SIGNS and not line[-2].isspace():
            line, drop = line[: max(line.rfind(x) for x in (" ", "\t", "\u00a0", "\u3000")) + 1], True
        kept.append(line)
    return _WORDS.findall("\n".join(kept))


def word_counts(pages: DataFrame, text: str = "page_content") -> DataFrame:
    """``(word, n)`` over all pages, counted in each batch first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()
        for batch in batches:
            for content in batch.column(0).to_pylist():
                count.update(page_words(content))
            if len(count) >= COUNTED_WORDS:
                yield pa.RecordBatch.from_arrays([pa.array(count.keys(), pa.string()), pa.array(count.values(), pa.int64())], names=["word", "n"])
                count.clear()
        yield pa.RecordBatch.from_arrays([pa.array(count.keys(), pa.string()), pa.array(count.values(), pa.int64())], names=["word", "n"])

    counted = spread(pages.where(F.col(text).isNotNull()).select(text)).mapInArrow(run, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def known_words(pages: DataFrame, text: str = "page_content") -> DataFrame:
    """All words that occur ``KNOWN_LEAST`` times or more, with their counts; numbers are none."""
    letters = F.col("word").rlike(r"[\p{L}]") & ~F.col("word").rlike(r"\d{3}")
    return durable(word_counts(pages, text).where((F.col("n") >= KNOWN_LEAST) & letters))


def _with_words(rows: DataFrame, pages: DataFrame, key: str, page: str, text: str):
    """``(rows, lexicon)``: the rows to decode with their column ``found``, and for a worker the lexicon of a row by it.

    Up to ``LEXICON_WORDS`` known words are sent to all workers.  Of more words the
    commonest are, and each page is decoded to see which other words it asks for;
    these are joined on, until no page asks for another one.  The result is that of
    the whole lexicon.
    """
    context = pages.sparkSession.sparkContext
    words = known_words(pages, text)
    sums = words.agg(F.count("*").alias("n"), F.sum("n").alias("total"), F.max(F.length("word")).alias("longest")).first()
    if sums["n"] <= LEXICON_WORDS:
        shared = context.broadcast(({r["word"]: r["n"] for r in words.toLocalIterator()}, sums["total"] or 0, sums["longest"] or 0))
        return rows.withColumn("found", F.lit(None).cast(FOUND_TYPE)), lambda found: _lexicon(shared)
    common = words.orderBy(F.desc("n"), "word").limit(LEXICON_WORDS)
    shared = context.broadcast(({r["word"]: r["n"] for r in common.toLocalIterator()}, sums["total"], sums["longest"]))
    last = min((n, w) for w, n in shared.value[0].items())[0]
    least = max(w for w, n in shared.value[0].items() if n == last)
    rare = words.where((F.col("n") < last) | (F.col("n") == last) & (F.col("word") > least))
    lexicon_of = lambda found: PageLexicon(_lexicon(shared), {x["word"]: (x["n"], x["longer"], x["hyphened"]) for x in found or ()})

    def ask(texts: pa.Array, numbers: pa.Array, headers: pa.Array, heads: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        for t, p, h, n, f in zip(texts.to_pylist(), numbers.to_pylist(), headers.to_pylist(), heads.to_pylist(), found.to_pylist()):
            lexicon = lexicon_of(f)
            decode(t, set(h or ()), n, p, lexicon)
            out.append(sorted(lexicon.asked))
        return pa.array(out, pa.list_(pa.string()))

    known = None
    while True:
        held = rows.withColumn("found", F.lit(None).cast(FOUND_TYPE)) if known is None else rows.join(known.groupBy(key).agg(F.collect_list(F.struct("word", "n", "longer", "hyphened")).alias("found")), key, "left")
        asked = durable(held.select(key, F.explode(F.arrow_udf(ask, "array<string>")(text, F.col(page).cast("int"), "header_lines", "next_head", "found")).alias("word")))
        if asked.limit(1).count() == 0:
            return held, lexicon_of
        wanted = asked.select("word").distinct()
        starts = rare.select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("_at")).select("n", F.substring("word", F.lit(1), F.col("_at")).alias("word"), F.col("_at") == F.length("word"), F.substring("word", F.col("_at") + 1, F.lit(1)).alias("_next")).toDF("n", "word", "_whole", "_next")
        sums_of = starts.join(wanted, "word", "left_semi").groupBy("word").agg(*[F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(name) for name, c in (("n1", F.col("_whole")), ("longer", ~F.col("_whole")), ("hyphened", (F.col("_next") == "-") & ~F.col("_whole")))])
        answer = asked.join(sums_of, "word", "left").select(key, "word", F.coalesce("n1", F.lit(0)).alias("n"), F.coalesce("longer", F.lit(0)).alias("longer"), F.coalesce("hyphened", F.lit(0)).alias("hyphened"))
        known = durable(answer if known is None else known.unionByName(answer))


def _lines_udf(texts: pa.Array, pages: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("line_no", pa.int32()), ("skeleton", pa.int64()), ("place", pa.int32()), ("rest", pa.int32()), ("head", pa.string()), ("broken", pa.bool_()), ("outer", pa.bool_())]))
    names = ("line_no", "skeleton", "place", "rest", "head", "broken", "outer")
    return pa.array([[dict(zip(names, x)) for x in page_lines(t, p)] if t else [] for t, p in zip(texts.to_pylist(), pages.to_pylist())], kind)


def page_frames(pages: DataFrame, key: str = "page_key", file: str = "file_id", page: str = "page_no", text: str = "page_content") -> DataFrame:
    """``(<key>, header_lines, next_head)``: which lines of a page are headers, and the first word of the running text of the next page.

    The outermost lines of the pages are looked at first, then those that headers
    found so far leave outermost, until no page has another one.  A page is one row
    with all its lines, so that each round joins pages and takes only edge lines out.
    """
    spread_pages = spread(pages.where(F.col(text).isNotNull()).select(key, file, page, text))
    sheets = durable(spread_pages.select(F.col(key).alias("_key"), F.col(file).alias("_file"), F.col(page).alias("_page"), F.arrow_udf(_lines_udf, LINES_TYPE)(text, F.col(page).cast("int")).alias("_lines")))
    bones = sheets.select("_file", "_page", F.explode("_lines.skeleton").alias("skeleton")).where("skeleton is not null")
    every = bones.groupBy("_file", "skeleton", "_page").agg(F.count("*").alias("_n")).groupBy("_file", "skeleton").agg(F.count("*").alias("_all"), F.sum("_n").alias("_all_lines"))
    size = sheets.where(F.size("_lines") > 0).select("_file", "_page").distinct().groupBy("_file").agg(F.count("*").alias("_size"))
    repeated = durable(every.where(f"_all >= {HEADER_PAGES}").join(size, "_file"))
    depth, found, before = None, None, 0
    for deepest in itertools.count():
        # A round goes one line deeper at most, so only so many lines of a page are shuffled.
        shallow = sheets.withColumn("_lines", F.filter("_lines", lambda x: F.least(x["place"], x["rest"]) <= deepest))  # noqa: B023
        at_edge = F.filter("_lines", lambda x: (x["place"] <= F.col("_top")) | (x["rest"] <= F.col("_bottom")))
        deep_sheets = shallow.withColumns({"_top": F.lit(0), "_bottom": F.lit(0)}) if depth is None else shallow.join(depth, "_key")
        edge = deep_sheets.select("_key", "_file", "_page", "_top", "_bottom", F.explode(at_edge).alias("_l")).select("_key", "_file", "_page", "_top", "_bottom", "_l.*")
        new = _headers(edge, repeated, found is not None).withColumn("_inner", F.lit(found is not None))
        found = durable(new if found is None else found.unionByName(new).groupBy("_file", "skeleton").agg(F.max("_inner").alias("_inner")))
        edge = durable(edge.join(found.withColumn("header", F.lit(True)), ["_file", "skeleton"], "left").withColumn("header", F.coalesce("header", F.lit(False)) & F.col("outer") & (F.col("_inner") | F.expr("place = 0 or rest = 0"))))
        # Per page: how many lines from either end on are headers.
        inner = lambda at, deep: F.coalesce(F.min(F.when(~F.col("header") & (F.col(at) <= F.col(deep)), F.col(at))), F.least(F.max(deep) + 1, F.max(F.col("place") + F.col("rest")) + 1))
        depth = durable(edge.groupBy("_key").agg(inner("place", "_top").alias("_t"), inner("rest", "_bottom").alias("_b")).select("_key", F.col("_t").alias("_top"), F.col("_b").alias("_bottom")))
        deep = depth.agg(F.sum(F.col("_top") + F.col("_bottom"))).first()[0] or 0
        if deep == before:
            break
        before = deep
    headers = edge.where("header").groupBy("_key").agg(F.collect_set("line_no").alias("header_lines"))
    first = edge.where("place = _top and not header")
    heads = first.groupBy("_file", "_page").agg(F.min_by("head", F.struct("line_no", "_key")).alias("next_head")).withColumn("_page", F.col("_page") - 1)
    plain = pages.select(F.col(key).alias("_key"), F.col(file).alias("_file"), F.col(page).alias("_page"))
    return plain.join(headers, "_key", "left").join(heads, ["_file", "_page"], "left").select(F.col("_key").alias(key), "header_lines", "next_head")


def _headers(edge: DataFrame, repeated: DataFrame, inner: bool) -> DataFrame:
    """``(_file, skeleton)`` of the edge lines that are headers.

    A header stands at the edge of three or more pages, and inside of no more than
    as many.  Against chance repeats it has one of three marks: most of its
    pages are near another of them; it stands always at the same edge and never
    inside; or it is on an eighth of the file's pages.  None of them asks more of a
    longer file than of a short one.  The third is not enough for lines within
    a header, where titles and lines of the text begin.  Of lines within a header (``inner``) single
    lines inside count too, so that a text of like lines is not taken off, and
    lines that end in a broken word or go on with that of the page before do not.
    """
    if inner:
        ends_open = edge.where("broken and rest = _bottom").select("_file", (F.col("_page") + 1).alias("_page")).distinct().withColumn("_open", F.lit(True))
        small = F.substring("head", 1, 1) != F.upper(F.substring("head", 1, 1))
        edge = edge.join(ends_open, ["_file", "_page"], "left").where(~(F.col("broken") & (F.col("rest") == F.col("_bottom"))) & ~(F.coalesce("_open", F.lit(False)) & small & (F.col("place") == F.col("_top"))))
    ends = edge.where("skeleton is not null").withColumns({"_at_top": (F.col("place") <= F.col("_top")).cast("int"), "_at_bottom": (F.col("rest") <= F.col("_bottom")).cast("int")})
    ends = ends.join(repeated.select("_file", "skeleton"), ["_file", "skeleton"], "left_semi").groupBy("_file", "skeleton", "_page").agg(F.max("_at_top").alias("_at_top"), F.max("_at_bottom").alias("_at_bottom"), F.count("*").alias("_lines"))
    steps = F.array(*[F.lit(d) for d in range(-HEADER_NEAR, HEADER_NEAR + 1) if d])
    near = ends.select("_file", "skeleton", F.explode(F.transform(steps, lambda d: (F.col("_page") + d))).alias("_page")).distinct().withColumn("_near", F.lit(1))
    sums = [F.count("*").alias("_edges"), *[F.sum(c).alias(c) for c in ("_at_top", "_at_bottom", "_lines", "_near")]]
    often = ends.join(near, ["_file", "skeleton", "_page"], "left").groupBy("_file", "skeleton").agg(*sums).join(repeated, ["_file", "skeleton"])
    mostly = f"_edges >= {HEADER_PAGES} and 2 * _edges >= _all" + (" and 2 * _lines >= _all_lines" if inner else "")
    share = "" if inner else f" or _edges >= {HEADER_SHARE} * _size"
    return often.where(mostly).where(f"2 * _near >= _edges or greatest(_at_top, _at_bottom) = _edges and _lines = _all_lines{share}").select("_file", "skeleton")


def _with_frames(pages: DataFrame, key: str, file: str, page: str, text: str) -> DataFrame:
    frames = page_frames(pages, key, file, page, text)
    return spread(pages.where(F.col(text).isNotNull()).select(key, file, page, text)).join(frames, key)


_lexicons: list[tuple[object, Lexicon]] = []


def _lexicon(shared) -> Lexicon:
    """The lexicon of broadcast counts, made once in each worker; the counts are kept, so others are never taken for them."""
    value = shared.value
    if not _lexicons or _lexicons[0][0] is not value:
        _lexicons[:] = [(value, Lexicon(*value))]
    return _lexicons[0][1]


def find_noise(pages: DataFrame, key: str = "page_key", file: str = "file_id", page: str = "page_no", text: str = "page_content") -> DataFrame:
    """``(<key>, line_no, noise)``: each line with a broken word, a misread word, a header or a page number.

    Lines count from 1, blank ones included.  A page scanned twice is looked at
    twice; a header needs three different pages.  Pages with null text give no
    row; a page without file or number has no neighbours.
    """
    rows, lexicon_of = _with_words(_with_frames(pages, key, file, page, text), pages, key, page, text)

    def run(texts: pa.Array, numbers: pa.Array, headers: pa.Array, heads: pa.Array, words: pa.Array) -> pa.Array:
        rows = zip(texts.to_pylist(), numbers.to_pylist(), headers.to_pylist(), heads.to_pylist(), words.to_pylist())
        found = [decode(t, set(h or ()), n, p, lexicon_of(f))[0] for t, p, h, n, f in rows]
        kind = pa.list_(pa.struct([("line_no", pa.int32()), ("noise", pa.string())]))
        return pa.array([[{"line_no": a, "noise": b} for a, b in x] for x in found], kind)

    return rows.select(key, F.explode(F.arrow_udf(run, NOISE_TYPE)(text, F.col(page).cast("int"), "header_lines", "next_head", "found")).alias("_n")).select(key, "_n.*")


def repaired_paragraphs(pages: DataFrame, key: str = "page_key", file: str = "file_id", page: str = "page_no", text: str = "page_content") -> DataFrame:
    """``(<file>, first_page, paragraph_no, last_page, paragraph)``: the running text of each file, repaired.

    Of a page scanned twice the first scan counts.  A paragraph that goes on over
    the end of a page is one paragraph; it belongs to the page it begins on.
    """
    once = pages.where(F.col(text).isNotNull()).groupBy(file, page).agg(F.min_by(F.struct(key, text), key).alias("_p")).select(F.col(f"_p.{key}").alias(key), file, page, F.col(f"_p.{text}").alias(text))
    framed, lexicon_of = _with_words(_with_frames(once, key, file, page, text), pages, key, page, text)
    kind = "array<struct<paragraph:string,open:boolean,glue:boolean,small:boolean>>"

    def run(texts: pa.Array, numbers: pa.Array, headers: pa.Array, heads: pa.Array, words: pa.Array) -> pa.Array:
        out = []
        for t, p, h, n, f in zip(texts.to_pylist(), numbers.to_pylist(), headers.to_pylist(), heads.to_pylist(), words.to_pylist()):
            parts = paragraphs(decode(t, set(h or ()), n, p, lexicon_of(f))[1])
            rows = []
            for part in parts:
                glue = part[-1][2]
                body = " ".join(x.strip() for _, x, _ in part)
                ended = body.rstrip("\"”’»」』)")[-1:] in ".!?。！？:"
                rows.append({"paragraph": body, "open": glue or not ended, "glue": glue, "small": body[:1].islower() or body[:1].isdigit()})
            out.append(rows)
        struct = pa.struct([("paragraph", pa.string()), ("open", pa.bool_()), ("glue", pa.bool_()), ("small", pa.bool_())])
        return pa.array(out, pa.list_(struct))

    rows = framed.select(file, page, F.posexplode(F.arrow_udf(run, kind)(text, F.col(page).cast("int"), "header_lines", "next_head", "found")).alias("_at", "_x")).select(file, page, "_at", "_x.*")
    rows = durable(rows)
    # A page's first paragraph goes on with the last of the page before if that one is open.
    ends = rows.groupBy(file, page).agg(F.max_by(F.struct("open", "glue"), "_at").alias("_end"))
    before = ends.select(file, (F.col(page) + 1).alias(page), "_end")
    linked = rows.join(before, [file, page], "left").withColumn("_on", (F.col("_at") == 0) & F.coalesce("_end.open", F.lit(False)))
    begins = linked.where("not _on").groupBy(file, page).agg(F.max("_at").alias("_last"))
    block = F.floor(F.col(page) / PAGE_BLOCK).alias("_block")
    own = begins.select(file, page, F.struct(F.col(page).alias("p"), F.col("_last").alias("k")).alias("_b"))
    blocks = own.select(file, block, "_b").groupBy(file, "_block").agg(F.max("_b").alias("_b"))
    carried = blocks.select(file, "_block", F.last("_b", True).over(W.partitionBy(file).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)).alias("_carried"))
    conts = linked.where("_on").select(file, page, "paragraph", block).withColumn("_b", F.lit(None).cast("struct<p:int,k:int>"))
    line = own.select(file, page, F.lit(None).cast("string").alias("paragraph"), block, F.col("_b").cast("struct<p:int,k:int>").alias("_b")).unionByName(conts)
    inside = F.last("_b", True).over(W.partitionBy(file, "_block").orderBy(page, F.col("paragraph").isNull()).rowsBetween(W.unboundedPreceding, -1))
    found = line.withColumn("_inside", inside).where("paragraph is not null").join(carried, [file, "_block"], "left")
    start = F.coalesce("_inside", F.col("_carried").cast("struct<p:int,k:int>"), F.struct(F.col(page).cast("int").alias("p"), F.lit(0).alias("k")))
    pieces = found.select(file, page, "paragraph", start.alias("_s")).select(file, F.col("_s.p").alias("first_page"), F.col("_s.k").alias("paragraph_no"), page, "paragraph")
    firsts = linked.where("not _on").select(file, F.col(page).cast("int").alias("first_page"), F.col("_at").alias("paragraph_no"), page, "paragraph")
    parts = firsts.unionByName(pieces).groupBy(file, "first_page", "paragraph_no").agg(F.max(page).alias("last_page"), F.sort_array(F.collect_list(F.struct(page, "paragraph"))).alias("_parts"))
    text_of = F.aggregate("_parts", F.lit(""), lambda a, x: F.when(a == "", x["paragraph"]).when(a.rlike(rf"\p{{L}}[{BREAK_SIGNS}]$"), F.concat(F.regexp_replace(a, rf"[{BREAK_SIGNS}]$", ""), x["paragraph"])).otherwise(F.concat(a, F.lit(" "), x["paragraph"])))
    return parts.select(file, "first_page", "paragraph_no", "last_page", text_of.alias("paragraph"))


