"""Find texts that hold passages of held-out items.

Letters and digits of a text form one stream, without case, blanks and signs.
Its q-grams are looked up among those of the items; the shared ones are counted
in overlapping bands of diagonals (place in the text less place in the item), and
bands that reach the count which the allowed edits must leave are verified by an
alignment of words around the runs that both hold.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import flatten, owners, slices

#: Letters of a q-gram.
GRAM = 7
#: Words in a row, without an edit, that every passage with one edit in eight words holds: of 7e words between e edits, e + 1 stretches, one has 5.
RUN = 5
#: Width of a band of diagonals; bands overlap by half, so words added or changed in a passage keep it in one band.
BAND = 64
#: Code points of a text looked at together, small enough for the processor's cache.
SLICE = 400_000
#: Characters of items held in the workers at a time; more items are searched in blocks of this size.
BLOCK_CHARS = 8_000_000
#: Bits of the table that turns most q-grams away.
SIEVE_BITS = 22

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MARK = re.compile(r"(?m)^[ \t]*(?:(?:[>#*|•–-]+|\(?\d{1,4}[.):\]|])[ \t]+)+")
_BROKEN = re.compile(r"(?<=\w)[-‐]\n(?=\w)")
_SIGN = re.compile(r"(?:_|[^\w\s])+")
#: Characters of scripts without blanks between words, each of which is a word here; how many of them make up a word of other scripts.
_UNSPACED, UNSPACED_CHARS = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]"), 2
#: Blocks of items that a worker holds in one scan.
BLOCKS_AT_ONCE = 4


@lru_cache(maxsize=1)
def _fold() -> np.ndarray:
    """Each code point in lower case, or 0 if it is neither letter, digit nor mark."""
    out = np.zeros(0x110000, np.uint32)
    for p in range(0x30000):
        if 0x3400 <= p < 0xD7A4:
            out[p] = p if unicodedata.category(chr(p))[0] in "LNM" else 0
        elif unicodedata.category(chr(p))[0] in "LNM":
            low = chr(p).lower()
            out[p] = ord(low) if len(low) == 1 else p
    return out


def words_of(text: str) -> list[str]:
    """Words of a text, as blanks part them, without case, line marks and signs (``n'en`` is one word); of scripts without blanks, characters."""
    plain = _SIGN.sub("", _MARK.sub("", text).lower())
    if not plain.isascii():
        plain = _UNSPACED.sub(r" \g<0> ", plain)
    return plain.split()


def _grams(stream: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` letters from each place on (places near the end give none)."""
    n = len(stream) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    letters = stream.astype(np.uint64)
    out = letters[:n].copy()
    for k in range(1, GRAM):
        out *= _BASE
        out += letters[k : k + n]
    out ^= out >> np.uint64(29)
    out *= _BASE
    return out


class Items:
    """The q-grams of a block of items, and what the allowed edits leave of each."""

    def __init__(self, ids: list[int], texts: list[str], words: int, rate: int) -> None:
        self.ids, self.words, self.rate = np.array(ids, np.int64), words, rate
        self.tokens = [words_of(t) for t in texts]
        streams = [np.array([ord(c) for c in "".join(t)], np.uint32) for t in self.tokens]
        grams = [_grams(s) for s in streams]
        hashes = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        order = np.argsort(hashes, kind="stable")
        self.owner, self.place = owner[order], place[order]
        self.hashes, self.first, self.count = np.unique(hashes[order], return_index=True, return_counts=True)
        self.sieve = np.zeros(1 << SIEVE_BITS, bool)
        self.sieve[(self.hashes >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)] = True
        self.runs = [_runs_of(t) for t in self.tokens]
        self.longest = max((len(s) for s in streams), default=0)
        self.scale = [UNSPACED_CHARS if 2 * sum(bool(_UNSPACED.match(w)) for w in t) > len(t) else 1 for t in self.tokens]
        self.least = np.array([self._least([len(w) for w in t], words * n) for t, n in zip(self.tokens, self.scale)], np.int64)

    def _least(self, sizes: list[int], words: int) -> int:
        """Fewest q-grams that a passage of so many words keeps if one of them is changed; more than any text has if the item is shorter."""
        if len(sizes) < words:
            return 1 << 40
        least = 1 << 40
        for a in range(len(sizes) - words + 1):
            part = sizes[a : a + words]
            total = sum(part)
            before = 0
            for w in part:
                kept = max(0, before - GRAM + 1) + max(0, total - before - w - GRAM + 1)
                least = min(least, kept)
                before += w
        return max(1, least)


def _runs_of(words: list[str]) -> dict[tuple[str, ...], list[int]]:
    out: dict[tuple[str, ...], list[int]] = {}
    for k in range(len(words) - RUN + 1):
        out.setdefault(tuple(words[k : k + RUN]), []).append(k)
    return out


def _covered(a: list[str], b: list[str], most: int) -> list[int]:
    """Words of ``a`` that can be aligned with the front of ``b`` with 0, 1, ... ``most`` edits, ending with words that agree.

    On each diagonal of the band only the farthest place reached is kept.
    """
    out, best = [], 0
    last: dict[int, int] = {}
    for e in range(most + 1):
        now: dict[int, int] = {}
        for d in range(-e, e + 1):
            i = max(last.get(d, -2) + 1, last.get(d - 1, -1), last.get(d + 1, -2) + 1) if e else 0
            if i < 0 or i > len(a) or i + d < 0 or i + d > len(b):
                continue
            begin = i
            while i < len(a) and i + d < len(b) and a[i] == b[i + d]:
                i += 1
            now[d] = i
            if i > begin:
                best = max(best, i)
        out.append(best)
        last = now
    return out


def holds(item: list[str], item_runs: dict[tuple[str, ...], list[int]], text: list[str], text_runs: dict[tuple[str, ...], list[int]], words: int, rate: int) -> bool:
    """Whether ``text`` holds ``words`` words in a row of ``item``, at most one in ``rate`` changed, added or left out.

    Each longest stretch of at least ``RUN`` words that both hold is extended to
    both sides, edit by edit; a passage begins and ends with words that agree.
    """
    both = {(i, j) for run in item_runs.keys() & text_runs.keys() for i in item_runs[run] for j in text_runs[run]}
    most = len(item) // rate
    for i, j in both:
        if (i - 1, j - 1) in both:
            continue
        size = RUN
        while (i + size - RUN + 1, j + size - RUN + 1) in both:
            size += 1
        if size >= words:
            return True
        reach = len(item) + most
        right = _covered(item[i + size :], text[j + size : j + size + reach], most)
        left = _covered(item[:i][::-1], text[max(0, j - reach) : j][::-1], most)
        if any(size + left[x] + right[y] >= max(words, rate * (x + y)) for x in range(most + 1) for y in range(most + 1 - x)):
            return True
    return False


def _search(ids: pa.Array, texts: pa.Array, items: Items) -> tuple[list, list]:
    keys, found = [], []
    one_doc = max(2, items.longest)
    for a, b in slices(texts, SLICE):
        points, offsets = flatten(texts.slice(a, b - a))
        letters = _fold()[points]
        kept = letters != 0
        owner = owners(offsets)[kept]
        grams = _grams(letters[kept])
        hit = np.flatnonzero(items.sieve[(grams >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)])
        if not len(hit):
            continue
        spot = np.minimum(np.searchsorted(items.hashes, grams[hit]), len(items.hashes) - 1)
        real = (items.hashes[spot] == grams[hit]) & (owner[hit] == owner[hit + GRAM - 1])
        hit, spot = hit[real], spot[real]
        rows = owner[hit]
        enough = np.bincount(rows, minlength=b - a) >= items.least.min()
        hit, spot, rows = hit[enough[rows]], spot[enough[rows]], rows[enough[rows]]
        if not len(hit):
            continue
        times = items.count[spot]
        at = np.repeat(items.first[spot], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        item, row, place = items.owner[at], np.repeat(rows, times), np.repeat(hit, times)
        begin = np.searchsorted(owner, np.arange(b - a))
        diagonal = place - begin[row] - items.place[at] + one_doc
        band = diagonal // (BAND // 2)
        wide = int(band.max()) + 2
        base = (row * len(items.ids) + item) * wide
        band_keys = np.concatenate([base + band, base + band + 1])  # every place lies in two bands
        gram_keys = np.concatenate([items.place[at]] * 2)
        # A q-gram that repeats counts once in a band.
        bands, counts = _distinct_counts(band_keys, gram_keys)
        pair = bands // wide
        good = counts >= items.least[pair % len(items.ids)]
        last, plain, joined = -1, ([], {}), ([], {})
        for p in sorted(set(pair[good].tolist())):
            doc, k = divmod(p, len(items.ids))
            if doc != last:
                text = texts[a + doc].as_py()
                whole = _BROKEN.sub("", text)
                plain, joined = ((w, _runs_of(w)) for w in (words_of(text), words_of(whole) if whole != text else []))
                last = doc
            scale = items.scale[k]
            if any(holds(items.tokens[k], items.runs[k], words, runs, items.words * scale, items.rate * scale) for words, runs in (plain, joined)):
                keys.append(ids[a + doc].as_py())
                found.append(int(items.ids[k]))
    return keys, found


def _distinct_counts(keys: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key and how many different parts it has."""
    wide = int(parts.max()) + 1
    both = np.sort(keys * wide + parts)
    both = both[np.concatenate([[True], both[1:] != both[:-1]])] // wide
    first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
    return both[first], np.diff(np.append(first, len(both)))


_built: list[tuple[object, list[Items]]] = []


def _blocks(value: list[list[tuple[int, str]]], words: int, rate: int) -> list[Items]:
    """The q-grams of broadcast blocks of items, made once in each worker."""
    if not _built or _built[0][0] is not value:
        _built[:] = [(value, [Items([k for k, _ in part], [t for _, t in part], words, rate) for part in value])]
    return _built[0][1]


def find_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", words: int = 12, rate: int = 8) -> DataFrame:
    """Rows ``(<key>, <item_key>)``, each once, of documents that hold a passage of an item.

    A passage is at least ``words`` words in a row of the item, of which at most
    one in ``rate`` is changed, added or left out; of scripts without blanks, twice
    as many characters.  All documents are searched for all items, the items in
    blocks of ``BLOCK_CHARS`` characters, ``BLOCKS_AT_ONCE`` of them in one scan, so
    what a worker holds is bounded.  A word added to a passage that is longer than
    half of ``BAND`` letters parts it into two.  Null or empty texts and items
    shorter than ``words`` hold nothing; a document key that repeats counts once.
    """
    schema = T.StructType([docs.schema[key], T.StructField(item_key, T.LongType())])
    out: DataFrame | None = None
    blocks: list[list[tuple[int, str]]] = [[]]
    chars = 0

    def search(parts: list[list[tuple[int, str]]]) -> DataFrame:
        packed = docs.sparkSession.sparkContext.broadcast(parts)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for known in _blocks(packed.value, words, rate):
                    keys, found = _search(batch.column(0), batch.column(1), known) if len(known.hashes) else ([], [])
                    yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(found, pa.int64())], names=[key, item_key])

        return docs.where(F.col(text).isNotNull()).select(key, text).mapInArrow(run, schema)

    for row in items.where(F.col(item_text).isNotNull()).select(item_key, item_text).toLocalIterator():
        if chars >= BLOCK_CHARS:
            if len(blocks) == BLOCKS_AT_ONCE:
                out, blocks = search(blocks) if out is None else out.unionByName(search(blocks)), []
            blocks, chars = [*blocks, []], 0
        blocks[-1].append((row[0], row[1]))
        chars += len(row[1])
    out = search(blocks) if out is None else out.unionByName(search(blocks))
    return out.distinct()
