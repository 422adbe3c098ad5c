"""Assign a language and a confidence to each text and to each segment of mixed texts.

Each language has a raw-content zstandard dictionary of its prose.  A sentence
belongs to the language whose dictionary makes it smallest; where the next one
makes it about as small, the sentence is left to its neighbours.  The compressor
without a dictionary competes too: what no dictionary makes smaller is in no
language that is known, whatever its script.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.spread import spread
from .lookalikes import UNSEEN, looks

#: Two-letter codes and the names under which labels give them (besides locales such as ``en-US``).
NAMES = {
    "en": ["en", "eng", "english", "englisch", "anglais", "inglés"],
    "ko": ["ko", "kor", "korean", "한국어", "koreanisch"],
    "de": ["de", "deu", "ger", "german", "deutsch"],
    "fr": ["fr", "fra", "fre", "french", "français", "francais"],
    "es": ["es", "spa", "spanish", "español", "espanol", "castellano"],
    "ja": ["ja", "jpn", "japanese", "日本語"],
    "pt": ["pt", "por", "portuguese", "português", "portugues"],
}
#: Labelled documents per language that dictionaries are made of, and characters taken of each: the bound of the fit.
SAMPLE_DOCS, SAMPLE_CHARS = 512, 4000
#: Bytes of a dictionary.
DICT_BYTES = 1 << 18
#: How hard compressors search, and the size up to which dictionaries are searched so: over a quarter of a million bytes, a level stands for a weaker search.
LEVEL, SEARCHED = 12, 200_000
#: How often a language must have a sentence, against the one that has it most, to keep it.
SHARED = 0.3
#: Sentences that a worker remembers.
REMEMBERED = 100_000
UNKNOWN = "und"
SEGMENTS_TYPE = "array<struct<seg_start:int,seg_end:int,lang_code:string,confidence:double,sentences:int>>"

#: Signs of code, what stands for an option, and names of programs; runs of Latin letters and signs in other scripts.
_CODED, _OPTION, _NAMED = re.compile(r"[\d/\\_=<>$#@|{}\[\]`~^]"), re.compile(r"[-‐]{1,2}\w"), re.compile(r"\b[A-Z]{2,}(?:-[A-Z]+)*\b|\b[A-Z][a-z]+[A-Z]\w*\b")
_LATIN_RUN, _LATIN_LETTERS = re.compile(r"[A-Za-z0-9/\\_=<>$#@|{}\[\]`~^:.,+-]+"), re.compile(r"[A-Za-z]+")
_STOP = re.compile(r"(?<![.!?])[.!?]++[\"”’»」』)]*(?=\s|$)|[。！？]+[\"”’»」』)]*|\n")
_WIDE = re.compile(r"[぀-ヿ㐀-鿿가-힣ｦ-ﾟ]")
_HANGUL = re.compile(r"[ᄀ-ᇿ㄰-㆏가-힣]")
_KANA = re.compile(r"[぀-ヿｦ-ﾟ]")
_LETTER = re.compile(r"[^\W\d_]")
#: Letters of other scripts that stand for Latin ones, and characters that cannot be seen.
_LOOKS = {ord(a): b for a, b in looks().items() if b.isascii()} | dict.fromkeys(UNSEEN)
_MARK = re.compile(r"^\s*(?:[-*•>#|]+|\(?\d{1,4}[.):])\s+")


def code_of(label: Column) -> Column:
    """The two-letter code that a label means, in any spelling; null if it names none of ``NAMES``."""
    first = F.split(F.lower(F.trim(label)), "[-_ ]").getItem(0)
    known = F.create_map(*[F.lit(x) for code, names in NAMES.items() for n in names for x in (n, code)])
    return F.try_element_at(known, first)


def prose(sentence: str) -> tuple[str, str]:
    """``(words, script)`` of a sentence without what belongs to no language; no words if little else is left."""
    if sentence[:1] == "|":  # a row of a table
        return "", ""
    if not sentence.isascii():
        sentence = unicodedata.normalize("NFKC", sentence.translate(_LOOKS))
    wide = len(_WIDE.findall(sentence))
    body = _MARK.sub("", sentence).strip()
    if wide:
        words = " ".join(_LATIN_RUN.sub(_without_latin, body).split())
        left = len(_WIDE.findall(words))
        if left < 5 or left < 0.25 * len(_LETTER.findall(body)):
            return _latin(body)
        hangul, kana = len(_HANGUL.findall(words)), len(_KANA.findall(words))
        return words, "hangul" if hangul >= max(1, left // 2) else "kana" if kana else "han"
    return _latin(body)


def _without_latin(run: re.Match) -> str:
    """Nothing of a run that is code; else its signs."""
    return " " if _CODED.search(run[0]) else _LATIN_LETTERS.sub(" ", run[0])


def _latin(body: str) -> tuple[str, str]:
    chunks = body.split()
    kept = " ".join(x for x in chunks if not _CODED.search(x) and not _OPTION.match(x))
    words = [w for w in _NAMED.sub(" ", kept).split() if _LETTER.search(w)]
    if len(words) < 2 or 2 * len(words) < len(chunks) or len(words) < 3 and not re.search(r"[.!?][\"”’»」)]*$", body):
        return "", ""
    return " ".join(words), "latin"


def sentences(text: str) -> list[tuple[int, int]]:
    """Where each sentence or line begins and ends, blanks around it left out."""
    out, at = [], 0
    for a, b, end in [*((m.start(), m.end(), m[0]) for m in _STOP.finditer(text)), (len(text), len(text), "\n")]:
        piece = text[at : a if end == "\n" else b]
        body = piece.strip()
        if body:
            start = at + len(piece) - len(piece.lstrip())
            out.append((start, start + len(body)))
        at = b
    return out


class Compressors:
    """A compressor per language and one without a dictionary, with the memory of a bounded number of sentences."""

    def __init__(self, dictionaries: dict[str, bytes], scripts: dict[str, list[str]], level: int = LEVEL) -> None:
        self.scripts = scripts
        self.by: dict[str, zstandard.ZstdCompressor] = {}
        # One search for all: by the size of each, a language would gain a tenth on others only because its dictionary is smaller.
        size = min(SEARCHED, max(map(len, dictionaries.values()), default=0))
        search = zstandard.ZstdCompressionParameters.from_level(level, dict_size=size, window_log=DICT_BYTES.bit_length(), write_content_size=False, write_checksum=False, write_dict_id=False)
        for lang, raw in sorted(dictionaries.items()):
            data = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(compression_params=search)
            self.by[lang] = zstandard.ZstdCompressor(compression_params=search, dict_data=data)
        self.plain = zstandard.ZstdCompressor(level=level, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.sizes = lru_cache(maxsize=REMEMBERED)(self._sizes)

    def _sizes(self, words: str, script: str) -> tuple[int, dict[str, int]]:
        """Compressed size without a dictionary, and with those of the script's languages."""
        raw = words.lower().encode("utf-8", "replace")
        return len(self.plain.compress(raw)), {lang: len(self.by[lang].compress(raw)) for lang in self.scripts.get(script, [])}


def best(sizes: dict[str, int]) -> tuple[str, float]:
    """The language that makes a text smallest and, from 0 to 1, how much smaller than the next."""
    if not sizes:
        return UNKNOWN, 0.0
    order = sorted(sizes.items(), key=lambda x: (x[1], x[0]))
    if len(order) == 1:
        return order[0][0], 1.0
    gain = (order[1][1] - order[0][1]) / max(1, order[1][1])
    return order[0][0], min(1.0, gain * 2.5)


#: Confidence below which a sentence is no case of its own, and below which a whole text has no language.
FIRM, WEAK = 0.25, 0.04
#: Bytes by which another language must beat the main one of a text to have a sentence of it.
APART = 4
#: Share by which the dictionary of a language must make all its sentences in a text smaller than no dictionary does.
FIT = 0.05


def segments(text: str, model: Compressors) -> list[tuple[int, int, str, float, int]]:
    """Stretches ``(start, end, language, confidence, sentences)`` of a text, in order.

    A sentence goes to another language than the main one of the text only if that
    one makes it firmly smaller, by ``APART`` bytes and twice ``FIT`` of its size.  Sentences of a language whose
    dictionary hardly helps with them are ``und``.
    """
    spans = []
    for a, b in sentences(text):
        words, script = prose(text[a:b])
        if words:
            plain, sizes = model.sizes(words, script)
            lang, sure = best(sizes)
            if len(sizes) == 1:  # the only language of its script: compared with no dictionary
                sure = min(1.0, max(0.0, 1 - sizes[lang] / max(1, plain)) * 2.5)
            spans.append([a, b, lang if sure >= FIRM or len(sizes) == 1 else "" if sizes else UNKNOWN, sure, sizes, len(words), plain])
    if not spans:
        return []
    letters: Counter = Counter()
    total: Counter = Counter()
    for s in spans:
        total.update(s[4])
        if s[2]:
            letters[s[2]] += s[5]
    if letters:
        main = max(sorted(letters), key=letters.__getitem__)
    else:
        main, sure = best(dict(total))
        main = main if sure >= WEAK else UNKNOWN
    size: Counter = Counter()
    plain: Counter = Counter()
    for s in spans:
        if not s[2]:
            s[2] = main if main in s[4] or main == UNKNOWN else best(s[4])[0]
        elif s[2] != main and main in s[4] and (s[4][main] - s[4][s[2]] < APART or s[4][s[2]] > (1 - 2 * FIT) * s[6]):
            s[2] = main
        size[s[2]] += s[4].get(s[2], s[6])
        plain[s[2]] += s[6]
    out: list[list] = []
    for a, b, lang, sure, _, n, _ in spans:
        lang = lang if size[lang] <= (1 - FIT) * plain[lang] else UNKNOWN
        sure = sure if lang != UNKNOWN else 0.0
        if out and out[-1][2] == lang:
            last = out[-1]
            last[1], last[3], last[4], last[5] = b, last[3] + sure * n, last[4] + 1, last[5] + n
        else:
            out.append([a, b, lang, sure * n, 1, n])
    return [(a, b, lang, s / n, k) for a, b, lang, s, k, n in out]


def train(labelled: DataFrame, text: str = "text", lang: str = "lang") -> tuple[dict[str, bytes], dict[str, list[str]]]:
    """Dictionaries of the languages of ``labelled`` rows, and which of them use a script.

    Of each language at most ``SAMPLE_DOCS`` documents are used, the first of each
    class of hashes, and ``SAMPLE_CHARS`` characters of each.  Sentences that the
    dictionary of another language fits much better are taken out, so some wrong
    labels do no harm.
    """
    code = code_of(F.col(lang))
    rows = labelled.where(F.col(text).isNotNull()).select(code.alias("_code"), F.substring(text, 1, SAMPLE_CHARS).alias("_text"), F.xxhash64(text).alias("_hash"))
    picked = rows.where(F.col("_code").isNotNull()).groupBy("_code", F.pmod("_hash", F.lit(SAMPLE_DOCS)).alias("_class")).agg(F.min_by("_text", "_hash").alias("_text"))
    found: dict[str, list[tuple[str, str]]] = {}
    for row in sorted(picked.collect(), key=lambda r: (r[0], r[1])):
        found.setdefault(row["_code"], []).extend(prose(row["_text"][a:b]) for a, b in sentences(row["_text"]))
    count: dict[tuple[str, str], Counter] = {}
    for lang, parts in sorted(found.items()):
        for x in parts:
            if x[0]:
                count.setdefault(x, Counter())[lang] += 1
    # A sentence stays under the labels that have it about as often as any; then each half is cleaned by dictionaries of the other.
    size = Counter(lang for by in count.values() for lang in by.elements())
    halves: list[dict[str, list[tuple[str, str]]]] = [{lang: [] for lang in found} for _ in range(2)]
    for x, by in sorted(count.items()):
        most = max(n / size[lang] for lang, n in by.items())
        for lang, n in by.items():
            if n / size[lang] >= SHARED * most:
                halves[hash_of(x[0]) % 2][lang].append(x)
    clean: dict[str, list[tuple[str, str]]] = {lang: [] for lang in found}
    for half, other in (halves, halves[::-1]):
        model = _build(other, count)
        for lang, parts in half.items():
            for words, script in parts:
                best_lang, sure = best(model.sizes(words, script)[1])
                if best_lang in (lang, UNKNOWN) or sure < 2 * FIRM:
                    clean[lang].append((words, script))
    return _dictionaries(clean, count), _scripts(clean)


def _dictionaries(found: dict[str, list[tuple[str, str]]], count: dict[tuple[str, str], Counter]) -> dict[str, bytes]:
    """Whole sentences up to ``DICT_BYTES``: if not all fit, the commonest of each language."""
    out = {}
    for lang, parts in found.items():
        lines, left = [], DICT_BYTES
        for x in sorted(parts, key=lambda x: (-count[x][lang], hash_of(x[0]))):
            line = x[0].lower().encode() + b"\n"
            left -= len(line)
            if left < 0:
                break
            lines.append(line)
        out[lang] = b"".join(lines[::-1]) or b"\n" * 16  # the commonest last, where references to them are shortest
    return out


def hash_of(text: str) -> int:
    """A fixed order of texts that has nothing to do with what they say."""
    import xxhash

    return xxhash.xxh64_intdigest(text)


def _scripts(found: dict[str, list[tuple[str, str]]]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for lang, parts in sorted(found.items()):
        count = Counter(s for _, s in parts)
        for script, n in count.items():
            if n >= 0.1 * sum(count.values()) or script == "han":
                out.setdefault(script, []).append(lang)
    if "kana" in out:
        out.setdefault("han", out["kana"])
    return out


def _build(found: dict[str, list[tuple[str, str]]], count: dict[tuple[str, str], Counter]) -> Compressors:
    return Compressors(_dictionaries(found, count), _scripts(found))


def language_segments(df: DataFrame, text: str, model: tuple[dict[str, bytes], dict[str, list[str]]], out: str = "segments") -> DataFrame:
    """``df`` with a column ``out``: the stretches of each text with language and confidence.

    Null, empty and text without any prose (logs, tables, commands) give an empty
    array.  ``model`` comes from :func:`train`; its size is bounded.  A column of
    ``df`` that is called ``out`` is replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> pa.Array:
        known = _model(shared)
        kind = pa.list_(pa.struct([("seg_start", pa.int32()), ("seg_end", pa.int32()), ("lang_code", pa.string()), ("confidence", pa.float64()), ("sentences", pa.int32())]))
        names = ("seg_start", "seg_end", "lang_code", "confidence", "sentences")
        return pa.array([[dict(zip(names, s)) for s in segments(t, known)] if t else [] for t in texts.to_pylist()], kind)

    return df.withColumn(out, F.arrow_udf(run, SEGMENTS_TYPE)(F.col(text)))


_models: list[tuple[object, Compressors]] = []


def _model(shared) -> Compressors:
    """The compressors of a broadcast model, made once in each worker; the model itself is kept, so another one is never taken for it."""
    value = shared.value
    if not _models or _models[0][0] is not value:
        _models[:] = [(value, Compressors(*value))]
    return _models[0][1]


def detect(df: DataFrame, text: str, model) -> DataFrame:
    """``df`` with ``languages``: language, share of the sentences and mean confidence, largest first.

    A text in one language has one entry; one without prose has none; a text whose
    language stays open has the entry ``und``.
    """
    seg = F.col("segments")
    codes = F.array_distinct(F.transform(seg, lambda s: s["lang_code"]))
    total = F.aggregate(seg, F.lit(0), lambda a, s: a + s["sentences"])

    def entry(code: Column) -> Column:
        own = F.filter(seg, lambda s: s["lang_code"] == code)
        n = F.aggregate(own, F.lit(0), lambda a, s: a + s["sentences"])
        sure = F.aggregate(own, F.lit(0.0), lambda a, s: a + s["confidence"] * s["sentences"])
        return F.struct((n / total).alias("share"), code.alias("lang_code"), (sure / n).alias("confidence"))

    return language_segments(df, text, model).withColumn("languages", F.sort_array(F.transform(codes, entry), asc=False))


def label_cases(df: DataFrame, key: str, text: str, label: str, model) -> DataFrame:
    """Rows ``(<key>, lang_code)``: the language of texts whose label is missing or another, all languages of mixed texts."""
    plain = spread(df.select(F.col(key).alias("_key"), F.col(text).alias("_text"), code_of(F.col(label)).alias("_label")))
    found = detect(plain, "_text", model).select(F.col("_key").alias(key), "_label", F.transform("languages", lambda x: x["lang_code"]).alias("_codes"))
    known = F.filter("_codes", lambda c: c != UNKNOWN)
    rows = found.select(key, "_label", known.alias("_codes")).where((F.size("_codes") > 1) | (F.size("_codes") == 1) & ~F.col("_codes")[0].eqNullSafe(F.col("_label")))
    return rows.select(key, F.explode("_codes").alias("lang_code"))
