"""Bring texts that look the same to one string, and find rows that do.

Texts are exploded to positioned code points, in flat arrays of a batch; the
decomposition and look-alike tables, the same in each worker, are joined on by
code point; combining marks are put in the order of their class and recomposed;
the strings are rebuilt.  What a reader can tell apart
(case, accents, superscripts, circled digits, kinds of quotes) stays apart.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .durable import durable
from .frames import flatten, owners, rebuild, slices

#: Letters of other scripts and the Latin letters that they cannot be told from.
CYRILLIC, CYRILLIC_AS = "АВЕКМНОРСТХЅІЈҮаеорсухѕіјһӏԁԛԝ", "ABEKMHOPCTXSIJYaeopcyxsijhldqw"
GREEK, GREEK_AS = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϳ", "ABEZHIKMNOPTYXoj"
ARMENIAN, ARMENIAN_AS = "ՕՏԼՍհոսօ", "OSLUhnuo"
CHEROKEE, CHEROKEE_AS = "ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᏚᎢᏙᎳᏃᎽᎡ", "ABCDEGHJKLMPSTVWZYR"
COPTIC, COPTIC_AS = "ⲀⲂⲎⲔⲘⲚⲞⲟⲢⲣⲤⲥⲦⲬ", "ABHKMNOoPpCcTX"
LISU, LISU_AS = "ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"
#: Ideographs and hiragana that are drawn like a katakana.
KANA, KANA_AS = "力口工二八夕卜へべぺ", "カロエニハタトヘベペ"
OTHER, OTHER_AS = "ɑɡ", "ag"
#: Blocks whose compatibility forms are drawn like the characters they stand for: ligatures, letter pairs, Roman numerals, radicals.
DRAWN_ALIKE = [(0x0132, 0x0133), (0x01C4, 0x01CC), (0x01F1, 0x01F3), (0x2160, 0x217F), (0x2E80, 0x2FD5), (0xFB00, 0xFB06), (0xFB13, 0xFB17)]
#: Code points that leave no mark on the page.
UNSEEN = [0x00AD, 0x034F, 0x061C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), *range(0x2066, 0x2070), 0xFEFF]
#: Hyphens drawn like the hyphen-minus, and other signs for a new line.
HYPHENS, NEW_LINES = [0x2010, 0x2011], [0x0085, 0x2028, 0x2029]

#: Rows of one stored form that are joined in one task.
SLOT_ROWS = 20_000
GONE = 0xFFFFFFFF
LONG = 0xFFFFFFFE


def looks() -> dict[str, str]:
    """Characters of other scripts and those that they cannot be told from."""
    pairs = ((CYRILLIC, CYRILLIC_AS), (GREEK, GREEK_AS), (ARMENIAN, ARMENIAN_AS), (CHEROKEE, CHEROKEE_AS), (COPTIC, COPTIC_AS), (LISU, LISU_AS), (KANA, KANA_AS), (OTHER, OTHER_AS))
    return {a: b for x, y in pairs for a, b in zip(x, y)}


def _mapped(char: str, plain: dict[str, str]) -> str:
    """What one character is compared as, before marks are put in order."""
    if char in plain:
        return plain[char]
    kind, _, rest = unicodedata.decomposition(char).partition("> ")
    if kind in ("<wide", "<narrow", "<noBreak") or kind == "<compat" and any(a <= ord(char) <= b for a, b in DRAWN_ALIKE):
        return "".join(plain.get(x, x) for x in (chr(int(p, 16)) for p in rest.split()))
    if unicodedata.category(char) == "Zs" or char == "\t":
        return " "
    apart = unicodedata.normalize("NFD", char)
    if apart != char and any(x in plain for x in apart):
        return unicodedata.normalize("NFC", "".join(plain.get(x, x) for x in apart))
    return char


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, dict[int, np.ndarray], np.ndarray]:
    """``(one, long, marks)``: code point to code point, to several, and whether it takes part in composition."""
    plain = looks()
    plain |= {chr(p): "" for p in UNSEEN} | {chr(p): "-" for p in HYPHENS} | {chr(p): "\n" for p in NEW_LINES}
    one, long, marks = np.arange(0x110000, dtype=np.uint32), {}, np.zeros(0x110000, bool)
    for p in range(0x80, 0x30000):
        char = chr(p)
        if (0x3400 <= p < 0xA000 or 0xAC00 <= p < 0xD7A4 or 0xD800 <= p < 0xF900) and char not in plain:
            continue
        to = _mapped(char, plain)
        if len(to) == 1:
            one[p] = ord(to)
        else:
            one[p] = LONG if to else GONE
            if to:
                long[p] = np.array([ord(x) for x in to], np.uint32)
        marks[p] = unicodedata.combining(char) > 0 or unicodedata.normalize("NFC", char) != char
    one[ord("\t")] = ord(" ")
    marks[0x1100:0x1200] = marks[0xA960:0xA980] = marks[0xD7B0:0xD800] = True
    return one, long, marks


def canonical_points(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mapped code points, their offsets, and the rows whose marks have yet to be ordered and composed."""
    one, long, marks = tables()
    owner = owners(offsets)
    to = one[points]
    returns = points == 13
    if returns.any():  # CR LF is one line end, a lone CR is another
        before_feed = returns.copy()
        before_feed[:-1] &= (points[1:] == 10) & (owner[1:] == owner[:-1])
        before_feed[-1:] = False
        to[returns], to[before_feed] = 10, GONE
    if (to >= LONG).any():
        size = np.ones(len(to), np.int64)
        size[to == GONE] = 0
        several = np.flatnonzero(to == LONG)
        size[several] = [len(long[int(p)]) for p in points[several]]
        place = np.cumsum(size) - size
        out = np.repeat(to, size)
        for k in several:
            out[place[k] : place[k] + size[k]] = long[int(points[k])]
        to, owner = out, np.repeat(owner, size)
        counts = np.bincount(owner, minlength=len(offsets) - 1)
        offsets = np.concatenate([[0], np.cumsum(counts)])
    return to, offsets, np.unique(owner[marks[to]])


def canonical_texts(texts: pa.Array) -> pa.Array:
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    parts = []
    for a, b in slices(texts):
        part = texts.slice(a, b - a)
        points, offsets = flatten(part)
        to, offsets, open_rows = canonical_points(points, offsets)
        out = rebuild(to, offsets, part.is_valid().to_numpy(zero_copy_only=False))
        if len(open_rows):
            # Marks by class, then composition: the normal form C of Unicode does both.
            done = [unicodedata.normalize("NFC", x) for x in out.take(pa.array(open_rows)).to_pylist()]
            mask = np.zeros(b - a, bool)
            mask[open_rows] = True
            out = pc.replace_with_mask(out, pa.array(mask), pa.array(done, out.type))
        parts.append(out.cast(pa.string()))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def _canonical_udf(texts: pa.Array) -> pa.Array:
    return canonical_texts(texts)


def canonical(text: Column) -> Column:
    """The one form of all texts that look like ``text``; null stays null, empty stays empty."""
    return F.arrow_udf(_canonical_udf, "string")(text)


def lookalike_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(<key>, class_id, form_id, forms, form_rows)`` of the rows that read like another row which is stored in other characters.

    ``class_id`` is the smallest key of all rows that read the same, ``form_id`` the
    smallest one stored in the same characters; ``forms`` counts the stored forms of
    the class and ``form_rows`` the rows of the form.  Two rows are look-alikes if
    their class is one and their form is not.  Classes and forms are told apart by
    two independent 64-bit hashes each.  Rows with a null key or text are in none.
    """
    members = _members(df, key, text)
    classes = members.groupBy("_l1", "_l2").agg(F.min("_least").alias("class_id"))
    return members.join(classes, ["_l1", "_l2"]).select(F.col("_key").alias(key), "class_id", F.col("_least").alias("form_id"), F.col("_forms").alias("forms"), F.col("_n").alias("form_rows"))


def _members(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows of classes with several forms: key, hashes of class and form, and of the form its rows and least key."""
    own, look = F.col(text), canonical(F.col(text))
    rows = df.where(own.isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("_key"), look.alias("_look"), F.xxhash64(own).alias("_f1"), F.xxhash64(F.lit(1), own).alias("_f2"))
    rows = durable(rows.select("_key", F.xxhash64("_look").alias("_l1"), F.xxhash64(F.lit(1), "_look").alias("_l2"), "_f1", "_f2"))
    forms = rows.groupBy("_l1", "_l2", "_f1", "_f2").agg(F.count("*").alias("_n"), F.min("_key").alias("_least"))
    several = forms.groupBy("_l1", "_l2").agg(F.count("*").alias("_forms")).where("_forms > 1")
    return rows.join(forms.join(several, ["_l1", "_l2"]), ["_l1", "_l2", "_f1", "_f2"])


def lookalike_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """Pairs ``(<key>_a, <key>_b)``, smaller key first, of rows that read the same but differ as stored.

    Only classes with two stored forms or more are expanded, first form to form, then
    form to rows, so exact copies are never compared with each other.  The rows of a
    form are cut into slots, so that a pair of large forms is many tasks.  Rows with
    a null key or text take part in no pair; two nulls are no pair.  For the classes
    themselves, without expansion, see :func:`lookalike_classes`.
    """
    slots = F.ceil(F.col("_n") / SLOT_ROWS).cast("int")
    members = durable(_members(df, key, text).withColumn("_slot", F.pmod(F.xxhash64("_key", F.lit(5)), slots).cast("int")))
    forms = members.groupBy("_l1", "_l2", "_f1", "_f2").agg(F.max("_n").alias("_n")).withColumn("_slots", slots)
    side = lambda x: forms.select("_l1", "_l2", F.struct("_f1", "_f2").alias(f"_f{x}"), F.sequence(F.lit(0), F.col("_slots") - 1).alias(f"_slots{x}"))
    pairs = side("a").join(side("b"), ["_l1", "_l2"]).where("_fa < _fb").withColumn("_sa", F.explode("_slotsa")).withColumn("_sb", F.explode("_slotsb"))
    rows = lambda x: members.select("_l1", "_l2", F.struct("_f1", "_f2").alias(f"_f{x}"), F.col("_slot").alias(f"_s{x}"), F.col("_key").alias(f"_k{x}"))
    found = pairs.drop("_slotsa", "_slotsb").join(rows("a"), ["_l1", "_l2", "_fa", "_sa"]).join(rows("b"), ["_l1", "_l2", "_fb", "_sb"])
    return found.select(F.least("_ka", "_kb").alias(f"{key}_a"), F.greatest("_ka", "_kb").alias(f"{key}_b"))
