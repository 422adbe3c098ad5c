"""Estimate how demanding each text is to read.

Distributions of sentence length, words, clauses and cohesion over the prose of
a text go into gradient-boosted regression trees, fitted to the bands that
readers gave.  Predictions are cross-validated by source, calibrated on the
held-out ones, and cut into bands where held-out agreement is best.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import PointSet, flatten, slices

#: The bands in order.
BANDS = ("basic", "middle", "advanced")
#: Labelled documents that the trees are fitted to at most (one of each class of hashes): the bound of the fit.
SAMPLE_DOCS = 3000
FOLDS, TREES, DEPTH, RATE, BINS = 5, 120, 3, 0.1, 32

FEATURES = (
    "sent_chars_mean", "sent_chars_sd", "sent_chars_p10", "sent_chars_p50", "sent_chars_p90", "sent_chars_max", "sent_words_mean", "short_sent_share", "short_char_share", "long_sent_share", "long_char_share",
    "word_chars_mean", "word_chars_p90", "long_word_share", "longer_word_share", "distinct_share", "commas_per_sent", "clause_chars_mean", "cohesion", "cohesion_any", "sentences", "hangul_share", "kana_share", "kanji_share", "prose_share",
)

_STOP, _WIDE_STOP, _BLANK = PointSet(".!?"), PointSet("。！？"), PointSet(" \t\n\r 　")
_CLOSE, _COMMA = PointSet("\"”’»」』)"), PointSet(",;:、，；")
_BULLET = PointSet("-*•>#|$=`+~·–—①②③④⑤⑥⑦⑧⑨0123456789[({")


def _alnum_table() -> np.ndarray:
    import unicodedata

    out = np.zeros(0x110000, np.uint8)
    for p in range(0x30000):
        kind = "L" if 0x3400 <= p < 0xA000 or 0xAC00 <= p < 0xD7A4 else unicodedata.category(chr(p))[0]
        out[p] = 1 if kind in "LM" else 2 if kind == "N" else 0
    return out


_KINDS: list[np.ndarray] = []


def _kinds() -> np.ndarray:
    if not _KINDS:
        _KINDS.append(_alnum_table())
    return _KINDS[0]


def _runs(flags: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of stretches of set ``flags``, never across a place in ``breaks`` (true: a text begins there)."""
    before = np.concatenate([[False], flags[:-1]]) & ~breaks
    start = np.flatnonzero(flags & ~before)
    after = np.concatenate([flags[1:] & ~breaks[1:], [False]])
    return start, np.flatnonzero(flags & ~after) + 1


def _mean(sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.where(counts > 0, sums / np.maximum(counts, 1), 0.0)


def _quantiles(values: np.ndarray, rows: np.ndarray, n: int, at: tuple[float, ...]) -> list[np.ndarray]:
    order = np.lexsort((values, rows))
    counts = np.bincount(rows, minlength=n)
    first = np.cumsum(counts) - counts
    sorted_values = np.append(values[order], 0)
    return [np.where(counts > 0, sorted_values[np.minimum(first + np.floor(q * (counts - 1)).astype(np.int64).clip(0), len(sorted_values) - 1)], 0) for q in at]


def _slice_features(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    out = np.zeros((n, len(FEATURES)))
    if not len(points):
        out[:, FEATURES.index("sentences")] = 0
        return out
    owner = np.repeat(np.arange(n), np.diff(offsets))
    begins = np.zeros(len(points), bool)
    begins[offsets[:-1][np.diff(offsets) > 0]] = True
    kind = _kinds()[points]
    blank = _BLANK(points)

    # Lines, and which of them are prose.
    line_start, line_end = _runs(points != 10, begins)
    solid = np.flatnonzero(~blank)
    if not len(solid):
        return out
    head = solid[np.minimum(np.searchsorted(solid, line_start), len(solid) - 1)]
    tail = solid[np.maximum(np.searchsorted(solid, line_end) - 1, 0)]
    empty = (head >= line_end) | (tail < line_start)
    close = _CLOSE(points[tail]) & (tail > 0)
    last = points[np.where(close, tail - 1, tail)]
    ended = _STOP(last) | _WIDE_STOP(last)
    total = np.concatenate([[0], np.cumsum(kind > 0)])
    digits = np.concatenate([[0], np.cumsum(kind == 2)])
    letters = total[line_end] - total[line_start]
    coded = (digits[line_end] - digits[line_start]) > 0.3 * letters
    size = tail - head + 1
    prose_line = ~empty & ~_BULLET(points[head]) & ~coded & (ended | (size >= 60)) & (letters >= 4)
    prose = np.repeat(prose_line, line_end - line_start)
    in_line = np.zeros(len(points), bool)
    in_line[_spread(line_start, line_end)] = prose

    # Sentences of the prose.
    following_blank = np.concatenate([blank[1:], [True]])
    following_close = np.concatenate([_CLOSE(points)[1:], [False]]) & np.concatenate([following_blank[1:], [True]])
    stop = (_STOP(points) & (following_blank | following_close)) | _WIDE_STOP(points)
    cut = np.zeros(len(points), bool)
    cut[1:] = stop[:-1]
    cut |= begins
    sent_start, sent_end = _runs(in_line, cut)
    words_n = total  # alphanumeric characters so far
    real = words_n[sent_end] - words_n[sent_start] >= 2
    sent_start, sent_end = sent_start[real], sent_end[real]
    rows = owner[sent_start]
    chars = (words_n[sent_end] - words_n[sent_start]).astype(np.float64)
    count = np.bincount(rows, minlength=n)
    sums = lambda x, r=rows: np.bincount(r, weights=x, minlength=n)

    # Words within the sentences.
    inside = np.zeros(len(points), bool)
    inside[_spread(sent_start, sent_end)] = True
    word = (kind > 0) & inside
    word_start, word_end = _runs(word, begins)
    word_row, length = owner[word_start], (word_end - word_start).astype(np.float64)
    sent_of = np.searchsorted(sent_start, word_start, "right") - 1
    word_count = np.bincount(word_row, minlength=n)
    wsums = lambda x: np.bincount(word_row, weights=x, minlength=n)
    hashes = _word_hashes(points, word_start, word_end)
    distinct = _unique_pairs(word_row, hashes)

    commas = np.concatenate([[0], np.cumsum(_COMMA(points) & ~np.concatenate([kind[1:] == 2, [False]]))])
    sent_commas = (commas[sent_end] - commas[sent_start]).astype(np.float64)
    hangul = np.bincount(owner[inside & (points >= 0xAC00) & (points < 0xD7A4)], minlength=n)
    kana = np.bincount(owner[inside & (points >= 0x3040) & (points < 0x3100)], minlength=n)
    kanji = np.bincount(owner[inside & (points >= 0x4E00) & (points < 0xA000)], minlength=n)

    same, pairs = _cohesion(sent_of, hashes, rows, n)
    mean = _mean(sums(chars), count)
    spread = np.sqrt(np.maximum(0, _mean(sums(chars**2), count) - mean**2))
    p10, p50, p90, top = _quantiles(chars, rows, n, (0.1, 0.5, 0.9, 1.0))
    # Scripts write the same sentence in fewer characters: a syllable or a Chinese character counts for about two letters.
    dense = _mean(hangul * 1.2 + (kana + kanji) * 1.2, sums(chars))
    scaled = chars * (1 + dense[rows])
    values = {
        "sent_chars_mean": mean, "sent_chars_sd": spread, "sent_chars_p10": p10, "sent_chars_p50": p50, "sent_chars_p90": p90, "sent_chars_max": top,
        "sent_words_mean": _mean(word_count, count),
        "short_sent_share": _mean(sums(scaled < 40), count), "short_char_share": _mean(sums(chars * (scaled < 40)), sums(chars)),
        "long_sent_share": _mean(sums(scaled > 130), count), "long_char_share": _mean(sums(chars * (scaled > 130)), sums(chars)),
        "word_chars_mean": _mean(wsums(length), word_count), "word_chars_p90": _quantiles(length, word_row, n, (0.9,))[0],
        "long_word_share": _mean(wsums(length >= 8), word_count), "longer_word_share": _mean(wsums(length >= 11), word_count),
        "distinct_share": _mean(np.bincount(distinct, minlength=n), word_count),
        "commas_per_sent": _mean(sums(sent_commas), count), "clause_chars_mean": _mean(sums(chars), count + sums(sent_commas)),
        "cohesion": _mean(same, word_count), "cohesion_any": _mean(pairs, count), "sentences": count,
        "hangul_share": _mean(hangul, sums(chars)), "kana_share": _mean(kana, sums(chars)), "kanji_share": _mean(kanji, sums(chars)),
        "prose_share": _mean(sums(chars), np.bincount(owner[kind > 0], minlength=n)),
    }
    for k, name in enumerate(FEATURES):
        out[:, k] = values[name]
    return out


def _spread(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All places of the stretches, in order."""
    size = end - start
    return np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]) if len(size) else start, size) + np.arange(size.sum())


def _word_hashes(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each word, from the sums of mixed code points weighted by place."""
    mixed = (points.astype(np.uint64) | np.uint64(0x20)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(31)
    place = np.arange(len(points), dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed)])
    weighted = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * place)])
    plain = sums[end] - sums[start]
    return (weighted[end] - weighted[start] - plain * start.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93) ^ plain


def _unique_pairs(rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The row of each distinct (row, hash)."""
    mixed = hashes ^ (rows.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    _, first = np.unique(mixed, return_index=True)
    return rows[first]


def _cohesion(sent: np.ndarray, hashes: np.ndarray, sent_rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text, words that the sentence before holds too, and sentences with such a word."""
    if not len(sent):
        return np.zeros(n), np.zeros(n)
    key = lambda s: hashes ^ (s.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    linked = (sent > 0) & (sent_rows[np.maximum(sent - 1, 0)] == sent_rows[sent])
    shared = np.isin(key(sent - 1), key(sent)) & linked
    with_one = np.unique(sent[shared])
    return np.bincount(sent_rows[sent[shared]], minlength=n), np.bincount(sent_rows[with_one], minlength=n)


def feature_matrix(texts: pa.Array) -> np.ndarray:
    """A row of ``FEATURES`` per text; a text without prose has 0 sentences."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    parts = [_slice_features(*flatten(texts.slice(a, b - a))) for a, b in slices(texts, 500_000)]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


@dataclass
class Trees:
    """Boosted regression trees over binned features; squared loss."""

    edges: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0
    feature: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.int64))
    cut: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.int64))
    leaf: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)], axis=1) if len(x) else np.zeros((0, len(self.edges)), np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
        self.base = float(y.mean())
        b, guess = self.binned(x), np.full(len(y), self.base)
        least = max(3, len(y) // 150)
        inner = 2**DEPTH - 1
        self.feature, self.cut, self.leaf = np.zeros((TREES, inner), np.int64), np.full((TREES, inner), BINS, np.int64), np.zeros((TREES, inner + 1))
        width, wide = BINS + 1, x.shape[1]
        column = np.arange(wide) * width
        for t in range(TREES):
            rest, node = y - guess, np.zeros(len(y), np.int64)
            for depth in range(DEPTH):
                nodes, first = 2**depth, 2**depth - 1
                local = node - first
                at = ((local * wide * width)[:, None] + column + b).ravel()
                shape = (nodes, wide, width)
                n = np.bincount(at, minlength=nodes * wide * width).reshape(shape).cumsum(2)
                s = np.bincount(at, weights=np.repeat(rest, wide), minlength=nodes * wide * width).reshape(shape).cumsum(2)
                right_n, right_s = n[:, :, -1:] - n, s[:, :, -1:] - s
                gain = s**2 / np.maximum(n, 1) + right_s**2 / np.maximum(right_n, 1)
                gain[(n < least) | (right_n < least)] = -1
                best = gain.reshape(nodes, -1).argmax(1)
                good = gain.reshape(nodes, -1)[np.arange(nodes), best] > 0
                self.feature[t, first : first + nodes] = best // width
                self.cut[t, first : first + nodes] = np.where(good, best % width, BINS)
                node = 2 * node + 1 + (b[np.arange(len(b)), self.feature[t, node]] > self.cut[t, node])
            local = node - inner
            n = np.bincount(local, minlength=inner + 1)
            self.leaf[t] = RATE * np.bincount(local, weights=rest, minlength=inner + 1) / np.maximum(n, 1)
            guess += self.leaf[t, local]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        b, out, rows = self.binned(x), np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1]
        for t in range(len(self.leaf)):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (b[rows, self.feature[t, node]] > self.cut[t, node])
            out += self.leaf[t, node - inner]
        return out


def _isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rising step function of ``x`` nearest to ``y`` (pool adjacent violators)."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for k in order:
        blocks.append([x[k], float(y[k]), 1.0])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            top = blocks.pop()
            n = blocks[-1][2] + top[2]
            blocks[-1][1] = (blocks[-1][1] * blocks[-1][2] + top[1] * top[2]) / n
            blocks[-1][0], blocks[-1][2] = top[0], n
    return np.array([b[0] for b in blocks]), np.array([b[1] for b in blocks])


@dataclass
class Grader:
    """Trees, calibration and the two limits between the bands; ``agreement`` is held out, by source."""

    trees: Trees
    knots: np.ndarray
    levels: np.ndarray
    low: float
    high: float
    agreement: float

    def grade(self, x: np.ndarray) -> np.ndarray:
        """The expected band as a number from 0 (basic) to 2 (advanced)."""
        return np.interp(self.trees.predict(x), self.knots, self.levels)


def fit(x: np.ndarray, y: np.ndarray, folds: np.ndarray) -> Grader:
    """Fit to band numbers ``y`` (means of raters), holding out one of ``folds`` after the other."""
    held = np.full(len(y), y.mean() if len(y) else 1.0)
    for k in np.unique(folds):
        rest = folds != k
        if rest.sum() >= 10:
            held[~rest] = Trees().fit(x[rest], y[rest]).predict(x[~rest])
    trees = Trees().fit(x, y)
    # The limits are set on what the trees say themselves: means pull labels of mistaken raters towards the middle.
    raw = np.rint(y)
    grid = np.unique(np.quantile(held, np.linspace(0.01, 0.99, 197)))
    gain_low = [np.sum((held < g) & (raw == 0)) - np.sum((held < g) & (raw != 0)) for g in grid]
    gain_high = [np.sum((held >= g) & (raw == 2)) - np.sum((held >= g) & (raw != 2)) for g in grid]
    low = _middle(grid, np.array(gain_low))
    high = _middle(grid, np.array(gain_high))
    band = np.where(held < low, 0, np.where(held >= high, 2, 1))
    knots, levels = _isotonic(held, y)
    return Grader(trees, knots, levels, float(low), float(max(high, low)), float(np.mean(band == raw)))


def _middle(grid: np.ndarray, gain: np.ndarray) -> float:
    """The middle of the limits that serve equally well."""
    best = np.flatnonzero(gain >= gain.max())
    return float((grid[best[0]] + grid[best[-1]]) / 2)


def _features_udf(texts: pa.Array) -> pa.Array:
    x = feature_matrix(texts)
    flat = pa.array(x.ravel(), pa.float64())
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(FEATURES), pa.int32()), flat)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> Grader:
    """Fit to the documents of ``labels`` (``<key>``, ``rater``, ``band``).

    Bands of several raters are averaged.  At most ``SAMPLE_DOCS`` labelled
    documents are used; unknown bands and documents without prose are left out.
    """
    number = F.create_map(*[F.lit(v) for k, b in enumerate(BANDS) for v in (b, k)])
    means = labels.select(key, F.try_element_at(number, F.lower(F.trim("band"))).alias("_y")).where("_y is not null").groupBy(key).agg(F.avg("_y").alias("_y"))
    first = F.struct(F.xxhash64(F.col(key), F.lit(3)).alias("h"), F.col(key).alias("k"), F.col("_y").alias("y"))
    sample = means.groupBy(F.pmod(F.xxhash64(key), F.lit(SAMPLE_DOCS)).alias("_class")).agg(F.min(first).alias("_r")).select(F.col("_r.k").alias(key), F.col("_r.y").alias("_y"))
    rows = docs.where(F.col(text).isNotNull()).select(key, text, F.lower(F.trim(source)).alias("_source")).join(F.broadcast(sample), key)
    got = rows.select(F.arrow_udf(_features_udf, "array<double>")(text).alias("x"), "_y", F.pmod(F.xxhash64(F.coalesce("_source", F.lit(""))), F.lit(FOLDS)).alias("fold")).collect()
    x = np.array([r["x"] for r in got], float).reshape(len(got), len(FEATURES))
    y, folds = np.array([r["_y"] for r in got], float), np.array([r["fold"] for r in got])
    real = x[:, FEATURES.index("sentences")] > 0 if len(x) else np.zeros(0, bool)
    if real.sum() < 10:
        raise ValueError("fewer than 10 labelled documents with prose")
    order = np.lexsort((y[real], x[real][:, 0]))
    return fit(x[real][order], y[real][order], folds[real][order])


def score(docs: DataFrame, grader: Grader, text: str = "text") -> DataFrame:
    """``docs`` with ``grade`` (0 basic to 2 advanced, calibrated) and ``band``; both null for a text without prose."""
    shared = docs.sparkSession.sparkContext.broadcast(grader)

    def run(texts: pa.Array) -> pa.Array:
        g = shared.value
        x = feature_matrix(texts)
        none = x[:, FEATURES.index("sentences")] == 0
        raw = g.trees.predict(x)
        grade = pa.array(np.interp(raw, g.knots, g.levels), mask=none)
        band = pa.array(np.array(BANDS)[np.where(raw < g.low, 0, np.where(raw >= g.high, 2, 1))], pa.string(), mask=none)
        return pa.StructArray.from_arrays([grade, band], ["grade", "band"])

    plain = docs.drop("grade", "band", "_read")
    rows = plain.withColumn("_read", F.arrow_udf(run, "struct<grade:double,band:string>")(F.col(text)))
    return rows.select(*plain.columns, "_read.grade", "_read.band")
