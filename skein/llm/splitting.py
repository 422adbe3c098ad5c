"""Cut oversized texts into overlapping pieces at natural boundaries.

Every possible cut of a text is a row of a successor table: the farthest cut
that the piece beginning there may legally reach, its overlap included.
Squaring that table doubles the cuts known from each start, so the greedy cuts
of all texts of a batch come out together in ``log2(pieces)`` passes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import PointSet, flatten, slices
from .sizes import broadcast_checked

#: Blanks, line breaks and full-width sentence ends that a cut may stand at.
BREAKS = " \t\n\r\x0b\x0c\x85\u2028\u2029。！？"
#: Signs after which a sentence or line is over.
LINE_ENDS, WIDE_STOPS, STOPS = "\n\r\x0b\x0c\x85\u2028\u2029", "。！？", ".!?"
CUTS_TYPE = "array<struct<piece_start:int,piece_end:int,forced:boolean>>"

_BREAK, _WIDE, _LINE, _STOP = PointSet(BREAKS), PointSet(WIDE_STOPS), PointSet(LINE_ENDS), PointSet(STOPS)


def cut_tables(points: np.ndarray, offsets: np.ndarray, limits: np.ndarray, overlaps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Greedy pieces of every text: ``(row, start, end, forced)``, sorted by row and place.

    A slot is a place before, between or after the characters of a text; slots
    of all texts share one numbering (a text of n characters has n + 1 of them).
    """
    rows = len(offsets) - 1
    length = np.diff(offsets)
    base = offsets[:-1] + np.arange(rows)
    last = base + length
    owner = np.repeat(np.arange(rows), length)
    slot = np.arange(len(points)) + owner
    brk = _BREAK(points)
    size = int(last[-1]) + 1 if rows else 0
    cand, strong = np.zeros(size, bool), np.zeros(size, bool)
    blank = brk & ~_WIDE(points)
    cand[slot[blank]] = True
    cand[slot[brk] + 1] = True
    strong[slot[_LINE(points) | _WIDE(points)] + 1] = True
    after_stop = blank.copy()
    after_stop[:1] = False
    after_stop[1:] &= _STOP(points[:-1]) & (owner[1:] == owner[:-1])
    strong[slot[after_stop] + 1] = True
    cand[base] = cand[last] = strong[base] = strong[last] = True

    pos = np.flatnonzero(cand)
    row = np.searchsorted(base, pos, "right") - 1
    # A stretch longer than the limit has no natural cut: lay cuts through it at the step of full pieces.
    gap = np.append(np.diff(pos), 0)
    gap[pos == last[row]] = 0
    step = np.maximum(1, limits - overlaps)[row]
    # A full piece right before a full-width stop leaves the stop to the next one: a natural cut all the same.
    ends_wide = np.zeros(len(pos), bool)
    ends_wide[:-1] = (gap[:-1] == limits[row[:-1]] + 1) & _WIDE(points[np.minimum(pos[1:] - row[:-1] - 1, len(points) - 1)]) if len(points) else False
    more = np.where(gap > limits[row], np.where(ends_wide, 1, (gap - 1) // step), 0)
    at = np.repeat(np.arange(len(pos)), more)
    rank = np.arange(len(at)) - np.repeat(np.cumsum(more) - more, more) + 1
    extra = pos[at] + np.where(ends_wide[at], limits[row[at]], rank * step[at])
    forced = np.concatenate([np.zeros(len(pos), bool), ~ends_wide[at]])
    pos, row = np.concatenate([pos, extra]), np.concatenate([row, row[at]])
    order = np.argsort(pos, kind="stable")
    pos, row, forced = pos[order], row[order], forced[order]

    end = last[row]
    following = np.minimum(np.append(pos[1:], pos[-1:]), end)
    want = np.maximum(np.maximum(pos - overlaps[row], following - limits[row]), base[row])
    snap = pos[np.minimum(np.searchsorted(pos, want), len(pos) - 1)] if len(pos) else pos
    start = np.where(snap - want > overlaps[row] // 2, want, np.minimum(snap, pos))
    reach = np.minimum(start + limits[row], end)
    succ = np.searchsorted(pos, reach, "right") - 1
    firm = np.flatnonzero(strong[pos] & ~forced)
    if len(firm):
        best = firm[np.maximum(np.searchsorted(pos[firm], reach, "right") - 1, 0)]
        good = (pos[best] > np.maximum(pos, start + limits[row] // 2)) & (row[best] == row)
        succ = np.where(good, best, succ)

    seen = np.zeros(len(pos), bool)
    seen[np.searchsorted(pos, base)] = True
    jump = succ
    while True:
        known = np.flatnonzero(seen)
        seen[jump[known]] = True
        if np.count_nonzero(seen) == len(known):
            break
        jump = jump[jump]
    cut = np.flatnonzero(seen & (pos < end))
    return row[cut], (start - base[row])[cut], (pos[succ] - base[row])[cut], forced[succ[cut]]


def _cuts(texts: pa.Array, limits: np.ndarray, overlaps: np.ndarray) -> pa.Array:
    parts = []
    for a, b in slices(texts):
        points, offsets = flatten(texts.slice(a, b - a))
        row, start, end, forced = cut_tables(points, offsets, limits[a:b], overlaps[a:b])
        ends = np.searchsorted(row, np.arange(b - a + 1))
        pieces = pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(forced)], ["piece_start", "piece_end", "forced"])
        valid = texts.slice(a, b - a).is_valid()
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pieces)
        parts.append(pc.if_else(valid, lists, pa.scalar(None, lists.type)))
    kind = pa.list_(pa.struct([("piece_start", pa.int32()), ("piece_end", pa.int32()), ("forced", pa.bool_())]))
    return pa.concat_arrays([x.cast(kind) for x in parts]) if parts else pa.array([], kind)


def _cuts_udf(texts: pa.Array, limits: pa.Array, overlaps: pa.Array) -> pa.Array:
    most = np.maximum(limits.cast(pa.int64()).fill_null(2**31 - 1).to_numpy(zero_copy_only=False).astype(np.int64), 1)
    again = overlaps.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return _cuts(texts, most, np.clip(again, 0, most - 1))


def greedy_cuts(text: Column, max_chars: Column, overlap_chars: Column) -> Column:
    """Array of pieces ``(piece_start, piece_end, forced)`` in code points.

    No piece is longer than ``max_chars`` and consecutive pieces share about
    ``overlap_chars``; a piece is ``forced`` where it had to end inside a stretch
    without any natural boundary.  Sentence and line ends are preferred in the
    second half of the limit.  A null text gives null, an empty one no piece; a
    limit below 1 counts as 1, none leaves the text whole, an overlap is kept below
    the limit.
    """
    return F.arrow_udf(_cuts_udf, CUTS_TYPE)(text, max_chars, overlap_chars)


def with_limits(chunks: DataFrame, limits: DataFrame, default_type: str = "general_content") -> DataFrame:
    """Add ``max_chars`` and ``overlap_chars`` of each row's ``chunk_type``.

    Types are compared without case and outer blanks; null and unknown types use
    ``default_type``; without that one either, the limit is null and the text is not
    cut.  Should a type be listed twice, the smaller limit counts.
    """
    key = lambda c: F.lower(F.trim(c))
    known = limits.where(F.col("chunk_type").isNotNull()).groupBy(key(F.col("chunk_type")).alias("_kind")).agg(F.min(F.struct("max_chars", "overlap_chars")).alias("_limit"))
    row = known.where(F.col("_kind") == default_type).first()
    plain = chunks.drop("max_chars", "overlap_chars", "_kind", "_limit")
    joined = plain.withColumn("_kind", key(F.col("chunk_type"))).join(broadcast_checked(known), "_kind", "left")
    pick = lambda c: F.coalesce(F.col(f"_limit.{c}"), F.lit(row["_limit"][c] if row else None).cast("int")).alias(c)
    return joined.select(*plain.columns, pick("max_chars"), pick("overlap_chars"))


def split_oversized(df: DataFrame, text: str = "page_content", max_chars: str = "max_chars", overlap_chars: str = "overlap_chars") -> DataFrame:
    """One row per piece: the columns of ``df`` and ``piece_no``, ``piece_start``, ``piece_end``, ``forced``, ``piece``.

    Texts within the limit come out as one piece.  Columns of ``df`` that carry
    one of the added names are replaced.  Rows with null or empty text give none.
    """
    added = ("piece_no", "piece_start", "piece_end", "forced", "piece", "_cuts")
    kept = [c for c in df.columns if c not in added or c in (text, max_chars, overlap_chars)]
    cuts = df.select(*kept, greedy_cuts(F.col(text), F.col(max_chars), F.col(overlap_chars)).alias("_cuts"))
    rows = cuts.select(*kept, F.posexplode("_cuts").alias("piece_no", "_cut"))
    return rows.select(
        *[c for c in kept if c not in added[:5]], "piece_no", "_cut.*", F.substring(F.col(text), F.col("_cut.piece_start") + 1, F.col("_cut.piece_end") - F.col("_cut.piece_start")).alias("piece")
    )


def oversized_cuts(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """Rows of ``chunks`` longer than their limit, with their ``cuts``."""
    sized = with_limits(chunks, limits)
    return sized.where(F.length("page_content") > F.col("max_chars")).withColumn("cuts", greedy_cuts(F.col("page_content"), F.col("max_chars"), F.col("overlap_chars")))
