"""Texts as flat arrays of code points.

A batch of strings becomes one ``uint32`` array plus the offset of each string,
so a rule over characters is a handful of numpy passes over the whole batch
instead of a Python loop over each text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Most code points handled at a time.  A longer text is handled alone, whole.
SLICE_POINTS = 2_000_000


def flatten(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts and, for each text, where it starts.

    Returns ``(points, offsets)`` with ``len(offsets) == len(texts) + 1``.  A null
    has no points.  Bytes that are not UTF-8 become U+FFFD.
    """
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.large_string()).fill_null("")
    if len(texts) == 0:
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    try:
        points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    except UnicodeDecodeError:
        body = raw.tobytes()
        fixed = [body[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:])]
        return flatten(pa.array(fixed, pa.large_string()))
    if len(points) == len(raw):
        return points, ends.copy()
    head = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=head[1:])
    return points, head[ends]


def rebuild(points: np.ndarray, offsets: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """The inverse of :func:`flatten`; texts where ``valid`` is false become null."""
    width = np.ones(len(points), np.int64)
    width += points >= 0x80
    width += points >= 0x800
    width += points >= 0x10000
    ends = np.zeros(len(points) + 1, np.int64)
    np.cumsum(width, out=ends[1:])
    data = points.astype(np.uint32).tobytes().decode("utf-32-le", "replace").encode("utf-8")
    mask = None if valid is None else pa.array(~valid)
    out = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(ends[offsets].tobytes()), pa.py_buffer(data))
    out = out.cast(pa.string()) if len(data) < 2**31 - 1 else out
    return out if mask is None else pc.if_else(mask, pa.scalar(None, out.type), out)


def slices(texts: pa.Array, most: int = SLICE_POINTS) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose bytes together stay below ``most``; at least a row each."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    size = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.cumsum(size)
    begin = 0
    while begin < len(size):
        before = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, before + most, "right")))
        yield begin, end
        begin = end


def owners(offsets: np.ndarray) -> np.ndarray:
    """For each code point the row that it belongs to."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


class PointSet:
    """Membership of code points in a fixed set, by table lookup."""

    def __init__(self, points: str | list[int]) -> None:
        self.table = np.zeros(0x110000, bool)
        self.table[[ord(x) if isinstance(x, str) else x for x in points]] = True

    def __call__(self, points: np.ndarray) -> np.ndarray:
        return self.table[points]
