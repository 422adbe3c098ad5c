import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skein.llm import frames, splitting


def pieces_of(text, limit, overlap):
    cuts = splitting._cuts(pa.array([text]), np.array([limit]), np.array([overlap]))
    return cuts[0].as_py()


def check(text, limit, overlap):
    pieces = pieces_of(text, limit, overlap)
    if not text:
        assert pieces == []
        return
    assert pieces[0]["piece_start"] == 0 and pieces[-1]["piece_end"] == len(text)
    for p in pieces:
        assert 0 < p["piece_end"] - p["piece_start"] <= limit
    for a, b in zip(pieces, pieces[1:]):
        assert a["piece_end"] - overlap <= b["piece_start"] <= a["piece_end"] < b["piece_end"]
    longest = max(len(s) for s in re.split("[ \t\n\r。！？]", text))
    assert any(p["forced"] for p in pieces) == (longest > limit)


def test_random_texts():
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice(["a", "b", "é", "글", " ", " ", ". ", "。", "\n", "x" * rng.randrange(1, 40)]) for _ in range(rng.randrange(0, 120)))
        limit = rng.randrange(2, 60)
        check(text, limit, rng.randrange(0, limit))


@pytest.mark.parametrize("text", ["", " ", "a", "a" * 10, "a" * 11, " " * 50, "a" * 10 + "。" + "b" * 10, "x" * 100_000, "word " * 40_000])
def test_edges(text):
    check(text, 10, 3)


def test_greedy_equals_step_by_step():
    """Each piece reaches the farthest boundary that a walk from cut to cut finds."""
    rng = random.Random(5)
    for _ in range(100):
        text = "".join(rng.choice("ab  c") for _ in range(rng.randrange(20, 200)))
        limit = 25
        if max(map(len, text.split(" "))) > limit:
            continue
        for p in pieces_of(text, limit, 5)[:-1]:
            reach = p["piece_start"] + limit
            marks = [k for k in range(p["piece_start"] + 1, reach + 1) if text[k - 1] == " " or text[k : k + 1] == " "]
            assert p["piece_end"] == max(marks)


def test_operator(spark):
    rows = spark.createDataFrame([(1, "word " * 100, 50, 10, "mine"), (2, None, 50, 10, None), (3, "", 50, 10, ""), (4, "short", 50, 90, "x")], "k int, t string, m int, o int, piece string")
    got = splitting.split_oversized(rows, "t", "m", "o").collect()
    assert {r["k"] for r in got} == {1, 4} and all(r["piece"] == r["t"][r["piece_start"] : r["piece_end"]] for r in got)
    assert splitting.split_oversized(rows.limit(0), "t", "m", "o").count() == 0


def test_limits(spark):
    limits = spark.createDataFrame([("general_content", 10, 2), ("summary", 5, 1)], "chunk_type string, max_chars int, overlap_chars int")
    rows = spark.createDataFrame([(1, " SUMMARY "), (2, None), (3, "odd")], "k int, chunk_type string")
    none = splitting.split_oversized(splitting.with_limits(rows, limits.limit(0)).withColumn("t", F.lit("some words")), "t")
    assert none.count() == 3
    assert {r["k"]: r["max_chars"] for r in splitting.with_limits(rows, limits).collect()} == {1: 5, 2: 10, 3: 10}


def test_frames_round_trip():
    texts = pa.array(["", "abc", None, "é글𝄞\n", "x" * 1000])
    points, offsets = frames.flatten(texts)
    assert frames.rebuild(points, offsets, texts.is_valid().to_numpy(zero_copy_only=False)).to_pylist() == texts.to_pylist()
    sliced = texts.slice(3, 2)
    assert frames.rebuild(*frames.flatten(sliced)).to_pylist() == sliced.to_pylist()
    assert list(frames.slices(texts, 1)) == [(k, k + 1) for k in range(5)] or sum(b - a for a, b in frames.slices(texts, 1)) == 5
