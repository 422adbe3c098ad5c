import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.llm import lookalikes


def form(*texts):
    return lookalikes.canonical_texts(pa.array(texts, pa.string())).to_pylist()


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("ＶＴ－１２", "VT-12"), ("é", "é"), ("a​b", "ab"), ("a b", "a b"), ("a　b", "a\tb"), ("сору", "copy"), ("Α", "A"), ("ﬁle", "file"), ("한글", unicodedata.normalize("NFD", "한글")), ("ガ", "ｶﾞ"),
        ("x­y", "xy"), ("a‑b", "a-b"), ("a\r\nb", "a\nb"), ("ạ̇", "ạ̇"), ("е́", "é"), ("q̣̇", "q̣̇"), ("﻿x", "x"), ("ѐ", "è"), ("力", "カ"), ("⼯", "工"), ("Ⅻ", "XII"), ("ǆ", "dž"), ("ՍՕ", "UO"), ("Ꭺ", "A"), ("Ⲟ", "O"), ("ĳ", "ij"),
    ],
)
def test_same(a, b):
    assert form(a) == form(b)


@pytest.mark.parametrize(("a", "b"), [("é", "e"), ("A", "a"), ("2", "²"), ("1", "①"), ("“a”", '"a"'), ("l", "1"), ("O", "0"), ("œ", "oe"), ("–", "-"), ("a b", "ab"), ("a\nb", "a b"), ("ß", "ss"), ("か", "が")])
def test_different(a, b):
    assert form(a) != form(b)


def test_stable_and_whole():
    texts = ["", None, "plain", "ｶﾞ​" * 5000, "x" * 3_000_000 + "é"]
    once = form(*texts)
    assert once[0] == "" and once[1] is None and once[2] == "plain" and once[3] == "ガ" * 5000 and len(once[4]) == 3_000_001
    assert form(*once) == once


def test_agrees_with_the_normal_form_where_nothing_is_mapped():
    texts = [chr(p) + chr(m) for p in (*range(0xC0, 0x132), *range(0x134, 0x180), *range(0xAC00, 0xAC40)) for m in (0x301, 0x323)]
    assert form(*texts) == [unicodedata.normalize("NFC", t) for t in texts]


def test_pairs(spark):
    rows = spark.createDataFrame([(5, "copy"), (1, "сopy"), (2, "copy"), (3, "Copy"), (4, None), (6, None), (7, ""), (8, "​"), (None, "copy")], "k long, t string")
    got = {tuple(r) for r in lookalikes.lookalike_pairs(rows.withColumnRenamed("t", "_look"), "k", "_look").collect()}
    assert got == {(1, 5), (1, 2), (7, 8)}
    assert lookalikes.lookalike_pairs(rows.limit(0), "k", "t").count() == 0


def test_pairs_of_a_hot_group(spark):
    rows = spark.createDataFrame([(k, "same text") for k in range(400)] + [(1000, "same text")], "k long, t string")
    assert lookalikes.lookalike_pairs(rows, "k", "t").count() == 400


def test_agrees_with_the_exploded_form(spark):
    """Positioned code points joined with the tables, marks ordered by class, composed pair by pair, and rebuilt."""
    one, long, _ = lookalikes.tables()
    texts = ["ＶＴ－１２ caf\u0065\u0301", "q\u0307\u0323 \u0435\u0301", "ﬁle\u200b Ⅻ", "\u1112\u1161\u11ab글", "ｶﾞ\u00a0x", "a\r\nb\rc", "力 ⼯", "", "x\u0323\u0307\u0323 \u01d5"]
    used = sorted({ord(c) for t in texts for c in t})
    table = [(p, [int(x) for x in long[p]] if one[p] == lookalikes.LONG else [] if one[p] == lookalikes.GONE else [int(one[p])]) for p in used]
    mapping = spark.createDataFrame(table, "point int, into array<int>")
    rows = spark.createDataFrame([(k, t, [ord(c) for c in t.replace("\r\n", "\n").replace("\r", "\n")]) for k, t in enumerate(texts)], "k int, t string, points array<int>")
    points = rows.select("k", F.posexplode("points").alias("at", "point")).join(F.broadcast(mapping), "point").select("k", "at", F.posexplode("into").alias("part", "point"))
    apart = [(k, at, part, [ord(c) for c in unicodedata.normalize("NFD", chr(p))]) for k, at, part, p in points.select("k", "at", "part", "point").collect()]
    split = spark.createDataFrame(apart, "k int, at int, part int, points array<int>").select("k", "at", "part", F.posexplode("points").alias("piece", "point"))
    classes = spark.createDataFrame([(p, unicodedata.combining(chr(p))) for p in {q for *_, ps in apart for q in ps}], "point int, class int")
    ordered = split.join(F.broadcast(classes), "point").withColumn("start", F.sum((F.col("class") == 0).cast("int")).over(W.partitionBy("k").orderBy("at", "part", "piece")))
    strung = ordered.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("start", "class", "at", "part", "piece", "point"))).alias("all"))
    want = {k: "" for k in range(len(texts))}
    for row in strung.collect():
        out = []  # composition by the public algorithm: a mark joins the last starter unless one of its class or above stands between
        starter, blocked = -1, 0
        for x in row["all"]:
            c, kind = chr(x["point"]), x["class"]
            whole = unicodedata.normalize("NFC", out[starter] + c) if starter >= 0 and (blocked < kind or blocked == 0) and (blocked == 0 or kind) else ""
            if len(whole) == 1:
                out[starter] = whole
            else:
                out.append(c)
                starter, blocked = (len(out) - 1, 0) if kind == 0 else (starter, kind)
        want[row["k"]] = "".join(out)
    assert dict(enumerate(form(*texts))) == want


def test_classes_and_slots(spark, monkeypatch):
    rows = spark.createDataFrame([(k, "same text") for k in range(30)] + [(100 + k, "sаme text") for k in range(20)] + [(200, "same  text"), (201, None)], "k long, t string")
    got = {r["k"]: tuple(r)[1:] for r in lookalikes.lookalike_classes(rows, "k", "t").collect()}
    assert got == {k: (0, 0, 2, 30) for k in range(30)} | {100 + k: (0, 100, 2, 20) for k in range(20)}
    monkeypatch.setattr(lookalikes, "SLOT_ROWS", 7)
    pairs = {tuple(r) for r in lookalikes.lookalike_pairs(rows, "k", "t").collect()}
    assert pairs == {(a, 100 + b) for a in range(30) for b in range(20)} and lookalikes.lookalike_pairs(rows, "k", "t").count() == 600
    assert lookalikes.lookalike_classes(rows.limit(0), "k", "t").count() == 0
