import pytest
from pyspark.sql import functions as F

from skein.functions import filetypes as ft
from skein.functions import text as tx
from skein.functions import vectors as vx
from skein.functions.predicates import where
from skein.operators import chunking


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'array<double>'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]



@pytest.mark.parametrize(
    ("rule", "text", "want"),
    [
        (tx.clean_text, "a — b\n•cあ", "a - b *c"), (tx.clean_text, "=== Page 3 ===", ""), (tx.clean_text, None, ""), (tx.clean_text, "Image 1: x", ""),
        (tx.strip_page_lines, "a\nPage 12\nb", "a\n\nb"), (tx.join_hyphens, "inter-\n national", "international"), (tx.join_lines, "a\nb\n\nc", "a b\n\nc"),
        (tx.rtf_plain, r"{\rtf1\ansi Hello \b world\b0 !}", "Hello world !"), (tx.collapse_repeats, "the the cat cat cat sat", "the cat sat"),
        (tx.clean_query, "what is the backup plan", "what backup plan"), (tx.clean_query, "the is a", "the is a"), (tx.clean_query, "is a the an", "is a the an"),
        (tx.title, "what is a backup", "A backup"), (tx.title, "", "New Chat"), (tx.title, None, "New Chat"), (tx.keep_legible, "-----a", ""), (tx.keep_legible, "abc", "abc"),
        (tx.preprocess, "a\n\n\n\nb  c\n.", "a\n\nb c."),
    ],
)
def test_text(spark, rule, text, want):
    assert one(spark, rule(F.col("a")), a=text) == want


def test_title_is_cut_at_a_word(spark):
    got = one(spark, tx.title(F.col("a")), a="explain " + "word " * 30)
    assert got.startswith("Word word") and got.endswith("word...") and len(got) <= 53


def test_snippet(spark):
    text = " ".join(f"w{k}" for k in range(400))
    got = one(spark, tx.snippet(F.col("a"), F.lit("w300")), a=text)
    assert got.startswith("...") and got.endswith("...") and " w300 " in got
    assert one(spark, tx.snippet(F.col("a"), F.lit("zzz")), a=text) == text[:500] + "..."
    assert one(spark, tx.snippet(F.col("a"), F.lit("zzz")), a="short") == "short"
    assert one(spark, tx.snippet(F.col("a"), F.lit("x")), a=None) is None


def test_overlap_tail_starts_at_a_sentence(spark):
    text = "x" * 300 + ". Second sentence is here and goes on for quite a while. " + "y" * 150
    assert one(spark, tx.overlap_tail(F.col("a")), a=text) == "y" * 150
    assert one(spark, tx.overlap_tail(F.col("a")), a="short") == "short"
    assert one(spark, tx.overlap_tail(F.col("a"), 200), a=text) == chunking.tail(text, 200)


@pytest.mark.parametrize(
    ("name", "kind", "valid"),
    [("a.PDF?x=1", "pdf", True), ("README", "unknown", False), ("x.null", "unknown", False), ("a.abcdefghijk", "unknown", True), ("t.csv", "txt", True), ("b.xlsm", "excel", True), ("...", "unknown", False), (None, "unknown", False), ("", "unknown", False)],
)
def test_file_names(spark, name, kind, valid):
    assert one(spark, ft.type_by_extension(F.col("a")), a=name) == kind
    assert one(spark, ft.valid_name(F.col("a")), a=name) == valid


def test_links(spark):
    url = "https://h/d/0a1b2c3d-0a1b-0a1b-0a1b-0a1b2c3d4e5f_report.pdf?X-Amz-Date=20240101T000000Z&X-Amz-Expires=60"
    assert one(spark, ft.name_of_link(F.col("a")), a=url) == "report.pdf"
    late, early = F.lit("2024-01-01 00:01:01").cast("timestamp"), F.lit("2024-01-01 00:00:59").cast("timestamp")
    assert one(spark, ft.link_expired(F.col("a"), late), a=url) is True
    assert one(spark, ft.link_expired(F.col("a"), early), a=url) is False
    assert one(spark, ft.link_expired(F.col("a"), late), a="https://h/x") is False


def test_html(spark):
    html = '<h1>A &amp; B</h1><script>no()</script><p>one <b>two</b></p><img src="a.png"><ul><li>x</li></ul>'
    assert one(spark, ft.html_lines(F.col("a")), a=html) == ["A & B", "one two", "x"]
    assert one(spark, ft.image_links(F.col("a")), a=html) == ["a.png"]
    assert one(spark, ft.html_lines(F.col("a")), a="") == []


def test_vectors(spark):
    assert one(spark, vx.cosine(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[1.0, 1.0]) == pytest.approx(0.70710678)
    assert one(spark, vx.cosine(F.col("a"), F.col("b")), a=[0.0, 0.0], b=[1.0, 1.0]) is None
    assert one(spark, vx.resize(F.col("a"), 3), a=[1.0]) == [1.0, 0.0, 0.0]
    assert sum(one(spark, vx.softmax(F.col("a")), a=[1.0, 2.0, 900.0])) == pytest.approx(1)


def test_filter_language(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, s string")
    keys = lambda rule: [r["k"] for r in rows.where(where(rule)).orderBy("k").collect()]
    assert keys({}) == [1, 2, 3] and keys({"s": "a"}) == [1] and keys({"s": None}) == [2] and keys({"s": {"$exists": True}}) == [1, 3]
    assert keys({"$or": [{"k": 1}, {"s": {"$contains": "c"}}]}) == [1, 3] and keys({"k": {"$in": []}}) == [] and keys({"$or": []}) == []
    assert keys({"k": {"$gt": 1, "$lt": 3}}) == [2] and keys({"$not": {"k": 2}}) == [1, 3] and keys({"s": {"$ne": "a"}}) == [2, 3]
    with pytest.raises(ValueError):
        where({"s": {"$near": 1}})


def test_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).selectExpr("id", "id * 2 AS v", "'x' AS s").write.parquet(path)
    plan = spark.read.parquet(path).where(where({"v": {"$in": [4, 6]}})).select("id")._jdf.queryExecution().toString()
    assert "PushedFilters: [In(v, [4,6])]" in plan and "s:string" not in plan.split("ReadSchema")[1]


def test_chunker():
    assert chunking.chunk_text(None) == [] == chunking.chunk_text("  \n ")
    assert chunking.chunk_text("short text")[0]["chunk_type"] == "single_chunk"
    long = "\n\n".join(f"Paragraph {k} says something plain and goes on for a while so that it has some length" for k in range(60))
    found = chunking.chunk_text(long)
    assert len(found) > 3 and all(c["text"] for c in found) and any(c["has_overlap"] for c in found)
    assert all(f"Paragraph {k} " in " ".join(c["text"] for c in found) for k in range(60))
    steps = "\n".join(["# Title", *[f"{k}. install step {k}: configure the thing" for k in range(80)]])
    kinds = {c["chunk_type"] for c in chunking.chunk_text(steps)}
    assert kinds == {"procedure"}
    assert chunking.classify("an ERROR occurred") == ("error_log", 0.9)
    assert chunking.classify("word " * 60)[0] in ("structured_content", "general_content")


def test_ocr_rules(spark):
    from skein.functions import ocr

    row = spark.createDataFrame([([(5.0, 20.0, "b"), (1.0, 21.0, "a"), (1.0, 40.0, "c")], [("sure words here", 0.9), ("noise", 0.2)], "x\n```\ncode\n```\ny\n```\nz")], "s array<struct<x:double,y:double,text:string>>, p array<struct<text:string,confidence:double>>, t string")
    got = row.select(ocr.lines_of_segments(F.col("s")).alias("lines"), ocr.sure_text(F.col("p")).alias("said"), ocr.without_fenced(F.col("t")).alias("plain")).first()
    assert got["lines"] == ["a b", "c"] and got["said"] == "sure words here" and got["plain"] == "x\ny"
    sizes = spark.createDataFrame([(60, 60, "full"), (60, 60, "selective"), (300, 200, "minimal"), (300, 200, "skip")], "w int, h int, m string")
    assert [r[0] for r in sizes.select(ocr.readable(F.col("w"), F.col("h"), F.col("m"))).collect()] == [True, False, True, False]
    assert one(spark, ocr.collapse_blank_lines(F.col("a")), a="a\n\n\n\nb\n\nc") == "a\n\nb\n\nc"


def test_requests(spark):
    from skein.functions import requests

    rows = spark.createDataFrame([("12", ["u"], ["n"]), (" ", ["u"], None), ("x1", ["u"], []), ("0", ["u"], None), ("3", ["u", "v"], ["n"])], "d string, u array<string>, n array<string>")
    errors = [r[0] for r in rows.select(requests.document_error(F.col("d"), F.col("u"), F.col("n"))).collect()]
    assert errors == [None, "document_id is missing", "document_id is not a number", "document_id must be positive", "names and urls differ in number"]
    pairs = rows.where("d = '3'").select(requests.zipped(F.col("u"), F.col("n")).alias("z")).first()["z"]
    assert [(p["file_index"], p["url"], p["name"]) for p in pairs] == [(0, "u", "n"), (1, "v", None)]


def test_structure_equals_the_chunkers(spark):
    texts = ["La tâche de réplication est lente", "| a | b |\nplain", "# Kopf\n- Punkt", "1. Énumération", "Page 3\nDate: x", "", "한국어 문장 하나 입니다", "def f(x):\n  return {}"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = {r["k"]: r for r in rows.select("k", tx.structure_markers(F.col("t")).alias("m"), tx.structure_ratio(F.col("t")).alias("r")).collect()}
    for k, text in enumerate(texts):
        assert got[k]["m"] == chunking.markers(text)
        lines = [x for x in text.split("\n") if x.strip()]
        hits = sum(bool(p.search(x)) for x in lines for p in chunking._GROUPS.values())
        assert got[k]["r"] == (hits / len(lines) if lines else None)


def test_segments_and_sections(spark):
    text = "One two three. Four five six. Seven eight nine ten eleven. Twelve."
    assert one(spark, tx.segments(F.col("a"), 6), a=text) == ["One two three. Four five six.", "Seven eight nine ten eleven. Twelve."]
    assert one(spark, tx.segments(F.col("a"), 2), a=text) == ["One two three.", "Four five six.", "Seven eight nine ten eleven.", "Twelve."]
    assert one(spark, tx.segments(F.col("a"), 6), a="") == []
    assert one(spark, tx.section_between(F.col("a"), "Cause:", "Fix:"), a="x Cause: disk full\n Fix: none") == "disk full"
    assert one(spark, tx.section_between(F.col("a"), "Cause:", "Fix:"), a="no marks") is None
    assert bytes(one(spark, ft.data_uri_bytes(F.col("a")), a="data:image/png;base64,aGk=")) == b"hi" and one(spark, ft.data_uri_bytes(F.col("a")), a="/x.png") is None
    from skein.operators.retrieval import reward

    assert one(spark, reward(F.length("a"), F.lit(1.0)), a="x" * 500) == pytest.approx(0.85)


def test_misread_signs_equal_the_rules_in_python(spark):
    import re

    from skein.functions import formats

    texts = ["a\n \nb  c", "한글  말", "v0l and Ol", "it’s “x”", "1l 1 21", "corn arm", "5O o7 oO", "", "x" * 3000 + "  1"]
    steps = [(r"\n\s*\n", "\n"), (r"(?<![가-힣])\s{2,}(?![가-힣])", " "), ("0l|Ol", "01"), ('[“”"]', '"'), ("[‘’']", "'"), ("1l", "11"), (r"(?<!\d)1(?!\d)", "I"), ("rn|m", "m"), (r"(?<=\d)O|o(?=\d)", "0")]

    def plain(text):
        for pattern, by in steps:
            text = re.sub(pattern, by, text)
        return text.strip()

    got = [r["x"] for r in spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select(formats.misread_signs(F.col("t")).alias("x")).collect()]
    assert got == [*map(plain, texts), None]


def test_formats_of_nothing(spark):
    from skein.functions import formats

    t = F.col("t")
    row = spark.createDataFrame([(None, None)], "t string, n int").select(formats.truncated(t).alias("a"), formats.file_label(t).alias("b"), formats.image_context(t, "pdf").alias("c"), formats.meaningful_words(t).alias("d"), formats.readable_lines(t).alias("e"), formats.document_lines(t).alias("f"), formats.embeddable(t).alias("g"), formats.mentions_code(t, t).alias("h"), formats.strategy(t, F.col("n"), F.col("n")).alias("i"), formats.screenshot_line(t, True).alias("j")).first()
    assert tuple(row) == (None, "", "general", "", "", "", False, False, "skip", "")
