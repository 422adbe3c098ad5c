import io
import struct
import zipfile
import zlib
from email.message import EmailMessage

from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.sources import files, tables
from skein.streaming import windows


def packed(**parts: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml").replace("_rels", ".rels"), body)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
DOCX = packed(word__document_xml=f"<w:document {W}><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>")
XLSX = packed(
    xl__workbook_xml="<workbook><sheets><sheet name='One'/></sheets></workbook>",
    xl__sharedStrings_xml="<sst><si><t>head</t></si></sst>",
    xl__worksheets__sheet1_xml="<worksheet><sheetData><row><c r='A1' t='s'><v>0</v></c><c r='C1'><v>7</v></c></row></sheetData></worksheet>",
)
PPTX = packed(ppt__slides__slide1_xml="<s><p><r><t>One</t></r></p></s>", ppt__slides__slide2_xml="<s><p><r><t>Two</t></r></p></s>")


def test_readers():
    assert files.extract(DOCX, "a.docx")["text"] == "Hello\n=== TABLE ===\na | b"
    assert files.extract(DOCX, "a.docx")["tables"] == [[["a", "b"]]]
    assert files.extract(XLSX, "a.xlsx")["text"] == "=== Sheet: One ===\nhead\t7"
    assert files.extract(XLSX, "a.xlsx")["tables"] == [[["head", "", "7"]]]
    assert files.extract(PPTX, "a.pptx")["text"] == "=== Slide 1 ===\nOne\n=== Slide 2 ===\nTwo"
    assert files.extract(rb"{\rtf1 Hi \b there}", "a.rtf")["text"].split() == ["Hi", "there"]
    html = files.extract(b"<p>a</p><table><tr><td>1</td><td>2</td></tr></table>", "a.html")
    assert html["tables"] == [[["1", "2"]]] and html["text"].split("\n")[0] == "a"
    assert files.extract("한글".encode("cp949"), "a.txt")["text"] == "한글"
    assert files.extract("﻿x".encode("utf-16"), "a.txt")["text"].endswith("x")
    assert files.extract(b"", "a.txt")["text"] == ""


def test_mail():
    m = EmailMessage()
    m["subject"] = "S"
    m.set_content("body")
    m.add_attachment(b"inner", maintype="text", subtype="plain", filename="n.txt")
    m.add_attachment(b"x", maintype="application", subtype="octet-stream", filename="n.bin")
    assert files.extract(m.as_bytes(), "a.eml")["text"] == "S\nbody\n=== Attachment: n.txt ===\ninner\n=== Attachment: n.bin ===\n[unsupported attachment]"


def test_record_stream():
    said = "글자".encode("utf-16-le")
    raw = struct.pack("<I", 67 | len(said) << 20) + said + struct.pack("<I", 1 | 2 << 20) + b"zz"
    deflate = zlib.compressobj(wbits=-15)
    assert files.hwp_section(deflate.compress(raw) + deflate.flush()) == "글자"
    assert files.hwp_section(raw) == "글자" and files.hwp_section(b"") == ""


def test_broken_files_are_rows_with_errors(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(b"no zip")
    (tmp_path / "b.txt").write_text("fine")
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    got = {r["path"].rsplit("/", 1)[1]: r for r in files.read_files(spark, str(tmp_path)).collect()}
    assert got["b.txt"]["text"] == "fine" and got["b.txt"]["error"] is None and got["a.docx"]["error"].startswith("BadZipFile") and got["c.pdf"]["error"] == "unsupported type pdf"
    with_plugin = files.with_text(spark.createDataFrame([("c.pdf", bytearray(b"%PDF"), "x")], "path string, content binary, text string"), plugins={"pdf": lambda raw: (f"{len(raw)} bytes", [])})
    assert with_plugin.first()["text"] == "4 bytes"


def test_chunk_table(spark, tmp_path):
    table = tables.ChunkTable(spark, str(tmp_path / "t"))
    table.insert(spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "id string, n int"))
    table.insert(spark.createDataFrame([("b", 9), ("c", 3)], "id string, n int"))
    assert sorted(r["id"] for r in table.read().collect()) == ["a", "b", "c"] and table.read().where("id = 'b' and n = 9").count() == 0
    table.delete(F.col("id") == "a")
    assert sorted(r["id"] for r in table.read().collect()) == ["b", "c"]
    assert table.delete(F.lit(None).cast("boolean")) == {"status": "not_found", "deleted": 0}
    assert table.read().count() == 2


def test_chunk_table_adds_without_rewriting(spark, tmp_path):
    table = tables.ChunkTable(spark, str(tmp_path / "t"))
    assert table.delete(F.lit(True)) == {"status": "not_found", "deleted": 0}
    rows = lambda *x: spark.createDataFrame([*x], "id string, document int, text string, kind string")
    assert table.insert(rows(("a", 1, "x", "k"), ("b", 1, "y", "k"))) == {"status": "success", "added": 2}
    first = table._parts()
    old = table.read()
    assert table.insert(rows(("c", 2, "z", "k"), ("a", 1, "no", "k"))) == {"status": "success", "added": 1} and table._parts()[:1] == first
    assert table.update(F.col("id") == "c", kind=F.lit("new")) == {"status": "success", "updated": 1} and table._parts()[:1] == first
    assert table.update_document("document", 1, rows(("a", 1, "x", "m"), ("b", 1, "y", "m"))) == {"status": "success", "change": "metadata"}
    assert {tuple(r) for r in table.read().collect()} == {("a", 1, "x", "m"), ("b", 1, "y", "m"), ("c", 2, "z", "new")}
    assert table.update_document("document", 1, rows(("d", 1, "w", "m"))) == {"status": "success", "change": "content"}
    assert table.delete(F.col("document") == 2) == {"status": "success", "deleted": 1} and [r["id"] for r in table.read().collect()] == ["d"]
    assert old.count() == 2  # an older version can still be read
    table.vacuum()
    assert [r["id"] for r in table.read().collect()] == ["d"]


def test_payloads(spark, tmp_path):
    rows = spark.createDataFrame([('{"a": 1}',), ('{"a":',), (None,), ("",)], "j string")
    got = tables.parsed_json(rows, "j", T.StructType([T.StructField("a", T.IntegerType())])).collect()
    assert [(r["payload"] and r["payload"]["a"], r["json_error"]) for r in got][:2] == [(1, False), (None, True)] and not got[2]["json_error"] and not got[3]["json_error"]
    (tmp_path / "o.csv").write_text("file_id,x\n1,2\n")
    try:
        tables.read_file_orders(spark, str(tmp_path / "o.csv"))
        raise AssertionError
    except ValueError as problem:
        assert "file_path" in str(problem)


def test_stream_equals_table(spark, tmp_path):
    rows = spark.range(500).selectExpr("id AS event_id", "timestamp_micros(1704067200000000 + id * 60000000) AS ts", "id % 3 AS user_id", "CASE WHEN id % 2 = 0 THEN 'a' ELSE 'b' END AS event_type", "id * 1.0 AS value")
    rows.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = windows.read_stream(spark, str(tmp_path / "in"), rows.schema, 100)
    windows.run_available(windows.tumbling(stream, late="1000 hours"), str(tmp_path / "out"), str(tmp_path / "c"), "append")
    want = {tuple(r) for r in windows.tumbling(rows).collect()}
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()} if list((tmp_path / "out").glob("*.parquet")) else set()
    assert got <= want
    windows.run_available(windows.once(windows.read_stream(spark, str(tmp_path / "in"), rows.schema, 2), ["event_id"], "1000 hours"), str(tmp_path / "o2"), str(tmp_path / "c2"))
    assert spark.read.parquet(str(tmp_path / "o2")).count() == 500 == windows.once(rows.union(rows), ["event_id"]).count()
