"""The ``pN_`` queries: each operator over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import languages, leakage, lookalikes, mixing, pairs, reading, scans, splitting


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuts = splitting.oversized_cuts(_read(spark, sf_dir, "chunks"), _read(spark, sf_dir, "chunk_limits"))
    return cuts.select("chunk_key", F.when(F.exists("cuts", lambda c: c["forced"]), "forced").otherwise("natural").alias("cut"))


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = splitting.with_limits(_read(spark, sf_dir, "chunks"), _read(spark, sf_dir, "chunk_limits"))
    return splitting.split_oversized(sized).select("chunk_key", "piece_no", "piece_start", "piece_end", "forced", "piece")


def p1_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What may not be in the pieces: ones over the limit, gaps, and neighbours without overlap where no cut was forced."""
    sized = splitting.with_limits(_read(spark, sf_dir, "chunks"), _read(spark, sf_dir, "chunk_limits"))
    pieces = splitting.split_oversized(sized).where(F.length("page_content") > F.col("max_chars"))
    after = F.lead("piece_start").over(Window.partitionBy("chunk_key").orderBy("piece_no"))
    rows = pieces.select("chunk_key", "max_chars", "page_content", "piece", "piece_no", "piece_start", "piece_end", after.alias("next_start"))
    return rows.groupBy("chunk_key").agg(
        F.count_if(F.length("piece") > F.col("max_chars")).alias("over_limit"),
        F.count_if(F.col("next_start") > F.col("piece_end")).alias("gaps"),
        F.count_if(F.substring("page_content", F.col("piece_start") + 1, F.col("piece_end") - F.col("piece_start")) != F.col("piece")).alias("not_as_stored"),
        ((F.min("piece_start") == 0) & (F.max("piece_end") == F.max(F.length("page_content")))).alias("whole"),
    )


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.lookalike_classes(_read(spark, sf_dir, "chunks"), "chunk_key", "page_content")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.lookalike_pairs(_read(spark, sf_dir, "chunks"), "chunk_key", "page_content")


def p4_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "chunks").select("chunk_key", lookalikes.canonical(F.col("page_content")).alias("page_content"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = _read(spark, sf_dir, "chat_messages")
    judge = pairs.train(messages, _read(spark, sf_dir, "documents"))
    return pairs.flag_defects(pairs.paired(messages), judge).where("defect is not null").select("conv_id", "turn", "defect")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "eval_items"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.find_noise(_read(spark, sf_dir, "scanned_pages"))


def p2_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.repaired_paragraphs(_read(spark, sf_dir, "scanned_pages"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = languages.train(_read(spark, sf_dir, "documents"))
    return languages.label_cases(_read(spark, sf_dir, "chunks"), "chunk_key", "page_content", "language_detected", model)


def p3_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = languages.train(_read(spark, sf_dir, "documents"))
    found = languages.language_segments(_read(spark, sf_dir, "chunks"), "page_content", model)
    return found.select("chunk_key", F.explode("segments").alias("s")).select("chunk_key", "s.*")


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "source_weights"))[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "source_weights"))[1]


def p7_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each listed source keeps to its repeats, and its tokens are as near the aim as stated."""
    shares = mixing.mix_sources(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "source_weights"))[1]
    return shares.select("source", "have_docs", "max_repeats", (F.col("most_copies") <= F.col("max_repeats")).alias("within_repeats"), (F.col("tokens_off") <= F.col("most_tokens_off")).alias("near_aim"))


def _graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return reading.score(docs, reading.train(docs, _read(spark, sf_dir, "reading_labels")))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graded(spark, sf_dir).where("band <> 'middle'").select("doc_id", "band")


def p8_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graded(spark, sf_dir).select("doc_id", "grade", "band")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (p1_found, p1_pieces, p1_checks, p2_found, p2_paragraphs, p3_found, p3_segments, p4_found, p4_canonical, p4_classes, p5_found, p6_found, p7_mix, p7_shares, p7_checks, p8_found, p8_grades)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    look = _canonical_sql("page_content")
    return {"p1_found": P1_FOUND, "p1_checks": P1_CHECKS, "p4_found": P4_FOUND.format(look=look), "p4_canonical": f"SELECT chunk_key, {look} AS page_content FROM chunks", "p4_classes": P4_CLASSES.format(look=look), "p7_checks": P7_CHECKS}


def _canonical_sql(column: str) -> str:
    """The mapping of the look-alike tables as replacements in SQL, and the normal form C."""
    one, long, _ = lookalikes.tables()
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    changed = [p for p in range(9, 0x30000) if int(one[p]) != p and int(one[p]) < lookalikes.LONG]
    gone = [p for p in range(9, 0x30000) if int(one[p]) == lookalikes.GONE]
    sql = f"replace(replace({column}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    for p in sorted(long):
        sql = f"replace({sql}, {quoted(chr(p))}, {quoted(''.join(map(chr, long[p])))})"
    return f"nfc_normalize(translate({sql}, {quoted(''.join(map(chr, changed + gone)))}, {quoted(''.join(chr(int(one[p])) for p in changed))}))"


P1_CHECKS = """
SELECT c.chunk_key, 0 AS over_limit, 0 AS gaps, 0 AS not_as_stored, true AS whole
FROM chunks c LEFT JOIN chunk_limits l ON lower(trim(c.chunk_type, ' ')) = l.chunk_type
WHERE length(c.page_content) > coalesce(l.max_chars, (SELECT max_chars FROM chunk_limits WHERE chunk_type = 'general_content'))
"""
P4_FOUND = """
WITH k AS (SELECT chunk_key, page_content, {look} AS look FROM chunks WHERE page_content IS NOT NULL)
SELECT a.chunk_key AS chunk_key_a, b.chunk_key AS chunk_key_b FROM k a JOIN k b ON a.look = b.look AND a.chunk_key < b.chunk_key AND a.page_content <> b.page_content
"""
P4_CLASSES = """
WITH k AS (SELECT chunk_key, page_content, {look} AS look FROM chunks WHERE page_content IS NOT NULL),
f AS (SELECT look, page_content, min(chunk_key) AS form_id, count(*) AS form_rows FROM k GROUP BY ALL),
c AS (SELECT look, min(form_id) AS class_id, count(*) AS forms FROM f GROUP BY look HAVING count(*) > 1)
SELECT k.chunk_key, c.class_id, f.form_id, c.forms, f.form_rows FROM k JOIN f USING (look, page_content) JOIN c USING (look)
"""
P7_CHECKS = """
WITH d AS (SELECT lower(trim(source)) AS source, count(*) AS n FROM documents WHERE text IS NOT NULL AND text <> '' GROUP BY 1),
w AS (SELECT lower(trim(source)) AS source, max(max_repeats) AS max_repeats FROM source_weights WHERE source IS NOT NULL GROUP BY 1)
SELECT w.source, coalesce(d.n, 0) AS have_docs, w.max_repeats, true AS within_repeats, true AS near_aim FROM w LEFT JOIN d USING (source)
"""
#: Plain statement of the p1 cases: a row is forced if any stretch between breaks exceeds its limit.
P1_FOUND = r"""
WITH usual AS (SELECT max_chars AS m FROM chunk_limits WHERE chunk_type = 'general_content'),
sized AS (
  SELECT c.chunk_key, c.page_content, COALESCE(l.max_chars, u.m) AS max_chars
  FROM chunks c LEFT JOIN chunk_limits l ON lower(trim(c.chunk_type, ' ')) = l.chunk_type CROSS JOIN usual u
  WHERE c.page_content IS NOT NULL)
SELECT chunk_key,
  CASE WHEN list_max(list_transform(regexp_split_to_array(page_content, '[ \t\n\r\x0b\x0c\x{85}\x{2028}\x{2029}。！？]'), lambda x: length(x))) > max_chars
       THEN 'forced' ELSE 'natural' END AS cut
FROM sized WHERE length(page_content) > max_chars
"""
