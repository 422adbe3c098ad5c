"""All queries of the core, by name, with the equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import filetypes as ft
from ..functions import ocr, requests
from ..functions import text as tx
from ..functions import vectors as vx
from ..functions.predicates import where
from ..operators import chunking, conversations, corpus, relational, retrieval, rewrite
from ..sources import tables
from ..streaming import windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: The time that stands for now in queries about age.
NOW = "2025-06-01 00:00:00"
FLAGSHIP_QUESTION = "replication topology backup scheduler"


def _query(sql: str | None = None):
    def add(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["group_by_source_topk"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import more  # noqa: F401  registers its queries

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import more  # noqa: F401

    return dict(SQL)


def _r(c, digits: int = 6):
    return F.round(c, digits)


def _chain_sql(sql: str, steps: list[tuple[str, str]]) -> str:
    """Replacements one after the other; the texts are SQL literals, escapes in the replacement included."""
    for pattern, by in steps:
        quoted = "E'" + by.replace("\\1", "\\\\1").replace("\\2", "\\\\2") + "'" if "\\" in by else f"'{by}'"
        sql = f"regexp_replace({sql}, '{pattern}', {quoted}, 'g')"
    return sql


def _chain(sql: str, steps: list[tuple[str, str]], around: str) -> str:
    head, tail = around.split("{}")
    return head + _chain_sql(sql, steps) + tail


#: Python's blanks as a class of DuckDB's regular expressions.
SB = r"[\s\v\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{85}\x1C-\x1F]"


def _squeezed(sql: str) -> str:
    return f"trim(regexp_replace({sql}, '{SB}+', ' ', 'g'))"


COS = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / (sqrt(list_sum(list_transform({a}, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform({b}, lambda x: x::DOUBLE * x::DOUBLE))))"


# Vectors


def _first_vector(t):
    return F.broadcast(t("embeddings").where("vec_id = 0").select(F.col("embedding").alias("q")))


@_query(f"SELECT e.vec_id, round({COS.format(a='e.embedding', b='q.embedding')}, 6) AS sim FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY sim DESC, vec_id LIMIT 10")
def vector_topk_cosine(t):
    rows = t("embeddings").join(_first_vector(t))
    found = rows.select("vec_id", _r(vx.cosine(F.col("embedding"), F.col("q"))).alias("sim"))
    return found.where("sim is not null").orderBy(F.desc("sim"), "vec_id").limit(10)


@_query(f"SELECT e.vec_id, e.label, round({COS.format(a='e.embedding', b='q.embedding')}, 6) AS sim FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.label IN (1, 2, 3) AND e.vec_id >= 5 ORDER BY sim DESC, vec_id LIMIT 8")
def vector_topk_filtered(t):
    rows = t("embeddings").where(where({"$and": [{"label": {"$in": [1, 2, 3]}}, {"vec_id": {"$gte": 5}}]})).join(_first_vector(t))
    return rows.select("vec_id", "label", _r(vx.cosine(F.col("embedding"), F.col("q"))).alias("sim")).orderBy(F.desc("sim"), "vec_id").limit(8)


@_query(f"SELECT e.vec_id, round(1 - (1 - {COS.format(a='e.embedding', b='q.embedding')}) / 2, 6) AS relevance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE round(1 - (1 - {COS.format(a='e.embedding', b='q.embedding')}) / 2, 6) >= 0.5")
def vector_relevance(t):
    rows = t("embeddings").join(_first_vector(t)).select("vec_id", _r(vx.relevance(vx.cosine(F.col("embedding"), F.col("q")))).alias("relevance"))
    return rows.where("relevance >= 0.5")


@_query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS norm, len(embedding) AS dims FROM embeddings")
def vector_norms(t):
    return t("embeddings").select("vec_id", _r(vx.norm(F.col("embedding")), 5).alias("norm"), F.size("embedding").alias("dims"))


@_query("SELECT vec_id, len(list_resize(embedding, 100, 0)) AS padded, round(list_sum(list_transform(embedding[1:16], lambda x: x::DOUBLE)), 5) AS head_sum FROM embeddings")
def vector_resize(t):
    head = F.aggregate(vx.resize(F.col("embedding"), 16), F.lit(0.0), lambda a, x: a + x)
    return t("embeddings").select("vec_id", F.size(vx.resize(F.col("embedding"), 100)).alias("padded"), _r(head, 5).alias("head_sum"))


@_query(f"""WITH q AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT q.query_id, e.vec_id, {COS.format(a='q.qv', b='e.embedding')} AS sim FROM q, embeddings e)
SELECT query_id, vec_id, round(sim, 6) AS sim FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) <= 5""")
def vector_topk_each(t):
    q = t("embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return retrieval.top_k_each(q, t("embeddings"), 5, "query_id", "vec_id").select("query_id", "vec_id", _r(F.col("sim")).alias("sim"))


@_query("SELECT label, count(*) AS vectors, round(avg(embedding[1]::DOUBLE), 6) AS mean_first FROM embeddings GROUP BY label")
def vectors_by_label(t):
    return t("embeddings").groupBy("label").agg(F.count("*").alias("vectors"), _r(F.avg(F.col("embedding")[0].cast("double"))).alias("mean_first"))


# Retrieval


@_query("""WITH h AS (SELECT coalesce(source, 'unknown') AS source, doc_id, text,
  (CASE WHEN contains(lower(text), 'replication') THEN 1 ELSE 0 END) + (CASE WHEN contains(lower(text), 'topology') THEN 1 ELSE 0 END) + (CASE WHEN contains(lower(text), 'backup') THEN 1 ELSE 0 END) + (CASE WHEN contains(lower(text), 'scheduler') THEN 1 ELSE 0 END) AS hits FROM documents)
SELECT source, round(sum(hits) / 4.0::DOUBLE, 6) AS score, count(*) AS chunks, arg_max(doc_id, hits::BIGINT * 1000000000 - doc_id) AS best_key FROM h GROUP BY source ORDER BY score DESC, source LIMIT 3""")
def group_by_source_topk(t):
    return retrieval.best_sources(t("documents"), FLAGSHIP_QUESTION).select("source", _r(F.col("score")).alias("score"), "chunks", "best_key")


@_query("""WITH h AS (SELECT coalesce(source, 'unknown') AS source, member_id = 7 AS own, (CASE WHEN contains(lower(text), 'backup') THEN 1 ELSE 0 END) AS hits FROM documents)
SELECT source, round(sum(hits)::DOUBLE + 0.2::DOUBLE * avg(own::INT), 6) AS score FROM h GROUP BY source ORDER BY score DESC, source LIMIT 5""")
def member_group_boost(t):
    return retrieval.best_sources(t("documents"), "backup", 5, owner=F.col("member_id") == 7).select("source", _r(F.col("score")).alias("score"))


@_query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY md5(substring(coalesce(text, ''), 1, 200))")
def doc_dedup_head(t):
    return retrieval.dedup_by_head(t("documents")).select("doc_id")


@_query("SELECT min(chunk_key) AS chunk_key, count(*) AS copies FROM chunks GROUP BY md5(page_content)")
def chunk_exact_copies(t):
    return t("chunks").groupBy(F.md5("page_content").alias("h")).agg(F.min("chunk_key").alias("chunk_key"), F.count("*").alias("copies")).drop("h")


@_query("SELECT chunk_key, document_id, chunk_type FROM chunks WHERE (lower(source) = 'upload' OR source IS NULL) AND error_code_id IN (1, 2, 3) AND contains(page_content, 'VT-')")
def metadata_filter(t):
    rule = {"$and": [{"$or": [{"source": "upload"}, {"source": {"$exists": False}}]}, {"error_code_id": {"$in": [1, 2, 3]}}, {"page_content": {"$contains": "VT-"}}]}
    return t("chunks").where(where(rule)).select("chunk_key", "document_id", "chunk_type")


@_query(f"""WITH s AS (SELECT doc_id, text, list_min(list_filter([strpos(lower(text), 'catalog') - 1, strpos(lower(text), 'server') - 1], lambda p: p >= 0)) AS p, length(text) AS n FROM documents WHERE text IS NOT NULL),
a AS (SELECT *, greatest(0, p - 200) AS s0, least(n, p + 300) AS e0 FROM s),
b AS (SELECT *, substring(text, 1, s0) AS lft, strpos(substring(text, e0 + 1), ' ') AS nb FROM a),
c AS (SELECT *, CASE WHEN s0 > 0 AND contains(lft, ' ') THEN length(lft) - strpos(reverse(lft), ' ') + 1 ELSE s0 END AS s1, CASE WHEN e0 < n AND nb > 0 THEN e0 + nb - 1 ELSE e0 END AS e1 FROM b)
SELECT doc_id, CASE WHEN p IS NULL THEN CASE WHEN n > 500 THEN substring(text, 1, 500) || '...' ELSE text END
 ELSE (CASE WHEN s1 > 0 THEN '...' ELSE '' END) || substring(text, s1 + 1, e1 - s1) || (CASE WHEN e1 < n THEN '...' ELSE '' END) END AS snippet FROM c""")
def snippet_keyword(t):
    return t("documents").where("text is not null").select("doc_id", tx.snippet(F.col("text"), F.lit("catalog server")).alias("snippet"))


_HITS = "(" + " + ".join(f"(CASE WHEN contains(lower(text), '{w}') THEN 1 ELSE 0 END)" for w in FLAGSHIP_QUESTION.split()) + ")"


@_query("""WITH s AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY """ + _HITS + """ DESC, doc_id) AS r, list_distinct(string_split(lower(""" + _squeezed("text") + """), ' ')) AS w FROM documents WHERE text IS NOT NULL AND source IS NOT NULL),
t AS (SELECT * FROM s WHERE r <= 10),
p AS (SELECT a.source, len(list_intersect(a.w, b.w))::DOUBLE / len(list_distinct(list_concat(a.w, b.w))) AS j FROM t a JOIN t b ON a.source = b.source AND a.doc_id < b.doc_id)
SELECT d.source, round(1 - coalesce(avg(p.j), 0), 6) AS diversity FROM (SELECT DISTINCT source FROM t) d LEFT JOIN p ON p.source = d.source GROUP BY d.source""")
def diversity_of_results(t):
    docs = retrieval.term_hits(t("documents").where("source is not null and text is not null"), retrieval.query_terms(FLAGSHIP_QUESTION))
    top = retrieval.best_each(docs.select("source", "doc_id", "text", "hits"), "source", "doc_id", "hits", 10)
    return corpus.diversity(top, "source", "doc_id", "text").select("source", _r(F.col("diversity")).alias("diversity"))


@_query()
def diverse_selection(t):
    docs = t("documents").where("text is not null and source is not null")
    scored = retrieval.term_hits(docs, retrieval.query_terms(FLAGSHIP_QUESTION)).withColumn("score", F.col("hits") / F.length("text"))
    top = retrieval.best_each(scored.select("source", "doc_id", "text", "score"), "source", "doc_id", "score")
    return retrieval.pick_diverse(top, "source", "doc_id", "text", "score", domain=corpus.tfidf_terms(docs), query=FLAGSHIP_QUESTION)


@_query("""SELECT doc_id, round(0.3::DOUBLE * least(1, length(text) / 5000.0::DOUBLE) + 0.2::DOUBLE * (CASE WHEN contains(text, '/') THEN 1 ELSE 0 END) + 0.4::DOUBLE * (CASE WHEN contains(lower(text), 'backup') THEN 1 ELSE 0 END) + 0.1::DOUBLE * 0, 6) AS score FROM documents WHERE text IS NOT NULL""")
def dynamic_score(t):
    c = F.col("text")
    score = retrieval.dynamic_score(F.least(F.lit(1.0), F.length(c) / 5000.0), F.contains(c, F.lit("/")).cast("int"), F.contains(F.lower(c), F.lit("backup")).cast("int"), F.lit(0.0))
    return t("documents").where("text is not null").select("doc_id", _r(score).alias("score"))


@_query(f"""SELECT doc_id, round(0.4::DOUBLE + 0.3::DOUBLE * 0.5 + 0.2::DOUBLE * (CASE WHEN member_id = 7 THEN 0.15 ELSE 0 END) + 0.1::DOUBLE * (CASE WHEN date_diff('day', created_at::DATE, DATE '2025-06-01') < 7 THEN 0.1::DOUBLE * (7 - date_diff('day', created_at::DATE, DATE '2025-06-01')) / 7 ELSE 0 END), 6) AS score FROM documents""")
def member_rank(t):
    age = F.datediff(F.lit(NOW).cast("date"), F.col("created_at"))
    return t("documents").select("doc_id", _r(retrieval.member_score(F.lit(0.5), F.coalesce(F.col("member_id") == 7, F.lit(False)), age)).alias("score"))


# Text


@_query("SELECT doc_id, CASE WHEN text IS NULL OR starts_with(text, '=== Page') OR starts_with(text, 'Image ') THEN '' ELSE regexp_replace(" + _squeezed("replace(replace(text, '—', '-'), '•', '*')") + ", '[^\\x20-\\x7E]', '', 'g') END AS cleaned FROM documents")
def clean_text(t):
    return t("documents").select("doc_id", tx.clean_text(F.col("text")).alias("cleaned"))


@_query("WITH a AS (SELECT chunk_key, replace(replace(replace(page_content, '—', '-'), '•', '*'), '…', '...') AS x FROM chunks), b AS (SELECT chunk_key, regexp_replace(regexp_replace(regexp_replace(x, '===\\s*Page\\s+\\d+\\s*===', ' ', 'g'), '===\\s*IMAGE TEXTS\\s*===', ' ', 'g'), 'Image\\s+\\d+:', ' ', 'g') AS x FROM a) SELECT chunk_key, " + _squeezed("regexp_replace(regexp_replace(x, '[^\\x20-\\x7E\\n]', '', 'g'), '\\n+', ' ', 'g')") + " AS cleaned FROM b")
def clean_for_embedding(t):
    return t("chunks").select("chunk_key", tx.clean_for_embedding(F.col("page_content")).alias("cleaned"))


@_query(_chain(
    _squeezed(_chain_sql("replace(replace(replace(page_content, '—', '-'), '•', '*'), '…', '...')", [(r"===\s*Page\s+\d+\s*===", " "), (r"===\s*IMAGE TEXTS\s*===", " "), (r"Image\s+\d+:", " "), (r"[^\x20-\x7E\n]", ""), (r"\n+", " ")])),
    [(r"-\w+\s+[\w\-_]+", " "), (r"\[\w+[\]\:]", " "), (r"/\w+", " "), (r"\|\s*\w+", " "), (r"\w+\.\w+\.\w+", " "), (r"\([^)]*\)", " "), ("mm/dd/yyyy", "date"), ("hh:mm:ss", "time"), (r"[^\w\s.,;:?!]", " "), (r"\s+", " ")],
    "SELECT chunk_key, trim(substring(trim({}), 1, 6000)) AS cleaned FROM chunks",
))
def clean_for_embedding_aggressive(t):
    return t("chunks").select("chunk_key", tx.clean_for_embedding(F.col("page_content"), True).alias("cleaned"))


@_query(_chain("text", [(r"\n\s*\n\s*\n+", r"\n\n"), (r"[ \t]+", " "), (r"[^\S\n]{3,}", " "), (r"([.!?])\s*([A-Z])", r"\1 \2"), (r"(?i)\n\s*(Page|페이지)\s*\d+\s*\n", r"\n"), (r"\n+([.,:;!?])", r"\1")], "SELECT doc_id, trim({}, ' ' || chr(9) || chr(10) || chr(13)) AS text FROM documents"))
def preprocess_text(t):
    return t("documents").select("doc_id", tx.preprocess(F.col("text")).alias("text"))


@_query("SELECT page_key, regexp_replace(page_content, '(?m)^\\s*Page\\s+\\d+\\s*$', '', 'g') AS body FROM scanned_pages")
def strip_page_lines(t):
    return t("scanned_pages").select("page_key", tx.strip_page_lines(F.col("page_content")).alias("body"))


@_query("SELECT page_key, regexp_replace(page_content, '([\\p{L}\\p{N}\\p{M}_])-" + SB + "+([\\p{L}\\p{N}\\p{M}_])', '\\1\\2', 'g') AS body FROM scanned_pages")
def join_hyphens(t):
    return t("scanned_pages").select("page_key", tx.join_hyphens(F.col("page_content")).alias("body"))


@_query("WITH w AS (SELECT doc_id, list_filter(string_split(" + _squeezed("regexp_replace(text, '<[^>]+>', ' ', 'g')") + ", ' ')[1:1000], lambda x: length(x) >= 2 AND NOT regexp_matches(x, '^[0-9]+$') AND regexp_matches(x, '^[a-zA-Z가-힣0-9_.-]+$')) AS k FROM documents) SELECT doc_id, substring(coalesce(array_to_string(k, ' '), ''), 1, 5000) AS words FROM w")
def for_analysis(t):
    return t("documents").select("doc_id", tx.for_analysis(F.col("text")).alias("words"))


@_query("WITH w AS (SELECT item_id, string_split(" + _squeezed("text") + ", ' ') AS w FROM eval_items), k AS (SELECT *, list_filter(w, lambda x: NOT list_contains(['a','an','the','is','are','was','were'], lower(x))) AS k FROM w) SELECT item_id, CASE WHEN len(w) > 3 AND len(k) > 0 THEN array_to_string(k, ' ') ELSE array_to_string(w, ' ') END AS query FROM k")
def query_cleaning(t):
    return t("eval_items").select("item_id", tx.clean_query(F.col("text")).alias("query"))


@_query()
def repeated_word_collapse(t):
    return t("documents").select("doc_id", tx.collapse_repeats(F.col("text")).alias("text"))


@_query()
def sentence_split(t):
    return t("documents").where("text is not null").select("doc_id", F.posexplode(tx.split_sentences(F.col("text"))).alias("sentence_no", "sentence"))


@_query("SELECT doc_id, round(length(regexp_replace(text, '[^가-힣]', '', 'g'))::DOUBLE / nullif(length(trim(text)), 0), 6) AS share FROM documents")
def korean_share(t):
    return t("documents").select("doc_id", _r(tx.korean_share(F.col("text"))).alias("share"))


@_query("SELECT page_key FROM scanned_pages WHERE length(regexp_replace(page_content, '[^\\p{L}\\p{N}]', '', 'g')) >= 0.75 * length(page_content)")
def legible_pages(t):
    return t("scanned_pages").where(tx.keep_legible(F.col("page_content"), 0.75) != "").select("page_key")


def _any(words: list[str], sql: str) -> str:
    return "(" + " OR ".join(f"contains({sql}, '{w}')" for w in words) + ")"


def _patterns(patterns: list[str], flags: str) -> str:
    """Alternatives as one pattern for DuckDB, with the word characters and digits of Unicode."""
    joined = "|".join(f"(?:{p})" for p in patterns).replace("[\\d\\w]", r"[\p{L}\p{M}\p{N}_\x{200C}\x{200D}]").replace("[\\da-zA-Z]", r"[\p{Nd}a-zA-Z]").replace(r"\d", r"\p{Nd}").replace(r"\s", SB)
    joined = joined.replace(r"\b(", r"(?:^|[^\p{L}\p{M}\p{N}_])(").replace(r")\b", r")(?:$|[^\p{L}\p{M}\p{N}_])")
    return f"({flags})" + joined


_MARKERS = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(page_content, '{_patterns(p, '?im')}') THEN '{name}' END" for name, p in tx.STRUCTURE.items()) + "], lambda m: m IS NOT NULL)"
_CLASS = f"CASE WHEN {_any(tx.ERROR_WORDS, 'lower(page_content)')} THEN 'error_log' WHEN {_any(tx.PROCEDURE_WORDS, 'lower(page_content)')} THEN 'procedure' WHEN len({_MARKERS}) > 0 THEN 'structured_content' WHEN {_any(tx.TECHNICAL_SIGNS, 'page_content')} THEN 'technical_content' WHEN len(list_filter(string_split({_squeezed('page_content')}, ' '), lambda w: w <> '')) < 50 THEN 'summary' ELSE 'general_content' END"
_SURE = "CASE kind WHEN 'error_log' THEN 0.9 WHEN 'procedure' THEN 0.8 WHEN 'structured_content' THEN 0.8 WHEN 'technical_content' THEN 0.7 WHEN 'summary' THEN 0.6 ELSE 0.5 END::DOUBLE"


@_query(f"WITH k AS (SELECT chunk_key, {_CLASS} AS kind, {_MARKERS} AS markers FROM chunks WHERE page_content IS NOT NULL) SELECT chunk_key, kind AS found_type, {_SURE} AS found_confidence, array_to_string(markers, ',') AS markers FROM k")
def chunk_class(t):
    c = tx.chunk_class(F.col("page_content"))
    rows = t("chunks").where("page_content is not null")
    return rows.select("chunk_key", c["chunk_type"].alias("found_type"), c["confidence"].alias("found_confidence"), F.array_join(tx.structure_markers(F.col("page_content")), ",").alias("markers"))


@_query("WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents) SELECT doc_id, round(list_sum(list_transform(l, lambda x: " + " + ".join(f"regexp_matches(x, '{_patterns(p, '?i')}')::INT" for p in tx.STRUCTURE.values()) + "))::DOUBLE / nullif(len(l), 0), 6) AS ratio FROM l")
def line_structure_ratio(t):
    return t("documents").select("doc_id", _r(tx.structure_ratio(F.col("text"))).alias("ratio"))


_LAST = "CASE WHEN contains(t, {m}) THEN length(regexp_extract(t, '(?s)^(.*)' || {m}, 1)) ELSE -1 END"
_STOPS = ", ".join(_LAST.replace("|| {m}", "|| '[" + m[0] + "] '").format(m=f"'{m}'") for m in (". ", "! ", "? "))


@_query(f"WITH a AS (SELECT chunk_key, page_content AS x, CASE WHEN length(page_content) <= 200 THEN page_content ELSE right(page_content, 200) END AS t FROM chunks), b AS (SELECT *, greatest({_STOPS}) AS stop, {_LAST.format(m='chr(10) || chr(10)')} AS para, {_LAST.format(m=repr(' '))} AS word FROM a) SELECT chunk_key, CASE WHEN length(x) <= 200 THEN x ELSE substring(t, (CASE WHEN stop > 0.3 * length(t) THEN stop + 2 WHEN para > 0.2 * length(t) THEN para + 2 WHEN word > 0.1 * length(t) THEN word + 1 ELSE 0 END) + 1) END AS tail FROM b")
def overlap_tail(t):
    return t("chunks").select("chunk_key", tx.overlap_tail(F.col("page_content"), 200).alias("tail"))


@_query("SELECT chunk_key, document_id, chunk_index, length(page_content) AS chars, length(lag(page_content) OVER (PARTITION BY document_id ORDER BY chunk_index, chunk_key)) AS chars_before FROM chunks")
def chunk_before(t):
    from pyspark.sql import Window

    w = Window.partitionBy("document_id").orderBy("chunk_index", "chunk_key")
    return t("chunks").select("chunk_key", "document_id", "chunk_index", F.length("page_content").alias("chars"), F.length(F.lag("page_content").over(w)).alias("chars_before"))


@_query()
def chunk_documents(t):
    return chunking.chunk_documents(t("documents"))


@_query()
def chunk_rollup(t):
    return chunking.chunk_rollup(chunking.chunk_documents(t("documents"))).withColumn("avg_confidence", _r(F.col("avg_confidence")))


# Files and HTML


@_query("""SELECT resolve_id, created_at, unnest(regexp_extract_all(content, '(?i)<img[^>]+src=["''](.*?)["'']', 1)) AS src FROM resolve""")
def html_images(t):
    return t("resolve").select("resolve_id", "created_at", F.explode(ft.image_links(F.col("content"))).alias("src"))


@_query("WITH b AS (SELECT resolve_id, " + _chain_sql("content", [(r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", " "), (r"(?i)</?(p|h[1-6]|li|ul|ol|div|tr|table|br|section|article|blockquote|pre)\b[^>]*>", r"\n"), ("<[^>]*>", ""), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")]) + " AS body, created_at FROM resolve), l AS (SELECT resolve_id, list_filter(list_transform(string_split(body, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') AS l FROM b) SELECT resolve_id, unnest(range(0, len(l)))::INT AS line_no, unnest(l) AS line FROM l")
def html_text(t):
    return t("resolve").select("resolve_id", F.posexplode(ft.html_lines(F.col("content"))).alias("line_no", "line"))


@_query("""WITH n AS (SELECT resolve_id, 'https://files.example/a/' || unnest(regexp_extract_all(content, '(?i)<img[^>]+src=["''](.*?)["'']', 1)) || '?v=1' AS url FROM resolve)
SELECT resolve_id, url, regexp_extract(split_part(url, '?', 1), '([^/]*)$', 1) AS file, 'image' AS file_type FROM n""")
def file_of_link(t):
    links = t("resolve").select("resolve_id", F.explode(ft.image_links(F.col("content"))).alias("src"))
    links = links.select("resolve_id", F.concat(F.lit("https://files.example/a/"), "src", F.lit("?v=1")).alias("url"))
    return links.select("resolve_id", "url", ft.name_of_link(F.col("url")).alias("file"), ft.type_by_extension(F.col("url")).alias("file_type"))


@_query("""WITH n AS (SELECT p_partkey, p_name || (CASE p_partkey % 7 WHEN 0 THEN '.PDF' WHEN 1 THEN '.xlsx?x=1' WHEN 2 THEN '' WHEN 3 THEN '.null' WHEN 4 THEN '.abcdefghijkl' WHEN 5 THEN '.csv' ELSE '.eml' END) AS name FROM part)
SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'pdf' WHEN 1 THEN 'excel' WHEN 5 THEN 'txt' WHEN 6 THEN 'msg' ELSE 'unknown' END AS file_type, substring(md5(name), 1, 10) AS short FROM n""")
def file_type_by_extension(t):
    ends = F.element_at(F.array(*map(F.lit, [".PDF", ".xlsx?x=1", "", ".null", ".abcdefghijkl", ".csv", ".eml"])), (F.col("p_partkey") % 7 + 1).cast("int"))
    rows = t("part").select("p_partkey", F.concat("p_name", ends).alias("name"))
    return rows.select("p_partkey", ft.type_by_extension(F.col("name")).alias("file_type"), F.substring(ft.sanitized_name(F.col("name")), 1, 10).alias("short"))


@_query("""SELECT event_id, ts + INTERVAL 900 SECOND < TIMESTAMPTZ '2024-01-15 00:00:00+00' AS expired FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)""")
def link_expiry(t):
    url = F.concat(F.lit("https://x/y?X-Amz-Date="), F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'"), F.lit("&X-Amz-Expires=900"))
    return t("events").select("event_id", ft.link_expired(url, F.lit("2024-01-15 00:00:00").cast("timestamp")).alias("expired"))


# Corpus


@_query("SELECT lower(w) AS word, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda w: regexp_matches(w, '^[a-z가-힣]{2,8}$')))) AS w FROM documents) GROUP BY 1")
def document_frequency(t):
    return corpus.document_frequency(t("documents"))


@_query("WITH d AS (SELECT w AS word, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda w: regexp_matches(w, '^[a-z가-힣]{2,8}$')))) AS w FROM documents) GROUP BY 1) SELECT word, df FROM d WHERE df > 0.3 * (SELECT count(text) FROM documents) AND length(word) < 8 ORDER BY df DESC, word LIMIT 150")
def corpus_stopwords(t):
    return corpus.corpus_stopwords(t("documents"), 0.3)


_TFIDF = """WITH t AS (SELECT doc_id, unnest({terms}) AS term FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS w FROM documents WHERE text IS NOT NULL)),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL), n AS (SELECT count(text) AS n FROM documents),
df AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY term),
v AS (SELECT term, df, ln((1 + n)::DOUBLE / (1 + df)) + 1 AS idf FROM df, n WHERE df >= 2 AND df <= {max_df}::DOUBLE * n ORDER BY total DESC, term LIMIT {vocabulary}),
w AS (SELECT doc_id, term, df, tf * idf AS w FROM tf JOIN v USING (term)), l AS (SELECT doc_id, sqrt(sum(w * w)) AS l FROM w GROUP BY doc_id)
SELECT term, any_value(df) AS df, round(sum(w / l) / (SELECT n FROM n), 6) AS weight FROM w JOIN l USING (doc_id) GROUP BY term ORDER BY sum(w / l) DESC, term LIMIT {k}"""


@_query(_TFIDF.format(terms="w", max_df=0.9, vocabulary=200, k=50))
def tfidf_domain_terms(t):
    return corpus.tfidf_terms(t("documents")).withColumn("weight", _r(F.col("weight")))


@_query(_TFIDF.format(terms="list_transform(list_zip(w[1:len(w)-1], w[2:len(w)]), lambda z: z[1] || ' ' || z[2])", max_df=0.8, vocabulary=50, k=15))
def bigram_phrases(t):
    return corpus.tfidf_terms(t("documents"), 2, max_df=0.8, vocabulary=50, k=15).withColumn("weight", _r(F.col("weight")))


@_query()
def technical_patterns(t):
    return corpus.technical_terms(t("documents"))


@_query("SELECT count(*) AS documents, round(avg(length(text)), 6) AS avg_length, round(avg(len(regexp_extract_all(text, '[.!?]+(?:[ \\t\\n\\v\\f\\r]|$)'))), 6) AS avg_sentences, sum(len(regexp_extract_all(text, '(?m)^[ \\t\\n\\v\\f\\r]*[-*•][ \\t\\n\\v\\f\\r]+')) + len(regexp_extract_all(text, '(?m)^[ \\t\\n\\v\\f\\r]*[0-9]+\\.[ \\t\\n\\v\\f\\r]+')))::BIGINT AS list_patterns, sum(len(regexp_extract_all(text, '`[^`]+`')) + len(regexp_extract_all(text, '(?s)```.*?```')))::BIGINT AS code_patterns FROM documents WHERE text IS NOT NULL")
def structure_stats(t):
    return corpus.structure_stats(t("documents")).withColumn("avg_length", _r(F.col("avg_length"))).withColumn("avg_sentences", _r(F.col("avg_sentences"))).withColumn("list_patterns", F.col("list_patterns").cast("bigint")).withColumn("code_patterns", F.col("code_patterns").cast("bigint"))


@_query("WITH d AS (SELECT regexp_replace(page_content, '[.!?]+$', ':') AS text FROM chunks), h AS (SELECT unnest(regexp_extract_all(text, '(?m)^[A-Z][^.!?\\n]*:$')) AS header FROM d) SELECT header, count(*) AS n FROM h GROUP BY header ORDER BY n DESC, header LIMIT 5")
def section_headers_top5(t):
    headed = t("chunks").select(F.regexp_replace("page_content", r"[.!?]+$", ":").alias("text"))
    return corpus.section_headers(headed)


# Relational


@_query("""WITH c AS (SELECT error_code_id, count(*) AS pieces, min(chunk_key) AS first_piece, count(DISTINCT document_id) AS documents FROM chunks GROUP BY 1)
SELECT DISTINCT r.resolve_id, r.client_nm, r.os_version_id, e.error_code_nm, coalesce(c.pieces, 0) AS pieces, c.first_piece, coalesce(c.documents, 0) AS documents FROM resolve r JOIN error_code e USING (error_code_id) LEFT JOIN c USING (error_code_id)""")
def report_join(t):
    pieces = t("chunks").groupBy("error_code_id").agg(F.count("*").alias("pieces"), F.min("chunk_key").alias("first_piece"), F.countDistinct("document_id").alias("documents"))
    joined = t("resolve").join(t("error_code"), "error_code_id").join(pieces, "error_code_id", "left").na.fill(0, ["pieces", "documents"])
    return joined.select("resolve_id", "client_nm", "os_version_id", "error_code_nm", "pieces", "first_piece", "documents").distinct()


@_query("SELECT l_orderkey, l_linenumber, o_orderpriority, p_brand, s_name, count(*) AS lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE o_orderstatus = 'F' AND p_size < 10 GROUP BY ALL")
def files_by_code(t):
    joined = t("orders").where("o_orderstatus = 'F'").join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("part").where("p_size < 10"), F.col("p_partkey") == F.col("l_partkey")).join(t("supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    return joined.groupBy("l_orderkey", "l_linenumber", "o_orderpriority", "p_brand", "s_name").agg(F.count("*").alias("lines"))


@_query("SELECT doc_id, lower(trim(source)) AS source FROM documents WHERE lower(trim(source)) IN ('kb-portal', 'wiki-export')")
def case_insensitive_in(t):
    low = F.lower(F.trim("source"))
    return t("documents").where(low.isin("kb-portal", "wiki-export")).select("doc_id", low.alias("source"))


@_query("""WITH n AS (SELECT DISTINCT p_brand AS name, substring(p_brand, 1, 7) AS prefix FROM part UNION ALL SELECT 'Brand#9x', 'Brand#1'),
e AS (SELECT name, p_partkey, 'exact' AS match FROM n JOIN part ON p_brand = name)
SELECT * FROM e UNION ALL SELECT name, p_partkey, 'prefix' FROM n JOIN part ON starts_with(p_brand, prefix) WHERE name NOT IN (SELECT name FROM e)""")
def exact_or_prefix_join(t):
    names = t("part").select(F.col("p_brand").alias("name"), F.substring("p_brand", 1, 7).alias("prefix")).distinct()
    more = names.sparkSession.createDataFrame([("Brand#9x", "Brand#1")], "name string, prefix string")
    return relational.exact_or_prefix(t("part").select("p_partkey", "p_brand"), names.unionByName(more), "p_brand").select("name", "p_partkey", "match")


@_query("SELECT DISTINCT d.document_id, d.document_type FROM document_metadata d WHERE lower(d.document_type) IN (SELECT lower(document_type) FROM documents WHERE document_type IS NOT NULL)")
def valid_types_semi(t):
    allowed = t("documents").where("document_type is not null").select(F.lower("document_type").alias("k")).distinct()
    return relational.valid_rows(t("document_metadata").withColumn("k", F.lower("document_type")), allowed, "k").select("document_id", "document_type").distinct()


@_query("SELECT chunk_key, id FROM chunks WHERE id NOT IN (SELECT id FROM chunks WHERE source = 'upload')")
def new_ids_anti(t):
    return relational.new_rows(t("chunks").select("chunk_key", "id"), t("chunks").where("source = 'upload'"), ["id"])


@_query("""WITH a AS (SELECT r_name, n_name, c_custkey FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey) SELECT r_name, n_name, count(DISTINCT c_custkey) AS leaves FROM a GROUP BY ALL""")
def graph_two_hop(t):
    first = t("region").join(t("nation"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name")
    second = t("nation").join(t("customer"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "c_custkey")
    nested = relational.two_hops(t("region"), first, second, "r_name", "n_name", "c_custkey")
    flat = nested.select("r_name", F.explode("neighbours").alias("x")).select("r_name", "x.n_name", F.size("x.leaves").cast("bigint").alias("leaves"))
    return flat.where("leaves > 0")


@_query("""SELECT e.event_id, e.user_id, p.value AS value_asof FROM (SELECT * FROM events WHERE event_type = 'error' UNION ALL SELECT * FROM events WHERE event_type = 'error') e LEFT JOIN LATERAL (SELECT value FROM events q WHERE q.event_type = 'click' AND q.user_id = e.user_id AND q.ts <= e.ts AND q.ts >= e.ts - INTERVAL 6 HOUR ORDER BY q.ts DESC, q.event_id DESC LIMIT 1) p ON true""")
def asof_latest_experience(t):
    errors, clicks = t("events").where("event_type = 'error'").select("event_id", "user_id", "ts"), t("events").where("event_type = 'click'")
    errors = errors.unionAll(errors)  # equal rows stay as many as they are
    return relational.asof_join(errors, clicks, ["user_id"], "ts", "value", 6 * 3600, "event_id").select("event_id", "user_id", "value_asof")


@_query("""WITH d AS (SELECT document_id, count(*) AS chunks, max(created_at) AS last_at, arg_min(coalesce(source, ''), chunk_key) AS source FROM chunks GROUP BY document_id) SELECT * FROM d ORDER BY last_at DESC, document_id LIMIT 50""")
def user_documents(t):
    docs = t("chunks").groupBy("document_id").agg(F.count("*").alias("chunks"), F.max("created_at").alias("last_at"), F.min_by(F.coalesce("source", F.lit("")), "chunk_key").alias("source"))
    return docs.orderBy(F.desc("last_at"), "document_id").limit(50)


@_query("SELECT member_id, count(DISTINCT conv_id) AS conversations, count(*) AS messages FROM chat_messages GROUP BY member_id")
def user_analytics(t):
    return conversations.user_analytics(t("chat_messages"))


@_query("""WITH s AS (SELECT user_id, CASE event_type WHEN 'error' THEN 'error' ELSE 'success' END AS st FROM events) SELECT user_id, count(*) FILTER (st = 'success') AS succeeded, count(*) FILTER (st = 'error') AS failed, count(*) AS total, CASE WHEN count(*) FILTER (st = 'error') = 0 THEN 'success' WHEN count(*) FILTER (st = 'success') = 0 THEN 'error' ELSE 'partial' END AS status FROM s GROUP BY user_id""")
def status_rollup(t):
    return relational.status_rollup(t("events").withColumn("st", F.when(F.col("event_type") == "error", "error").otherwise("success")), ["user_id"], "st")


@_query("SELECT event_id, round(sum(value) OVER w, 2) AS running_sum, count(value) OVER w AS running_count, floor(avg(value) OVER w * 1000 + 0.00037::DOUBLE) / 1000 AS running_avg FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def running_avg(t):
    found = relational.running(t("events"), ["user_id"], "ts", "event_id", "value")
    return found.select("event_id", _r(F.col("running_sum"), 2).alias("running_sum"), "running_count", (F.floor(F.col("running_avg") * 1000 + 0.00037) / 1000).alias("running_avg"))


@_query("""WITH l AS (SELECT document_id, lower(document_type) AS document_type, max(chunks_stored) AS chunks_stored, max(updated_at) AS updated_at FROM document_metadata GROUP BY ALL),
n AS (SELECT document_id, document_type, chunks_stored + 1 AS chunks_stored FROM l WHERE document_id % 3 = 0 UNION ALL SELECT document_id + 1000000, document_type, 1 FROM l WHERE document_id % 50 = 0)
SELECT coalesce(n.document_id, l.document_id) AS document_id, coalesce(n.document_type, l.document_type) AS document_type, coalesce(n.chunks_stored, l.chunks_stored) AS chunks_stored FROM l FULL JOIN n ON l.document_id = n.document_id AND l.document_type = n.document_type""")
def upsert_metadata(t):
    old = t("document_metadata").groupBy("document_id", F.lower("document_type").alias("document_type")).agg(F.max("chunks_stored").alias("chunks_stored"))
    new = old.where("document_id % 3 = 0").withColumn("chunks_stored", F.col("chunks_stored") + 1)
    added = old.where("document_id % 50 = 0").select((F.col("document_id") + 1000000).alias("document_id"), "document_type", F.lit(1).alias("chunks_stored"))
    return relational.upsert(old, new.unionByName(added), ["document_id", "document_type"])


@_query("""SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'removed' WHEN o_orderkey % 7 = 0 THEN 'changed' ELSE 'same' END AS change FROM orders UNION ALL SELECT o_orderkey + 10000000, 'added' FROM orders WHERE o_orderkey % 100 = 1""")
def change_detection(t):
    old = t("orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = old.where("o_orderkey % 10 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 7 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    added = old.where("o_orderkey % 100 = 1").withColumn("o_orderkey", F.col("o_orderkey") + 10000000)
    return relational.changes(old, new.unionByName(added), "o_orderkey", ["o_orderstatus", "o_totalprice"])


@_query("SELECT chunk_key FROM (SELECT chunk_key, count(*) OVER (PARTITION BY document_id, chunk_type) AS n, row_number() OVER (PARTITION BY document_id, chunk_type ORDER BY chunk_key) AS r FROM chunks WHERE chunk_type IS NOT NULL) WHERE n <= 5 OR r <= 2")
def cleanup_duplicates(t):
    return relational.drop_excess(t("chunks").where("chunk_type is not null"), ["document_id", "chunk_type"], ["chunk_key"]).select("chunk_key")


@_query("SELECT document_id, document_type, chunks_stored FROM (SELECT *, row_number() OVER (PARTITION BY document_id, lower(document_type) ORDER BY updated_at DESC, chunks_stored DESC, processed_count DESC) AS r FROM document_metadata) WHERE r = 1")
def latest_metadata(t):
    return relational.latest(t("document_metadata").withColumn("_t", F.lower("document_type")), ["document_id", "_t"], ["updated_at", "chunks_stored", "processed_count"]).select("document_id", "document_type", "chunks_stored")


@_query(f"SELECT chunk_key FROM chunks WHERE created_at IS NULL OR created_at > TIMESTAMPTZ '{NOW}+00' - INTERVAL 90 DAY")
def ttl_retention(t):
    return relational.retained(t("chunks"), "created_at", F.lit(NOW).cast("timestamp"), 90).select("chunk_key")


@_query("SELECT p_partkey, (row_number() OVER (ORDER BY p_partkey) - 1) // 64 AS batch_no FROM part")
def paged_batches(t):
    return relational.batches(t("part").select("p_partkey"), "p_partkey", 64, 7)


@_query("SELECT DISTINCT coalesce(error_code_nm, '') AS error_code_nm, coalesce(message_en, '') AS message_en FROM error_code")
def static_dimension(t):
    return tables.fill_texts(t("error_code").select("error_code_nm", "message_en")).distinct()


@_query("SELECT event_id, (props->>'k')::INT AS k FROM events")
def json_props(t):
    from pyspark.sql import types as T

    return tables.parsed_json(t("events"), "props", T.StructType([T.StructField("k", T.IntegerType())])).select("event_id", "payload.k")


@_query("SELECT document_id, document_type, updated_at, custom_metadata IS NOT NULL AND trim(custom_metadata) <> '' AND NOT coalesce(json_valid(custom_metadata), false) AS json_error FROM document_metadata")
def malformed_metadata(t):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("team", T.StringType()), T.StructField("site", T.StringType()), T.StructField("prio", T.IntegerType())])
    return tables.parsed_json(t("document_metadata"), "custom_metadata", schema).select("document_id", "document_type", "updated_at", "json_error")


@_query("SELECT document_id, updated_at, coalesce(array_to_string(string_split(tags, ','), ','), '') AS tags, coalesce(source, '') AS source FROM document_metadata")
def metadata_sanitize(t):
    return tables.flat_metadata(t("document_metadata").select("document_id", "updated_at", F.split("tags", ",").alias("tags"), "source"))


@_query("SELECT count(*) AS n, count(DISTINCT document_id) AS documents, count(DISTINCT id) AS ids FROM chunks")
def collection_count(t):
    return t("chunks").agg(F.count("*").alias("n"), F.countDistinct("document_id").alias("documents"), F.countDistinct("id").alias("ids"))


# Conversations

_ROLES = "CASE WHEN lower(trim(type)) IN ('humanmessage','human','user') THEN 'user' WHEN lower(trim(type)) IN ('aimessage','ai','assistant') THEN 'assistant' WHEN lower(trim(type)) IN ('systemmessage','system') THEN 'system' END"


@_query(f"SELECT {_ROLES} AS role, count(*) AS messages, count(content) AS filled FROM chat_messages GROUP BY 1")
def message_roles(t):
    return t("chat_messages").groupBy(conversations.role(F.col("type")).alias("role")).agg(F.count("*").alias("messages"), F.count("content").alias("filled"))


@_query(f"WITH m AS (SELECT conv_id, turn, {_ROLES} AS role, arg_min(content, message_id) AS content FROM chat_messages GROUP BY ALL) SELECT q.conv_id, q.turn, q.content AS question, a.content AS answer FROM m q JOIN m a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant' WHERE q.role = 'user'")
def history_pairs(t):
    return conversations.turn_pairs(t("chat_messages"))


@_query(f"""WITH m AS (SELECT conv_id, turn, {_ROLES} AS role, arg_min(content, message_id) AS content FROM chat_messages GROUP BY ALL),
f AS (SELECT conv_id, trim(regexp_replace(trim(arg_min(content, turn)), '(?i)^(what is|what are|how do|how to|explain|tell me|can you)\\s+', '')) AS b FROM m WHERE role = 'user' GROUP BY conv_id),
s AS (SELECT conv_id, b, CASE WHEN length(b) > 50 THEN regexp_replace(substring(b, 1, 50), ' [^ ]*$', '') || '...' ELSE b END AS s FROM f)
SELECT conv_id, CASE WHEN coalesce(length(b), 0) = 0 THEN 'New Chat' ELSE upper(substring(s, 1, 1)) || substring(s, 2) END AS title FROM s""")
def chat_titles(t):
    return conversations.titles(t("chat_messages"))


@_query(f"WITH m AS (SELECT conv_id, turn, {_ROLES} AS role, arg_min(content, message_id) AS content FROM chat_messages GROUP BY ALL), k AS (SELECT * FROM m WHERE role <> 'system' AND content IS NOT NULL), e AS (SELECT conv_id, max(turn) AS e FROM k GROUP BY conv_id) SELECT conv_id, string_agg(upper(role[1]) || role[2:] || ': ' || content, chr(10) || chr(10) ORDER BY turn, role) AS history FROM k JOIN e USING (conv_id) WHERE turn > e - 10 GROUP BY conv_id")
def chat_history(t):
    return conversations.history(t("chat_messages"))


# Events


@_query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def tumbling_windows(t):
    return windows.tumbling(t("events")).withColumn("value", _r(F.col("value"), 4))


@_query("WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS events FROM s GROUP BY user_id, s")
def session_windows(t):
    return windows.sessions(t("events"), "6 hours")


@_query("WITH c AS (SELECT date_trunc('hour', ts) AS batch_start, count(*) AS n FROM events GROUP BY 1) SELECT batch_start, p::INT AS batch_part, least(6, n - p * 6) AS requests, CASE WHEN p * 3600 > 2 THEN least(6, n - p * 6) ELSE 0 END AS expired FROM c, unnest(range(0, ceil(n / 6.0)::BIGINT)) u(p)")
def micro_batches(t):
    return windows.micro_batches(t("events"), 3600)


@_query("SELECT event_type, count(DISTINCT user_id) AS users, count(*) AS events, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def event_rollup(t):
    return t("events").groupBy("event_type").agg(F.countDistinct("user_id").alias("users"), F.count("*").alias("events"), _r(F.avg("value")).alias("mean"))


# Rewriting and requests


@_query("SELECT item_id, CASE WHEN len(k) > 0 THEN array_to_string(k, ' ') ELSE x END AS query FROM (SELECT item_id, " + _squeezed("text") + " AS x, list_filter(string_split(" + _squeezed("text") + ", ' '), lambda w: NOT list_contains(['the', 'of', 'and', 'for'], lower(w)) OR lower(w) = 'of') AS k FROM eval_items)")
def corpus_query_cleaning(t):
    words = lambda *w: F.array(*map(F.lit, w))
    return t("eval_items").select("item_id", rewrite.corpus_clean(F.col("text"), words("the", "of", "and", "for"), words("of")).alias("query"))


@_query("SELECT error_code_id, CASE WHEN contains(lower(explanation_en), 'server') OR contains(lower(explanation_en), 'backup') THEN true ELSE false END AS related FROM error_code WHERE explanation_en IS NOT NULL")
def related_terms(t):
    return t("error_code").where("explanation_en is not null").select("error_code_id", (rewrite.related(F.col("explanation_en"), F.lit("server")) | rewrite.related(F.col("explanation_en"), F.lit("backup"))).alias("related"))


@_query()
def query_expansion(t):
    words = lambda *w: F.array(*map(F.lit, w))
    q = F.coalesce("message_en", F.lit(""))
    return t("error_code").select("error_code_id", rewrite.expand(q, words("tape library", "server", "drive"), words("master server")).alias("expanded"), rewrite.variations(q, words("tape library", "server"), words("master server")).alias("variations"))


@_query("SELECT chunk_key, 1 AS strategy FROM chunks WHERE error_code_id = 5 AND NOT EXISTS (SELECT 1 FROM chunks WHERE error_code_id = 5 AND contains(page_content, 'no such words'))")
def search_cascade(t):
    own = t("chunks").where("error_code_id = 5").select("chunk_key", "page_content")
    return rewrite.first_with_rows([own.where(F.contains("page_content", F.lit("no such words"))), own, t("chunks").select("chunk_key", "page_content")]).select("chunk_key", "strategy")


@_query("""WITH k AS (SELECT page_key, length(page_content) * (1 + page_key % 13) AS n, page_key % 4 + 1 AS pages, ['pdf', 'image', 'pptx', 'excel', 'doc'][page_key % 5 + 1] AS kind FROM scanned_pages)
SELECT page_key, CASE WHEN kind = 'image' THEN 'full' WHEN kind = 'pptx' THEN CASE WHEN n > 1000 THEN 'selective' ELSE 'full' END WHEN kind = 'excel' THEN CASE WHEN n > 2000 THEN 'minimal' ELSE 'selective' END
 WHEN n < 500 THEN 'full' WHEN n < 3000 OR n::DOUBLE / pages < 500 THEN 'selective' WHEN n < 8000 THEN 'minimal' ELSE 'skip' END AS mode FROM k""")
def ocr_mode(t):
    key = F.col("page_key")
    kind = F.element_at(F.array(*map(F.lit, ["pdf", "image", "pptx", "excel", "doc"])), (key % 5 + 1).cast("int"))
    return t("scanned_pages").select("page_key", ocr.mode(kind, F.length("page_content") * (1 + key % 13), key % 4 + 1).alias("mode"))


_UNFENCED = """WITH l AS (SELECT chunk_key, unnest(string_split({text}, chr(10))) AS line, generate_subscripts(string_split({text}, chr(10)), 1) AS i FROM chunks WHERE page_content IS NOT NULL),
f AS (SELECT *, starts_with(ltrim(line), '```') AS fence, sum(starts_with(ltrim(line), '```')::INT) OVER (PARTITION BY chunk_key ORDER BY i) AS n FROM l)
SELECT chunk_key, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT fence AND n % 2 = 0), '') AS body FROM f GROUP BY chunk_key"""


@_query(_UNFENCED.format(text="page_content") + " UNION ALL SELECT chunk_key, NULL FROM chunks WHERE page_content IS NULL")
def without_code_blocks(t):
    return t("chunks").select("chunk_key", ocr.without_fenced(F.col("page_content")).alias("body"))


@_query("SELECT document_id, document_type, updated_at, CASE WHEN document_id = 0 THEN 'document_id must be positive' WHEN n > 0 AND n <> 2 THEN 'names and urls differ in number' END AS error FROM (SELECT *, CASE WHEN tags IS NULL THEN 0 ELSE len(string_split(tags, ',')) END AS n FROM document_metadata)")
def request_errors(t):
    rows = t("document_metadata").withColumn("_names", F.split("tags", ","))
    return rows.select("document_id", "document_type", "updated_at", requests.document_error(F.col("document_id").cast("string"), F.array(F.lit("u1"), F.lit("u2")), F.col("_names")).alias("error"))


@_query("SELECT event_id, round(exp(a) / (exp(a) + exp(b)), 6) AS p_first FROM (SELECT event_id, greatest(value / 100.0, 0)::DOUBLE - greatest(1 - value / 100.0, 0) AS a, 0.5::DOUBLE * greatest(1 - value / 100.0, 0) AS b FROM events)")
def policy_net(t):
    p = rewrite.policy(F.array(F.col("value") / 100.0, F.lit(1.0)), [[1.0, 0.0], [-1.0, 1.0]], [[1.0, -1.0], [0.0, 0.5]])
    return t("events").select("event_id", _r(p[0]).alias("p_first"))


@_query()
def answer_context(t):
    ranked = retrieval.term_hits(t("documents").where("text is not null"), retrieval.query_terms(FLAGSHIP_QUESTION)).withColumn("place", F.struct(-F.col("hits"), "doc_id"))
    return rewrite.prompt_context(ranked, "source", "text", "place")
