"""Queries over formats, scores, sessions and corpus reports, with the equivalent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import filetypes as ft
from ..functions import formats, ocr, requests
from ..functions import text as tx
from ..functions import vectors as vx
from ..operators import corpus, relational, retrieval, rewrite, scoring, sessions
from .catalog import _HITS, _TFIDF, _UNFENCED, FLAGSHIP_QUESTION, NOW, _chain_sql, _query, _r, _squeezed

_AS_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_NOW_SQL = f"TIMESTAMPTZ '{NOW}+00'"


def _now():
    return F.lit(NOW).cast("timestamp")


# Formats and cleaners


@_query("SELECT doc_id, CASE WHEN length(text) > 300 THEN substring(text, 1, 300) || '...' ELSE text END AS short FROM documents")
def truncated_texts(t):
    return t("documents").select("doc_id", formats.truncated(F.col("text"), 300).alias("short"))


@_query("""WITH n AS (SELECT p_partkey, p_name || ['.xlsx', '.PDF', '', '.exe', '.kb', '.txt.log'][p_partkey % 6 + 1] AS name, CASE WHEN p_partkey % 10 = 0 THEN 'scan' END AS kind FROM part), e AS (SELECT *, lower(regexp_extract(name, '\\.([^.]*)$', 1)) AS x FROM n)
SELECT p_partkey, CASE WHEN kind IS NOT NULL THEN kind WHEN x IN ('xlsx', 'xls', 'pdf', 'docx', 'doc', 'txt', 'log', 'html', 'kb') THEN upper(x) || ' 파일' ELSE '' END AS label FROM e""")
def file_labels(t):
    ends = F.element_at(F.array(*map(F.lit, [".xlsx", ".PDF", "", ".exe", ".kb", ".txt.log"])), (F.col("p_partkey") % 6 + 1).cast("int"))
    kind = F.when(F.col("p_partkey") % 10 == 0, "scan")
    return t("part").select("p_partkey", formats.file_label(F.concat("p_name", ends), kind).alias("label"))


@_query("""SELECT error_code_id, 'SOURCE: ' || coalesce(error_code_nm, 'Unknown source') || chr(10) || 'TITLE: ' || coalesce(message_en, 'No title') || chr(10) || 'CONTENT: ' || coalesce(explanation_en, 'No content') || chr(10) || chr(10) || 'SOURCE: Unknown source' || chr(10) || 'TITLE: No title' || chr(10) || 'CONTENT: ' || coalesce(recom_action_en, 'No content') AS shown FROM error_code""")
def web_results(t):
    none = F.lit(None).cast("string")
    one = F.struct(F.col("error_code_nm").alias("url"), F.col("message_en").alias("title"), F.col("explanation_en").alias("content"))
    return t("error_code").select("error_code_id", formats.web_results(F.array(one, F.struct(none.alias("url"), none.alias("title"), F.col("recom_action_en").alias("content")))).alias("shown"))


def _context_sql(kind: str, column: str) -> str:
    steps = " ".join("WHEN " + " OR ".join(f"contains(lower({column}), '{w}')" for w in words) + f" THEN '{name}'" for name, words in formats.CONTEXTS[kind])
    return f"CASE {steps} ELSE 'general' END"


@_query(f"SELECT resolve_id, created_at, {_context_sql('html', 'content')} AS html_context, {_context_sql('pdf', 'content')} AS pdf_context, {_context_sql('docx', 'content')} AS docx_context FROM resolve")
def image_contexts(t):
    return t("resolve").select("resolve_id", "created_at", *[formats.image_context(F.col("content"), k).alias(f"{k}_context") for k in ("html", "pdf", "docx")])


@_query("""WITH k AS (SELECT page_key, length(page_content) * (page_key % 11) AS n, page_key % 5 AS u, ['docx', 'xlsx', 'pptx', 'pdf', 'html', 'zip'][page_key % 6 + 1] AS kind FROM scanned_pages), d AS (SELECT *, CASE WHEN u > 0 THEN n::DOUBLE / u ELSE 0 END AS dens FROM k)
SELECT page_key, CASE kind WHEN 'docx' THEN CASE WHEN n < 500 THEN 'full' WHEN n < 2000 THEN 'selective' WHEN n < 5000 THEN 'minimal' ELSE 'skip' END
 WHEN 'xlsx' THEN CASE WHEN n < 200 THEN 'selective' WHEN n < 1000 THEN 'minimal' ELSE 'skip' END
 WHEN 'pptx' THEN CASE WHEN n < 500 THEN 'full' WHEN n < 2000 OR dens < 200 THEN 'selective' WHEN n < 5000 THEN 'minimal' ELSE 'skip' END
 WHEN 'pdf' THEN CASE WHEN n < 100 THEN 'full_legacy' WHEN n < 500 THEN 'full_smart' WHEN n < 3000 OR dens < 500 THEN 'selective' WHEN n < 8000 THEN 'minimal' ELSE 'skip' END
 WHEN 'html' THEN CASE WHEN n < 200 THEN 'full' WHEN n < 1000 OR u > 3 THEN 'selective' WHEN n < 3000 THEN 'minimal' ELSE 'skip' END ELSE 'skip' END AS strategy FROM d WHERE n IS NOT NULL""")
def image_strategies(t):
    key = F.col("page_key")
    kind = F.element_at(F.array(*map(F.lit, ["docx", "xlsx", "pptx", "pdf", "html", "zip"])), (key % 6 + 1).cast("int"))
    return t("scanned_pages").where("page_content is not null").select("page_key", formats.strategy(kind, F.length("page_content") * (key % 11), key % 5).alias("strategy"))


@_query("WITH w AS (SELECT page_key, array_to_string(list_filter(string_split(" + _squeezed("page_content") + r", ' '), lambda w: length(w) > 1 OR regexp_matches(w, '^(\p{Nd}|a|I)$')), ' ') AS k FROM scanned_pages) SELECT page_key, coalesce(CASE WHEN length(regexp_replace(k, '[^\p{L}\p{N}]', '', 'g')) < 0.3 * length(k) THEN '' ELSE k END, '') AS words FROM w")
def recognised_words(t):
    return t("scanned_pages").select("page_key", formats.meaningful_words(F.col("page_content")).alias("words"))


@_query(r"SELECT page_key, coalesce(replace(replace(replace(replace(replace(array_to_string(list_filter(string_split(page_content, chr(10)), lambda x: NOT regexp_matches(x, '^[ .\-=_|\s\v]*$')), chr(10)), '|', 'I'), '1l', 'II'), '0', 'O'), '《', '<'), '》', '>'), '') AS body FROM scanned_pages")
def recognised_lines(t):
    return t("scanned_pages").select("page_key", formats.readable_lines(F.col("page_content")).alias("body"))


@_query("SELECT page_key, coalesce(" + _squeezed("page_content") + ", '') AS line, coalesce(CASE WHEN regexp_full_match(" + _squeezed("page_content") + ", '[-+|]*') THEN '' ELSE " + _squeezed("page_content") + " END, '') AS table_line FROM scanned_pages")
def screenshot_lines(t):
    c = F.col("page_content")
    return t("scanned_pages").select("page_key", formats.screenshot_line(c, False).alias("line"), formats.screenshot_line(c, True).alias("table_line"))


_SAID = "['Extracted text: ', 'The image shows:', ''][chunk_key % 3 + 1] || page_content"
_PLAIN_SAID = _chain_sql(_SAID, [(rf"^(?i:{p.replace('.', '[.]')})\s*".replace("'", "''"), "") for p in formats.ANNOUNCEMENTS])


@_query(_UNFENCED.format(text=_PLAIN_SAID) + " UNION ALL SELECT chunk_key, NULL FROM chunks WHERE page_content IS NULL")
def vision_answers(t):
    head = F.element_at(F.array(*map(F.lit, ["Extracted text: ", "The image shows:", ""])), (F.col("chunk_key") % 3 + 1).cast("int"))
    return t("chunks").select("chunk_key", ocr.without_fenced(formats.announced(F.concat(head, "page_content"))).alias("body"))


_DOC_LINE = r"trim(regexp_replace(x, '[\x00-\x09\x0B-\x1F\x7F-\xFF]', '', 'g'))"


@_query(r"WITH l AS (SELECT doc_id, list_transform(list_transform(string_split(regexp_replace(text, '\r\n|\r', E'\n', 'g'), chr(10)), lambda x: " + _DOC_LINE + r"), lambda y: CASE WHEN regexp_matches(y, '^([1-4]\.|->|-|ㅇ)') THEN '    ' || y WHEN contains(y, ':') THEN trim(split_part(y, ':', 1)) || ': ' || trim(substring(y, strpos(y, ':') + 1)) ELSE y END) AS l FROM documents) SELECT doc_id, coalesce(regexp_replace(regexp_replace(regexp_replace(array_to_string(l, chr(10)), '\n{3,}', E'\n\n', 'g'), '^\n+', E'\n'), '\n+$', E'\n'), '') AS body FROM l")
def document_lines(t):
    return t("documents").select("doc_id", formats.document_lines(F.col("text")).alias("body"))


@_query()
def misread_signs(t):
    return t("scanned_pages").select("page_key", formats.misread_signs(F.col("page_content")).alias("body"))


@_query("SELECT doc_id, coalesce(length(trim(text)) >= 10, false) AS embeddable FROM documents")
def embeddable_texts(t):
    return t("documents").select("doc_id", formats.embeddable(F.col("text")).alias("embeddable"))


@_query("SELECT message_id, array_to_string(list_filter(string_split(content, ' '), lambda w: w <> '' AND NOT contains(w, '<think>') AND NOT contains(w, '###')), ' ') AS shown FROM chat_messages")
def shown_tokens(t):
    return t("chat_messages").select("message_id", F.array_join(formats.shown_tokens(F.split("content", " ")), " ").alias("shown"))


@_query("SELECT message_id, coalesce(" + " OR ".join(f"contains(x, '{p}' || c)" for p in formats.CODE_PHRASES) + ", false) AS named FROM (SELECT message_id, replace(content, 'status ', 'Code ') AS x, (message_id % 50)::VARCHAR AS c FROM chat_messages)")
def mentioned_codes(t):
    said = F.replace("content", F.lit("status "), F.lit("Code "))
    return t("chat_messages").select("message_id", formats.mentions_code(said, (F.col("message_id") % 50).cast("string")).alias("named"))


@_query("SELECT resolve_id, created_at, regexp_replace(content, '\\s+', '_', 'g') <> '' AS any_text, substring(md5(content), 1, 10) AS short FROM resolve WHERE content IS NOT NULL")
def content_keys(t):
    rows = t("resolve").where("content is not null")
    return rows.select("resolve_id", "created_at", (F.regexp_replace("content", r"\s+", "_") != "").alias("any_text"), F.substring(F.md5("content"), 1, 10).alias("short"))


# Files, requests and images


@_query("""WITH n AS (SELECT p_partkey, p_name || ['.PDF', '', '.null', '.x', ' (1).txt?a=1'][p_partkey % 5 + 1] AS name FROM part) SELECT p_partkey, coalesce(length(trim(name)) >= 3 AND contains(trim(name), '.') AND NOT ends_with(lower(trim(name)), '.null') AND regexp_matches(trim(name), '[\\p{L}\\p{N}]'), false) AS valid, regexp_replace(split_part(name, '?', 1), '[^A-Za-z0-9._-]', '_', 'g') AS safe FROM n""")
def file_names(t):
    name = F.concat("p_name", F.element_at(F.array(*map(F.lit, [".PDF", "", ".null", ".x", " (1).txt?a=1"])), (F.col("p_partkey") % 5 + 1).cast("int")))
    return t("part").select("p_partkey", ft.valid_name(name).alias("valid"), ft.safe_name(name).alias("safe"))


@_query("""SELECT p_partkey, ['pdf', 'doc', 'unknown', 'image', 'unknown'][p_partkey % 5 + 1] AS by_content, ['pdf', 'image', 'unknown'][p_partkey % 3 + 1] AS by_magic FROM part""")
def file_type_by_content(t):
    kind = F.element_at(F.array(*map(F.lit, ["application/PDF", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "x/y", "image/png", "text/html; charset=utf-8"])), (F.col("p_partkey") % 5 + 1).cast("int"))
    head = F.element_at(F.array(*[F.unhex(F.lit(h)) for h in ("255044462D312E37", "89504E470D0A1A0A", "0001")]), (F.col("p_partkey") % 3 + 1).cast("int"))
    return t("part").select("p_partkey", ft.type_by_content(kind).alias("by_content"), ft.type_by_magic(head).alias("by_magic"))


@_query("SELECT document_id, document_type, updated_at, i - 1 AS file_index, 'u' || i AS url, CASE WHEN i <= len(k) THEN k[i] END AS name FROM (SELECT document_id, document_type, updated_at, string_split(coalesce(tags, ''), ',') AS k, unnest([1, 2, 3]) AS i FROM document_metadata)")
def zipped_names(t):
    links = F.array(*[F.lit(f"u{k}") for k in (1, 2, 3)])
    rows = t("document_metadata").withColumn("_z", F.explode(requests.zipped(links, F.split(F.coalesce("tags", F.lit("")), ","))))
    return rows.select("document_id", "document_type", "updated_at", "_z.file_index", "_z.url", "_z.name")


@_query("SELECT p_partkey, w, h, CASE m WHEN 'full' THEN w >= 50 AND h >= 50 WHEN 'selective' THEN w >= 150 AND h >= 100 WHEN 'minimal' THEN w >= 250 AND h >= 150 ELSE false END AS readable FROM (SELECT p_partkey, p_partkey % 400 AS w, p_size * 7 AS h, ['full', 'selective', 'minimal', 'skip'][p_partkey % 4 + 1] AS m FROM part)")
def readable_images(t):
    rows = t("part").select("p_partkey", (F.col("p_partkey") % 400).alias("w"), (F.col("p_size") * 7).alias("h"), F.element_at(F.array(*map(F.lit, ["full", "selective", "minimal", "skip"])), (F.col("p_partkey") % 4 + 1).cast("int")).alias("m"))
    return rows.select("p_partkey", "w", "h", ocr.readable(F.col("w"), F.col("h"), F.col("m")).alias("readable"))


@_query("WITH p AS (SELECT l_orderkey, list(l_returnflag || l_linenumber ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) FILTER (l_discount > 0.05) AS k FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, CASE WHEN length(array_to_string(k, ' ')) >= 6 THEN array_to_string(k, ' ') ELSE '' END AS said FROM p")
def sure_pieces(t):
    piece = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("text"), F.when(F.col("l_discount") > 0.05, 0.9).otherwise(0.3).alias("confidence"))
    rows = t("lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(piece)).alias("p"))
    return rows.select("l_orderkey", ocr.sure_text(F.col("p")).alias("said"))


@_query("SELECT term, coalesce(length(term) >= 2 AND NOT regexp_matches(term, '^[0-9]+$') AND NOT list_contains(" + _AS_LIST(tx.COMMON_WORDS) + ", lower(term)), false) AS meaningful FROM (SELECT DISTINCT unnest(string_split(text, ' ')) AS term FROM eval_items)")
def meaningful_terms(t):
    words = t("eval_items").select(F.explode(F.split("text", " ")).alias("term")).distinct()
    return words.select("term", rewrite.meaningful(F.col("term")).alias("meaningful"))


@_query("SELECT message_id, round(CASE WHEN turn % 3 = 0 THEN least(length(content) / 1000.0::DOUBLE, 1) ELSE 0.3::DOUBLE * least(length(content) / 1000.0::DOUBLE, 1) + 0.7::DOUBLE * (turn % 2) END, 6) AS reward FROM chat_messages WHERE content IS NOT NULL")
def answer_rewards(t):
    feedback = F.when(F.col("turn") % 3 != 0, (F.col("turn") % 2).cast("double"))
    return t("chat_messages").where("content is not null").select("message_id", _r(retrieval.reward(F.length("content"), feedback)).alias("reward"))


@_query("SELECT vec_id, len(embedding) AS dims, round(embedding[2]::DOUBLE, 6) AS second FROM embeddings")
def flattened_vectors(t):
    nested = t("embeddings").select("vec_id", vx.flattened(F.array("embedding")).alias("v"))
    return nested.select("vec_id", F.size("v").alias("dims"), _r(F.col("v")[1].cast("double")).alias("second"))


# Corpus reports

_TERMS = "list_transform(list_zip(w[1:len(w)-1], w[2:len(w)]), lambda z: z[1] || ' ' || z[2])"
_MEANT = "length(term) >= 2 AND NOT regexp_matches(term, '^[0-9]+$') AND NOT list_contains(" + _AS_LIST(tx.COMMON_WORDS) + ", lower(term))"
_BOUNDED = _TFIDF.replace("df >= 2", "df >= greatest(1, least(3, n // 20))").replace("{max_df}::DOUBLE * n", "(CASE WHEN n > 5 THEN least(0.9::DOUBLE, greatest(0.6::DOUBLE, 1 - 5.0::DOUBLE / n)) ELSE 0.9 END) * n")
_DOMAIN = f"SELECT * FROM ({_BOUNDED.format(terms='w', vocabulary=200, k=50)}) WHERE {_MEANT}"
_BOUNDED_PAIRS = _TFIDF.replace("df >= 2", "df >= greatest(1, least(2, n // 30))")
_PHRASES = f"SELECT * FROM ({_BOUNDED_PAIRS.format(terms=_TERMS, max_df=0.8, vocabulary=50, k=15)}) WHERE {_MEANT}"


@_query(_DOMAIN)
def corpus_domain_terms(t):
    return corpus.domain_terms(t("documents")).withColumn("weight", _r(F.col("weight")))


@_query(_PHRASES)
def corpus_phrases(t):
    return corpus.domain_terms(t("documents"), 2, 15).withColumn("weight", _r(F.col("weight")))


@_query("WITH f AS (SELECT doc_id, trim(text) AS text FROM documents ORDER BY doc_id LIMIT 500), k AS (SELECT min(doc_id) AS doc_id, substring(text, 1, 200) AS h FROM f WHERE length(text) >= 50 GROUP BY 2) SELECT f.doc_id, f.text FROM f JOIN k USING (doc_id) ORDER BY f.doc_id LIMIT 300")
def corpus_sample(t):
    return corpus.corpus_sample(t("documents")).select("doc_id", "text")


_STOPS_SQL = "SELECT w FROM (SELECT w, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda w: regexp_matches(w, '^[a-z가-힣]{2,8}$')))) AS w FROM documents) GROUP BY 1) WHERE df > 0.3 * (SELECT count(text) FROM documents) AND length(w) < 8 ORDER BY df DESC, w LIMIT 150"


@_query(f"SELECT w AS word FROM ({_STOPS_SQL}) UNION SELECT unnest({_AS_LIST(tx.COMMON_WORDS)})")
def stopword_union(t):
    dynamic = corpus.corpus_stopwords(t("documents"), 0.3).select("word")
    fixed = dynamic.sparkSession.createDataFrame([(w,) for w in tx.COMMON_WORDS], "word string")
    return dynamic.unionByName(fixed).distinct()


@_query("SELECT key, count(*) AS rows FROM (SELECT unnest(json_keys(custom_metadata)) AS key FROM document_metadata WHERE json_valid(custom_metadata) AND custom_metadata <> '') GROUP BY key")
def metadata_keys(t):
    return corpus.map_keys(t("document_metadata"), "custom_metadata")


@_query("SELECT doc_id FROM documents WHERE length(trim(text)) > 10 AND (SELECT count(*) FROM documents WHERE length(trim(text)) > 10) >= 2")
def analyzable_documents(t):
    return corpus.analyzable(t("documents")).select("doc_id")


@_query(f"SELECT (SELECT count(*) FROM ({_DOMAIN})) AS domain_terms, (SELECT count(*) FROM ({_STOPS_SQL})) AS stopwords, (SELECT count(*) FROM ({_PHRASES})) AS phrases")
def corpus_insights(t):
    return corpus.insights(t("documents"), share=0.3).select("domain_terms", "stopwords", "phrases")


# Lists of results

_TOP = "SELECT * FROM (SELECT doc_id, source, text, " + _HITS + " AS hits, row_number() OVER (PARTITION BY source ORDER BY " + _HITS + " DESC, doc_id) AS r FROM documents WHERE text IS NOT NULL AND source IS NOT NULL) WHERE r <= 5"
_IN = "len(list_filter((SELECT list(term) FROM {rows}), lambda x: contains(lower(text), x)))"


def _top(t, k: int = 5):
    docs = retrieval.term_hits(t("documents").where("source is not null and text is not null"), retrieval.query_terms(FLAGSHIP_QUESTION))
    return retrieval.best_each(docs.select("source", "doc_id", "text", "hits"), "source", "doc_id", "hits", k)


def _short(found):
    """A short list of terms, which is a top-k of its own, found once."""
    return found.sparkSession.createDataFrame(found.select("term").collect(), "term string")


def _terms(t, domain=None):
    docs = t("documents")
    domain = _short(corpus.domain_terms(docs)) if domain is None else domain
    return scoring.term_arrays(domain, domain.limit(0), _short(corpus.domain_terms(docs, 2, 15)))


@_query(f"""WITH dom AS MATERIALIZED ({_DOMAIN}), phr AS MATERIALIZED ({_PHRASES}), dl AS (SELECT coalesce(list(term), []) AS l FROM dom), pl AS (SELECT coalesce(list(term), []) AS l FROM phr), top AS ({_TOP}),
h AS (SELECT source, text, len(list_filter(dl.l, lambda x: contains(lower(text), x))) AS d, len(list_filter(pl.l, lambda x: contains(lower(text), x))) AS p, length(text) - length(translate(text, chr(10) || ':-•', '')) AS s FROM top, dl, pl)
SELECT source, round(least(avg(d) / 10, 1), 6) AS domain_avg, round(least(max(d) / 10.0::DOUBLE, 1), 6) AS domain_max, round(least(avg(length(text)) / 1000, 1), 6) AS length, round(least(avg(s) / 10, 1), 6) AS structure, round(least(sum(p) / 5.0::DOUBLE, 1), 6) AS phrases, 15 AS places FROM h GROUP BY source""")
def result_features(t):
    found = scoring.list_features(_top(t), "source", "text", _terms(t))
    return found.select("source", *[_r(F.col(c)).alias(c) for c in ("domain_avg", "domain_max", "length", "structure", "phrases")], F.size("features").alias("places"))


@_query(f"""WITH dom AS MATERIALIZED ({_DOMAIN}), phr AS MATERIALIZED ({_PHRASES}), dl AS (SELECT coalesce(list(term), []) AS l FROM dom), pl AS (SELECT coalesce(list(term), []) AS l FROM phr), top AS ({_TOP}),
h AS (SELECT source, doc_id, count(*) OVER (PARTITION BY source) AS n, CASE WHEN len(dl.l) > 0 THEN least(len(list_filter(dl.l, lambda x: contains(lower(text), x))) / greatest(len(dl.l) * 0.1::DOUBLE, 1), 1) ELSE 0 END AS d, CASE WHEN len(pl.l) > 0 THEN least(len(list_filter(pl.l, lambda x: contains(lower(text), x))) / greatest(len(pl.l) * 0.1::DOUBLE, 1), 1) ELSE 0 END AS p, hits / 4.0::DOUBLE AS q FROM top, dl, pl)
SELECT source, doc_id, round(CASE WHEN n > 2 THEN 0.6::DOUBLE + 0.4::DOUBLE * (0.3::DOUBLE * d + 0.4::DOUBLE * q + 0.1::DOUBLE * p) ELSE 1 END, 6) AS final_score FROM h""")
def final_ranking(t):
    ranked = scoring.final_ranking(_top(t), "source", "doc_id", "text", FLAGSHIP_QUESTION, F.array().cast("array<string>"), _terms(t))
    return ranked.select("source", "doc_id", _r(F.col("final_score")).alias("final_score"))


@_query()
def relevant_chunks(t):
    docs, domain = t("documents"), _short(corpus.domain_terms(t("documents")))
    found = scoring.relevant_chunks(docs, FLAGSHIP_QUESTION, "doc_id", "text", "source", _terms(t, domain), domain, F.array().cast("array<string>"))
    return found.withColumn("final_score", _r(F.col("final_score")))


@_query("""WITH h AS (SELECT doc_id, (CASE WHEN contains(lower(text), 'backup') THEN 1 ELSE 0 END) + (CASE WHEN contains(lower(text), 'scheduler') THEN 1 ELSE 0 END) AS hits, coalesce(member_id = 7, false) AS own, coalesce(document_type IN ('manual', 'memo'), false) AS wanted, text FROM documents)
SELECT doc_id, round(hits / 2.0::DOUBLE * (CASE WHEN own THEN 1.3::DOUBLE ELSE 1 END) * (CASE WHEN wanted THEN 1.1::DOUBLE ELSE 1 END), 6) AS score, own AS is_member_document, CASE WHEN length(text) > 500 THEN substring(text, 1, 500) || '...' ELSE text END AS content FROM h WHERE hits > 0 ORDER BY hits / 2.0::DOUBLE * (CASE WHEN own THEN 1.3::DOUBLE ELSE 1 END) * (CASE WHEN wanted THEN 1.1::DOUBLE ELSE 1 END) DESC, doc_id LIMIT 10""")
def member_search(t):
    return scoring.member_search(t("documents"), "backup scheduler", 7, ["manual", "memo"], "doc_id", "text").withColumn("score", _r(F.col("score")))


@_query(f"""WITH top AS (SELECT doc_id, source, text FROM documents WHERE text IS NOT NULL ORDER BY {_HITS} DESC, doc_id LIMIT 15), g AS (SELECT coalesce(source, 'unknown') AS source, count(*) AS chunks, string_agg(text, ' ' ORDER BY doc_id) AS x FROM top GROUP BY 1)
SELECT source, chunks, CASE WHEN length(x) > 800 THEN substring(x, 1, 800) || '...' ELSE x END AS snippet, 'doc-' || substring(md5(substring(x, 1, 1000)), 1, 8) AS result_id FROM g""")
def grouped_results(t):
    docs = retrieval.term_hits(t("documents").where("text is not null"), retrieval.query_terms(FLAGSHIP_QUESTION))
    return scoring.grouped_results(docs.orderBy(F.desc("hits"), "doc_id").limit(15), "source", "doc_id", "text")


@_query("SELECT label, list_sum(list_transform(s, lambda x: x[1]::DOUBLE)) IS NOT NULL AS filled, 64 * 6 + 15 AS places FROM (SELECT label, list(embedding ORDER BY vec_id) AS s FROM embeddings WHERE vec_id < 100000 GROUP BY label)")
def choice_states(t):
    rows = t("embeddings").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("first"))
    made = scoring.state(F.col("first"), F.array(F.col("first").cast("array<double>")), F.array(F.lit(0.5)), 64)
    return rows.select("label", F.aggregate(made, F.lit(0.0), lambda a, x: a + x).isNotNull().alias("filled"), F.size(made).alias("places"))


@_query("SELECT event_id, CASE WHEN a * 1.2::DOUBLE >= b THEN 0 ELSE 1 END AS best_place, round(-ln(greatest(a, 1e-8::DOUBLE)) * 0.5::DOUBLE, 6) AS loss FROM (SELECT event_id, (event_id % 10) / 10.0::DOUBLE AS a, 1 - (event_id % 10) / 10.0::DOUBLE AS b FROM events)")
def boosted_choice(t):
    p = (F.col("event_id") % 10) / 10.0
    places = scoring.best_places(scoring.boosted(F.array(p, 1 - p), F.array(F.lit(0))), 1)
    return t("events").select("event_id", places[0].alias("best_place"), _r(scoring.policy_step(p, F.lit(0.5))).alias("loss"))


# Sessions, conversations and pages of results


@_query(f"WITH old AS (SELECT conv_id, max(turn) AS turns, min(created_at) AS created_at, max(created_at) AS updated_at FROM chat_messages GROUP BY conv_id), fresh AS (SELECT conv_id + (CASE WHEN conv_id % 20 = 0 THEN 1000000 ELSE 0 END) AS conv_id, turns + 1 AS turns FROM old WHERE conv_id % 10 = 0) SELECT * FROM old WHERE conv_id NOT IN (SELECT conv_id FROM fresh) UNION ALL SELECT conv_id, turns, {_NOW_SQL}, {_NOW_SQL} FROM fresh")
def saved_chats(t):
    old = t("chat_messages").groupBy("conv_id").agg(F.max("turn").alias("turns"), F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at"))
    fresh = old.where("conv_id % 10 = 0").select((F.col("conv_id") + F.when(F.col("conv_id") % 20 == 0, 1000000).otherwise(0)).alias("conv_id"), (F.col("turns") + 1).alias("turns"))
    return sessions.save_chats(old, fresh, _now())


@_query("SELECT conv_id, count(*) AS messages FROM chat_messages WHERE conv_id % 7 <> 0 GROUP BY conv_id")
def deleted_chats(t):
    stored = t("chat_messages").groupBy("conv_id").agg(F.count("*").alias("messages"))
    return sessions.delete_chats(stored, stored.where("conv_id % 7 = 0"))


@_query("SELECT conv_id, count(*) AS messages, min(created_at) AS first_at, max(created_at) AS last_at FROM chat_messages WHERE member_id = 7 GROUP BY conv_id")
def member_conversations(t):
    return sessions.conversations_of(t("chat_messages"), F.col("member_id") == 7)


@_query("SELECT event_id, user_id, ts AS created_at, ts + INTERVAL 24 HOUR AS expires_at, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AS is_active FROM events")
def user_sessions(t):
    return sessions.open_sessions(t("events"), "user_id", "ts", "event_id")


@_query("SELECT event_id, user_id FROM (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 AND ts + INTERVAL 24 HOUR > TIMESTAMPTZ '2024-01-30 12:00:00+00'")
def live_sessions(t):
    opened = sessions.open_sessions(t("events"), "user_id", "ts", "event_id")
    return sessions.active_sessions(opened, F.lit("2024-01-30 12:00:00").cast("timestamp")).select("event_id", "user_id")


@_query("SELECT c.chunk_key FROM chunks c WHERE c.chunk_key % 10 = 0 OR EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = c.document_id AND d.member_id = c.member_id)")
def owned_chunks(t):
    requests_ = t("chunks").select("chunk_key", "document_id", "member_id", F.when(F.col("chunk_key") % 10 == 0, "admin").alias("role"))
    return sessions.owned(requests_, t("documents").withColumnRenamed("doc_id", "document_id"), "member_id", "document_id", "role").select("chunk_key")


@_query("SELECT r.resolve_id, r.created_at, r.client_nm, coalesce(e.error_code_nm, 'Unknown') AS error_code_nm FROM resolve r LEFT JOIN (SELECT error_code_id, error_code_nm FROM error_code WHERE error_code_id % 3 <> 0) e USING (error_code_id)")
def code_lookup(t):
    return sessions.lookup(t("resolve"), t("error_code").where("error_code_id % 3 <> 0"), "error_code_id", "error_code_nm").select("resolve_id", "created_at", "client_nm", "error_code_nm")


@_query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 40")
def order_page(t):
    return sessions.page(t("orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 20, 40)


@_query("SELECT user_id, count(*) AS requests, count(*) FILTER (event_type = 'click') AS hits, round(count(*) FILTER (event_type = 'click') / greatest(count(*), 1)::DOUBLE, 6) AS rate FROM events GROUP BY user_id")
def hit_rates(t):
    rows = t("events").groupBy("user_id").agg(F.count("*").alias("requests"), F.count_if(F.col("event_type") == "click").alias("hits"))
    return rows.withColumn("rate", _r(F.col("hits") / F.greatest("requests", F.lit(1))))


@_query("SELECT count(*) AS requests, count(*) FILTER (event_type = 'click') AS hits, count(*) FILTER (event_type = 'click') / greatest(count(*), 1)::DOUBLE AS rate FROM events")
def cache_hit_rate(t):
    return sessions.hit_rate(t("events"), F.col("event_type") == "click")


@_query("SELECT DISTINCT document_id FROM document_metadata m WHERE EXISTS (SELECT 1 FROM chunks c WHERE starts_with(c.id, m.document_id || '_chunk_') AND c.chunk_index > 3)")
def documents_with_pieces(t):
    ids = t("document_metadata").select("document_id").distinct()
    return sessions.with_prefix(ids, t("chunks").where("chunk_index > 3"), "document_id", "id", "_chunk_")


@_query("SELECT error_code_id, upper(message_en) AS message_en, upper(explanation_en) AS explanation_en FROM error_code")
def translated_codes(t):
    rows = t("error_code").select("error_code_id", "message_en", "explanation_en")
    return sessions.translated(rows, ["message_en", "explanation_en"], lambda texts: [x.upper() for x in texts])


@_query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS global_id FROM orders")
def running_chunk_ids(t):
    return relational.batches(t("orders").select("o_orderkey"), "o_orderkey", 1).withColumnRenamed("batch_no", "global_id")


@_query("SELECT ts - to_minutes(30 * k) AS window_start, event_type, count(*) AS events FROM (SELECT time_bucket(INTERVAL 30 MINUTE, ts, TIMESTAMPTZ '1970-01-01 00:00:00+00') AS ts, event_type, unnest([0, 1]) AS k FROM events) GROUP BY ALL")
def sliding_windows(t):
    from ..streaming import windows

    return windows.tumbling(t("events"), "1 hour", slide="30 minutes").select("window_start", "event_type", "events")

