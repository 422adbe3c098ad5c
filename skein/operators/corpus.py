"""Statistics of a corpus: document frequency, TF-IDF terms and phrases, patterns and structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

#: Patterns of technical terms, by kind.
TECHNICAL = {
    "commands": r"(?iU)\b[a-z]+\s*-[a-z]+\b",
    "file_paths": r"[a-zA-Z]:\\[^\s]+|/[^\s]+",
    "error_codes": r"(?iU)\berror[_\s]*code[_\s]*\d+\b|\bcode[_\s]*\d+\b",
    "configuration": r"(?iU)\bconfig\w*\b|\bsetup\w*\b|\binstall\w*\b",
}


def words(text: Column) -> Column:
    """Lower-case words of 2 to 8 Latin or Hangul letters."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?<![\p{L}\p{N}_])[a-z가-힣]{2,8}(?![\p{L}\p{N}_])"), F.lit(0))


def document_frequency(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(word, df)``: in how many documents a word stands.  Words are made distinct within their row, so one count is enough."""
    terms = docs.where(F.col(text).isNotNull()).select(F.explode(F.array_distinct(words(F.col(text)))).alias("word"))
    return terms.groupBy("word").agg(F.count("*").alias("df"))


def corpus_stopwords(docs: DataFrame, share: float = 0.8, text: str = "text", cap: int = 150) -> DataFrame:
    """Words of fewer than 8 letters that stand in more than ``share`` of all documents, the commonest ``cap``."""
    n = docs.where(F.col(text).isNotNull()).agg(F.count("*").alias("_n"))
    df = document_frequency(docs, text=text).join(F.broadcast(n), how="inner")
    return df.where((F.col("df") > share * F.col("_n")) & (F.length("word") < 8)).orderBy(F.desc("df"), "word").limit(cap).select("word", "df")


def terms(text: Column, n: int = 1) -> Column:
    """Words of two characters and more (``n`` = 1), or pairs of them (``n`` = 2)."""
    one = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    if n == 1:
        return one
    pairs = F.zip_with(F.slice(one, 1, F.greatest(F.size(one) - 1, F.lit(0))), F.slice(one, 2, F.greatest(F.size(one), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(F.size(one) < 2, F.array().cast("array<string>")).otherwise(pairs)


def tfidf_terms(docs: DataFrame, n: int = 1, min_df: int = 2, max_df: float = 0.9, vocabulary: int = 200, k: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(term, df, weight)``: the ``k`` terms with the highest mean TF-IDF.

    idf is ln((1 + N) / (1 + df)) + 1; each document's weights are brought to
    length 1 over the vocabulary, the ``vocabulary`` commonest terms whose document
    frequency lies within the bounds.
    """
    plain = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("_k"), terms(F.col(text), n).alias("_t"))
    count = plain.agg(F.count("*").alias("_n"))
    # Each document gives its different terms and all of its terms; both counts are combined before they are shuffled.
    twice = plain.select(F.explode(F.array(F.struct(F.lit(1).alias("once"), F.array_distinct("_t").alias("terms")), F.struct(F.lit(0).alias("once"), F.col("_t").alias("terms")))).alias("_x"))
    both = twice.select("_x.once", F.explode("_x.terms").alias("term")).groupBy("term").agg(F.sum("once").alias("df"), F.sum(1 - F.col("once")).alias("total"))
    known = both.where(F.col("df") >= min_df).join(F.broadcast(count)).where(F.col("df") <= max_df * F.col("_n")).orderBy(F.desc("total"), "term").limit(vocabulary)
    # Only the terms of the vocabulary are counted by document.
    known = known.withColumn("idf", F.log((1 + F.col("_n")) / (1 + F.col("df"))) + 1)
    tf = plain.select("_k", F.explode("_t").alias("term")).join(F.broadcast(known), "term").groupBy("_k", "term").agg(F.count("*").alias("tf"), *[F.first(c).alias(c) for c in ("df", "_n", "idf")])
    weighted = tf.withColumn("_w", F.col("tf") * F.col("idf"))
    length = weighted.groupBy("_k").agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_l"))
    mean = weighted.join(length, "_k").groupBy("term").agg(F.max("df").alias("df"), (F.sum(F.col("_w") / F.col("_l")) / F.max("_n")).alias("weight"))
    return mean.orderBy(F.desc("weight"), "term").limit(k)


def technical_terms(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(kind, term, n)``: how often each technical term stands in all documents."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0)).alias("found")) for k, p in TECHNICAL.items()])
    rows = docs.where(F.col(text).isNotNull()).select(F.explode(kinds).alias("_x")).select("_x.kind", F.explode("_x.found").alias("term"))
    return rows.groupBy("kind", "term").agg(F.count("*").alias("n"))


def structure_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row: documents, mean length, mean sentences, list lines and code spans."""
    c = F.col(text)
    count = lambda p: F.regexp_count(c, F.lit(p))
    return docs.where(c.isNotNull()).agg(
        F.count("*").alias("documents"),
        F.avg(F.length(c)).alias("avg_length"),
        F.avg(count(r"[.!?]+(?:\s|$)")).alias("avg_sentences"),
        F.sum(count(r"(?m)^\s*[-*•]\s+") + count(r"(?m)^\s*\d+\.\s+")).alias("list_patterns"),
        F.sum(count("`[^`]+`") + count(r"```[\s\S]*?```")).alias("code_patterns"),
    )


def section_headers(docs: DataFrame, k: int = 5, text: str = "text") -> DataFrame:
    """The ``k`` commonest lines that end with a colon and hold no sentence end."""
    rows = docs.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(r"(?m)^[A-Z][^.!?\n]*:$"), F.lit(0))).alias("header"))
    return rows.groupBy("header").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "header").limit(k)


def diversity(rows: DataFrame, group: str, key: str, text: str, words: int | None = None) -> DataFrame:
    """``(group, diversity)``: 1 less the mean likeness of the texts of a group, by pairs.

    For lists of results, which are short by nature (see :func:`retrieval.best_each`);
    ``words`` compares only so many first words of each text.
    """
    sets = rows.where(F.col(text).isNotNull()).groupBy(group).agg(F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), _words(F.col(text), words).alias("w")))).alias("_s"))
    pairs = F.flatten(F.transform("_s", lambda a, i: F.transform(F.slice(F.col("_s"), i + 2, F.greatest(F.size("_s"), F.lit(1))), lambda b: _likeness(a["w"], b["w"]))))
    mean = F.try_divide(F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x), F.size(pairs))
    return sets.select(group, (1 - F.coalesce(mean, F.lit(0.0))).alias("diversity"))


def _words(text: Column, most: int | None) -> Column:
    words = F.split(F.lower(tx.squeeze(text)), " ")
    return F.array_distinct(words if most is None else F.slice(words, 1, most))


def _likeness(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))), F.lit(0.0))


def frequency_bounds(docs: int, n: int = 1) -> tuple[int, float]:
    """Least number and largest share of documents of a term, by how many documents there are: of words (``n`` = 1) or pairs of words."""
    if n > 1:
        return max(1, min(2, docs // 30)), 0.8
    return max(1, min(3, docs // 20)), min(0.9, max(0.6, 1 - 5 / docs)) if docs > 5 else 0.9


def analyzable(docs: DataFrame, text: str = "text", least: int = 10) -> DataFrame:
    """Documents with more than ``least`` characters besides outer blanks; none if that leaves fewer than two."""
    long = docs.where(F.length(F.trim(F.col(text))) > least)
    enough = long.limit(2).agg((F.count("*") > 1).alias("_enough"))
    return long.join(F.broadcast(enough.where("_enough").drop("_enough").withColumn("_one", F.lit(1)))).drop("_one")


def domain_terms(docs: DataFrame, n: int = 1, k: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(term, df, weight)`` of a corpus, with bounds that follow its size and without common words."""
    from .rewrite import meaningful

    least, most = frequency_bounds(docs.where(F.col(text).isNotNull()).count(), n)
    return tfidf_terms(docs, n, least, most, 200 if n == 1 else 50, k, key, text).where(meaningful(F.col("term")))


def corpus_sample(docs: DataFrame, key: str = "doc_id", text: str = "text", look: int = 500, keep: int = 300, least: int = 50) -> DataFrame:
    """At most ``keep`` of the first ``look`` documents: trimmed, of ``least`` characters and more, each opening of 200 characters once."""
    first = docs.orderBy(key).limit(look).select(key, F.trim(F.col(text)).alias(text)).where(F.length(text) >= least)
    once = first.groupBy(F.substring(text, 1, 200).alias("_head")).agg(F.min_by(F.struct(key, text), key).alias("_r")).select("_r.*")
    return once.orderBy(key).limit(keep)


def insights(docs: DataFrame, key: str = "doc_id", text: str = "text", share: float = 0.8) -> DataFrame:
    """One row: how many domain terms, stopwords, phrases and technical terms a corpus has."""
    counted = [("domain_terms", domain_terms(docs, 1, 50, key, text)), ("stopwords", corpus_stopwords(docs, share, text)), ("phrases", domain_terms(docs, 2, 15, key, text)), ("technical_terms", technical_terms(docs, text).select("term").distinct())]
    out = None
    for name, found in counted:
        one = found.agg(F.count("*").alias(name))
        out = one if out is None else out.join(F.broadcast(one))
    return out


def all_stopwords(docs: DataFrame, share: float = 0.8, text: str = "text") -> DataFrame:
    """``(word)``: the fixed common words, Spark's English list and those of the corpus, each once."""
    from pyspark.ml.feature import StopWordsRemover

    spark = docs.sparkSession
    fixed = sorted({*tx.COMMON_WORDS, *StopWordsRemover.loadDefaultStopWords("english")})
    return corpus_stopwords(docs, share, text).select("word").unionByName(spark.createDataFrame([(w,) for w in fixed], "word string")).distinct()


def map_keys(rows: DataFrame, json: str) -> DataFrame:
    """``(key, rows)``: the keys that JSON objects of a column have, and how many have them."""
    found = rows.select(F.explode(F.json_object_keys(F.col(json))).alias("key"))
    return found.groupBy("key").agg(F.count("*").alias("rows"))
