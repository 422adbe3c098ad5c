"""Rewriting queries with the statistics of a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


def meaningful(term: Column) -> Column:
    """Terms of two characters and more that are no number and no common word."""
    return F.coalesce((F.length(term) >= 2) & ~term.rlike(r"^\d+$") & ~F.lower(term).isin(*tx.COMMON_WORDS), F.lit(False))


def related(query: Column, term: Column) -> Column:
    """Whether a term shares a word with a query, or a word of more than three letters lies in the other."""
    q, t = F.split(F.lower(tx.squeeze(query)), " "), F.split(F.lower(tx.squeeze(term)), " ")
    within = F.exists(q, lambda a: (F.length(a) > 3) & F.exists(t, lambda b: F.contains(b, a))) | F.exists(t, lambda b: (F.length(b) > 3) & F.exists(q, lambda a: F.contains(a, b)))
    return F.arrays_overlap(q, t) | within


def corpus_clean(query: Column, stopwords: Column, domain: Column) -> Column:
    """A query without the corpus' own stopwords, its domain terms excepted; as it was if nothing is left."""
    kept = F.filter(F.split(tx.squeeze(query), " "), lambda w: ~F.array_contains(stopwords, F.lower(w)) | F.array_contains(domain, F.lower(w)))
    return F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(tx.squeeze(query))


def expand(query: Column, domain: Column, phrases: Column, most: int = 2, cap: int = 500) -> Column:
    """A query followed by at most ``most`` related terms or phrases that it lacks."""
    extra = F.filter(F.concat(domain, phrases), lambda t: related(query, t) & ~F.contains(F.lower(query), F.lower(t)))
    return F.substring(F.concat_ws(" ", query, F.array_join(F.slice(extra, 1, most), " ")), 1, cap)


def variations(query: Column, domain: Column, phrases: Column, cap: int = 300) -> Column:
    """The query, the query with each of two related domain terms, and with one related phrase; each once."""
    terms = F.slice(F.filter(domain, lambda t: related(query, t)), 1, 2)
    phrase = F.slice(F.filter(phrases, lambda t: related(query, t)), 1, 1)
    return F.array_distinct(F.concat(F.array(query), F.transform(F.concat(terms, phrase), lambda t: F.substring(F.concat_ws(" ", query, t), 1, cap))))


def first_with_rows(strategies: list[DataFrame]) -> DataFrame:
    """The rows of the first strategy that has any, in one plan: all are tagged, the least tag wins."""
    tagged = None
    for at, rows in enumerate(strategies):
        part = rows.withColumn("strategy", F.lit(at))
        tagged = part if tagged is None else tagged.unionByName(part)
    least = tagged.agg(F.min("strategy").alias("strategy"))
    return tagged.join(F.broadcast(least), "strategy", "left_semi")


def policy(x: Column, w1: list[list[float]], w2: list[list[float]]) -> Column:
    """Probabilities of a two-layer net, softmax(W2 relu(W1 x)); its weights are a small table of parameters."""
    from ..functions import vectors as vx

    row = lambda w: F.array(*[F.lit(float(v)) for v in w])
    hidden = F.transform(F.array(*[row(w) for w in w1]), lambda w: F.greatest(vx.dot(w, x), F.lit(0.0)))
    return vx.softmax(F.transform(F.array(*[row(w) for w in w2]), lambda w: vx.dot(w, hidden)))


def prompt_context(rows: DataFrame, source: str, text: str, order: str, most: int = 15) -> DataFrame:
    """One row ``context``: the first ``most`` texts with their sources."""
    top = rows.orderBy(order).limit(most)
    line = F.concat(F.lit("Document: "), F.coalesce(source, F.lit("unknown")), F.lit("\n"), F.coalesce(text, F.lit("")))
    return top.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, line.alias("_t")))), lambda x: x["_t"]), "\n\n").alias("context"))
