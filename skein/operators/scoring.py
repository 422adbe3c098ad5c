"""Features and scores of short lists of results, and the choice among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import formats
from . import retrieval, rewrite

#: Places of the feature vector of a list of results.
STATE = 15


def hits(text: Column, terms: Column) -> Column:
    """How many of an array of terms a text contains, without case; 0 for null."""
    return F.coalesce(F.size(F.filter(terms, lambda t: (t != "") & F.contains(F.lower(text), F.lower(t)))), F.lit(0))


def term_arrays(domain: DataFrame, technical: DataFrame, phrases: DataFrame) -> DataFrame:
    """One row with the arrays ``domain``, ``technical`` and ``phrases`` of the ``term`` columns of three short lists."""
    one = lambda rows, name: rows.agg(F.sort_array(F.collect_set("term")).alias(name))
    return one(domain, "domain").join(F.broadcast(one(technical, "technical"))).join(F.broadcast(one(phrases, "phrases")))


def list_features(results: DataFrame, group: str, text: str, terms: DataFrame) -> DataFrame:
    """``(group, features)`` for each list of results, ``STATE`` places filled up with zeros.

    In order: mean and most domain terms (tenths), mean length (thousands), mean
    signs of structure (tenths), technical terms (tenths), phrases (fifths); each at
    most 1.  ``terms`` comes from :func:`term_arrays`.
    """
    c = F.coalesce(F.col(text), F.lit(""))
    signs = F.length(c) - F.length(F.translate(c, "\n:-•", ""))
    rows = results.join(F.broadcast(terms))
    capped = lambda x: F.least(x, F.lit(1.0))
    found = rows.groupBy(group).agg(
        capped(F.avg(hits(c, F.col("domain"))) / 10.0).alias("domain_avg"), capped(F.max(hits(c, F.col("domain"))) / 10.0).alias("domain_max"), capped(F.avg(F.length(c)) / 1000.0).alias("length"), capped(F.avg(signs) / 10.0).alias("structure"),
        capped(F.sum(hits(c, F.col("technical"))) / 10.0).alias("technical"), capped(F.sum(hits(c, F.col("phrases"))) / 5.0).alias("phrases"),
    )
    names = [n for n in found.columns if n != group]
    return found.select(group, *names, F.concat(F.array(*names), F.array_repeat(F.lit(0.0), STATE - len(names))).alias("features"))


def state(query: Column, documents: Column, features: Column, size: int, most: int = 5) -> Column:
    """The input of the choice: a query's vector, those of ``most`` documents (zeros where there are fewer), and the features of the list."""
    from ..functions import vectors as vx

    filled = F.flatten(F.transform(F.slice(F.concat(documents, F.array_repeat(F.array().cast("array<double>"), most)), 1, most), lambda v: vx.resize(v, size)))
    return F.concat(vx.resize(query, size), filled, vx.resize(features, STATE))


def boosted(chances: Column, own: Column, by: float = 1.2) -> Column:
    """Chances of candidates with those at the places ``own`` (from 0) raised."""
    return F.transform(chances, lambda p, i: F.when(F.array_contains(own, i), p * by).otherwise(p))


def best_places(chances: Column, k: int = 5) -> Column:
    """Places (from 0) of the ``k`` highest chances, ties to the earlier place."""
    order = F.sort_array(F.transform(chances, lambda p, i: F.struct((-p).alias("p"), i.alias("i"))))
    return F.transform(F.slice(order, 1, k), lambda x: x["i"])


def policy_step(chance: Column, reward: Column) -> Column:
    """What one choice adds to the loss of the policy: -log(chance) x reward."""
    return -F.log(F.greatest(chance, F.lit(1e-8))) * reward


def final_ranking(results: DataFrame, group: str, key: str, text: str, query: str, stops: Column, terms: DataFrame) -> DataFrame:
    """``(group, <key>, final_score, place)``: 0.6 and 0.4 of the dynamic score; lists of up to two stay as they come (by key, with 1).

    The dynamic score weighs the shares of domain terms, technical terms, words of
    the query that are no stopwords, and phrases.
    """
    c = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.array(*map(F.lit, query.lower().split())), lambda w: ~F.array_contains(stops, w))
    share = lambda n, of: F.when(F.size(of) > 0, F.least(n / F.greatest(F.size(of) * 0.1, F.lit(1.0)), F.lit(1.0))).otherwise(0.0)
    dynamic = retrieval.dynamic_score(share(hits(c, F.col("domain")), F.col("domain")), F.least(hits(c, F.col("technical")) / 10.0, F.lit(1.0)), F.coalesce(F.try_divide(hits(c, words), F.size(words)), F.lit(0.0)), share(hits(c, F.col("phrases")), F.col("phrases")))
    size = F.count("*").over(W.partitionBy(group))
    rows = results.join(F.broadcast(terms)).withColumn("_n", size).withColumn("final_score", F.when(F.col("_n") > 2, 0.6 + 0.4 * dynamic).otherwise(1.0))
    return rows.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy(F.desc("final_score"), key))).select(group, key, "final_score", "place")


def relevant_chunks(rows: DataFrame, query: str, key: str, text: str, group: str, terms: DataFrame, domain: DataFrame, stops: Column, candidates: int = 15, k: int = 5) -> DataFrame:
    """The chunks that answer a query, per ``group``: ``(group, <key>, final_score, place)``.

    The best candidates by the words of the query, in each group its own; of these
    the ``k`` best that differ from each other; these ranked again by the corpus.
    """
    asked = retrieval.query_terms(query) or [query.lower()]
    scored = retrieval.term_hits(rows.where(F.col(text).isNotNull() & F.col(group).isNotNull()), asked, text).withColumn("score", F.col("hits") / F.lit(float(len(asked))))
    top = retrieval.best_each(scored.select(group, key, text, "score"), group, key, "score", candidates)
    chosen = retrieval.pick_diverse(top, group, key, text, "score", k, domain=domain, query=query)
    texts = top.select(group, key, text).join(chosen.select(group, key), [group, key])
    return final_ranking(texts, group, key, text, query, stops, terms)


def member_search(rows: DataFrame, query: str, member: int, kinds: list[str], key: str, text: str, owner: str = "member_id", kind: str = "document_type", limit: int = 10) -> DataFrame:
    """``(<key>, score, is_member_document, content)``: chunks of some types by the words of a query, one's own times 1.3, those of a wanted type times 1.1."""
    asked = retrieval.query_terms(query) or [query.lower()]
    own, wanted = F.coalesce(F.col(owner) == member, F.lit(False)), F.coalesce(F.col(kind).isin(*kinds), F.lit(False))
    found = retrieval.term_hits(rows, asked, text).where("hits > 0")
    score = F.col("hits") / float(len(asked)) * F.when(own, 1.3).otherwise(1.0) * F.when(wanted, 1.1).otherwise(1.0)
    return found.select(key, score.alias("score"), own.alias("is_member_document"), formats.truncated(F.col(text)).alias("content")).orderBy(F.desc("score"), key).limit(limit)


def grouped_results(results: DataFrame, group: str, key: str, text: str, most: int = 800) -> DataFrame:
    """``(group, chunks, snippet, result_id)`` of a short list of results: the texts of a group, in order of key, as one.

    ``result_id`` is made of the md5 of its first thousand characters.
    """
    said = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), F.coalesce(text, F.lit("")).alias("t")))), lambda x: x["t"]), " ")
    grouped = results.groupBy(F.coalesce(group, F.lit("unknown")).alias(group)).agg(F.count("*").alias("chunks"), said.alias("_t"))
    return grouped.select(group, "chunks", formats.truncated(F.col("_t"), most).alias("snippet"), F.concat(F.lit("doc-"), F.substring(F.md5(F.substring("_t", 1, 1000)), 1, 8)).alias("result_id"))


def member_candidates(own: DataFrame, plain: DataFrame, expanded: DataFrame, rest: DataFrame, key: str, text: str, cap: int = 15) -> DataFrame:
    """Candidates for a member: one's own first, then those of the query, of its expansion, and any; each opening once."""
    return retrieval.union_candidates([own, plain, expanded, rest], key, text, cap)


def corpus_strategies(query: Column, domain: Column, phrases: Column) -> Column:
    """The texts that candidates are looked up by: the query and its variations."""
    return rewrite.variations(query, domain, phrases)
