"""Search, candidate union, diversity, ranking and grouping of chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text as tx
from ..functions import vectors as vx
from ..functions.predicates import where

#: Digits to which products of matrices agree however they are cut into blocks.
SIM_DIGITS = 12
#: Queries that a worker holds at a time.
QUERY_ROWS = 10_000


def top_k(rows: DataFrame, query: list[float] | Column, k: int, vector: str = "embedding", tie: str = "vec_id", rule: dict | None = None) -> DataFrame:
    """The ``k`` rows nearest to one vector by cosine, with ``sim``; the filter goes to the scan before.

    Rows whose vector is null or all zeros have no cosine and are left out; ties
    go to the smaller ``tie``.
    """
    q = F.array(*[F.lit(float(x)) for x in query]) if isinstance(query, list) else query
    found = rows.where(where(rule or {})).withColumn("sim", vx.cosine(F.col(vector), q))
    return found.where("sim is not null").orderBy(F.desc("sim"), tie).limit(k)


def top_k_each(queries: DataFrame, rows: DataFrame, k: int, query_key: str, key: str, query_vector: str = "query_vector", vector: str = "embedding") -> DataFrame:
    """For each query its ``k`` nearest rows: ``(<query_key>, <key>, sim, rank)``.

    The query set is stated; it is sent to the workers in blocks of ``QUERY_ROWS``
    and compared with all rows where they lie, by products of matrices.  Of a
    partition only the best ``k`` for each query are shuffled.  A place that a
    vector lacks counts as 0; vectors of zeros and null ones are near nothing.
    """
    schema = T.StructType([queries.schema[query_key], rows.schema[key], T.StructField("sim", T.DoubleType())])
    names = [f.name for f in schema.fields]

    def search(part: list[tuple]) -> DataFrame:
        shared = rows.sparkSession.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked = [q for q in shared.value if q[1]]
            matrix = _unit([q[1] for q in asked])
            live = np.flatnonzero(matrix.any(1))
            best_sims, best_keys = np.zeros((len(live), 0)), np.zeros((len(live), 0), object)
            for batch in batches if len(live) else ():
                keys = np.array(batch.column(0).to_pylist(), object)
                unit = _unit(batch.column(1).to_pylist())
                near = np.flatnonzero(unit.any(1))
                wide = min(unit.shape[1], matrix.shape[1])
                sims = np.concatenate([best_sims, np.round(matrix[live, :wide] @ unit[near, :wide].T, SIM_DIGITS)], 1)
                of = np.concatenate([best_keys, np.broadcast_to(keys[near], (len(live), len(near)))], 1)
                if sims.shape[1] > k:  # all that is as near as the k-th stays until the ties are settled
                    least = np.partition(sims, sims.shape[1] - k, 1)[:, sims.shape[1] - k]
                    order = [sorted(np.flatnonzero(row >= at), key=lambda j, row=row, own=own: (-row[j], own[j]))[:k] for row, own, at in zip(sims, of, least)]
                    order = np.array(order, int).reshape(len(live), -1)
                    sims, of = np.take_along_axis(sims, order, 1), np.take_along_axis(of, order, 1)
                best_sims, best_keys = sims, of
            many = best_sims.shape[1]
            out = [[asked[q][0] for q in live for _ in range(many)], best_keys.ravel().tolist(), best_sims.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], names=names)

        kinds = [to_arrow_type(f.dataType) for f in schema.fields]
        return rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(key, vector).mapInArrow(run, schema)

    found, block = None, []
    for q in queries.where(F.col(query_vector).isNotNull()).select(query_key, query_vector).toLocalIterator():
        if len(block) == QUERY_ROWS:
            found, block = search(block) if found is None else found.unionByName(search(block)), []
        block.append((q[0], list(q[1])))
    found = search(block) if found is None else found.unionByName(search(block))
    best = W.partitionBy(query_key).orderBy(F.desc("sim"), key)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(query_key, key, "sim", "rank")


def _unit(vectors: list[list[float] | None]) -> np.ndarray:
    """Vectors as rows of length 1, or of zeros where there is no direction."""
    wide = max((len(v) for v in vectors if v), default=0)
    out = np.zeros((len(vectors), wide))
    for at, v in enumerate(vectors):
        if v:
            out[at, : len(v)] = [0.0 if x is None else x for x in v]
    length = np.sqrt((out * out).sum(1))
    return out / np.where(length > 0, length, 1)[:, None]


def keep_first(rows: DataFrame, keys: list[str | Column], order: list[str | Column]) -> DataFrame:
    """The first row of each key.  The winner is found by an aggregate, so a key with very many rows is combined before the shuffle."""
    cols = rows.columns
    named = [F.struct(*[F.col(o) if isinstance(o, str) else o for o in order]).alias("_o")]
    packed = rows.select(*[(F.col(k) if isinstance(k, str) else k).alias(f"_k{i}") for i, k in enumerate(keys)], *named, F.struct(*cols).alias("_row"))
    return packed.groupBy(*[f"_k{i}" for i in range(len(keys))]).agg(F.min_by("_row", "_o").alias("_row")).select("_row.*")


def dedup_by_head(rows: DataFrame, text: str = "text", key: str = "doc_id", head: int = 200) -> DataFrame:
    """One row for each opening of ``head`` characters, the one with the smallest key.  Null texts are one opening."""
    return keep_first(rows, [F.md5(F.substring(F.coalesce(F.col(text), F.lit("")), 1, head))], [key])


def term_hits(rows: DataFrame, terms: list[str], text: str = "text") -> DataFrame:
    """``hits``: how many of the terms a text contains, without case."""
    low = F.lower(F.col(text))
    return rows.withColumn("hits", sum((F.coalesce(F.contains(low, F.lit(t)).cast("int"), F.lit(0)) for t in terms), F.lit(0)))


def query_terms(query: str, shortest: int = 4) -> list[str]:
    """Different words of a query of ``shortest`` characters and more, in lower case, in order."""
    return list(dict.fromkeys(w for w in query.lower().split() if len(w) >= shortest))


def best_sources(rows: DataFrame, query: str, k: int = 3, source: str = "source", text: str = "text", key: str = "doc_id", owner: Column | None = None) -> DataFrame:
    """``(source, score, chunks, best_key, snippet)`` of the ``k`` sources that answer a query best.

    The score is the sum of term hits over the number of terms; with ``owner``
    (true for one's own rows) two tenths of their share are added.
    """
    terms = query_terms(query) or [query.lower()]
    hit = term_hits(rows, terms, text)
    own = F.avg(owner.cast("double")) * 0.2 if owner is not None else F.lit(0.0)
    best = F.max_by(F.struct(F.col(key).alias("k"), F.col(text).alias("t")), F.struct("hits", -F.col(key)))
    grouped = hit.groupBy(F.coalesce(source, F.lit("unknown")).alias("source")).agg((F.sum("hits") / len(terms) + own).alias("score"), F.count("*").alias("chunks"), best.alias("_b"))
    return grouped.orderBy(F.desc("score"), "source").limit(k).select("source", "score", "chunks", F.col("_b.k").alias("best_key"), tx.snippet(F.col("_b.t"), F.lit(query)).alias("snippet"))


def union_candidates(strategies: list[DataFrame], key: str, text: str, cap: int = 15) -> DataFrame:
    """Candidates of several strategies, each opening once, the earliest strategy first, ``cap`` at most.

    Every strategy has ``<key>``, ``<text>`` and ``rank``.
    """
    all_rows = None
    for at, rows in enumerate(strategies):
        part = rows.select(key, text, F.lit(at).alias("strategy"), "rank")
        all_rows = part if all_rows is None else all_rows.unionByName(part)
    once = keep_first(all_rows, [F.md5(F.substring(text, 1, 200))], ["strategy", "rank", key])
    return once.orderBy("strategy", "rank", key).limit(cap)


def jaccard(a: Column, b: Column) -> Column:
    """Share of common words among all words of two arrays; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def word_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(tx.squeeze(text)), " "), lambda w: w != ""))


def weighted_overlap(a: Column, b: Column, domain: Column, query: Column) -> Column:
    """Common words of two arrays over all their words; 0 if one is empty.

    A common word counts double if it is a domain term, one and a half if it is a
    word of the query; a domain term that only one of them has adds a half below.
    """
    both, either = F.array_intersect(a, b), F.array_union(a, b)
    terms = F.size(F.array_intersect(both, domain))
    above = F.size(both) + terms + 0.5 * F.size(F.array_except(F.array_intersect(both, query), domain))
    below = F.size(either) + 0.5 * (F.size(F.array_intersect(either, domain)) - terms)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(above / F.greatest(below, F.lit(1.0)))


def best_each(rows: DataFrame, group: str, key: str, score: str, k: int = 15) -> DataFrame:
    """The ``k`` rows of each group with the highest score, ties to the smaller key; of 64 slots of a group each gives its own best first."""
    order = [F.desc(score), key]
    local = rows.withColumn("_slot", F.pmod(F.xxhash64(key), F.lit(64))).withColumn("_r", F.row_number().over(W.partitionBy(group, "_slot").orderBy(*order))).where(F.col("_r") <= k)
    return local.withColumn("_r", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("_r") <= k).drop("_slot", "_r")


def pick_diverse(candidates: DataFrame, group: str, key: str, text: str, score: str, k: int = 5, limit: float = 0.75, domain: DataFrame | None = None, query: str = "") -> DataFrame:
    """Greedy choice per query: best first, leaving out whatever is too like one chosen before.

    Whole texts are compared by :func:`weighted_overlap`; ``domain`` holds a few
    ``term`` rows.  Candidates are few per query (see :func:`union_candidates` and
    :func:`best_each`), so each query's are folded in one array.
    """
    empty_terms = F.array().cast("array<string>")
    asked = F.array(*[F.lit(w) for w in dict.fromkeys(query.lower().split())]).cast("array<string>")
    entry = F.struct((-F.col(score)).alias("s"), F.col(key).alias("k"), word_set(F.col(text)).alias("w"))
    rows = candidates.groupBy(group).agg(F.sort_array(F.collect_list(entry)).alias("_c"))
    rows = rows.withColumn("_d", empty_terms) if domain is None else rows.crossJoin(F.broadcast(domain.agg(F.collect_set("term").alias("_d"))))
    empty = F.slice("_c", 1, 0)
    chosen = F.aggregate("_c", empty, lambda acc, c: F.when((F.size(acc) < k) & ~F.exists(acc, lambda a: weighted_overlap(a["w"], c["w"], F.col("_d"), asked) > limit), F.concat(acc, F.array(c))).otherwise(acc))
    return rows.select(group, F.posexplode(chosen).alias("_p", "_c")).select(group, (F.col("_p") + 1).alias("rank"), F.col("_c.k").alias(key), (-F.col("_c.s")).alias(score))


def dynamic_score(domain: Column, technical: Column, query: Column, phrase: Column) -> Column:
    return 0.3 * domain + 0.2 * technical + 0.4 * query + 0.1 * phrase


def member_score(dynamic: Column, own: Column, age_days: Column) -> Column:
    """Rank of a chunk for a member: a bonus for one's own and for the last seven days."""
    fresh = F.when(age_days < 7, 0.1 * (7 - age_days) / 7).otherwise(0.0)
    return 0.4 + 0.3 * dynamic + 0.2 * F.when(own, 0.15).otherwise(0.0) + 0.1 * fresh


def reward(length: Column, feedback: Column, dynamic: Column | None = None) -> Column:
    """How good an answer was, from 0 to 1: its length up to 1000 characters, then feedback (7 tenths), then its rank (3 tenths)."""
    base = F.least(length / 1000.0, F.lit(1.0))
    mixed = F.when(feedback.isNull(), base).otherwise(0.3 * base + 0.7 * feedback)
    return mixed if dynamic is None else 0.7 * mixed + 0.3 * dynamic
