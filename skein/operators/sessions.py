"""Stored conversations and sessions as tables of which each change gives a new one."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import relational


def save_chats(stored: DataFrame, saved: DataFrame, now: Column, key: str = "conv_id") -> DataFrame:
    """``stored`` with the conversations of ``saved`` in place of those with the same key; both of their times are set to ``now``."""
    fresh = saved.withColumn("created_at", now).withColumn("updated_at", now)
    return stored.join(fresh.select(key), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def delete_chats(stored: DataFrame, keys: DataFrame, key: str = "conv_id") -> DataFrame:
    """``stored`` without some conversations."""
    return stored.join(keys.select(key), key, "left_anti")


def conversations_of(messages: DataFrame, member: Column) -> DataFrame:
    """``(conv_id, messages, first_at, last_at)`` of one member's conversations."""
    return messages.where(member).groupBy("conv_id").agg(F.count("*").alias("messages"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))


def open_sessions(logins: DataFrame, user: str, at: str, key: str, hours: int = 24) -> DataFrame:
    """Logins as sessions: of a user only the latest is active, each ends after ``hours``.

    The latest login of a user is found by an aggregate and marked by a join, so a
    busy user is never one task.
    """
    last = logins.groupBy(user).agg(F.max(F.struct(F.col(at).alias("t"), F.col(key).alias("k"))).alias("_last")).select(F.col(user).alias("_user"), F.col("_last.k").alias("_key"))
    marked = logins.join(last, (F.col(user) == F.col("_user")) & (F.col(key) == F.col("_key")), "left")
    return marked.select(key, user, F.col(at).alias("created_at"), (F.col(at) + F.make_dt_interval(F.lit(0), F.lit(hours))).alias("expires_at"), F.col("_key").isNotNull().alias("is_active"))


def active_sessions(sessions: DataFrame, now: Column) -> DataFrame:
    """Sessions that are active and not over at ``now``."""
    return sessions.where(F.col("is_active") & (F.col("expires_at") > now))


def owned(requests: DataFrame, documents: DataFrame, member: str, document: str, role: str | None = None) -> DataFrame:
    """Requests whose member may touch the document: its owner, or an ``admin`` or ``moderator``."""
    pairs = documents.select(F.col(document).alias("_d"), F.col(member).alias("_m")).distinct()
    mine = requests.join(pairs, (F.col(document) == F.col("_d")) & (F.col(member) == F.col("_m")), "left_semi")
    if role is None:
        return mine
    high = F.coalesce(F.col(role).isin("admin", "moderator"), F.lit(False))
    return requests.where(high).unionByName(mine.where(~high))


def lookup(rows: DataFrame, dimension: DataFrame, key: str, value: str, default: str = "Unknown") -> DataFrame:
    """``rows`` with ``value`` of a small dimension by ``key``, or ``default`` where there is none."""
    names = dimension.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(value).alias(value))
    return rows.join(relational._checked(names), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def page(rows: DataFrame, order: list[str], size: int, skip: int) -> DataFrame:
    """``size`` rows after the first ``skip``, in a stated order."""
    return rows.orderBy(*order).offset(skip).limit(size)


def hit_rate(rows: DataFrame, hit: Column) -> DataFrame:
    """One row: requests, hits and their share (0 without requests)."""
    return rows.agg(F.count("*").alias("requests"), F.count_if(hit).alias("hits")).withColumn("rate", F.col("hits") / F.greatest("requests", F.lit(1)))


def with_prefix(ids: DataFrame, pieces: DataFrame, key: str, piece: str, separator: str) -> DataFrame:
    """Ids of which a piece ``<id><separator>...`` exists, by the exact part before the last separator."""
    heads = pieces.select(F.regexp_extract(piece, rf"^(.*)\Q{separator}\E", 1).alias("_h")).where("_h <> ''").distinct()
    return ids.join(heads, F.col(key).cast("string") == F.col("_h"), "left_semi")


def translated(rows: DataFrame, columns: list[str], model, batch: int = 64) -> DataFrame:
    """``rows`` with texts of ``columns`` translated by ``model`` (a list of texts to a list of texts), in batches; where it fails the text stays as it is."""
    def run(texts: pa.Array) -> pa.Array:
        out: list[str | None] = []
        for a in range(0, len(texts), batch):
            part = texts.slice(a, batch).to_pylist()
            said = [t for t in part if t]
            try:
                made = iter(model(said)) if said else iter(())
                out += [next(made) if t else t for t in part]
            except Exception:  # the model's own errors: the source text is kept
                out += part
        return pa.array(out, pa.string())

    return rows.withColumns({c: F.arrow_udf(run, "string")(F.col(c)) for c in columns})

