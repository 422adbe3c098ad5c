"""Conversations: roles, turns, pairs, titles and history texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


def role(kind: Column) -> Column:
    """``user``, ``assistant`` or ``system``, from any spelling of a message type; null for others."""
    low = F.lower(F.trim(kind))
    return F.when(low.isin("humanmessage", "human", "user"), "user").when(low.isin("aimessage", "ai", "assistant"), "assistant").when(low.isin("systemmessage", "system"), "system")


def messages(rows: DataFrame) -> DataFrame:
    """Each turn of a conversation once: ``(conv_id, turn, role, content)``, the earliest message of several."""
    known = rows.withColumn("role", role(F.col("type"))).where("role is not null")
    return known.groupBy("conv_id", "turn", "role").agg(F.min_by("content", "message_id").alias("content"))


def user_analytics(rows: DataFrame) -> DataFrame:
    """``(member_id, conversations, messages)``.  Conversations are made distinct before they are counted, so a busy member is combined in parts."""
    per = rows.groupBy("member_id", "conv_id").agg(F.count("*").alias("_n"))
    return per.groupBy("member_id").agg(F.count("*").alias("conversations"), F.sum("_n").alias("messages"))


def titles(rows: DataFrame) -> DataFrame:
    """``(conv_id, title)`` from the first message of a user."""
    first = messages(rows).where("role = 'user'").groupBy("conv_id").agg(F.min_by("content", "turn").alias("content"))
    return first.select("conv_id", tx.title(F.col("content")).alias("title"))


def turn_pairs(rows: DataFrame) -> DataFrame:
    """Questions with the answer in the turn after: ``(conv_id, turn, question, answer)``; unpaired ones are left out."""
    each = messages(rows)
    asked = each.where("role = 'user'").select("conv_id", "turn", F.col("content").alias("question"))
    said = each.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("content").alias("answer"))
    return asked.join(said, ["conv_id", "turn"])


def history(rows: DataFrame, last: int = 10) -> DataFrame:
    """``(conv_id, history)``: the last turns as one text.  Turns before are left out by number, before anything is gathered."""
    each = messages(rows).where("role <> 'system' and content is not null")
    end = each.groupBy("conv_id").agg(F.max("turn").alias("_end"))
    recent = each.join(end, "conv_id").where(F.col("turn") > F.col("_end") - last)
    line = F.concat(F.initcap("role"), F.lit(": "), F.col("content"))
    return recent.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", line.alias("t")))), lambda x: x["t"]), "\n\n").alias("history"))
