"""Checks of requests as column expressions that name what is wrong."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def document_error(document_id: Column, urls: Column, names: Column) -> Column:
    """What is wrong with an order to ingest a document; null if nothing is."""
    n_urls, n_names = F.coalesce(F.array_size(urls), F.lit(0)), F.coalesce(F.array_size(names), F.lit(0))
    blank = F.coalesce(F.trim(document_id), F.lit("")) == ""
    return (
        F.when(blank, "document_id is missing")
        .when(~F.trim(document_id).rlike("^[0-9]+$"), "document_id is not a number")
        .when(F.trim(document_id).rlike("^0+$"), "document_id must be positive")
        .when((n_names > 0) & (n_names != n_urls), "names and urls differ in number")
    )


def zipped(urls: Column, names: Column) -> Column:
    """Links with their names by place; a link without a name gets null."""
    return F.transform(urls, lambda u, i: F.struct(i.alias("file_index"), u.alias("url"), F.try_element_at(names, i + 1).alias("name")))


def session_valid(active: Column, expires_at: Column, now: Column) -> Column:
    return F.coalesce(active & (expires_at > now), F.lit(False))
