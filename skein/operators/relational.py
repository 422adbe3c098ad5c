"""Joins, change detection, upserts, retention and roll-ups over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .retrieval import keep_first


def micros(ts: Column) -> Column:
    """A time, with or without zone, as microseconds."""
    return F.unix_micros(ts.cast("timestamp"))


def new_rows(rows: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not yet there."""
    return rows.join(existing.select(*keys).distinct(), keys, "left_anti")


def valid_rows(rows: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among the allowed ones."""
    return rows.join(allowed.select(key), key, "left_semi")


def exact_or_prefix(rows: DataFrame, names: DataFrame, column: str, name: str = "name", prefix: str = "prefix") -> DataFrame:
    """Each name with the rows that equal it, else with those that begin with its ``prefix``.

    The prefix join is an equi-join: a row is looked up once for each length that
    prefixes have.  An empty prefix matches every row with a text, a null one none.
    """
    exact = names.join(rows, F.col(column) == F.col(name))
    rest = names.join(rows.select(F.col(column).alias("_c")).distinct(), F.col("_c") == F.col(name), "left_anti").where(F.col(prefix).isNotNull())
    sizes = sorted(r[0] for r in rest.select(F.length(prefix)).distinct().collect())
    heads = F.array(*[F.when(F.length(column) >= n, F.substring(column, 1, n)) for n in sizes]) if sizes else F.array().cast("array<string>")
    looked = rows.withColumn("_h", F.explode(F.array_compact(heads)))
    by_prefix = _checked(rest).withColumn("_h", F.col(prefix)).join(looked, "_h").drop("_h")
    return exact.withColumn("match", F.lit("exact")).unionByName(by_prefix.select(*exact.columns).withColumn("match", F.lit("prefix")))


def _checked(side: DataFrame, most: int = 100_000) -> DataFrame:
    """A side of a join with a hint to broadcast it, if it has at most so many rows."""
    return F.broadcast(side) if side.limit(most + 1).count() <= most else side


def asof_join(left: DataFrame, right: DataFrame, by: list[str], ts: str, value: str, within_seconds: int, tie: str) -> DataFrame:
    """Each left row with the latest right row of the same ``by`` at or before it, at most so long ago.

    Both sides are put in one order within time buckets as wide as the tolerance, and
    the last right row is carried on; a left row without one in its bucket takes the
    last of the bucket before.  So no key is sorted as a whole, no pairs are made,
    and equal left rows stay as many as they were.  Adds ``<value>_asof`` and
    ``age_seconds``, null without a match; null keys and times match nothing.
    """
    most = within_seconds * 1_000_000
    keys = [f"_k{i}" for i in range(len(by))]
    kinds = dict(right.select(F.col(tie).alias("_tie"), F.col(value).alias("_value")).dtypes)
    row = F.struct(*left.columns)
    kind_of_row = left.select(row.alias("_row")).dtypes[0][1]
    named = [F.col(b).alias(k) for b, k in zip(by, keys)]
    now = left.select(*named, micros(F.col(ts)).alias("_us"), F.lit(1).alias("_side"), *[F.lit(None).cast(kinds[c]).alias(c) for c in ("_tie", "_value")], row.alias("_row"))
    past = right.where(F.col(ts).isNotNull()).select(*named, micros(F.col(ts)).alias("_us"), F.lit(0).alias("_side"), F.col(tie).alias("_tie"), F.col(value).alias("_value"), F.lit(None).cast(kind_of_row).alias("_row"))
    bucket = F.floor(F.col("_us") / most)
    found = F.struct("_us", "_tie", "_value")
    order = W.partitionBy(*keys, "_bucket").orderBy("_us", "_side", "_tie").rowsBetween(W.unboundedPreceding, 0)
    inside = F.last(F.when(F.col("_side") == 0, found), True).over(order)
    ends = past.groupBy(*keys, (bucket + 1).alias("_bucket")).agg(F.max(found).alias("_before"))
    asked = now.unionByName(past).withColumn("_bucket", bucket).withColumn("_inside", inside).where("_side = 1").join(ends, [*keys, "_bucket"], "left")
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    best = F.when(known & F.col("_us").isNotNull(), F.coalesce("_inside", "_before"))
    near = asked.select("_row", "_us", best.alias("_b")).withColumn("_b", F.when(F.col("_us") - F.col("_b._us") <= most, F.col("_b")))
    return near.select("_row.*", F.col("_b._value").alias(f"{value}_asof"), ((F.col("_us") - F.col("_b._us")) / 1_000_000).alias("age_seconds"))


def running(rows: DataFrame, by: list[str], ts: str, tie: str, value: str, cell: str = "day") -> DataFrame:
    """``rows`` with ``running_sum``, ``running_count`` and ``running_avg`` of ``value`` over the rows of a key so far.

    The sums of whole cells of time are carried on from cell to cell, so a task
    orders one cell of a key and never the key as a whole.
    """
    cut = rows.withColumn("_cell", F.date_trunc(cell, F.col(ts)))
    totals = cut.groupBy(*by, "_cell").agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    before = W.partitionBy(*by).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select(*[F.col(b).alias(f"_{b}") for b in by], F.col("_cell").alias("_c"), F.coalesce(F.sum("_s").over(before), F.lit(0.0)).alias("_s"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"))
    here = W.partitionBy(*by, "_cell").orderBy(ts, tie).rowsBetween(W.unboundedPreceding, 0)
    own = cut.withColumn("_own_s", F.coalesce(F.sum(value).over(here), F.lit(0.0))).withColumn("_own_n", F.count(value).over(here))
    same = F.col("_cell").eqNullSafe(F.col("_c"))
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_{b}"))
    summed = own.join(carried, same).withColumn("running_sum", F.col("_s") + F.col("_own_s")).withColumn("running_count", F.col("_n") + F.col("_own_n"))
    return summed.withColumn("running_avg", F.try_divide("running_sum", "running_count")).select(*rows.columns, "running_sum", "running_count", "running_avg")


def two_hops(nodes: DataFrame, first: DataFrame, second: DataFrame, key: str, mid: str, leaf: str) -> DataFrame:
    """For each node its neighbours and, nested, theirs: ``(<key>, neighbours array<struct<<mid>, leaves>>)``."""
    leaves = second.groupBy(mid).agg(F.sort_array(F.collect_set(leaf)).alias("leaves"))
    pairs = first.select(key, mid).distinct().join(leaves, mid, "left")
    nested = pairs.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(mid), F.coalesce("leaves", F.array().cast(dict(leaves.dtypes)["leaves"])).alias("leaves")))).alias("neighbours"))
    return nodes.select(key).distinct().join(nested, key, "left")


def latest(rows: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The last row of each key."""
    cols = rows.columns
    packed = rows.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.struct(*order).alias("_o"), F.struct(*cols).alias("_row"))
    return packed.groupBy(*[f"_k{i}" for i in range(len(keys))]).agg(F.max_by("_row", "_o").alias("_row")).select("_row.*")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same key, a null leaving what was there."""
    other = [c for c in old.columns if c not in keys]
    named = new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in other if c in new.columns])
    joined = old.join(named, keys, "full_outer")
    return joined.select(*keys, *[F.coalesce(f"_new_{c}", c).alias(c) if c in new.columns else F.col(c) for c in other])


def changes(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``(<key>, change)``: ``added``, ``removed``, ``changed`` or ``same``; nulls compare as equal."""
    a = old.select(F.col(key), F.struct(*columns).alias("_a"))
    b = new.select(F.col(key), F.struct(*columns).alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a").eqNullSafe(F.col("_b")), "same").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def drop_excess(rows: DataFrame, keys: list[str], order: list[str], more_than: int = 5, keep: int = 2) -> DataFrame:
    """Of keys with more than ``more_than`` rows only the first ``keep``.

    Sizes are counted by an aggregate first; only rows of oversized keys are
    ordered, after the rest went by.
    """
    size = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > more_than).select(*keys)
    few = rows.join(size, keys, "left_anti")
    many = rows.join(size, keys, "left_semi").withColumn("_slot", F.pmod(F.xxhash64(*order), F.lit(64)))
    local = many.withColumn("_r", F.row_number().over(W.partitionBy(*keys, "_slot").orderBy(*order))).where(F.col("_r") <= keep)
    left = local.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= keep)
    return few.unionByName(left.drop("_r", "_slot"))


def retained(rows: DataFrame, ts: str, now: Column, days: int) -> DataFrame:
    """Rows not older than ``days`` at ``now``; rows without a time stay."""
    return rows.where(F.col(ts).isNull() | (F.col(ts) > now - F.make_dt_interval(F.lit(days))))


def batches(rows: DataFrame, order: str, size: int, count: int | None = None) -> DataFrame:
    """``batch_no`` from 0 by the order of a unique number.

    Ranks come from the counts of ranges of the number that hold about as many rows,
    summed up, so no single task numbers all rows, whatever outliers there are.
    """
    n = rows.count()
    if not n:
        return rows.withColumn("batch_no", F.lit(0).cast("bigint"))
    parts = min(count or n // 100_000 + 1, 1024)
    # Bounds near equal counts, however the numbers lie; ranks are exact for any bounds.
    marks = sorted(set(rows.approxQuantile(order, [k / parts for k in range(1, parts)], 1 / (4 * parts)))) if parts > 1 else []
    cell = F.size(F.filter(F.array(*[F.lit(float(m)) for m in marks]), lambda m: m <= F.col(order))) if marks else F.lit(0)
    cut = rows.withColumn("_cell", cell)
    before = F.coalesce(F.sum("_n").over(W.orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = cut.groupBy("_cell").agg(F.count("*").alias("_n")).select("_cell", before.alias("_before"))
    rank = F.row_number().over(W.partitionBy("_cell").orderBy(order)) - 1
    return cut.join(starts, "_cell").withColumn("batch_no", F.floor((F.col("_before") + rank) / size)).drop("_cell", "_before")


def status_rollup(rows: DataFrame, group: list[str], status: str) -> DataFrame:
    """Counts of ``success`` and ``error`` and what they make together."""
    done = rows.groupBy(*group).agg(F.count_if(F.col(status) == "success").alias("succeeded"), F.count_if(F.col(status) == "error").alias("failed"), F.count("*").alias("total"))
    verdict = F.when(F.col("failed") == 0, "success").when(F.col("succeeded") == 0, "error").otherwise("partial")
    return done.withColumn("status", verdict)


def first_seen(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return keep_first(rows, list(keys), list(order))
