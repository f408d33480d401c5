"""Joins, merges and checks of record tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.numbers import half_even


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key, the first in the given order; a null key is one key.

    The plan limits each key to its first row within every partition before rows are dealt
    (WindowGroupLimit), so a key that holds any share of them is no hot one.
    """
    own = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(own)).where("_rn = 1").drop("_rn")


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The table with changes put in by key: a key's latest change replaces its row, new keys are added.

    `order` puts the latest change of a key first; without it keys must not repeat.
    """
    last = latest(changes, keys, *order) if order else changes
    return table.join(last, keys, "left_anti").unionByName(last)


def only_new(rows: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key isn't in `existing`, one per key."""
    return rows.dropDuplicates(keys).join(existing, keys, "left_anti")


def soft_delete(rows: DataFrame, gone: Column, at: Column) -> DataFrame:
    """`deleted_at` set on the rows where `gone` holds and it was null."""
    return rows.withColumn("deleted_at", F.when(gone, F.coalesce("deleted_at", at)).otherwise(F.col("deleted_at")))


def fill_missing(actual: DataFrame, baseline: DataFrame, key: str) -> DataFrame:
    """Actual rows, and baseline rows of keys that have none."""
    return actual.unionByName(baseline.join(actual.select(key).distinct(), key, "left_anti"))


def lookup(rows: DataFrame, names: DataFrame, key: str, value: str, default: str) -> DataFrame:
    """Rows with the name of their key, or the default."""
    return rows.join(names, key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def duplicates_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(order, first_id): rows that share any non-null key with an earlier one, and the earliest of those.

    The OR of keys is a union of one equi-grouping per key, so there is no pair of rows in a group.
    """
    parts = []
    for key in keys:
        first = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("first_id"))
        parts.append(rows.select(order, key).join(first, key).where(F.col("first_id") < F.col(order)).select(order, "first_id"))
    return reduce(DataFrame.unionByName, parts).groupBy(order).agg(F.min("first_id").alias("first_id"))


def snapshot_diff(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, change, fields) of rows that were added, removed or changed between two snapshots; null equals null."""
    left = a.select(F.col(key), F.struct(*fields).alias("_a"))
    right = b.select(F.col(key), F.struct(*fields).alias("_b"))
    changed = F.array_compact(F.array(*[F.when(~F.col(f"_a.{f}").eqNullSafe(F.col(f"_b.{f}")), f) for f in fields]))
    both = left.join(right, key, "full_outer")
    kind = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.size(changed) > 0, "changed")
    return both.select(key, kind.alias("change"), F.when(kind == "changed", F.array_join(changed, ",")).otherwise("").alias("fields")).where("change IS NOT NULL")


def page_of(rows: DataFrame, limit: int, offset: int, *order: Column) -> DataFrame:
    """One page with `has_more`: sorted and cut before anything else, so only limit + 1 rows are numbered."""
    cut = rows.orderBy(*order).offset(offset).limit(limit + 1)
    numbered = cut.withColumn("place", F.row_number().over(Window.partitionBy().orderBy(*order)))
    more = F.max("place").over(Window.partitionBy()) > limit
    return numbered.withColumn("has_more", more).where(F.col("place") <= limit)


def reconcile(records: DataFrame, items: DataFrame, key: str, tolerance: float = 10.0) -> DataFrame:
    """Records (key, total) against their items (key, amount, discount): sums, difference and reasons for review.

    An item sum passes against the total or the total and discounts together.  Records
    without items, and totals that are null or not positive, have reasons of their own.
    """
    sums = items.groupBy(key).agg(F.count("*").alias("n_items"), F.sum("amount").alias("item_sum"), F.sum("discount").alias("discounts"))
    joined = records.join(sums, key, "left")
    off = F.least(F.abs(F.col("item_sum") - F.col("total")), F.abs(F.col("item_sum") - F.col("total") - F.col("discounts")))
    reasons = F.array_compact(
        F.array(
            F.when(F.coalesce(F.col("total") <= 0, F.lit(True)), "AMOUNT_MISSING"),
            F.when(F.col("n_items").isNull(), "ITEMS_MISSING"),
            F.when(off > tolerance, "ITEM_SUM_MISMATCH"),
        )
    )
    return joined.select(key, F.coalesce("n_items", F.lit(0)).alias("n_items"), F.round("item_sum", 2).alias("item_sum"), F.array_join(reasons, ",").alias("reasons"), F.when(F.size(reasons) == 0, "PASS").otherwise("REVIEW").alias("decision"))


def group_records(rows: DataFrame, ts: str, kind: str, total: str) -> DataFrame:
    """Count and total per month and kind."""
    return rows.groupBy(F.date_format(ts, "yyyy-MM").alias("month"), F.col(kind).alias("kind")).agg(F.count("*").alias("n"), F.round(F.sum(total), 2).alias("total"))


def tax_parts(rows: DataFrame, total: str) -> DataFrame:
    """supply and tax of totals that include a tenth, in whole units, ties to even."""
    tax = half_even(F.col(total) / 11)
    return rows.withColumn("tax", tax).withColumn("supply", F.col(total) - F.col("tax"))


def weighted_score(parts: dict[str, tuple[Column, float]]) -> Column:
    """Sum of booleans or shares times their weights; nulls count 0."""
    return reduce(lambda a, b: a + b, [F.coalesce(c.cast("double"), F.lit(0.0)) * w for c, w in parts.values()])


def unique_ids(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Rows with a key of their own: all but the first of each key get their number within it added."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("_rn", place).withColumn(key, F.when(F.col("_rn") == 1, F.col(key)).otherwise(F.concat(F.col(key), F.lit("-"), F.col("_rn").cast("string")))).drop("_rn")


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n) of several tables."""
    return reduce(DataFrame.unionByName, [rows.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, rows in tables.items()])


def multisets(a: DataFrame, b: DataFrame, by: str, value: str) -> DataFrame:
    """(by, equal, common): whether the values of two tables are the same as multisets, and how many they share."""
    tagged = a.select(by, value, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(b.select(by, value, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    counts = tagged.groupBy(by, value).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    return counts.groupBy(by).agg(F.every(F.col("_a") == F.col("_b")).alias("equal"), F.sum(F.least("_a", "_b")).alias("common"))


def last_mentioned(text: Column, items: list[str]) -> Column:
    """The item that stands last in the text, the first in the list of equals; null if none does."""
    places = [F.when(F.contains(text, F.lit(i)), F.length(text) - F.instr(F.reverse(text), i[::-1]) - len(i) + 2).otherwise(0) for i in items]
    best = F.array_position(F.array(*places), F.greatest(*places)) if len(items) > 1 else F.lit(1)
    return F.when(F.array_max(F.array(*places)) > 0, F.element_at(F.array(*map(F.lit, items)), best.cast("int")))


def rerank(rows: DataFrame, by: str, score: str, again: str, tie: str, first: int = 10, last: int = 5) -> DataFrame:
    """The best `last` by `again` among the best `first` by `score`, with `rank` from 1."""
    best = rows.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), tie))).where(F.col("_r") <= first)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(again), tie))).where(F.col("rank") <= last).drop("_r")


def with_status(documents: DataFrame, parts: DataFrame, key: str) -> DataFrame:
    """Documents with the number of their parts, and READY if there are any, else EMPTY."""
    counts = parts.groupBy(key).agg(F.count("*").alias("n"))
    return documents.join(counts, key, "left").select(*documents.columns, F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") > 0, "READY").otherwise("EMPTY").alias("status"))


#: Days that a payment keeps a subscription.
PERIOD_DAYS = 30


def subscriptions(payments: DataFrame, cancels: DataFrame, now: Column) -> DataFrame:
    """(user, tier, status, period_start, period_end) of each user's last payment (user, paid_at) and the cancels (user, asked_at) since.

    A payment keeps the subscription for PERIOD_DAYS and undoes what was cancelled before; a later cancel takes
    effect at the period's end, when the tier is FREE.  Without a cancel the status stays ACTIVE, as periods
    are renewed by payments only.  Null users and times don't count.
    """
    last = payments.where("user IS NOT NULL AND paid_at IS NOT NULL").groupBy("user").agg(F.max("paid_at").alias("period_start"))
    asked = cancels.where("user IS NOT NULL AND asked_at IS NOT NULL").groupBy("user").agg(F.max("asked_at").alias("_asked"))
    held = last.join(asked, "user", "left").withColumn("period_end", F.col("period_start") + F.make_interval(days=F.lit(PERIOD_DAYS)))
    cancelled = F.coalesce(F.col("_asked") >= F.col("period_start"), F.lit(False))
    over = cancelled & (F.col("period_end") <= now)
    return held.select("user", F.when(over, "FREE").otherwise("ENTERPRISE").alias("tier"), F.when(over, "CANCELED").when(cancelled, "CANCEL_SCHEDULED").otherwise("ACTIVE").alias("status"), "period_start", "period_end")
