"""Row filters and listings of record tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.session import checkpointed


def active(rows: DataFrame, deleted: str = "deleted_at") -> DataFrame:
    """Rows that aren't deleted."""
    return rows.where(F.col(deleted).isNull())


def of_person(rows: DataFrame, person: object, *columns: str) -> DataFrame:
    """Rows that name the person in any of the columns."""
    found = F.lit(False)
    for c in columns:
        found = found | (F.col(c) == F.lit(person))
    return rows.where(found)


def not_demo(config: Column) -> Column:
    """Whether a JSON configuration has no true member `demo`; a null one has none."""
    return F.coalesce(F.get_json_object(config, "$.demo"), F.lit("")) != "true"


def in_category(rows: DataFrame, column: str, wanted: str | None, unclassified: str = "UNCLASSIFIED") -> DataFrame:
    """Rows of a category; the unclassified have none, and no category wanted means all."""
    if wanted is None:
        return rows
    return rows.where(F.col(column).isNull() if wanted == unclassified else F.col(column) == wanted)


def mentions(rows: DataFrame, term: str, *columns: str, limit: int | None = None, order: list[Column] | None = None) -> DataFrame:
    """Rows whose columns hold the term, letter case apart; the first `limit` in an order if given."""
    found = F.lit(False)
    for c in columns:
        found = found | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(term.lower()))
    kept = rows.where(found)
    return kept.orderBy(*(order or [])).limit(limit) if limit is not None else kept


def completed_runs(rows: DataFrame, count: str, done: str) -> DataFrame:
    """Runs that asked something and completed all of it."""
    return rows.where((F.col(count) > 0) & (F.col(count) == F.col(done)))


def clamp(value: int, least: int, most: int) -> int:
    """A limit within its bounds."""
    return max(least, min(most, value))


def visible(rows: DataFrame, members: DataFrame, key: str, person: object, owner: str = "owner", roles: tuple[str, ...] = ("EDITOR", "VIEWER")) -> DataFrame:
    """Rows that the person owns, or is a member of with one of the roles; each once."""
    own = F.col(owner) == F.lit(person)
    shared = members.where((F.col("member") == F.lit(person)) & F.col("role").isin(*roles)).select(F.col(key).alias("_key")).distinct()
    joined = rows.join(shared, rows[key] == shared["_key"], "left")
    return joined.where(own | F.col("_key").isNotNull()).drop("_key")


def coalesced_lookup(rows: DataFrame, by: list[tuple[str, DataFrame]], name: str, default: str) -> DataFrame:
    """Rows with `name` from the first of several lookup tables (key, value) that has their key, else the default column."""
    found, got = rows, []
    for i, (key, names) in enumerate(by):
        side = names.select(F.col("key").alias(f"_k{i}"), F.col("value").alias(f"_v{i}")).dropDuplicates([f"_k{i}"])
        found = found.join(side, F.col(key) == F.col(f"_k{i}"), "left")
        got.append(F.col(f"_v{i}"))
    return found.withColumn(name, F.coalesce(*got, F.col(default))).drop(*[f"_{x}{i}" for i in range(len(by)) for x in "kv"])


def update_where(rows: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """The table with new values in the rows where the condition holds."""
    return rows.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def hard_delete(rows: DataFrame, ids: DataFrame, key: str, scope: Column) -> DataFrame:
    """The table without the ids, all of which must be in scope: one that isn't keeps its row and is told by `outside_scope`."""
    return rows.join(ids.select(key).distinct().withColumn("_gone", F.lit(True)), key, "left").where(F.col("_gone").isNull() | ~scope).withColumn("outside_scope", F.col("_gone").isNotNull()).drop("_gone")


def pending_twice(rows: DataFrame, key: str, pending: Column) -> DataFrame:
    """(key, n) of keys with more than one pending row: what a partial unique index would refuse."""
    return rows.where(pending).groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def fold_paid(events: DataFrame, key: str, order: list[str], status: str) -> DataFrame:
    """(key, status, paid_once) after all events: PAID is final, so what comes after the first one changes nothing."""
    place = F.struct(*order)
    first_paid = F.min(F.when(F.col(status) == "PAID", place))
    return events.groupBy(key).agg(F.when(first_paid.isNotNull(), "PAID").otherwise(F.max_by(status, place)).alias("status"), F.count_if(F.col(status) == "PAID").alias("n_paid"))


def key_union(owned: DataFrame, shared: DataFrame, key: str) -> DataFrame:
    """Owned rows, and shared ones whose key isn't owned."""
    return owned.unionByName(shared.dropDuplicates([key]).join(owned.select(key).distinct(), key, "left_anti"))


def relabel(rows: DataFrame, names: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Rows with names mapped (old, new), and the keys that either side lacks (side, key): none if the map fits exactly."""
    held = rows.select(F.col(column).alias("key")).distinct()
    lacking = held.join(names.select(F.col("old").alias("key")), "key", "left_anti").withColumn("side", F.lit("map")).unionByName(names.select(F.col("old").alias("key")).join(held, "key", "left_anti").withColumn("side", F.lit("rows")))
    joined = rows.join(names, F.col(column) == F.col("old"), "left")
    return joined.withColumn(column, F.coalesce("new", column)).drop("old", "new"), lacking


def split_groups(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, group) of undirected edges (a, b): smallest node within reach, so that alike rows never cross a split.

    Labels spread by joins until none changes; each round is checkpointed.  The joins merge: both sides grow
    with the edges, so none is sent to the driver for a broadcast.  Raises if they still change after `rounds`.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct()
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("group")))
    for _ in range(rounds):
        near = both.join(labels.hint("merge"), both["b"] == labels["node"]).groupBy("a").agg(F.min("group").alias("near"))
        joined = labels.join(near.hint("merge"), labels["node"] == near["a"])
        # a label leads on to its own label, so paths halve each round
        stepped = joined.select("node", F.least("group", "near").alias("group"), (F.col("near") < F.col("group")).alias("changed"))
        hop = stepped.select(F.col("node").alias("_n"), F.col("group").alias("_g"))
        stepped = checkpointed(stepped.join(hop.hint("merge"), stepped["group"] == hop["_n"], "left").select("node", F.least("group", F.coalesce("_g", "group")).alias("group"), "changed"))
        labels = stepped.select("node", "group")
        if stepped.where("changed").isEmpty():
            return labels
    raise RuntimeError(f"groups still change after {rounds} rounds")
