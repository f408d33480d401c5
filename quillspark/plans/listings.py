"""Filters, listings and changes of record tables as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import filters as L
from quillspark.operators import records as R
from quillspark.plans.registry import StandIn, choice, query
from quillspark.sources.tables import table

TASKS = StandIn(
    "orders",
    {
        "id": "o_orderkey", "owner": "o_custkey % 50", "assignee": "o_custkey % 37", "deleted_at": "CASE WHEN o_orderkey % 7 = 0 THEN o_orderdate END", "seen_at": "o_orderdate", "status": "o_orderstatus", "title": "o_orderpriority",
        "category": choice("o_orderkey", "MEAL", "TRAVEL"), "config": "CASE o_orderkey % 4 WHEN 0 THEN '{\"demo\":\"true\"}' WHEN 1 THEN '{\"demo\":\"false\",\"flow\":{\"submitted_at\":\"x\"}}' WHEN 2 THEN '{\"flow\":{}}' END",
        "saved_at": "CASE WHEN o_custkey % 3 > 0 THEN o_orderdate END", "asked": "o_orderkey % 5", "done": "o_custkey % 5",
    },
)


@query(f"SELECT id, owner, assignee FROM {TASKS.sql} WHERE deleted_at IS NULL AND (owner = 5 OR assignee = 5)")
def tasks_of_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live tasks that a person owns or has been given."""
    return L.of_person(L.active(TASKS.rows(spark, sf_dir)), 5, "owner", "assignee").select("id", "owner", "assignee")


@query(f"SELECT id, config ->> '$.flow.submitted_at' IS NOT NULL AS submitted FROM {TASKS.sql} WHERE coalesce(config ->> '$.demo', '') <> 'true'")
def runs_not_demo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose configuration is no demo's, and whether they were submitted."""
    rows = TASKS.rows(spark, sf_dir).where(L.not_demo(F.col("config")))
    return rows.select("id", F.get_json_object("config", "$.flow.submitted_at").isNotNull().alias("submitted"))


@query(f"SELECT id FROM {TASKS.sql} WHERE category IS NULL AND status = 'F' AND saved_at IS NOT NULL")
def unclassified_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmed and saved rows without a category."""
    rows = L.in_category(TASKS.rows(spark, sf_dir), "category", "UNCLASSIFIED")
    return rows.where((F.col("status") == "F") & F.col("saved_at").isNotNull()).select("id")


@query(f"SELECT id, title FROM {TASKS.sql} WHERE contains(lower(title), 'medium') OR contains(lower(status), 'medium') ORDER BY seen_at DESC, id LIMIT 10")
def mention_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten latest rows that mention a word; a limit out of bounds is brought within them."""
    return L.mentions(TASKS.rows(spark, sf_dir), "MEDIUM", "title", "status", limit=L.clamp(10, 1, 100), order=[F.desc("seen_at"), F.asc("id")]).select("id", "title")


@query(f"SELECT owner, max(id) AS id, max(seen_at) AS seen_at FROM (SELECT * FROM {TASKS.sql} WHERE asked > 0 AND asked = done QUALIFY row_number() OVER (PARTITION BY owner ORDER BY seen_at DESC, id DESC) = 1) GROUP BY owner")
def latest_completed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each owner's latest completed run."""
    rows = L.completed_runs(TASKS.rows(spark, sf_dir), "asked", "done")
    return R.latest(rows.select("owner", "id", "seen_at"), ["owner"], F.desc("seen_at"), F.desc("id"))


MEMBERS = StandIn("lineitem", {"id": "l_orderkey", "member": "l_suppkey % 40", "role": "CASE l_linenumber % 3 WHEN 0 THEN 'EDITOR' WHEN 1 THEN 'VIEWER' ELSE 'GUEST' END"})


@query(f"SELECT id, owner FROM {TASKS.sql} WHERE owner = 7 OR id IN (SELECT id FROM {MEMBERS.sql} WHERE member = 7 AND role IN ('EDITOR', 'VIEWER'))")
def visible_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a person owns or shares."""
    return L.visible(TASKS.rows(spark, sf_dir), MEMBERS.rows(spark, sf_dir), "id", 7).select("id", "owner")


NAMED = StandIn("lineitem", {"id": "l_orderkey * 10 + l_linenumber", "file": "CASE WHEN l_linenumber % 2 = 0 THEN l_partkey END", "title": "CASE WHEN l_linenumber % 3 = 0 THEN l_suppkey END", "source": "'doc ' || cast(l_orderkey % 9 as string)"})


@query(f"SELECT id, coalesce(p_name, s_name, source) AS doc FROM {NAMED.sql} LEFT JOIN part ON file = p_partkey LEFT JOIN supplier ON title = s_suppkey")
def document_of_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by file, else by title, else by the name of their source."""
    parts, suppliers = table(spark, sf_dir, "part").selectExpr("p_partkey AS key", "p_name AS value"), table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS key", "s_name AS value")
    return L.coalesced_lookup(NAMED.rows(spark, sf_dir), [("file", parts), ("title", suppliers)], "doc", "source").select("id", "doc")


@query(f"SELECT id, coalesce(deleted_at, CASE WHEN owner = 3 THEN TIMESTAMP '2024-01-01 00:00:00' END) AS deleted_at, CASE WHEN category = 'MEAL' THEN 'FOOD' ELSE category END AS category, id % 11 = 0 AS outside_scope FROM {TASKS.sql} WHERE id % 11 <> 0 OR owner >= 25")
def changed_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows updated, marked as deleted, and deleted by a set of ids within a scope."""
    rows = R.soft_delete(TASKS.rows(spark, sf_dir), F.col("owner") == 3, F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")))
    rows = L.update_where(rows, F.col("category") == "MEAL", category=F.lit("FOOD"))
    return L.hard_delete(rows, rows.where("id % 11 = 0"), "id", F.col("owner") < 25).select("id", "deleted_at", "category", "outside_scope")


@query(f"SELECT owner, count(*) AS n FROM {TASKS.sql} WHERE status = 'P' GROUP BY owner HAVING count(*) > 1")
def pending_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners with more than one pending row."""
    return L.pending_twice(TASKS.rows(spark, sf_dir), "owner", F.col("status") == "P")


PAYMENTS = StandIn("events", {"id": "event_id", "payer": "user_id", "seen_at": "ts", "status": "CASE event_type WHEN 'purchase' THEN 'PAID' WHEN 'error' THEN 'FAILED' ELSE 'PENDING' END"})


@query(f"SELECT payer, CASE WHEN count_if(status = 'PAID') > 0 THEN 'PAID' ELSE arg_max(status, struct_pack(a := seen_at, b := id)) END AS status, count_if(status = 'PAID') AS n_paid FROM {PAYMENTS.sql} GROUP BY payer")
def payment_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each payer's events come to."""
    return L.fold_paid(PAYMENTS.rows(spark, sf_dir), "payer", ["seen_at", "id"], "status")


@query("SELECT o_orderkey AS id, 'own' AS origin FROM orders WHERE o_custkey % 20 = 1 UNION ALL SELECT DISTINCT l_orderkey, 'shared' FROM lineitem WHERE l_suppkey % 20 = 1 AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 20 = 1)")
def owned_and_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own rows, and shared ones that aren't own."""
    own = table(spark, sf_dir, "orders").where("o_custkey % 20 = 1").select(F.col("o_orderkey").alias("id"), F.lit("own").alias("origin"))
    return L.key_union(own, table(spark, sf_dir, "lineitem").where("l_suppkey % 20 = 1").select(F.col("l_orderkey").alias("id"), F.lit("shared").alias("origin")), "id")


MAP = (("F", "FINAL"), ("O", "OPEN"), ("X", "EXTRA"))


@query("SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'FINAL' WHEN 'O' THEN 'OPEN' ELSE o_orderstatus END AS status FROM orders UNION ALL SELECT NULL, 'map lacks ' || s FROM (SELECT DISTINCT o_orderstatus AS s FROM orders WHERE o_orderstatus NOT IN ('F', 'O', 'X')) UNION ALL SELECT NULL, 'rows lack X' WHERE 'X' NOT IN (SELECT o_orderstatus FROM orders)")
def relabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with present names, and what either side of the map lacks."""
    rows, lacking = L.relabel(table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "o_orderstatus AS status"), spark.createDataFrame(MAP, "old string, new string"), "status")
    return rows.unionByName(lacking.select(F.lit(None).cast("long").alias("id"), F.concat(F.when(F.col("side") == "map", "map lacks ").otherwise("rows lack "), "key").alias("status")))


@query("SELECT c_custkey AS node, CASE WHEN c_custkey = 0 THEN 0 ELSE c_custkey % 10 + CASE WHEN c_custkey % 10 = 0 THEN 10 ELSE 0 END END AS \"group\" FROM customer")
def split_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of customers linked ten by ten."""
    keys = table(spark, sf_dir, "customer").select("c_custkey")
    edges = keys.select(F.col("c_custkey").alias("a"), F.when(F.col("c_custkey") > 10, F.col("c_custkey") - 10).otherwise(F.col("c_custkey")).alias("b"))
    return L.split_groups(edges)


@query(f"SELECT id, CASE WHEN rn = 1 THEN CAST(owner AS VARCHAR) ELSE CAST(owner AS VARCHAR) || '-' || CAST(rn AS VARCHAR) END AS run_id FROM (SELECT id, owner, row_number() OVER (PARTITION BY owner ORDER BY id) AS rn FROM {TASKS.sql})")
def unique_run_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run ids, new ones for all but the first row of each."""
    return R.unique_ids(TASKS.rows(spark, sf_dir).select("id", F.col("owner").cast("string").alias("run_id")), "run_id", "id")


@query(
    "SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'part', count(*) FROM part"
)
def row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of several tables."""
    return R.row_counts({name: table(spark, sf_dir, name) for name in ("orders", "customer", "part")})


@query("WITH a AS (SELECT l_orderkey AS id, l_quantity AS v, count(*) AS n FROM lineitem GROUP BY ALL), b AS (SELECT l_orderkey AS id, CASE WHEN l_linenumber = 2 THEN l_quantity + l_orderkey % 2 ELSE l_quantity END AS v, count(*) AS n FROM lineitem GROUP BY ALL) SELECT id, bool_and(a.n IS NOT DISTINCT FROM b.n) AS equal, CAST(sum(least(coalesce(a.n, 0), coalesce(b.n, 0))) AS BIGINT) AS common FROM a FULL JOIN b USING (id, v) GROUP BY id")
def multiset_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose quantities stay the same as multisets, and how many they share."""
    rows = table(spark, sf_dir, "lineitem")
    after = F.when(F.col("l_linenumber") == 2, F.col("l_quantity") + F.col("l_orderkey") % 2).otherwise(F.col("l_quantity"))
    return R.multisets(rows.select(F.col("l_orderkey").alias("id"), F.col("l_quantity").alias("v")), rows.select(F.col("l_orderkey").alias("id"), after.alias("v")), "id", "v")


MENTIONS = StandIn("orders", {"id": "o_orderkey", "history": "o_orderpriority || ' then ' || o_orderstatus || ' at ' || cast(o_custkey as string) || ' ' || o_orderpriority"})


@query(f"SELECT id, CASE WHEN list_max(p) > 0 THEN list_extract(['HIGH', 'LOW', ' at ', 'MEDIUM'], CAST(list_position(p, list_max(p)) AS INTEGER)) END AS item FROM (SELECT id, list_transform(['HIGH', 'LOW', ' at ', 'MEDIUM'], lambda t: CASE WHEN contains(history, t) THEN length(history) - strpos(reverse(history), reverse(t)) - length(t) + 2 ELSE 0 END) AS p FROM {MENTIONS.sql})")
def latest_mention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of several titles a history mentions last."""
    return MENTIONS.rows(spark, sf_dir).select("id", R.last_mentioned(F.col("history"), ["HIGH", "LOW", " at ", "MEDIUM"]).alias("item"))


@query("WITH t AS (SELECT l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS r FROM lineitem), f AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS q FROM t WHERE r <= 4) SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY round(1 / (1 + exp(-(l_linenumber - 3))), 9) DESC, l_linenumber) AS rank FROM f QUALIFY rank <= 2")
def reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best four of each order by price, the best two of those by another score."""
    from quillspark.functions.numbers import sigmoid

    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", F.round(sigmoid(F.col("l_linenumber") - 3), 9).alias("again"))
    return R.rerank(rows, "l_orderkey", "l_extendedprice", "again", "l_linenumber", 4, 2).select("l_orderkey", "l_linenumber", "rank")


@query("SELECT c_custkey, coalesce(n, 0) AS n, CASE WHEN n > 0 THEN 'READY' ELSE 'EMPTY' END AS status FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def ready_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of each document, and whether it has any."""
    return R.with_status(table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query(
    """WITH paid AS (SELECT o_custkey AS user, max(CAST(o_orderdate AS TIMESTAMP)) AS s FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1), asked AS (SELECT o_custkey AS user, max(CAST(o_orderdate AS TIMESTAMP)) AS a FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
held AS (SELECT user, s, s + INTERVAL 30 DAYS AS e, coalesce(a >= s, false) AS c FROM paid LEFT JOIN asked USING (user))
SELECT user, CASE WHEN c AND e <= TIMESTAMP '2001-06-01' THEN 'FREE' ELSE 'ENTERPRISE' END AS tier, CASE WHEN c AND e <= TIMESTAMP '2001-06-01' THEN 'CANCELED' WHEN c THEN 'CANCEL_SCHEDULED' ELSE 'ACTIVE' END AS status, CAST(s AS VARCHAR) AS period_start, CAST(e AS VARCHAR) AS period_end FROM held"""
)
def subscription_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' subscriptions: orders pay, those of status F cancel."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user"), "o_orderdate", "o_orderstatus")
    found = R.subscriptions(orders.where("o_orderstatus <> 'F'").withColumnRenamed("o_orderdate", "paid_at"), orders.where("o_orderstatus = 'F'").withColumnRenamed("o_orderdate", "asked_at"), F.to_timestamp_ntz(F.lit("2001-06-01 00:00:00")))
    return found.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("period_start", "period_end")})
