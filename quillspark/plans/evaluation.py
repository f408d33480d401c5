"""Summaries of evaluations as queries; orders stand in for evaluated receipts, lines and events for cases."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import evaluation as E
from quillspark.operators.monitoring import date_spine
from quillspark.plans.registry import StandIn, query
from quillspark.sources.tables import table

ITEMS = StandIn(
    "orders",
    {
        "id": "o_orderkey", "batch": "o_custkey % 40", "status": "CASE WHEN o_orderkey % 9 = 0 OR o_custkey % 40 = 3 THEN 'FAILED' ELSE 'COMPLETED' END", "field_accuracy": "cast((o_orderkey % 11) / 10.0 as double)", "complete_match": "o_orderkey % 11 = 10",
        "schema_rate": "cast(CASE WHEN o_custkey % 40 = 4 THEN 1 ELSE (o_orderkey % 3) / 2.0 END as double)", "total_correct": "o_custkey % 40 = 4 OR o_orderkey % 5 > 0", "latency_ms": "cast((o_orderkey % 13) * 1000 * (o_custkey % 40) as bigint)", "extraction_score": "cast(o_orderkey % 101 as double)",
        "stage": "CASE o_orderkey % 6 WHEN 0 THEN 'OCR' WHEN 1 THEN 'UPLOAD' WHEN 2 THEN 'ODD' WHEN 3 THEN 'EVALUATION' END", "decision": "CASE o_orderkey % 3 WHEN 0 THEN 'PASS' WHEN 1 THEN 'REVIEW' ELSE 'USER_CONFIRM' END",
    },
)


@query(
    f"""WITH i AS (SELECT *, status = 'COMPLETED' AS done FROM {ITEMS.sql}),
g AS (SELECT batch, count(*) AS requested, count_if(done) AS completed, coalesce(avg(field_accuracy) FILTER (done), 0) AS field_accuracy, coalesce(avg(CAST(complete_match AS DOUBLE)) FILTER (done), 0) AS complete_match_rate, avg(schema_rate) FILTER (done) AS schema_rate, avg(CAST(total_correct AS DOUBLE)) FILTER (done) AS total_accuracy, avg(latency_ms) FILTER (done AND latency_ms > 0) AS m, quantile_disc(latency_ms, 0.95) FILTER (done AND latency_ms > 0) AS p95_ms, CAST(sum(latency_ms) AS BIGINT) AS total_ms, avg(extraction_score) FILTER (done) AS e FROM i GROUP BY batch),
s AS (SELECT *, coalesce(CASE WHEN p95_ms > 180000 THEN least(greatest(0, least(3, (120 - m / 1000) / 30)), 1) ELSE greatest(0, least(3, (120 - m / 1000) / 30)) END, 0) AS speed FROM g)
SELECT batch, requested, completed, requested - completed AS failed, round(field_accuracy, 6) AS field_accuracy, round(complete_match_rate, 6) AS complete_match_rate, round(schema_rate, 6) AS schema_rate, round(total_accuracy, 6) AS total_accuracy, CAST(round(m) AS BIGINT) AS mean_ms, CAST(p95_ms AS DOUBLE) AS p95_ms, total_ms, round(CASE WHEN m IS NULL THEN 0 ELSE speed END, 6) AS speed, round(coalesce(e, 0) + CASE WHEN m IS NULL THEN 0 ELSE speed END + CASE WHEN completed > 0 THEN 2 ELSE 0 END, 6) AS final_score, CASE WHEN completed = requested THEN 'COMPLETED' WHEN completed = 0 THEN 'FAILED' ELSE 'PARTIAL' END AS state, coalesce(schema_rate >= 0.98 AND total_accuracy >= 0.95, false) AS gate FROM s"""
)
def batch_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of receipts summed up."""
    found = E.batch_summary(ITEMS.rows(spark, sf_dir), "batch")
    return found.withColumns({c: F.round(c, 6) for c in ("field_accuracy", "complete_match_rate", "schema_rate", "total_accuracy", "speed", "final_score")})


DETAILS = StandIn("lineitem", {"field": "CASE l_linenumber WHEN 1 THEN 'merchant' WHEN 2 THEN 'items.name' WHEN 3 THEN 'total' ELSE 'items.price' END", "correct": "(l_orderkey + l_partkey) % 5 > l_linenumber % 3"})


@query(f"SELECT *, row_number() OVER (ORDER BY accuracy DESC, field) AS place FROM (SELECT field, count(*) AS n, count_if(NOT correct) AS errors, round(avg(CAST(correct AS DOUBLE)), 6) AS accuracy FROM {DETAILS.sql} GROUP BY field)")
def field_accuracies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy and errors of each field, items' fields among them."""
    return E.field_accuracy(DETAILS.rows(spark, sf_dir), "field", "correct").withColumn("accuracy", F.round("accuracy", 6))


STAGES = ("UPLOAD", "OCR", "DOCUMENTATION", "EVALUATION")


@query(f"SELECT s.stage, count(id) AS n FROM (VALUES ('UPLOAD'), ('OCR'), ('DOCUMENTATION'), ('EVALUATION'), ('UNREGISTERED')) AS s(stage) LEFT JOIN (SELECT id, CASE WHEN stage IN {STAGES} THEN stage ELSE 'UNREGISTERED' END AS stage FROM {ITEMS.sql}) USING (stage) GROUP BY s.stage HAVING count(id) > 0 OR s.stage <> 'UNREGISTERED'")
def failed_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by the stage that they failed in."""
    return E.stage_counts(ITEMS.rows(spark, sf_dir), "stage", STAGES)


@query(f"WITH i AS (SELECT decision, list_distinct(list_filter(['A' || CAST(id % 3 AS VARCHAR), 'B', 'A1', CASE WHEN id % 2 = 0 THEN 'B' END], lambda x: x IS NOT NULL)) AS reasons FROM {ITEMS.sql}) SELECT 'decision' AS kind, decision AS code, count(*) AS n FROM i GROUP BY decision UNION ALL SELECT 'reason', r, count(*) FROM (SELECT unnest(reasons) AS r FROM i) GROUP BY r")
def automation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions, and distinct reasons for each."""
    rows = ITEMS.rows(spark, sf_dir)
    reasons = F.array_compact(F.array(F.concat(F.lit("A"), (F.col("id") % 3).cast("string")), F.lit("B"), F.lit("A1"), F.when(F.col("id") % 2 == 0, "B")))
    return E.automation(rows.withColumn("reasons", reasons), "decision", "reasons")


CASES = StandIn(
    "orders",
    {
        "id": "o_orderkey", "model": "o_custkey % 5", "answerable": "o_orderkey % 4 > 0", "rejected": "o_orderkey % 3 = 0", "correct": "CASE WHEN o_orderkey % 7 > 0 THEN o_custkey % 2 = 0 END", "faithfulness": "cast((o_orderkey % 21) / 20.0 as double)", "citation": "cast((o_custkey % 5) / 4.0 as double)",
        "relevancy": "cast((o_custkey % 9) / 8.0 as double)", "kind": "CASE o_custkey % 4 WHEN 0 THEN 'fact' WHEN 1 THEN 'table' WHEN 2 THEN 'other' ELSE 'a' END", "hit": "o_custkey % 3 > 0", "rr": "cast(1.0 / (1 + o_custkey % 6) as double)", "a": "o_orderkey % 6", "b": "o_custkey % 6", "c": "(o_orderkey + o_custkey) % 6",
    },
)


@query(
    f"""WITH k AS (SELECT *, CASE WHEN id % 5 = 0 THEN [] ELSE list_distinct([a, b]) END AS expected, list_distinct([c, (c + 1) % 6, (c + 3) % 6, b]) AS nothing FROM {CASES.sql}),
r AS (SELECT *, CASE WHEN b IN (c, (c + 1) % 6, (c + 3) % 6) THEN [c, (c + 1) % 6, (c + 3) % 6] ELSE [c, (c + 1) % 6, (c + 3) % 6, b] END AS retrieved FROM k),
f AS (SELECT *, coalesce(list_min(list_transform(list_filter(expected, lambda e: list_contains(retrieved, e)), lambda e: list_position(retrieved, e))), 0) AS first FROM r)
SELECT count(*) AS total, count_if(len(expected) > 0) AS evaluated, {", ".join(f"round(avg(CAST(first BETWEEN 1 AND {n} AS DOUBLE)) FILTER (len(expected) > 0), 6) AS hit_at_{n}" for n in (1, 3, 4, 5))},
round(avg(len(list_intersect(expected, retrieved)) / len(expected)) FILTER (len(expected) > 0), 6) AS recall, round(avg(CASE WHEN first > 0 THEN 1 / first ELSE 0 END) FILTER (len(expected) > 0), 6) AS mrr, round(avg(CAST(correct AS DOUBLE)) FILTER (answerable), 6) AS answer_accuracy, round(avg(CAST(rejected AS DOUBLE)) FILTER (NOT answerable), 6) AS rejection_rate, round(avg(citation), 6) AS citation_accuracy, round(avg(faithfulness), 6) AS faithfulness, round(avg(1 - faithfulness), 6) AS hallucination_rate FROM f"""
)
def retrieval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval and answers over all cases."""
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    none = F.array().cast("array<bigint>")
    cases = CASES.rows(spark, sf_dir).withColumns({"expected": F.when(F.col("id") % 5 == 0, none).otherwise(F.array_distinct(F.array(a, b))), "retrieved": F.array_distinct(F.array(c, (c + 1) % 6, (c + 3) % 6, b)), "answer_correct": F.col("correct")})
    found = E.retrieval_summary(cases)
    return found.select("total", "evaluated", *[F.round(x, 6).alias(x) for x in found.columns[2:]])


@query(
    f"""WITH m AS (SELECT model, coalesce(avg(CAST(correct AS DOUBLE)) FILTER (answerable), 0) AS a, avg(faithfulness) AS f, coalesce(avg(relevancy) FILTER (answerable), 0) AS r, coalesce(avg(CAST(rejected AS DOUBLE)) FILTER (NOT answerable), 0) AS n FROM {CASES.sql} GROUP BY model)
SELECT model, round(a, 6) AS accuracy, round(f, 6) AS faithfulness, round(r, 6) AS relevancy, round(n, 6) AS no_answer, round(100 * (0.40 * a + 0.25 * f + 0.20 * r + 0.15 * n), 1) AS final FROM m"""
)
def answer_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted answer scores of each model."""
    return E.answer_final(CASES.rows(spark, sf_dir), "model").withColumns({c: F.round(c, 6) for c in ("accuracy", "faithfulness", "relevancy", "no_answer")})


@query(f"SELECT *, row_number() OVER (ORDER BY CASE kind WHEN 'table' THEN 1 WHEN 'fact' THEN 2 ELSE 3 END, kind) AS place FROM (SELECT kind, count(*) AS n, round(avg(CAST(correct AS DOUBLE)), 6) AS accuracy, round(avg(CAST(hit AS DOUBLE)), 6) AS hit, round(avg(rr), 6) AS mrr FROM {CASES.sql} GROUP BY kind)")
def question_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures by type of question, in an order of their own."""
    return E.by_question_type(CASES.rows(spark, sf_dir), "kind", ("table", "fact")).withColumns({c: F.round(c, 6) for c in ("accuracy", "hit", "mrr")})


@query(f"SELECT CASE WHEN rejected THEN 'rejected' WHEN correct THEN 'correct' WHEN NOT correct THEN 'incorrect' ELSE 'unknown' END AS response, count(*) AS n FROM {CASES.sql} GROUP BY 1")
def response_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses by what came of them."""
    return CASES.rows(spark, sf_dir).groupBy(E.response_kind(F.col("rejected"), F.col("correct")).alias("response")).agg(F.count("*").alias("n"))


SOURCES = ("view", "purchase", "error")


@query("SELECT CAST(d AS DATE) AS day, " + ", ".join(f"coalesce(count_if(event_type = '{s}'), 0) AS {s}" for s in SOURCES) + " FROM generate_series(DATE '2024-01-01', DATE '2024-02-10', INTERVAL 1 DAY) AS u(d) LEFT JOIN events ON CAST(ts AS DATE) = CAST(d AS DATE) GROUP BY d")
def usage_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts of three sources on a full spine."""
    return E.usage_report(table(spark, sf_dir, "events"), date_spine(spark, date(2024, 1, 1), date(2024, 2, 10)), F.to_date("ts"), "event_type", SOURCES)


@query(f"SELECT model, id, faithfulness, row_number() OVER (PARTITION BY model ORDER BY faithfulness, id) AS place FROM {CASES.sql} QUALIFY place <= 5")
def worst_of_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five worst cases of each model."""
    return E.worst(CASES.rows(spark, sf_dir).select("model", "id", "faithfulness"), "model", "faithfulness", "id", 5)


@query(f"SELECT CASE WHEN hit AND correct THEN 'SUPPORTED' WHEN hit AND NOT correct THEN 'ANSWER_ERROR' WHEN NOT hit AND correct THEN 'INFERRED' WHEN NOT hit AND NOT correct THEN 'READING_ERROR' ELSE 'UNKNOWN' END AS status, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM {CASES.sql} GROUP BY 1")
def reading_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What readings did to answers, with shares."""
    from quillspark.operators.monitoring import distribution

    rows = CASES.rows(spark, sf_dir).select(E.impact(F.col("hit"), F.col("correct")).alias("status"))
    return distribution(rows, "status").select("status", "n", F.round("share", 6).alias("share"))


@query(f"SELECT kind, count_if(NOT hit AND rejected) AS fixed, count_if(hit AND NOT rejected) AS regressed, round(avg(CAST(rejected AS DOUBLE)) - avg(CAST(hit AS DOUBLE)), 6) AS delta FROM {CASES.sql} GROUP BY kind")
def fixed_and_regressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a change repaired and broke."""
    return E.before_after(CASES.rows(spark, sf_dir), "kind", "hit", "rejected").withColumn("delta", F.round("delta", 6))


@query(f"SELECT answerable, faithfulness >= 0.55 AS accepted, count(*) AS n FROM {CASES.sql} GROUP BY ALL")
def gate_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a gate at 0.55 lets through."""
    return E.gate_counts(CASES.rows(spark, sf_dir), F.col("faithfulness"), 0.55)


@query("WITH p AS (SELECT quality AS t, CAST(n_chars >= 500 AS INTEGER) AS s FROM labels JOIN documents USING (doc_id)), c AS (SELECT c, count_if(t = c AND s = c) AS tp, count_if(t = c) + count_if(s = c) AS n_both FROM p, (SELECT t AS c FROM p UNION SELECT s FROM p) GROUP BY c) SELECT round((SELECT avg(CAST(t = s AS DOUBLE)) FROM p), 6) AS accuracy, round(avg(2 * tp / n_both), 6) AS macro_f1 FROM c")
def classifier_macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy and macro F1 of a rule against labels."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    found = E.macro_f1(rows.select(F.col("quality").cast("int").alias("truth"), (F.col("n_chars") >= 500).cast("int").alias("said")), "truth", "said")
    return found.select(F.round("accuracy", 6).alias("accuracy"), F.round("macro_f1", 6).alias("macro_f1"))


@query("SELECT array_to_string(list_filter([CASE WHEN text IS NULL OR trim(text) = '' THEN 'EMPTY' END, CASE WHEN n_chars > 2000 THEN 'LONG' END, CASE WHEN lang IS NULL THEN 'NO_LANG' END], lambda x: x IS NOT NULL), ',') AS issues, count(*) AS n FROM documents GROUP BY 1")
def truth_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the rules that they break."""
    flags = E.issue_flags({"EMPTY": F.trim(F.coalesce("text", F.lit(""))) == "", "LONG": F.col("n_chars") > 2000, "NO_LANG": F.col("lang").isNull()})
    return table(spark, sf_dir, "documents").groupBy(F.array_join(flags, ",").alias("issues")).agg(F.count("*").alias("n"))


@query("WITH c AS (SELECT o_custkey % 50 AS run, count(*) AS total, count_if(o_orderstatus = 'F') AS done, count_if(o_orderstatus = 'F') * 2.5 AS s FROM orders WHERE o_custkey % 50 > 0 GROUP BY 1) SELECT run, CAST(floor(100 * done / total) AS BIGINT) AS percent, round(s / nullif(done, 0), 6) AS mean, round(s / nullif(done, 0) * (total - done), 6) AS rest FROM c")
def run_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far runs are, and how long they will take."""
    runs = table(spark, sf_dir, "orders").where("o_custkey % 50 > 0").groupBy((F.col("o_custkey") % 50).alias("run")).agg(F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("done"))
    told = runs.withColumn("p", E.progress(F.col("done"), F.col("total"), F.col("done") * 2.5))
    return told.select("run", F.col("p.percent").alias("percent"), F.round("p.mean", 6).alias("mean"), F.round("p.left", 6).alias("rest"))


@query("WITH r AS (SELECT l_orderkey AS run, l_linenumber AS c, l_quantity > 10 AS passed FROM lineitem WHERE l_linenumber < 4 OR l_orderkey % 3 > 0), n AS (SELECT run, count(*) AS n_run, count_if(passed) AS n_passed FROM r GROUP BY run), j AS (SELECT run, bool_or(r.c IS NULL) AS odd FROM (SELECT DISTINCT l_orderkey AS run, l_linenumber AS c FROM lineitem) k LEFT JOIN (SELECT DISTINCT run, c FROM r) r USING (run, c) GROUP BY run) SELECT run, coalesce(n_run, 0) AS n_run, coalesce(n_passed, 0) AS n_passed, coalesce(n_run - n_passed, 0) AS n_failed, NOT odd AS same_ids FROM j LEFT JOIN n USING (run)")
def run_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs' counts, and whether they ran all that was asked."""
    rows = table(spark, sf_dir, "lineitem")
    runs = rows.where("l_linenumber < 4 OR l_orderkey % 3 > 0").select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("case_id"), (F.col("l_quantity") > 10).alias("passed"))
    return E.run_payload(runs, rows.select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("case_id")), "run")


@query("SELECT stage, round(avg(ms), 2) AS mean, round(quantile_cont(ms, 0.5), 2) AS p50, round(quantile_cont(ms, 0.95), 2) AS p95 FROM (SELECT unnest(['tax', 'discount', 'quantity']) AS stage, unnest([CASE WHEN l_linenumber > 1 THEN l_tax * 1000 ELSE 0 END, l_discount * 1000, l_quantity]) AS ms FROM lineitem) GROUP BY stage")
def stage_latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and percentiles of three stages; what wasn't measured counts 0."""
    rows = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_linenumber") > 1, F.col("l_tax") * 1000).alias("tax"), (F.col("l_discount") * 1000).alias("discount"), F.col("l_quantity").alias("quantity"))
    return E.unpivoted_latency(rows, ["tax", "discount", "quantity"])


RANKED = StandIn("lineitem", {"query_id": "l_orderkey % 500", "doc_id": "l_partkey", "content": "l_suppkey % 3", "rnk": "l_linenumber + 7 * (l_partkey % 4)"})


@query(f"WITH w AS (SELECT query_id, doc_id, content, min(rnk) AS rank FROM {RANKED.sql} WHERE rnk <= 20 AND (doc_id % 3 > 0) GROUP BY ALL), n AS (SELECT *, count_if(rank <= 6) OVER (PARTITION BY query_id) AS near FROM w) SELECT query_id, doc_id, rank FROM n WHERE near < 30 OR rank <= 6")
def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieved documents that weren't expected, from further down where the top holds too few."""
    rows = RANKED.rows(spark, sf_dir).withColumnRenamed("rnk", "rank")
    expected = rows.where("doc_id % 3 = 0").select("query_id", "doc_id").distinct()
    return E.hard_negatives(rows, expected, enough=30)
