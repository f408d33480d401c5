"""Summaries of evaluation runs: receipts, retrieval, answers, usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mean_or_zero(value: Column, where: Column | None = None) -> Column:
    """Mean of the rows where a condition holds, nulls apart; 0 if there are none."""
    return F.coalesce(F.avg(F.when(where, value) if where is not None else value), F.lit(0.0))


def batch_summary(items: DataFrame, by: str) -> DataFrame:
    """Per batch: requested, completed and failed items, accuracies, rates, latencies and the final score.

    `items` has status, field_accuracy, complete_match, schema_rate, total_correct, latency_ms
    and extraction_score.  Accuracies and rates look at completed items; latencies that aren't
    positive don't count; processing time sums all rows.
    """
    done = F.col("status") == "COMPLETED"
    timed = F.when(done & (F.col("latency_ms") > 0), F.col("latency_ms"))
    found = items.withColumn("_timed", timed).groupBy(by).agg(
        F.count("*").alias("requested"),
        F.count_if(done).alias("completed"),
        mean_or_zero(F.col("field_accuracy"), done).alias("field_accuracy"),
        mean_or_zero(F.col("complete_match").cast("double"), done).alias("complete_match_rate"),
        F.avg(F.when(done, F.col("schema_rate"))).alias("schema_rate"),
        F.avg(F.when(done, F.col("total_correct").cast("double"))).alias("total_accuracy"),
        F.avg("_timed").alias("_mean"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY _timed)").alias("p95_ms"),
        F.sum("latency_ms").alias("total_ms"),
        F.avg(F.when(done, F.col("extraction_score"))).alias("extraction_score"),
    )
    points = F.greatest(F.lit(0.0), F.least(F.lit(3.0), (120 - F.col("_mean") / 1000) / 30))
    speed = F.when(F.col("_mean").isNull(), 0.0).when(F.col("p95_ms") > 180_000, F.least(points, F.lit(1.0))).otherwise(points)
    state = F.when((F.col("requested") > 0) & (F.col("completed") == F.col("requested")), "COMPLETED").when(F.col("completed") == 0, "FAILED").otherwise("PARTIAL")
    passed = F.coalesce((F.col("schema_rate") >= 0.98) & (F.col("total_accuracy") >= 0.95), F.lit(False))
    return found.select(
        by, "requested", "completed", (F.col("requested") - F.col("completed")).alias("failed"), "field_accuracy", "complete_match_rate", "schema_rate", "total_accuracy", F.round("_mean").cast("long").alias("mean_ms"), "p95_ms", "total_ms",
        speed.alias("speed"), (F.coalesce("extraction_score", F.lit(0.0)) + speed + F.when(F.col("completed") > 0, 2.0).otherwise(0.0)).alias("final_score"), state.alias("state"), passed.alias("gate"),
    )


def field_accuracy(details: DataFrame, field: str, correct: str) -> DataFrame:
    """(field, n, errors, accuracy, place): least accurate last, equals by name."""
    found = details.groupBy(field).agg(F.count("*").alias("n"), F.count_if(~F.col(correct)).alias("errors"), F.avg(F.col(correct).cast("double")).alias("accuracy"))
    return found.withColumn("place", F.row_number().over(Window.orderBy(F.desc("accuracy"), field)))


def stage_counts(items: DataFrame, stage: str, stages: tuple[str, ...]) -> DataFrame:
    """(stage, n) for every stage, zeros included, and UNREGISTERED for other or no stages if there are any."""
    named = F.when(F.col(stage).isin(*stages), F.col(stage)).otherwise("UNREGISTERED")
    domain = items.sparkSession.createDataFrame([(s,) for s in (*stages, "UNREGISTERED")], f"{stage} string")
    counts = items.groupBy(named.alias(stage)).agg(F.count("*").alias("n"))
    return domain.join(counts, stage, "left").select(stage, F.coalesce("n", F.lit(0)).alias("n")).where(f"n > 0 OR {stage} <> 'UNREGISTERED'")


def automation(rows: DataFrame, decision: str, reasons: str) -> DataFrame:
    """(kind, code, n): rows by decision, and rows by each of their distinct reasons."""
    decided = rows.groupBy(F.lit("decision").alias("kind"), F.col(decision).alias("code")).agg(F.count("*").alias("n"))
    why = rows.select(F.explode(F.array_distinct(reasons)).alias("code")).groupBy(F.lit("reason").alias("kind"), "code").agg(F.count("*").alias("n"))
    return decided.unionByName(why)


def retrieval_summary(cases: DataFrame, depths: tuple[int, ...] = (1, 3, 4, 5)) -> DataFrame:
    """One row of means over cases (expected, retrieved, answerable, answer_correct, rejected, faithfulness, citation).

    Retrieval looks at cases that expect documents, answers at answerable ones, rejection at
    the others, citation and faithfulness at all; a mean over none is 0.
    """
    asked = F.size("expected") > 0
    hit = lambda got: F.arrays_overlap("expected", got).cast("double")
    first = F.array_position(F.transform("retrieved", lambda d: F.array_contains("expected", d)), True)
    return cases.agg(
        F.count("*").alias("total"),
        F.count_if(asked).alias("evaluated"),
        *[mean_or_zero(F.coalesce(hit(F.slice("retrieved", 1, k)), F.lit(0.0)), asked).alias(f"hit_at_{k}") for k in depths],
        mean_or_zero(F.size(F.array_intersect("expected", "retrieved")) / F.size("expected"), asked).alias("recall"),
        mean_or_zero(F.coalesce(1 / F.nullif(first, F.lit(0)), F.lit(0.0)), asked).alias("mrr"),
        mean_or_zero(F.col("answer_correct").cast("double"), F.col("answerable")).alias("answer_accuracy"),
        mean_or_zero(F.col("rejected").cast("double"), ~F.col("answerable")).alias("rejection_rate"),
        mean_or_zero(F.col("citation")).alias("citation_accuracy"),
        mean_or_zero(F.col("faithfulness")).alias("faithfulness"),
        mean_or_zero(1 - F.col("faithfulness")).alias("hallucination_rate"),
    )


def answer_final(rows: DataFrame, by: str) -> DataFrame:
    """(by, accuracy, faithfulness, relevancy, no_answer, final): means, those over no rows 0, weighted 40, 25, 20 and 15."""
    answerable = F.col("answerable")
    means = rows.groupBy(by).agg(
        mean_or_zero(F.col("correct").cast("double"), answerable).alias("accuracy"), mean_or_zero(F.col("faithfulness")).alias("faithfulness"), mean_or_zero(F.col("relevancy"), answerable).alias("relevancy"), mean_or_zero(F.col("rejected").cast("double"), ~answerable).alias("no_answer")
    )
    return means.withColumn("final", F.round(100 * (0.40 * F.col("accuracy") + 0.25 * F.col("faithfulness") + 0.20 * F.col("relevancy") + 0.15 * F.col("no_answer")), 1))


def by_question_type(rows: DataFrame, kind: str, order: tuple[str, ...]) -> DataFrame:
    """(kind, n, accuracy, hit, mrr, place): nulls apart in each mean, types in the given order, others after by name."""
    found = rows.groupBy(kind).agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy"), F.avg(F.col("hit").cast("double")).alias("hit"), F.avg("rr").alias("mrr"))
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col(kind)), F.lit(0)), F.lit(len(order) + 1))
    return found.withColumn("place", F.row_number().over(Window.orderBy(rank, kind)))


def response_kind(rejected: Column, correct: Column) -> Column:
    """rejected before all, then correct, incorrect, or unknown where correctness is null."""
    return F.when(F.coalesce(rejected, F.lit(False)), "rejected").when(correct, "correct").when(~correct, "incorrect").otherwise("unknown")


def usage_report(rows: DataFrame, spine: DataFrame, day: Column, source: str, sources: tuple[str, ...]) -> DataFrame:
    """Per day of the spine, a column of counts for each source; zeros where there is nothing."""
    counts = rows.groupBy(day.alias("day")).agg(*[F.count_if(F.col(source) == s).alias(s) for s in sources])
    return spine.join(counts, "day", "left").select("day", *[F.coalesce(s, F.lit(0)).alias(s) for s in sources])


def worst(rows: DataFrame, by: str | None, score: str, tie: str, n: int) -> DataFrame:
    """The n rows of least score, in each group if `by` is given, with their place."""
    if by is None:
        return rows.orderBy(score, tie).limit(n).withColumn("place", F.row_number().over(Window.orderBy(score, tie)))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(score, tie))).where(F.col("place") <= n)


def impact(evidence: Column, correct: Column) -> Column:
    """What a reading did to an answer: evidence there or not, answer right or not."""
    return F.when(evidence & correct, "SUPPORTED").when(evidence & ~correct, "ANSWER_ERROR").when(~evidence & correct, "INFERRED").when(~evidence & ~correct, "READING_ERROR").otherwise("UNKNOWN")


def before_after(rows: DataFrame, by: str, before: str, after: str) -> DataFrame:
    """(by, fixed, regressed, delta): what became right, what became wrong, and the change of the mean."""
    b, a = F.col(before), F.col(after)
    return rows.groupBy(by).agg(F.count_if(~b & a).alias("fixed"), F.count_if(b & ~a).alias("regressed"), (F.avg(a.cast("double")) - F.avg(b.cast("double"))).alias("delta"))


def gate_counts(rows: DataFrame, score: Column, least: float) -> DataFrame:
    """(answerable, accepted, n): what a gate lets through."""
    return rows.groupBy("answerable", (score >= least).alias("accepted")).agg(F.count("*").alias("n"))


def macro_f1(rows: DataFrame, truth: str, said: str) -> DataFrame:
    """One row: accuracy, and the mean over all classes of the F1 of each."""
    pairs = rows.groupBy(truth, said).agg(F.count("*").alias("n"))
    each = pairs.select(F.explode(F.array(F.struct(F.col(truth).alias("c"), F.lit("t").alias("side")), F.struct(F.col(said).alias("c"), F.lit("s").alias("side")))).alias("e"), (F.col(truth) == F.col(said)).alias("same"), "n")
    by = each.groupBy("e.c").agg(F.sum(F.when((F.col("e.side") == "t") & F.col("same"), F.col("n")).otherwise(0)).alias("tp"), F.sum("n").alias("both"))
    right = pairs.agg((F.sum(F.when(F.col(truth) == F.col(said), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    return right.crossJoin(by.agg(F.avg(2 * F.col("tp") / F.col("both")).alias("macro_f1")))


def issue_flags(rules: dict[str, Column]) -> Column:
    """Codes of the rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(rule, code) for code, rule in rules.items()]))


def progress(done: Column, total: Column, seconds: Column) -> Column:
    """Struct of percent, mean seconds a case and seconds left; null means until a case is done."""
    mean = F.try_divide(seconds, done)
    return F.struct(F.floor(100 * F.try_divide(done, total)).alias("percent"), mean.alias("mean"), (mean * (total - done)).alias("left"))


def run_payload(runs: DataFrame, cases: DataFrame, key: str) -> DataFrame:
    """(key, n_run, n_passed, n_failed, same_ids): counts of a run's cases, and whether it ran exactly the cases asked."""
    counts = runs.groupBy(key).agg(F.count("*").alias("n_run"), F.count_if("passed").alias("n_passed"))
    pairs = runs.select(key, "case_id", F.lit(1).alias("r"), F.lit(0).alias("c")).unionByName(cases.select(key, "case_id", F.lit(0).alias("r"), F.lit(1).alias("c")))
    odd = pairs.groupBy(key, "case_id").agg(F.max("r").alias("r"), F.max("c").alias("c")).groupBy(key).agg(F.count_if(F.col("r") != F.col("c")).alias("odd"))
    return odd.join(counts, key, "left").select(key, F.coalesce("n_run", F.lit(0)).alias("n_run"), F.coalesce("n_passed", F.lit(0)).alias("n_passed"), (F.coalesce("n_run", F.lit(0)) - F.coalesce("n_passed", F.lit(0))).alias("n_failed"), (F.col("odd") == 0).alias("same_ids"))


def unpivoted_latency(rows: DataFrame, stages: list[str]) -> DataFrame:
    """(stage, mean, p50, p95) of columns of milliseconds; a null counts 0, percentiles are interpolated."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), F.coalesce(F.col(s), F.lit(0.0)).alias("ms")) for s in stages])).alias("x")).select("x.*")
    return long.groupBy("stage").agg(F.round(F.avg("ms"), 2).alias("mean"), F.round(F.percentile("ms", 0.5), 2).alias("p50"), F.round(F.percentile("ms", 0.95), 2).alias("p95"))


def hard_negatives(ranked: DataFrame, expected: DataFrame, first: int = 6, wider: int = 20, enough: int = 3) -> DataFrame:
    """(query_id, doc_id, rank) of retrieved documents that aren't expected: of the first few, or of the wider list where those hold too few.

    Equal contents of a document count once, at their best rank.
    """
    wrong = ranked.where(F.col("rank") <= wider).join(expected, ["query_id", "doc_id"], "left_anti")
    once = wrong.groupBy("query_id", "doc_id", "content").agg(F.min("rank").alias("rank"))
    near = F.count_if(F.col("rank") <= first).over(Window.partitionBy("query_id"))
    return once.withColumn("_near", near).where((F.col("_near") < enough) | (F.col("rank") <= first)).select("query_id", "doc_id", "rank")
