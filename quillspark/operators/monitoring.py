"""Aggregates over runs, stages and days."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def kst_day(ts: Column) -> Column:
    """The Korean day of a UTC time without zone."""
    return F.to_date(ts + F.expr("INTERVAL 9 HOURS"))


def date_spine(spark, start: date, end: date) -> DataFrame:
    """A row `day` for each day from start to end, both included."""
    if end < start or (end - start).days > 366:
        raise ValueError("the range must not be reversed or longer than 366 days")
    return spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("day"))


def latency(rows: DataFrame, by: str, value: str, accuracy: int | None = None) -> DataFrame:
    """Mean, interpolated p50 and p95 and nearest-rank p95 per group; nulls don't count.

    Exact percentiles hold a group's distinct values; `accuracy` takes bounded sketches instead.
    """
    if accuracy:
        p50, p95 = (F.percentile_approx(value, p, accuracy) for p in (0.5, 0.95))
        return rows.groupBy(by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), p50.alias("p50"), p95.alias("p95"), p95.alias("p95_nearest"))
    nearest = F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY `{value}`)")
    return rows.groupBy(by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.percentile(value, 0.5).alias("p50"), F.percentile(value, 0.95).alias("p95"), nearest.alias("p95_nearest"))


def daily_kpis(rows: DataFrame, spine: DataFrame, day: Column, failed: Column, value: str) -> DataFrame:
    """Per day of the spine: items, failures, success rate and mean value (null on days without rows)."""
    found = rows.groupBy(day.alias("day")).agg(F.count("*").alias("items"), F.count_if(failed).alias("failures"), F.avg(value).alias("mean_value"))
    return spine.join(found, "day", "left").select("day", F.coalesce("items", F.lit(0)).alias("items"), F.coalesce("failures", F.lit(0)).alias("failures"), (1 - F.try_divide("failures", "items")).alias("success_rate"), "mean_value")


def compare_periods(rows: DataFrame, day: Column, start: date, end: date, by: str, value: str) -> DataFrame:
    """Per group, count and mean in [start, end] and in the equally long period before; one scan tags both."""
    before = start - timedelta(days=(end - start).days + 1)
    period = F.when(day >= F.lit(start), "now").otherwise("before")
    now, then = F.col("period") == "now", F.col("period") == "before"
    tagged = rows.where((day >= F.lit(before)) & (day <= F.lit(end))).withColumn("period", period)
    mean = lambda which: F.avg(F.when(which, F.col(value)))
    return tagged.groupBy(by).agg(F.count_if(now).alias("n_now"), F.count_if(then).alias("n_before"), mean(now).alias("mean_now"), mean(then).alias("mean_before"), (mean(now) - mean(then)).alias("change"))


def distribution(rows: DataFrame, by: str) -> DataFrame:
    """Counts of values, their share of all rows, and rank by count, then value."""
    counts = rows.groupBy(by).agg(F.count("*").alias("n"))
    every = Window.partitionBy()
    return counts.select(by, "n", (F.col("n") / F.sum("n").over(every)).alias("share"), F.row_number().over(every.orderBy(F.desc("n"), by)).alias("rank"))


def run_summary(rows: DataFrame, by: str, value: str, single: str) -> DataFrame:
    """Mean without nulls, and the one value of `single` in a group: null if there are several, a null among them included."""
    one = F.when((F.count_distinct(single) == 1) & (F.count(single) == F.count("*")), F.min(single))
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), one.alias("only"))


def zero_filled(rows: DataFrame, domain: DataFrame, by: str) -> DataFrame:
    """Counts for every value of the domain, 0 where there is none."""
    counts = rows.groupBy(by).agg(F.count("*").alias("n"))
    return domain.join(counts, by, "left").select(by, F.coalesce("n", F.lit(0)).alias("n"))


def largest_remainder(counts: DataFrame, key: str, n: str, total: int = 1000) -> DataFrame:
    """`total` units dealt in proportion to n: floors first, what is left by largest remainder, then key."""
    every = Window.partitionBy()
    exact = counts.withColumn("_all", F.sum(n).over(every)).withColumn("_num", F.col(n) * total)
    floors = exact.withColumn("_floor", F.floor(F.col("_num") / F.col("_all"))).withColumn("_rest", F.col("_num") - F.col("_floor") * F.col("_all"))
    order = floors.withColumn("_rank", F.row_number().over(every.orderBy(F.desc("_rest"), key))).withColumn("_left", total - F.sum("_floor").over(every))
    return order.select(key, n, (F.col("_floor") + (F.col("_rank") <= F.col("_left")).cast("long")).alias("units"))


def threshold_sweep(rows: DataFrame, score: str, good: str, thresholds: list[float]) -> DataFrame:
    """Per threshold: rows at or over it, their share of all, and accuracy among them (null if none).  One pass, no join."""
    levels = F.array(*[F.lit(t) for t in thresholds])
    each = rows.select(F.col(score).alias("_s"), F.col(good).alias("_g"), F.explode(levels).alias("threshold"))
    over = F.col("_s") >= F.col("threshold")
    return each.groupBy("threshold").agg(F.count_if(over).alias("accepted"), (F.count_if(over) / F.count("*")).alias("coverage"), F.avg(F.when(over, F.col("_g").cast("double"))).alias("accuracy"))


def length_stats(rows: DataFrame, by: str, text: str, over: int) -> DataFrame:
    """Least, largest, mean and median length, and how many texts exceed `over`."""
    n = F.length(text)
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.min(n).alias("least"), F.max(n).alias("largest"), F.avg(n).alias("mean"), F.median(n).alias("median"), F.count_if(n > over).alias("n_over"))
