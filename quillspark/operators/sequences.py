"""Operators on ordered rows: gaps, islands, as-of, chunks, packing of parts, headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cluster_gaps(rows: DataFrame, by: str, at: Column, tie: str, gap: float) -> DataFrame:
    """`cluster` from 0 within `by`: a new one starts where the step from the row before exceeds `gap`."""
    order = Window.partitionBy(by).orderBy("_at", tie)
    steps = rows.withColumn("_at", at).withColumn("_new", (F.col("_at") - F.lag("_at").over(order) > gap).cast("int"))
    return steps.withColumn("cluster", F.coalesce(F.sum("_new").over(order), F.lit(0))).drop("_at", "_new")


def islands(rows: DataFrame, by: str, index: str) -> DataFrame:
    """(by, first, last, n) of maximal runs of consecutive indexes; repeated indexes count once."""
    order = Window.partitionBy(by).orderBy(index)
    marked = rows.select(by, index).distinct().withColumn("_island", F.col(index) - F.row_number().over(order))
    return marked.groupBy(by, "_island").agg(F.min(index).alias("first"), F.max(index).alias("last"), F.count("*").alias("n")).drop("_island")


def asof_last(rows: DataFrame, by: str, order: list[str], marker: Column, value: Column, name: str) -> DataFrame:
    """Each row with the value of the latest marker row at or before it within `by`; null before the first."""
    seen = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(F.when(marker, value), ignorenulls=True).over(seen))


def contiguous(rows: DataFrame, by: str, start: str, end: str, *ties: str) -> DataFrame:
    """Rows with `joined`: whether they start where the one before ends (true for the first)."""
    order = Window.partitionBy(by).orderBy(start, end, *ties)
    return rows.withColumn("joined", F.coalesce(F.lag(end).over(order) == F.col(start), F.lit(True)))


def text_chunks(docs: DataFrame, id_col: str, text_col: str, size: int, overlap: int) -> DataFrame:
    """(id, chunk, start, length, content): windows of `size` characters, `size - overlap` apart, none for empty texts.

    The last chunk is the first that reaches the end.
    """
    n, step = F.length(text_col), size - overlap
    last = F.greatest(F.ceil((n - size) / step), F.lit(0)).cast("int")
    starts = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("chunk"), (i * step).alias("start")))
    rows = docs.where(n > 0).select(F.col(id_col), F.col(text_col).alias("_text"), F.explode(starts).alias("c")).select(id_col, "_text", "c.*")
    content = F.substring(F.col("_text"), F.col("start") + 1, F.lit(size))
    return rows.select(id_col, "chunk", "start", F.length(content).alias("length"), content.alias("content"))


def pack_parts(parts: Column, limit: int) -> Column:
    """Consecutive texts joined by line ends into packs of at most `limit` characters; a longer text is a pack of its own."""

    def put(packs: Column, part: Column) -> Column:
        last = F.try_element_at(packs, F.lit(-1))
        joined = F.concat(last, F.lit("\n"), part)
        return F.when(F.coalesce(F.length(joined) <= limit, F.lit(False)), F.concat(F.slice(packs, F.lit(1), F.size(packs) - 1), F.array(joined))).otherwise(F.concat(packs, F.array(part)))

    return F.aggregate(parts, F.array().cast("array<string>"), put)


def repeated_margins(lines: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """(doc, text) of lines, digits as #, on at least six tenths of a document's pages and on two."""
    plain = F.regexp_replace(text, r"\d", "#")
    pages = lines.groupBy(doc).agg(F.count_distinct(page).alias("_pages"))
    often = lines.groupBy(doc, plain.alias(text)).agg(F.count_distinct(page).alias("_on"))
    return often.join(pages, doc).where(F.col("_on") >= F.greatest(F.lit(2), F.ceil(0.6 * F.col("_pages")))).select(doc, text)
