"""Tables without borders: columns are places that repeat from row to row."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.lines import LineRule, visual_lines

#: Rows of such tables are found like lines, by the mean of their middles, within a distance that the page gives.
ROWS = LineRule(look_back=3, share=0.0, middle="mean", by_top=False)
# Rows that a column and a table need, columns of a table, and the gap that ends one, in usual gaps.
LEAST_ROWS, LEAST_COLUMNS, MOST_COLUMNS, WIDE_GAP = 3, 2, 12, 1.5


def borderless_tables(cells: DataFrame) -> DataFrame:
    """(page, row, column, text) of the table on each page of cells (page, cell, text, x0, y0, x1, y1); pages without one have no rows.

    Rows are lines of two cells or more.  Places of cells a gap apart are columns if three rows have a cell there; of
    columns set apart by a gap far over the usual the group with most cells counts.  Two to twelve columns
    and three rows with two of them make a table.  Cells far from every column are left out, and
    several at one place are joined from left to right.  Pages are dealt out once before the lines are found and once
    after; all else is done where they lie.  A column's cells on a page are held together, a page's aren't.
    """
    boxed = cells.where("page IS NOT NULL AND x1 IS NOT NULL AND y1 IS NOT NULL AND x0 IS NOT NULL AND y0 IS NOT NULL").select("page", "cell", F.trim(F.coalesce("text", F.lit(""))).alias("text"), "x0", "y0", "x1", "y1")
    boxed = boxed.withColumns({"h": F.greatest(F.lit(1.0), F.col("y1") - F.col("y0")), "x": (F.col("x0") + F.col("x1")) / 2})
    page, line, group = (Window.partitionBy(*by) for by in (("page",), ("page", "line"), ("page", "_g")))
    boxed = boxed.withColumn("near", F.greatest(F.lit(6.0), F.floor(F.median("h").over(page) * 0.65).cast("double")))
    lined = visual_lines(boxed, "page", "cell", replace(ROWS, within="near"), keep=("page", "cell", "text", "x0", "h", "x")).repartition("page")
    rows = lined.withColumn("_n", F.count("*").over(line)).where("_n >= 2").withColumns({"wide": F.greatest(F.lit(12.0), F.floor(F.median("h").over(page) * 1.8).cast("double")), "_at": F.bround("x")})

    order = page.orderBy("_at")
    steps = rows.select("page", "line", "cell", "text", "x0", "x", "wide", "_at", F.coalesce((F.col("_at") - F.lag("_at").over(order) > F.col("wide")).cast("int"), F.lit(0)).alias("_new"))
    groups = steps.withColumn("_g", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # Groups lie over `wide` apart, and both are whole numbers: no cell is within `wide` of another group's anchor.
    meets = groups.withColumn("anchor", F.bround(F.avg("_at").over(group))).where(F.abs(F.col("x") - F.col("anchor")) <= F.col("wide"))
    each = F.struct("x0", "cell", "text")
    filled = meets.groupBy("page", "_g", "anchor", "line").agg(F.array_join(F.filter(F.transform(F.array_sort(F.collect_set(each)), lambda s: s["text"]), lambda t: t != ""), " ").alias("text"))
    often = filled.groupBy("page", "_g", "anchor").agg(F.count("*").alias("hits"), F.collect_list(F.struct("line", "text")).alias("_cells")).where(F.col("hits") >= LEAST_ROWS)

    across, part = page.orderBy("anchor"), Window.partitionBy("page", "_part")
    gaps = often.withColumn("_gap", F.col("anchor") - F.lag("anchor").over(across))
    typical = gaps.withColumns({"_typical": F.median("_gap").over(page), "_columns": F.count("*").over(page)})
    parted = typical.withColumn("_part", F.sum(F.coalesce(((F.col("_columns") >= 3) & (F.col("_typical") > 0) & (F.col("_gap") > WIDE_GAP * F.col("_typical"))).cast("int"), F.lit(0))).over(across))
    sizes = parted.withColumns({"_size": F.count("*").over(part), "_hits": F.sum("hits").over(part)})
    viable = sizes.withColumn("_best", -F.max(F.when(F.col("_size") >= 2, F.struct("_hits", (-F.col("_part")).alias("_first")))).over(page)["_first"])
    chosen = viable.where(F.col("_best").isNull() | (F.col("_part") == F.col("_best")))
    columns = chosen.withColumns({"column": F.row_number().over(across), "_all": F.count("*").over(page)}).where(F.col("_all").between(LEAST_COLUMNS, MOST_COLUMNS))

    kept = columns.select("page", "column", F.inline("_cells")).withColumn("_used", F.count("*").over(line)).where("_used >= 2")
    said = F.when(F.col("text") != "", F.col("column"))
    numbered = kept.withColumn("row", F.dense_rank().over(page.orderBy("line")))
    whole = numbered.withColumns({"_rows": F.max("row").over(page), "_several": F.min(said).over(page) < F.max(said).over(page)}).where((F.col("_rows") >= LEAST_ROWS) & F.col("_several"))
    return whole.select("page", "row", "column", "text")
