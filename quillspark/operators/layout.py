"""Rows with places on pages: boxes, containment, anchors, bands, headings, gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BOX = ("x0", "y0", "x1", "y1")


def box_of(points: Column) -> Column:
    """Struct x0, y0, x1, y1 around an array of points (arrays of x and y); null without points."""
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return F.when(F.size(points) > 0, F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1")))


def centre(box: Column) -> Column:
    """Struct x, y of a box's middle."""
    return F.struct(((box["x0"] + box["x1"]) / 2).alias("x"), ((box["y0"] + box["y1"]) / 2).alias("y"))


def covered(box: Column, reference: Column) -> Column:
    """Share of the reference's area that the box covers; 0 where the reference has none."""
    wide = F.greatest(F.least(box["x1"], reference["x1"]) - F.greatest(box["x0"], reference["x0"]), F.lit(0.0))
    high = F.greatest(F.least(box["y1"], reference["y1"]) - F.greatest(box["y0"], reference["y0"]), F.lit(0.0))
    area = (reference["x1"] - reference["x0"]) * (reference["y1"] - reference["y0"])
    return F.when(area > 0, wide * high / area).otherwise(0.0)


def scaled(box: Column, sx: Column | float, sy: Column | float, dx: Column | float = 0.0, dy: Column | float = 0.0) -> Column:
    """A box in other coordinates: each place times a factor, and moved."""
    return F.struct(*[(box[c] * (sx if c[0] == "x" else sy) + (dx if c[0] == "x" else dy)).alias(c) for c in BOX])


def inside(items: DataFrame, areas: DataFrame, page: str) -> DataFrame:
    """Items (page, item, x, y) with the area (page, area, x0..y1) that holds their point, the first by name; null outside all."""
    held = (F.col("x").between(F.col("x0"), F.col("x1"))) & (F.col("y").between(F.col("y0"), F.col("y1")))
    found = items.join(areas, page).where(held).groupBy(page, "item").agg(F.min("area").alias("area"))
    return items.join(found, [page, "item"], "left").select(page, "item", "area")


def nearest_anchor(cells: DataFrame, anchors: DataFrame, page: str, tolerance: float) -> DataFrame:
    """Cells (page, cell, x) with the nearest anchor (page, anchor, x) within the tolerance, the lower name of equals; null beyond."""
    away = F.abs(F.col("x") - F.col("_x"))
    joined = cells.join(anchors.withColumnRenamed("x", "_x"), page).where(away <= tolerance)
    best = joined.groupBy(page, "cell").agg(F.min(F.struct(away.alias("away"), F.col("anchor"))).alias("b"))
    return cells.join(best, [page, "cell"], "left").select(page, "cell", F.col("b.anchor").alias("anchor"))


def band_match(names: DataFrame, numbers: DataFrame, page: str, above: float = 0.55, below: float = 1.4, margin: float = 0.12) -> DataFrame:
    """Names (page, name, y, h) with the number row (page, number, y) nearest to them in their band; null where the two nearest are too alike.

    A band reaches `above` heights over a name and `below` under it; distances are in heights.
    """
    step = (F.col("_y") - F.col("y")) / F.col("h")
    joined = names.join(numbers.withColumnRenamed("y", "_y"), page).where((step >= -above) & (step <= below))
    near = joined.groupBy(page, "name").agg(F.slice(F.array_sort(F.collect_list(F.struct(F.abs(step).alias("d"), F.col("number").alias("n")))), 1, 2).alias("two"))
    clear = (F.size("two") == 1) | (F.try_element_at("two", F.lit(2))["d"] - F.col("two")[0]["d"] >= margin)
    return names.join(near, [page, "name"], "left").select(page, "name", F.when(clear, F.col("two")[0]["n"]).alias("number"))


def heading_path(rows: DataFrame, by: str, order: str, level: str, title: str, levels: int = 4) -> DataFrame:
    """Rows with `path`: the titles in force, outermost first; a heading ends those of its own and deeper levels."""
    seen = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    marked = rows
    for k in range(1, levels + 1):
        at = F.when(F.col(level) == k, F.struct(F.col(order).alias("at"), F.col(title).alias("title")))
        marked = marked.withColumn(f"_h{k}", F.last(at, ignorenulls=True).over(seen))
    steps = []
    for k in range(1, levels + 1):
        above = [F.col(f"_h{j}.at") for j in range(1, k)]
        outer = F.greatest(*above) if len(above) > 1 else above[0] if above else F.lit(None)
        steps.append(F.when(F.col(f"_h{k}").isNotNull() & (F.coalesce(F.col(f"_h{k}.at") > outer, F.lit(True))), F.col(f"_h{k}.title")))
    return marked.withColumn("path", F.array_compact(F.array(*steps))).drop(*[f"_h{k}" for k in range(1, levels + 1)])


def wide_gaps(rows: DataFrame, by: str, at: str, tie: str, factor: float = 1.5) -> DataFrame:
    """Rows with gap to the next, and whether it exceeds `factor` times the median gap of the group."""
    order = Window.partitionBy(by).orderBy(at, tie)
    gaps = rows.withColumn("gap", F.lead(at).over(order) - F.col(at))
    middle = gaps.groupBy(by).agg(F.median("gap").alias("_median"))
    return gaps.join(middle, by).withColumn("split", F.coalesce(F.col("gap") > factor * F.col("_median"), F.lit(False))).drop("_median")


def neighbours(rows: DataFrame, by: str, order: str, text: str) -> DataFrame:
    """Rows with the texts before and after, the part's number from 1 and how many parts there are."""
    own = Window.partitionBy(by).orderBy(order)
    counts = rows.groupBy(by).agg(F.count("*").alias("parts"))
    return rows.withColumns({"before": F.lag(text).over(own), "after": F.lead(text).over(own), "part": F.row_number().over(own)}).join(counts, by)


def skew(headers: DataFrame, page: str) -> DataFrame:
    """(page, slope): median slope between a page's neighbouring header cells (page, x, y), 0 where there is but one."""
    own = Window.partitionBy(page).orderBy("x", "y")
    steps = headers.withColumns({"_dx": F.col("x") - F.lag("x").over(own), "_dy": F.col("y") - F.lag("y").over(own)})
    return steps.groupBy(page).agg(F.coalesce(F.median(F.when(F.col("_dx") > 0, F.col("_dy") / F.col("_dx"))), F.lit(0.0)).alias("slope"))


def two_columns(boxes: DataFrame, page: str, width: str, share: float = 0.025, least: float = 8.0) -> DataFrame:
    """Boxes (page, item, x0, x1, y0) with `place` in reading order, by two columns where a page has them.

    A page has two if at least four boxes are on it and two lie wholly on either side of a
    gutter around its middle.  Boxes across the gutter that stand over all column boxes come
    first, then left, right, and what is left.
    """
    gutter = F.greatest(F.col(width) * share, F.lit(least)) / 2
    side = F.when(F.col("x1") <= F.col(width) / 2 - gutter, 1).when(F.col("x0") >= F.col(width) / 2 + gutter, 2).otherwise(0)
    sided = boxes.withColumn("_side", side)
    pages = sided.groupBy(page).agg(F.count("*").alias("_n"), F.count_if(F.col("_side") == 1).alias("_l"), F.count_if(F.col("_side") == 2).alias("_r"), F.min(F.when(F.col("_side") > 0, F.col("y0"))).alias("_top"))
    two = (F.col("_n") >= 4) & (F.col("_l") >= 2) & (F.col("_r") >= 2)
    group = F.when(~two, 0).when((F.col("_side") == 0) & (F.col("y0") < F.col("_top")), 0).when(F.col("_side") == 0, 3).otherwise(F.col("_side"))
    own = Window.partitionBy(page).orderBy("_group", "y0", "x0", "item")
    return sided.join(pages, page).withColumn("_group", group).withColumn("place", F.row_number().over(own)).withColumn("two_columns", two).drop("_side", "_n", "_l", "_r", "_top", "_group")


def propagate_labels(cells: DataFrame, row: str, order: str, sensitive: Column, label: Column, direct: Column) -> DataFrame:
    """Cells with `hidden`: those with private data themselves, and those after a sensitive label until the next label."""
    seen = Window.partitionBy(row).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(label | sensitive, sensitive), ignorenulls=True).over(seen)
    return cells.withColumn("hidden", F.coalesce(direct, F.lit(False)) | (sensitive & ~label) | (F.coalesce(last, F.lit(False)) & ~label))


def structure_faults(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row with a count of rows for each rule that is broken; a sound table has zeros only."""
    return rows.agg(*[F.count_if(F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()])
