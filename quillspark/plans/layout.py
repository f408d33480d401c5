"""Layout operators as queries: an order is a page, its lines are cells with places made of their numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import layout as G
from quillspark.operators import sequences as S
from quillspark.plans.registry import StandIn, query

CELLS = StandIn(
    "lineitem",
    {
        "page": "l_orderkey", "item": "l_partkey * 10 + l_linenumber", "x": "cast(l_quantity as double)", "y": "cast(l_linenumber * 10 + l_suppkey % 7 as double)", "h": "cast(8 + l_suppkey % 3 as double)", "level": "CASE WHEN l_partkey % 3 = 0 THEN l_suppkey % 4 + 1 END", "title": "'T' || cast(l_partkey as string)",
        "x0": "cast(l_quantity as double)", "x1": "cast(l_quantity + 10 + l_suppkey % 20 as double)", "y0": "cast(l_linenumber as double)", "y1": "cast(l_linenumber + 2 as double)", "pos": "l_partkey * 100000 + l_suppkey * 10 + l_linenumber",
    },
)
AREAS = StandIn("orders", {"page": "o_orderkey", "area": "'a' || cast(o_custkey % 3 as string)", "x0": "cast(o_custkey % 20 as double)", "x1": "cast(o_custkey % 20 + 15 as double)", "y0": "cast(o_custkey % 30 as double)", "y1": "cast(o_custkey % 30 + 25 as double)"})


@query(f"SELECT page, item, CASE WHEN x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 THEN area END AS area FROM (SELECT page, item, max(x) AS x, max(y) AS y FROM {CELLS.sql} GROUP BY ALL) LEFT JOIN {AREAS.sql} USING (page)")
def cells_in_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with the area of their page that holds their middle."""
    cells = CELLS.rows(spark, sf_dir).groupBy("page", "item").agg(F.max("x").alias("x"), F.max("y").alias("y"))
    return G.inside(cells, AREAS.rows(spark, sf_dir), "page")


@query(f"WITH c AS (SELECT DISTINCT page, item, x FROM {CELLS.sql}), a AS (SELECT page, item AS anchor, x AS ax FROM c WHERE item % 3 = 0), d AS (SELECT page, item, x, anchor, abs(x - ax) AS away FROM c LEFT JOIN a USING (page)) SELECT page, item AS cell, x, arg_min(anchor, struct_pack(w := away, n := anchor)) FILTER (away <= 12) AS anchor FROM d GROUP BY page, item, x")
def nearest_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with their nearest anchor within twelve."""
    cells = CELLS.rows(spark, sf_dir).select("page", F.col("item").alias("cell"), "x").distinct()
    anchors = cells.where("cell % 3 = 0").select("page", F.col("cell").alias("anchor"), "x")
    keyed = cells.withColumn("cell", F.struct("cell", "x"))
    return G.nearest_anchor(keyed, anchors, "page", 12.0).select("page", "cell.cell", "cell.x", "anchor")


@query(
    f"""WITH n AS (SELECT page, item AS name, max(y) AS y, max(h) AS h FROM {CELLS.sql} WHERE item % 2 = 0 GROUP BY ALL), m AS (SELECT page, item AS number, max(y) AS my FROM {CELLS.sql} WHERE item % 2 = 1 GROUP BY ALL),
d AS (SELECT page, name, list_sort(list(struct_pack(d := abs((my - y) / h), n := number)) FILTER (my IS NOT NULL AND (my - y) / h >= -0.55 AND (my - y) / h <= 1.4)) AS near FROM n LEFT JOIN m USING (page) GROUP BY page, name)
SELECT page, name, CASE WHEN len(near) = 1 OR near[2].d - near[1].d >= 0.12 THEN near[1].n END AS number FROM d"""
)
def band_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with the number row in their band, unless two are too alike."""
    rows = CELLS.rows(spark, sf_dir).groupBy("page", "item").agg(F.max("y").alias("y"), F.max("h").alias("h"))
    names, numbers = rows.where("item % 2 = 0").withColumnRenamed("item", "name"), rows.where("item % 2 = 1").select("page", F.col("item").alias("number"), "y")
    return G.band_match(names, numbers, "page")


@query(
    f"""WITH r AS (SELECT page, pos, {", ".join(f"last_value(CASE WHEN level = {k} THEN struct_pack(a := pos, t := title) END IGNORE NULLS) OVER w AS h{k}" for k in (1, 2, 3, 4))} FROM {CELLS.sql} WINDOW w AS (PARTITION BY page ORDER BY pos ROWS UNBOUNDED PRECEDING))
SELECT page, pos, list_filter([h1.t, CASE WHEN coalesce(h2.a > h1.a, true) THEN h2.t END, CASE WHEN coalesce(h3.a > greatest(h1.a, h2.a), true) THEN h3.t END, CASE WHEN coalesce(h4.a > greatest(h1.a, h2.a, h3.a), true) THEN h4.t END], lambda t: t IS NOT NULL) AS path FROM r""",
    joined=("path",),
)
def heading_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headings in force at each cell."""
    return G.heading_path(CELLS.rows(spark, sf_dir), "page", "pos", "level", "title").select("page", "pos", "path")


@query(f"WITH g AS (SELECT page, pos, y, lead(y) OVER (PARTITION BY page ORDER BY y, pos) - y AS gap FROM {CELLS.sql}), m AS (SELECT page, median(gap) AS mid FROM g GROUP BY page) SELECT page, pos, gap, coalesce(gap > 1.5 * mid, false) AS split FROM g JOIN m USING (page)")
def wide_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps between lines that are wider than usual on their page."""
    return G.wide_gaps(CELLS.rows(spark, sf_dir).select("page", "pos", "y"), "page", "y", "pos").select("page", "pos", "gap", "split")


@query(f"SELECT page, pos, lag(title) OVER w AS before, lead(title) OVER w AS after, row_number() OVER w AS part, count(*) OVER (PARTITION BY page) AS parts FROM {CELLS.sql} WINDOW w AS (PARTITION BY page ORDER BY pos)")
def part_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with the texts around them and their number."""
    return G.neighbours(CELLS.rows(spark, sf_dir).select("page", "pos", "title"), "page", "pos", "title").select("page", "pos", "before", "after", "part", "parts")


@query(f"SELECT page, pos, coalesce(lag(x1) OVER (PARTITION BY page ORDER BY x0, x1, pos) = x0, true) AS joined FROM {CELLS.sql}")
def contiguous_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether spans start where the one before ends."""
    return S.contiguous(CELLS.rows(spark, sf_dir).select("page", "pos", "x0", "x1"), "page", "x0", "x1", "pos").select("page", "pos", "joined")


@query(f"WITH s AS (SELECT page, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM {CELLS.sql} WINDOW w AS (PARTITION BY page ORDER BY x, y)) SELECT page, round(coalesce(median(dy / dx) FILTER (dx > 0), 0), 6) AS slope FROM s GROUP BY page")
def page_skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much pages' cells slope."""
    return G.skew(CELLS.rows(spark, sf_dir).select("page", "x", "y"), "page").withColumn("slope", F.round("slope", 6))


@query(
    f"""WITH b AS (SELECT *, CASE WHEN x1 <= 40 - 4 THEN 1 WHEN x0 >= 40 + 4 THEN 2 ELSE 0 END AS side FROM {CELLS.sql}), p AS (SELECT page, count(*) >= 4 AND count_if(side = 1) >= 2 AND count_if(side = 2) >= 2 AS two, min(y0) FILTER (side > 0) AS top FROM b GROUP BY page)
SELECT page, pos, two AS two_columns, row_number() OVER (PARTITION BY page ORDER BY CASE WHEN NOT two OR (side = 0 AND y0 < top) THEN 0 WHEN side = 0 THEN 3 ELSE side END, y0, x0, pos) AS place FROM b JOIN p USING (page)"""
)
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes in reading order, by columns where pages have two."""
    boxes = CELLS.rows(spark, sf_dir).select("page", F.col("pos").alias("item"), "x0", "x1", "y0", F.lit(80.0).alias("width"))
    return G.two_columns(boxes, "page", "width").select("page", F.col("item").alias("pos"), "two_columns", "place")


@query(
    f"""WITH b AS (SELECT page, pos, x0, y0, x1, y1, greatest(least(x1, 40) - greatest(x0, 20), 0) * greatest(least(y1, 5) - greatest(y0, 1), 0) / 80 AS share FROM {CELLS.sql})
SELECT page, pos, round(share, 6) AS share, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, round(x0 * 0.5 + 3, 6) AS sx, round(y1 * 2, 6) AS sy FROM b"""
)
def box_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes around points, their middles, their cover of a reference, and their places in other coordinates."""
    point = lambda x, y: F.array(F.col(x), F.col(y))
    box, reference = F.col("box"), F.struct(F.lit(20.0).alias("x0"), F.lit(1.0).alias("y0"), F.lit(40.0).alias("x1"), F.lit(5.0).alias("y1"))
    rows = CELLS.rows(spark, sf_dir).withColumn("box", G.box_of(F.array(point("x1", "y0"), point("x0", "y1"), point("x0", "y0"))))
    moved = G.scaled(box, 0.5, 2.0, 3.0)
    return rows.select("page", "pos", F.round(G.covered(box, reference), 6).alias("share"), G.centre(box)["x"].alias("cx"), G.centre(box)["y"].alias("cy"), F.round(moved["x0"], 6).alias("sx"), F.round(moved["y1"], 6).alias("sy"))


@query(
    f"""WITH c AS (SELECT page, pos, pos % 5 = 0 AS sensitive, pos % 5 < 2 AS label, pos % 11 = 0 AS direct FROM {CELLS.sql}), l AS (SELECT *, last_value(CASE WHEN label OR sensitive THEN sensitive END IGNORE NULLS) OVER (PARTITION BY page ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM c)
SELECT page, pos, direct OR (sensitive AND NOT label) OR (coalesce(last, false) AND NOT label) AS hidden FROM l"""
)
def hidden_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells hidden for private data, those after a sensitive label among them."""
    pos = F.col("pos")
    return G.propagate_labels(CELLS.rows(spark, sf_dir), "page", "pos", pos % 5 == 0, pos % 5 < 2, pos % 11 == 0).select("page", "pos", "hidden")


@query("SELECT count_if(l_quantity <= 0) AS empty, count_if(l_discount > 0.09) AS steep, count_if(l_shipdate IS NULL) AS undated, count_if(l_tax > l_discount) AS taxed FROM lineitem")
def structure_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows break each rule."""
    from quillspark.sources.tables import table

    rules = {"empty": F.col("l_quantity") <= 0, "steep": F.col("l_discount") > 0.09, "undated": F.col("l_shipdate").isNull(), "taxed": F.col("l_tax") > F.col("l_discount")}
    return G.structure_faults(table(spark, sf_dir, "lineitem"), rules)


@query("SELECT o_custkey AS doc, CAST(len(list_distinct(list(o_orderkey % 9))) AS BIGINT) AS pages, count(*) AS boxes, CAST(sum(o_orderkey % 4) AS BIGINT) AS tables FROM orders GROUP BY o_custkey")
def structure_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, boxes and tables of each document."""
    from quillspark.sources.tables import table

    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc")).agg(F.count_distinct(F.col("o_orderkey") % 9).alias("pages"), F.count("*").alias("boxes"), F.sum(F.col("o_orderkey") % 4).alias("tables"))


@query(f"WITH l AS (SELECT page % 400 AS doc, page % 7 AS sheet, regexp_replace(title, '[0-9]', '#', 'g') || CAST(item % 10 AS VARCHAR)[1:0] AS line FROM {CELLS.sql}), p AS (SELECT doc, count(DISTINCT sheet) AS n FROM l GROUP BY doc) SELECT doc, line FROM l JOIN p USING (doc) GROUP BY doc, line, n HAVING count(DISTINCT sheet) >= greatest(2, ceil(0.6 * n))")
def repeated_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that stand on most pages of their document, digits apart."""
    lines = CELLS.rows(spark, sf_dir).select((F.col("page") % 400).alias("doc"), (F.col("page") % 7).alias("sheet"), F.col("title").alias("line"))
    return S.repeated_margins(lines, "doc", "sheet", "line")
