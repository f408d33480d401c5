"""Chunk builders as queries: documents split exactly, customers' orders as statutes with chapters, pages' tables as lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import chunks as C
from quillspark.plans.registry import StandIn, query
from quillspark.sources.tables import table

TARGET, MOST = 500, 700


@query(f"SELECT doc_id, sha256(text) AS whole, CAST(length(text) AS BIGINT) AS length, true AS in_order, length(text) > {MOST} AS cut, true AS within, true AS full FROM documents WHERE text IS NOT NULL")
def exact_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the parts of each document are together: its text again, none over the limit, no two neighbours that could be one."""
    parts = C.exact_parts(table(spark, sf_dir, "documents"), "doc_id", "text", TARGET, MOST)
    held = parts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("part", "start", "length", "content"))).alias("p"))
    pairs = F.zip_with(F.slice("p", 1, F.size("p") - 1), F.slice("p", 2, F.size("p")), lambda a, b: (a["start"] + a["length"] == b["start"]) & ((a["length"] + b["length"] > TARGET) | (a["length"] > TARGET)))
    text = F.array_join(F.transform("p", lambda s: s["content"]), "")
    sizes = F.transform("p", lambda s: s["length"])
    one = F.size("p") == 1
    return held.select("doc_id", F.sha2(text, 256).alias("whole"), F.aggregate(sizes, F.lit(0).cast("long"), lambda s, n: s + n).alias("length"), (F.array_sort("p") == F.col("p")).alias("in_order"), (~one).alias("cut"), (F.array_max(sizes) <= MOST).alias("within"), (one | F.forall(pairs, lambda x: x)).alias("full"))


#: Lines of a customer's statute: a chapter for each order, sections, numbered clauses and plain sentences.
ORDERS = StandIn(
    "orders",
    {"customer": "o_custkey", "pos": "o_orderkey * 4", "line": "'제 ' || cast(o_orderkey % 40 + 1 as string) || CASE WHEN o_orderkey % 3 = 0 THEN ' 장 ' ELSE ' 절 ' END || o_orderpriority", "body": "'Order ' || cast(o_orderkey as string) || ' of ' || cast(cast(o_orderdate as date) as string) || ' stands at ' || cast(cast(floor(o_totalprice) as bigint) as string)", "clause": "cast(o_orderkey % 5 + 1 as string) || '.' || cast(o_orderkey % 3 + 1 as string) || ' Terms of ' || o_orderstatus", "rest": "'  ' || o_orderpriority || ' goods are sent first, and what is left of them follows when it can be had again  '"},
)
STEPS = (("line", 0), ("body", 1), ("clause", 2), ("rest", 3))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.array(*[F.struct((F.col("pos") + i).alias("pos"), F.col(c).alias("text")) for c, i in STEPS])
    # Dealt out by customer before four lines are made of each order: the fold needs no other shuffle.
    return ORDERS.rows(spark, sf_dir).repartition("customer").select("customer", F.inline(rows))


FOLD = f"""
WITH RECURSIVE raw AS ({" UNION ALL ".join(f"SELECT customer, pos + {i} AS pos, trim({c}) AS text FROM {ORDERS.sql}" for c, i in STEPS)}),
lines AS (SELECT *, CASE WHEN regexp_matches(text, '^제\\s*\\d+\\s*장') THEN 1 WHEN regexp_matches(text, '^제\\s*\\d+\\s*절') THEN 2 WHEN regexp_matches(text, '^\\d+\\.\\d+\\s+\\S') THEN 2 END AS level, row_number() OVER (PARTITION BY customer ORDER BY pos) AS i FROM raw),
pathed AS (SELECT *, last_value(CASE WHEN level = 1 THEN struct_pack(a := pos, t := text) END IGNORE NULLS) OVER w AS h1, last_value(CASE WHEN level = 2 THEN struct_pack(a := pos, t := text) END IGNORE NULLS) OVER w AS h2, last_value(CASE WHEN level IS NOT NULL THEN text END IGNORE NULLS) OVER w AS section, last_value(level IGNORE NULLS) OVER w AS deep FROM lines WINDOW w AS (PARTITION BY customer ORDER BY pos ROWS UNBOUNDED PRECEDING)),
fold AS (
SELECT customer, i, 0 AS chunk, length(text) + 1 AS size, CASE WHEN level IS NOT NULL THEN length(text) END AS head, false AS led FROM lines WHERE i = 1
UNION ALL
SELECT l.customer, l.i, CASE WHEN l.level IS NOT NULL OR f.size + length(l.text) > 100 THEN f.chunk + 1 ELSE f.chunk END,
  CASE WHEN l.level IS NOT NULL THEN 0 WHEN f.size + length(l.text) > 100 THEN CASE WHEN f.head IS NULL THEN 0 ELSE f.head + 6 END ELSE f.size END + length(l.text) + 1,
  CASE WHEN l.level IS NOT NULL THEN length(l.text) ELSE f.head END, CASE WHEN l.level IS NOT NULL THEN false WHEN f.size + length(l.text) > 100 THEN f.head IS NOT NULL ELSE f.led END
FROM fold f JOIN lines l ON l.customer = f.customer AND l.i = f.i + 1),
held AS (SELECT p.customer, f.chunk, min(p.pos) AS first, string_agg(p.text, chr(10) ORDER BY p.pos) AS body, bool_or(f.led) AS led FROM fold f JOIN pathed p ON p.customer = f.customer AND p.i = f.i GROUP BY p.customer, f.chunk),
told AS (SELECT h.*, p.section, p.deep AS level, list_filter([p.h1.t, CASE WHEN coalesce(p.h2.a > p.h1.a, true) THEN p.h2.t END], lambda t: t IS NOT NULL) AS path FROM held h JOIN pathed p ON p.customer = h.customer AND p.pos = h.first)
SELECT customer, chunk, section, path, level, '[문서 제목] Customer ' || customer || coalesce(chr(10) || '[섹션] ' || section, '') || CASE WHEN len(path) > 0 THEN chr(10) || '[장절항 경로] ' || array_to_string(path, ' > ') ELSE '' END || CASE WHEN led THEN chr(10) || '[섹션] ' || section ELSE '' END || chr(10) || body AS content FROM told
"""


@query(FOLD, joined=("path",))
def statute_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' statutes in chunks that never cross a heading and lead with where they stand."""
    return C.section_chunks(_lines(spark, sf_dir), "customer", "pos", "text", F.concat(F.lit("Customer "), F.col("customer").cast("string")), target=100)


#: Orders as tables: heads in row 1, of which the second and some others are blank, and a row for each line.
CELLS = """SELECT l_orderkey AS t, l_linenumber + 1 AS r, l_partkey, l_suppkey, l_quantity, l_returnflag FROM lineitem"""
COLUMNS = {1: "cast(l_partkey as string)", 2: "' ' || cast(l_suppkey as string) || ' '", 3: "CASE WHEN l_quantity > 25 THEN cast(cast(l_quantity as bigint) as string) ELSE ' ' END", 4: "l_returnflag"}
HEADS = {1: "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'Part' END", 2: "''", 3: "' Quantity '", 4: "o_orderstatus"}
_ROWS = "SELECT t, r, max(l_partkey) AS l_partkey, max(l_suppkey) AS l_suppkey, max(l_quantity) AS l_quantity, max(l_returnflag) AS l_returnflag FROM ({cells}) GROUP BY t, r"


@query(
    f"""WITH rows_ AS ({_ROWS.format(cells=CELLS)}), cells AS ({" UNION ALL ".join(f"SELECT t, r, {k} AS c, trim({e}) AS v FROM rows_" for k, e in COLUMNS.items())} UNION ALL {" UNION ALL ".join(f"SELECT o_orderkey, 1, {k}, trim(coalesce({e}, '')) FROM orders" for k, e in HEADS.items())}),
heads AS (SELECT t, c, v AS h FROM cells WHERE r = 1 AND v <> ''), shape AS (SELECT t, max(r) AS n, max(c) AS m FROM cells GROUP BY t),
named AS (SELECT t, n, m, k, h FROM shape, unnest(range(1, m + 1)) AS u(k) LEFT JOIN (SELECT t AS ht, c AS hc, h FROM heads) ON ht = t AND hc = k)
SELECT t, 1 AS row, '[표 크기] 헤더 포함 ' || n || '행 × ' || m || '열' || chr(10) || '[표 테이블 열 컬럼명] ' || string_agg(CASE WHEN h IS NOT NULL THEN k || '열: ' || h WHEN k = 1 THEN '1열: 헤더 없음(행 구분)' ELSE k || '열: 헤더 없음' END, ' | ' ORDER BY k) AS content FROM named GROUP BY t, n, m
UNION ALL SELECT cells.t, r, '[표 행] ' || string_agg(CASE WHEN h IS NOT NULL THEN cells.c || '열(' || h || ')' WHEN cells.c = 1 THEN '1열(행 구분·헤더 없음)' ELSE cells.c || '열(헤더 없음)' END || ': ' || v, ' | ' ORDER BY cells.c) FROM cells LEFT JOIN heads ON heads.t = cells.t AND heads.c = cells.c WHERE r > 1 AND v <> '' GROUP BY cells.t, r"""
)
def table_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' tables as lines of text: size and heads, then each row with its columns' heads."""
    # Both are dealt out by table before cells are made of them; Spark then leaves out the shuffle of the cells.
    lines = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS t", "l_linenumber + 1 AS r", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag").repartition("t")
    rows = lines.groupBy("t", "r").agg(*[F.max(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_quantity", "l_returnflag")])
    cells = rows.select("t", "r", F.inline(F.array(*[F.struct(F.lit(k).alias("c"), F.expr(e).alias("v")) for k, e in COLUMNS.items()])))
    heads = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("t"), "o_orderstatus").withColumn("o_orderkey", F.col("t")).repartition("t").select("t", F.lit(1).alias("r"), F.inline(F.array(*[F.struct(F.lit(k).alias("c"), F.expr(e).alias("v")) for k, e in HEADS.items()])))
    return C.table_lines(cells.union(heads), "t", "r", "c", "v")
