"""Receipts as queries: orders are receipts, lines their items, and texts are made of both."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.operators import receipts as P
from quillspark.plans.registry import StandIn, choice, query
from quillspark.sources.tables import table

CATEGORY = StandIn("orders", {"id": "o_orderkey", "category": choice("o_orderkey", "외식 / 식사", "교통비", "도서 인쇄비", "복리후생(비)", "레저", "UNKNOWN", "카페/음료", "의류/패션")})


@query(f"SELECT id, c AS category, CASE c WHEN '대중교통' THEN 'TRAVEL_EXPENSE' WHEN '의류/패션' THEN 'PURCHASE_REQUEST' ELSE CASE WHEN c IS NOT NULL THEN 'WELFARE_BENEFIT' END END AS kind FROM (SELECT id, CASE category WHEN '외식 / 식사' THEN '외식/식사' WHEN '교통비' THEN '대중교통' WHEN '도서 인쇄비' THEN '도서' WHEN '레저' THEN '레저/스포츠' WHEN '카페/음료' THEN '카페/음료' WHEN '의류/패션' THEN '의류/패션' END AS c FROM {CATEGORY.sql})")
def receipt_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Present names of categories, and the kind of document of each."""
    named = P.canonical_category(F.col("category"))
    return CATEGORY.rows(spark, sf_dir).select("id", named.alias("category"), P.document_type(named).alias("kind"))


PAID = StandIn("orders", {"id": "o_orderkey", "said": choice("o_orderkey", "합계 1,000\n신용 카드 승인", "현금 결제 500\n카드 0원", "카드 1,000\n현금 500", "현금영수증 미발급", "신한카드", "CASH 300", "카드 환불 안내"), "method": choice("o_orderkey % 7", "신용카드", "체크카드 1", "계좌 이체", "My CARD", "Voucher  A", "현금")})


@query(
    f"""SELECT id, CASE id % 8 WHEN 0 THEN '카드' WHEN 1 THEN '현금' WHEN 4 THEN '카드' WHEN 5 THEN '현금' END AS method, CASE id % 8 WHEN 2 THEN 'CONFLICT' WHEN 3 THEN 'MISSING' WHEN 6 THEN 'MISSING' WHEN 7 THEN 'MISSING' ELSE 'UNIQUE' END AS reason,
CASE method WHEN '신용카드' THEN 'credit_card' WHEN '체크카드 1' THEN 'debit_card' WHEN '계좌 이체' THEN 'bank_transfer' WHEN 'My CARD' THEN 'credit_card' WHEN 'Voucher  A' THEN 'voucher a' WHEN '현금' THEN 'cash' ELSE '' END AS standard FROM {PAID.sql}"""
)
def payment_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What receipts' lines say was paid with, and standard names of methods."""
    rows = PAID.rows(spark, sf_dir).withColumn("p", P.payment_from_text(F.col("said")))
    return rows.select("id", F.col("p.method").alias("method"), F.col("p.reason").alias("reason"), P.canonical_payment(F.col("method")).alias("standard"))


GOODS = StandIn("part", {"id": "p_partkey", "name": "CASE p_partkey % 5 WHEN 0 THEN '12) ' WHEN 1 THEN '+ BEST: 추천 ' WHEN 2 THEN '강추 오리지널 ' ELSE ' ' END || p_name || CASE WHEN p_partkey % 2 = 0 THEN '  AB1234567' ELSE ' 12.5' END"})


@query(f"SELECT id, p_name || CASE WHEN id % 2 = 0 THEN '' ELSE ' 12.5' END AS name, list_sort(list_distinct(regexp_extract_all(lower(p_name || CASE WHEN id % 2 = 0 THEN '' ELSE ' 12.5' END), '[0-9]+(?:[.,][0-9]+)?|[a-z]+'))) AS tokens FROM {GOODS.sql} JOIN part ON id = p_partkey", joined=("tokens",))
def item_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items' names without decorations, and their tokens."""
    return GOODS.rows(spark, sf_dir).select("id", P.item_name(F.col("name")).alias("name"), F.array_sort(P.item_tokens(F.col("name"))).alias("tokens"))


TEXTS = StandIn("orders", {"id": "o_orderkey", "said": "CASE o_orderkey % 4 WHEN 0 THEN '합 계 : 12,' || lpad(cast(o_custkey % 1000 as string), 3, '0') || '원' || '\n부가세 ' || cast(o_custkey as string) || '\n합계 (' || cast(o_custkey as string) || ')' WHEN 1 THEN '합계 ' || cast(o_custkey as string) || '\n합계: ' || cast(o_custkey as string) WHEN 2 THEN '합계' ELSE '부가세 -' || cast(o_custkey as string) END"})


@query(
    f"""WITH t AS (SELECT id, said, TRY_CAST(regexp_extract(said, '(부가세 -?|합계 )(\\d+)', 2) AS BIGINT) AS n, 12000 + TRY_CAST(regexp_extract(said, '12,(\\d\\d\\d)', 1) AS BIGINT) AS a FROM {TEXTS.sql})
SELECT id, CASE id % 4 WHEN 0 THEN CASE WHEN a = n THEN a END WHEN 1 THEN n END AS total, id % 4 = 0 AND a <> n AS conflict, CASE id % 4 WHEN 0 THEN n WHEN 3 THEN -n END AS tax, list_filter([CASE WHEN length(trim(regexp_replace(said, '\\s+', ' ', 'g'))) < 40 THEN 'OCR_TEXT_TOO_SHORT' END, CASE WHEN NOT regexp_matches(said, '\\d\\d\\d') THEN 'NO_MONEY_EVIDENCE' END], lambda x: x IS NOT NULL) AS reasons FROM t""",
    joined=("reasons",),
)
def labelled_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts after labels, and why texts should be reviewed."""
    total, tax = P.labelled_amount(F.col("said"), "합계"), P.labelled_amount(F.col("said"), "부가세")
    return TEXTS.rows(spark, sf_dir).select("id", total["value"].alias("total"), total["conflict"].alias("conflict"), tax["value"].alias("tax"), P.preflight(F.col("said")).alias("reasons"))


AMOUNTS = StandIn(
    "orders",
    {
        "id": "o_orderkey", "total": "CASE WHEN o_orderkey % 13 > 0 THEN cast(round(o_totalprice, 0) as double) END", "supply": "CASE WHEN o_orderkey % 3 = 0 THEN cast(round(o_totalprice * 0.9, 0) as double) END", "tax": "CASE WHEN o_orderkey % 4 = 0 THEN cast(round(o_totalprice * 0.1, 0) as double) END",
        "exempt": "o_custkey % 5 = 0", "taxed": "o_custkey % 5 = 1", "confirmed": "o_custkey % 7 > 0", "discount": "CASE WHEN o_custkey % 2 = 0 THEN cast(o_custkey % 100 as double) END",
    },
)


@query(
    f"""WITH b AS (SELECT *, CASE WHEN supply IS NOT NULL AND tax IS NOT NULL THEN 'GIVEN' WHEN NOT confirmed OR total IS NULL THEN 'UNRESOLVED' WHEN supply IS NOT NULL THEN 'TAX_IS_REST' WHEN tax IS NOT NULL THEN 'SUPPLY_IS_REST' WHEN exempt THEN 'EXEMPT' WHEN taxed THEN 'ELEVENTH' ELSE 'UNRESOLVED' END AS basis FROM {AMOUNTS.sql}),
f AS (SELECT id, total, discount, basis, CASE basis WHEN 'SUPPLY_IS_REST' THEN total - tax WHEN 'EXEMPT' THEN total WHEN 'ELEVENTH' THEN total - round_even(total / 11, 0) ELSE supply END AS supply, CASE basis WHEN 'TAX_IS_REST' THEN total - supply WHEN 'EXEMPT' THEN 0 WHEN 'ELEVENTH' THEN round_even(total / 11, 0) ELSE tax END AS tax FROM b)
SELECT id, supply, tax, basis, CASE WHEN supply IS NULL OR tax IS NULL OR total IS NULL THEN 'NOT_CHECKABLE' WHEN abs(supply + tax - total) <= 10 THEN 'AFTER_DISCOUNT' WHEN coalesce(discount, 0) <> 0 AND abs(supply + tax - discount - total) <= 10 THEN 'BEFORE_DISCOUNT' ELSE 'MISMATCH' END AS relation FROM f"""
)
def reconciled_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supply and tax of receipts filled from confirmed totals, and how they relate to them."""
    rows = AMOUNTS.rows(spark, sf_dir)
    rows = rows.withColumn("r", P.reconcile_amounts(*map(F.col, ("total", "supply", "tax", "exempt", "taxed", "confirmed"))))
    return rows.select("id", "r.supply", "r.tax", "r.basis", P.amount_relation(F.col("total"), F.col("r.supply"), F.col("r.tax"), F.col("discount")).alias("relation"))


LINES = StandIn("lineitem", {"id": "l_orderkey", "quantity": "cast(l_linenumber as double)", "unit_price": "cast(l_suppkey as double)", "total_amount": "CASE WHEN l_partkey % 19 > 0 THEN cast(l_linenumber * l_suppkey + CASE WHEN l_partkey % 7 = 0 THEN 5 ELSE 0 END as double) END"})


@query(
    f"""WITH s AS (SELECT id, count(*) AS n, count(total_amount) AS k, sum(total_amount) AS s, coalesce(bool_or(abs(quantity * unit_price - total_amount) > 1), false) AS odd FROM {LINES.sql} GROUP BY id), t AS (SELECT *, cast(id % 50 as double) * 10 AS total, cast(id % 3 as double) * 5 AS less FROM s)
SELECT id, list_filter([CASE WHEN k < n THEN 'ITEM_TOTALS_INCOMPLETE' END, CASE WHEN k > 0 AND ((k = n AND least(abs(s - total), abs(s - total - less)) > 10) OR s - total - less > 10) THEN 'ITEM_SUM_TOTAL_MISMATCH' END, CASE WHEN odd THEN 'ITEM_ARITHMETIC_MISMATCH' END], lambda x: x IS NOT NULL) AS reasons FROM t""",
    joined=("reasons",),
)
def item_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why receipts' items should be reviewed."""
    items = LINES.rows(spark, sf_dir).groupBy("id").agg(F.collect_list(F.struct("quantity", "unit_price", "total_amount")).alias("items"))
    return items.select("id", P.item_reasons(F.col("items"), (F.col("id") % 50).cast("double") * 10, (F.col("id") % 3).cast("double") * 5).alias("reasons"))


RUBRIC = StandIn("orders", {"id": "o_orderkey", "merchant": "o_orderkey % 2 = 0", "transaction_date": "o_custkey % 2 = 0", "total_amount": "CASE WHEN o_orderkey % 3 > 0 THEN o_custkey % 3 = 0 END", "item_name_f1": "cast((o_custkey % 5) / 4.0 as double)", "category": "o_orderkey % 5 = 0"})


@query(f"SELECT id, round(8 * CAST(merchant AS DOUBLE) + 8 * CAST(transaction_date AS DOUBLE) + 15 * coalesce(CAST(total_amount AS DOUBLE), 0) + 12 * item_name_f1 + 10 * CAST(category AS DOUBLE), 6) AS points FROM {RUBRIC.sql}")
def rubric_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of receipts by the rubric."""
    names = ("merchant", "transaction_date", "total_amount", "item_name_f1", "category")
    return RUBRIC.rows(spark, sf_dir).select("id", F.round(P.rubric_points({n: F.col(n) for n in names}), 6).alias("points"))


@query()
def matched_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of receipts' items that a reading, lines with some fields changed and every seventh lacking, got right."""
    # Parts are as many as a large table has: they are merged with, not sent to the driver.
    parts = table(spark, sf_dir, "part").selectExpr("p_partkey AS l_partkey", "p_name AS name").hint("merge")
    lines = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS id", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity AS quantity", "l_extendedprice AS unit_price", "l_tax AS total_amount").join(parts, "l_partkey")
    rows = lines.withColumn("index", F.row_number().over(Window.partitionBy("id").orderBy("l_linenumber", "l_partkey", "l_suppkey")))
    # Both sides are made of what is dealt out by order: a generator leaves lines out, as a filter would ask for a shuffle of its own.
    read = F.struct(F.col("index").alias("said_index"), F.when(F.col("l_partkey") % 5 == 0, F.reverse("name")).otherwise(F.upper("name")).alias("name"), (F.col("quantity") + (F.col("l_partkey") % 3 == 0).cast("int")).alias("quantity"), "unit_price", "total_amount")
    said = rows.select("id", F.inline(F.filter(F.array(F.when(F.col("l_partkey") % 7 > 0, read)), lambda r: r.isNotNull())))
    found = P.item_scores(rows, said, "id")
    return found.select("id", "n_expected", "n_said", *[F.round(c, 6).alias(c) for c in ("name_f1", "unit_price", "quantity", "total_amount")])
