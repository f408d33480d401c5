"""Amounts of receipts put together from an order's columns: labels of every kind, final payments, and conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import amounts as A
from quillspark.plans.registry import StandIn, query

_N = {"total": "cast(floor(o_totalprice) as bigint)", "tax": "cast(floor(o_totalprice / 11) as bigint)"}
_LINES = (
    f"CASE WHEN o_custkey % 4 > 0 THEN '공급가액 : ' || cast({_N['total']} - {_N['tax']} as string) ELSE '주문' END",
    f"CASE o_custkey % 6 WHEN 0 THEN '과세 물품가액 ' || cast({_N['total']} - {_N['tax']} - 5 as string) WHEN 1 THEN '면세금액 ' || cast({_N['total']} as string) WHEN 2 THEN '과세 금액 / 면세' WHEN 3 THEN '면세합계(5) 과세합계(7)' ELSE o_orderpriority END",
    f"CASE WHEN o_orderkey % 3 > 0 THEN '부가세액 ' || cast({_N['tax']} as string) || '원' ELSE '세액: 12*3' END",
    f"CASE o_orderkey % 5 WHEN 0 THEN '합계 금액 ' || cast({_N['total']} as string) WHEN 1 THEN '총 액 ' || cast({_N['total']} as string) || ' / 받을금액 ' || cast({_N['total']} + 100 as string) WHEN 2 THEN cast({_N['total']} as string) ELSE '결제금액 ' || cast({_N['total']} as string) || '원 / 결제액 ' || cast({_N['total']} as string) END",
    f"CASE WHEN o_orderkey % 7 = 0 THEN '카드전표' ELSE '할인금액 - 100' END",
    f"CASE WHEN o_orderkey % 7 = 0 AND o_custkey % 2 = 0 THEN '최종 카드승인금액 ' || cast({_N['total']} - 3 as string) ELSE '절사금액 ' || cast({_N['total']} % 10 as string) END",
)
RECEIPTS = StandIn("orders", {"id": "o_orderkey", "text": " || chr(10) || ".join(_LINES), "model_total": f"CASE WHEN o_custkey % 3 = 0 THEN cast({_N['total']} as double) WHEN o_custkey % 3 = 1 THEN cast({_N['total']} + 100 as double) END", "item": f"CASE WHEN o_custkey % 5 < 3 THEN cast({_N['total']} + o_custkey % 5 * 6 as double) ELSE -1.0 END"})
#: The labels without look-around, for an engine that lacks it; the texts have none of what it excludes.
_PLAIN = A.LABELLED | {"tax_amount": "(?:부가가치세|부가세(?:액|포함)?|세액|VAT)"}
_SHOWN = tuple(A.LABELLED)
_FOUND = """list_filter(flatten(list_transform(range(1, len(ls) + 1), lambda i: list_transform(regexp_extract_all(ls[i] || ' ', '(?i){p}[()\\[\\]:：]*(-?[0-9]{{1,3}}(?:[,.][0-9]{{3}})+|-?[0-9]{{1,8}})(?:원)?[^0-9*xX]', 1), lambda v: struct_pack(value := CAST(v AS BIGINT), line := i - 1)))), lambda s: s.line >= coalesce({start}, 0))"""
SQL = f"""
WITH raw AS (SELECT *, list_transform(string_split(text, chr(10)), lambda l: regexp_replace(l, '\\s+', '', 'g')) AS ls FROM {RECEIPTS.sql}),
anchored AS (SELECT *, list_filter(range(1, len(ls) + 1), lambda i: regexp_matches(ls[i], '{A.FINAL}'))[1] - 1 AS anchor FROM raw),
scoped AS (SELECT *, anchor IS NOT NULL AND len({_FOUND.format(p=_PLAIN["total_amount"], start="anchor")}) > 0 AS final FROM anchored),
started AS (SELECT *, CASE WHEN final THEN anchor ELSE 0 END AS start FROM scoped),
found AS (SELECT *, {", ".join(f"{_FOUND.format(p=_PLAIN[f], start='start')} AS f_{f}" for f in _SHOWN)} FROM started),
valued AS (SELECT *, {", ".join(f"CASE WHEN len(list_distinct(list_transform(f_{f}, lambda s: s.value))) = 1 THEN f_{f}[1].value END AS v_{f}, CASE WHEN len(list_distinct(list_transform(f_{f}, lambda s: s.value))) = 1 THEN f_{f}[1].line END AS l_{f}" for f in _SHOWN)},
  list_filter([{", ".join(f"CASE WHEN len(list_distinct(list_transform(f_{f}, lambda s: s.value))) > 1 THEN '{f}' END" for f in _SHOWN)}], lambda c: c IS NOT NULL) AS conflicts FROM found)
"""


def _receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.amount_evidence(RECEIPTS.rows(spark, sf_dir).withColumn("item_amounts", F.array("item")))


@query(SQL + f"SELECT id, final, array_to_string(conflicts, '|') AS conflicts, {', '.join(f'v_{f} AS {f}, CAST(l_{f} AS INTEGER) AS {f}_line, CAST(len(f_{f}) AS INTEGER) AS {f}_said' for f in _SHOWN)} FROM valued")
def amounts_said(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The amounts that receipts' labels give, on which line and how often."""
    return _receipts(spark, sf_dir).select("id", "final", F.array_join("conflicts", "|").alias("conflicts"), *[c for f in _SHOWN for c in (F.col(f"{f}.value").alias(f), F.col(f"{f}.line").alias(f"{f}_line"), F.col(f"{f}.said").alias(f"{f}_said"))])


@query(
    SQL
    + """, told AS (SELECT *, coalesce(CAST(v_total_amount AS DOUBLE), model_total) AS total, list_transform(regexp_extract_all(text, '[0-9]{3,8}'), lambda v: CAST(v AS DOUBLE)) AS nums, regexp_replace(text, '\\s+', '', 'g') AS plain FROM valued),
backed AS (SELECT *, coalesce(v_total_amount = total, false) AS said, list_filter([CASE WHEN v_total_amount = total THEN 'EXPLICIT_PAYMENT_OCR' END, CASE WHEN model_total = total THEN 'LLM_TOTAL' END, CASE WHEN NOT coalesce(v_total_amount = total, false) AND list_contains(nums, total) AND NOT coalesce(total = v_tax_amount, false) THEN 'OCR_AMOUNT_CANDIDATE' END, CASE WHEN item >= 0 AND abs(item - total) <= 10 THEN 'ITEM_SUM' END], lambda s: s IS NOT NULL) AS s FROM told)
SELECT id, total, CASE WHEN total >= 0 THEN array_to_string(s, '|') ELSE '' END AS support, NOT list_contains(conflicts, 'total_amount') AND coalesce(total >= 0, false) AND (said OR list_contains(s, 'OCR_AMOUNT_CANDIDATE') AND len(s) >= 2) AS confirmed,
CASE WHEN CASE WHEN v_taxable_supply_amount IS NOT NULL AND v_tax_exempt_amount IS NOT NULL THEN v_taxable_supply_amount > 0 AND v_tax_exempt_amount > 0 ELSE regexp_matches(plain, '과세.{0,8}면세|면세.{0,8}과세') END THEN 'MIXED' WHEN regexp_matches(plain, '전액면세|면세전용|면세상품|도서.*면세|면세.*도서') OR coalesce(v_tax_exempt_amount = total AND coalesce(v_taxable_supply_amount, 0) = 0 AND coalesce(v_tax_amount, 0) = 0, false) THEN 'EXEMPT'
WHEN coalesce(v_taxable_supply_amount > 0, false) OR coalesce(v_tax_amount > 0, false) THEN 'TAXABLE' ELSE 'UNKNOWN' END AS treatment FROM backed"""
)
def confirmed_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts' totals with what supports them, whether they are confirmed, and the kind of tax."""
    return A.total_confidence(_receipts(spark, sf_dir)).select("id", "total", F.array_join("support", "|").alias("support"), "confirmed", "treatment")
