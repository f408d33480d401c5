"""Why readings of receipts fail: orders read with planted faults, and the tags that name the faults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import attribution as A
from quillspark.plans.registry import StandIn, query
from quillspark.sources.tables import table

ORDERS = StandIn("orders", {"sample": "o_orderkey", "cust": "cast(o_custkey as string)", "day": "cast(cast(o_orderdate as date) as string)", "total": "cast(floor(o_totalprice) as bigint)", "supply": "cast(floor(o_totalprice / 1.1) as bigint)", "fault": "(o_custkey * 7 + o_orderkey) % 15"})
LINES = StandIn(
    "lineitem",
    {"sample": "l_orderkey", "item": "(l_partkey * 1000 + l_suppkey) * 10 + l_linenumber", "name": "'part' || cast(l_partkey as string) || 'x'", "q": "cast(l_quantity as bigint)", "price": "l_partkey % 90 + 10", "fault": "(l_partkey * 3 + l_suppkey + l_linenumber) % 18"},
)
#: What a receipt's text says of an order and of its lines, in both engines' words.
HEAD = """CASE WHEN fault = 6 THEN 'Store' ELSE 'Shop ' || cust || ' Main Branch' END || ' ' || day || ' 2001-01-01 식사 커피 card 합계 ' || cast(CASE WHEN fault = 5 THEN total + 3 ELSE total END as string) || CASE WHEN fault = 10 THEN '' ELSE ' 공급가액 ' || cast(supply as string) END || ' 총수량 1.25 '"""
SAID = """CASE WHEN fault = 2 THEN '' WHEN fault = 3 THEN translate(name, '0125', 'oizs') ELSE name END || ' ' || CASE WHEN fault = 15 THEN '' WHEN fault = 13 THEN '1.5' ELSE cast(q as string) END || ' ' || cast(price as string) || ' ' || cast(q * price as string)"""
#: (field, expected, actual, model) of an order; `low` is the least amount of its items.
FIELDS = {
    "merchant": ("'Shop ' || cust || ' Main Branch'", "CASE fault WHEN 6 THEN 'Depot' WHEN 7 THEN 'Shop ' || cust WHEN 12 THEN 'SHOP ' || cust || '  main-branch' ELSE 'Shop ' || cust || ' Main Branch' END", "'Shop'"),
    "transaction_date": ("day", "CASE fault WHEN 8 THEN '2001-01-01' WHEN 13 THEN '1999-12-31' ELSE replace(day, '-', '.') END", "day"),
    "total_amount": ("cast(total as string)", "CASE fault WHEN 1 THEN cast(total + 1 as string) WHEN 2 THEN NULL WHEN 3 THEN cast(coalesce(low, total + 7) as string) WHEN 4 THEN cast(total + 7 as string) WHEN 5 THEN cast(total + 3 as string) ELSE cast(total as string) || '원' END", "CASE fault WHEN 1 THEN cast(total as string) WHEN 2 THEN '' ELSE '7' END"),
    "supply_amount": ("cast(supply as string)", "CASE WHEN fault IN (10, 14) THEN cast(supply + 500 as string) ELSE cast(supply as string) END", "cast(supply + 500 as string)"),
    "total_quantity": ("'1.25'", "CASE WHEN fault = 11 THEN '1250' ELSE '1.25' END", "'1250'"),
    "expense_category": ("'외식/식사'", "CASE fault WHEN 9 THEN '카페/음료' WHEN 12 THEN '식비' ELSE '외식/식사' END", "NULL"),
    "payment_method": ("CASE WHEN fault = 0 THEN '' ELSE 'card' END", "CASE fault WHEN 13 THEN 'cash' WHEN 12 THEN 'CARD' ELSE 'card' END", "NULL"),
}
#: Items as they are, as the model told them and as they came out; a fault may leave a side out or add an item.
TRUTH = "CASE WHEN fault < 16 THEN {s}('name', name, 'quantity', CASE WHEN fault = 13 THEN 1.5 ELSE cast(q as double) END, 'unit_price', cast(price as double), 'total_amount', cast(q * price as double)) END"
MODEL = """CASE WHEN fault NOT IN (1, 2, 17) THEN {s}('name', CASE fault WHEN 3 THEN translate(name, '0125', 'oizs') ELSE name END, 'quantity', CASE fault WHEN 4 THEN q + 1.0 WHEN 13 THEN 1500.0 ELSE cast(q as double) END, 'unit_price', CASE fault WHEN 5 THEN price + 1.0 ELSE cast(price as double) END,
'total_amount', CASE fault WHEN 6 THEN q * price + 1.0 ELSE cast(q * price as double) END) END"""
FINAL = """CASE WHEN fault NOT IN (1, 2, 11) THEN {s}('name', CASE fault WHEN 3 THEN translate(name, '0125', 'oizs') WHEN 12 THEN upper(name) ELSE name END, 'quantity', CASE fault WHEN 4 THEN q + 1.0 WHEN 13 THEN 1500.0 WHEN 14 THEN q + 2.0 ELSE cast(q as double) END, 'unit_price', cast(price as double), 'total_amount', cast(q * price as double)) END"""
#: Items that only the model told, by fault.
EXTRAS = {7: "'쿠폰 할인'", 8: "'합계 금액'", 9: "'zzz'", 10: "'Main Branch'"}


def readings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The fields, items and results of all orders, as `attribute` takes them."""
    # Lines are dealt out by order before texts and sides are made of them; fields, items and sums are all made of what stands in an order's row.
    dealt = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity").where("l_orderkey IS NOT NULL").repartition("l_orderkey")
    kind = "struct<name: string, quantity: double, unit_price: double, total_amount: double>"
    truth, model, final = (F.expr(e.format(s="named_struct")).cast(kind).alias(n) for n, e in (("truth", TRUTH), ("model", MODEL), ("final", FINAL)))
    lines = LINES.of(dealt).select("*", F.expr("q * price").alias("amount"), F.expr(SAID).alias("said"), final)
    of_order = lines.groupBy("sample").agg(F.sort_array(F.collect_list(F.struct("item", "said", "amount", "name", "q", "price", "fault", "final"))).alias("lines"))
    held = ORDERS.rows(spark, sf_dir).join(of_order.hint("merge"), "sample", "left").withColumns({"said": F.array_join("lines.said", "\n"), "low": F.array_min("lines.amount")})
    orders = held.withColumn("text", F.expr(f"{HEAD} || coalesce(said, '')"))
    told = lambda array: F.coalesce(F.filter(array, lambda x: x.isNotNull()), F.array())

    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.expr(e).cast("string").alias("expected"), F.expr(a).cast("string").alias("actual"), F.expr(m).cast("string").alias("model")) for f, (e, a, m) in FIELDS.items()])
    amounts = told(F.transform("lines", lambda x: x["amount"].cast("double"))).cast("array<double>")
    fields = A.read_texts(orders).select("sample", "text", "numbers", "words", amounts.alias("item_amounts"), F.when(F.col("fault") == 10, "CALCULATED_TAXABLE").alias("source"), F.inline(rows))

    name = F.expr(f"CASE fault {' '.join(f'WHEN {k} THEN {n}' for k, n in EXTRAS.items())} END")
    own = F.struct("item", truth, model, "final")
    extra = F.struct((-1 - F.col("item")).alias("item"), F.lit(None).cast(kind).alias("truth"), F.struct(name.alias("name"), F.lit(1.0).alias("quantity"), F.lit(1.0).alias("unit_price"), F.lit(999999999.0).alias("total_amount")).cast(kind).alias("model"), F.lit(None).cast(kind).alias("final"))
    each = A.read_texts(orders.where("lines IS NOT NULL").select("sample", "text", "lines")).select("sample", "text", "numbers", "words", F.inline("lines"))
    items = each.select("sample", "text", "numbers", "words", F.inline(F.when(F.col("fault").isin(*EXTRAS), F.array(own, extra)).otherwise(F.array(own))))

    finals = F.filter("lines.final", lambda x: x.isNotNull())
    amount = lambda f: A.as_amount(F.expr(FIELDS[f][1]).cast("string"))
    summed = orders.withColumn("_finals", finals)
    whole = summed.select("sample", told(F.col("_finals.total_amount")).cast("array<double>").alias("item_amounts"), amount("total_amount").alias("total"), F.lit(None).cast("double").alias("discount"), amount("supply_amount").alias("supply"), (F.col("total") - F.col("supply")).cast("double").alias("tax"), told(F.col("_finals.name")).cast("array<string>").alias("names"))
    return fields, items, whole


def _plain(value: str) -> str:
    return f"regexp_replace(lower(coalesce({value}, '')), '[^0-9a-z가-힣]', '', 'g')"


def _amount(value: str) -> str:
    return f"round(try_cast(regexp_replace({value}, '[^0-9.+-]', '', 'g') AS DOUBLE), 2)"


def _lost(a: str, b: str) -> str:
    return f"coalesce({a} > 0 AND {b} > 0 AND (abs({a} * 1000 - {b}) < 0.01 OR abs({b} * 1000 - {a}) < 0.01), false)"


_BASE = f"""
WITH told AS (SELECT sample, item, q, price, name, fault, q * price AS amount, {SAID} AS said FROM {LINES.sql}),
of_order AS (SELECT sample, string_agg(said, chr(10) ORDER BY item, said) AS said, min(amount) AS low, list(CAST(amount AS DOUBLE)) AS amounts FROM told GROUP BY sample),
orders_ AS (SELECT o.*, low, coalesce(amounts, []) AS item_amounts, {HEAD} || coalesce(said, '') AS text FROM {ORDERS.sql} o LEFT JOIN of_order USING (sample)),
texts AS (SELECT sample, text, {_plain("text")} AS words, list_transform(regexp_extract_all(text, '[0-9][0-9,.]*'), lambda t: {_amount("t")}) AS nums FROM orders_),
raw AS ({" UNION ALL ".join(f"SELECT sample, fault, item_amounts, '{f}' AS field, CAST({e} AS VARCHAR) AS expected, CAST({a} AS VARCHAR) AS actual, CAST({m} AS VARCHAR) AS model FROM orders_" for f, (e, a, m) in FIELDS.items())}),
known AS (SELECT *, field LIKE '%amount' OR field LIKE '%quantity' AS num, {_amount("expected")} AS e, {_amount("actual")} AS a, {_amount("model")} AS m, {_plain("expected")} AS ce, {_plain("actual")} AS ca FROM raw JOIN texts USING (sample)),
judged AS (SELECT *, CASE WHEN num THEN len(list_filter(nums, lambda n: abs(n - e) < 0.01)) > 0 ELSE ce <> '' AND contains(words, ce) END AS held,
  NOT num AND (ce <> '' AND ce = ca OR field = 'expense_category' AND actual = '식비') AS alike,
  coalesce(CASE WHEN num THEN abs(e - a) < 0.01 WHEN field = 'transaction_date' THEN ce = ca ELSE ce <> '' AND ce = ca OR field = 'expense_category' AND actual = '식비' OR field <> 'merchant' AND ce <> '' AND ca <> '' AND (contains(ce, ca) OR contains(ca, ce)) END, false) AS eq FROM known),
fields_ AS (SELECT sample, field, eq, CASE
  WHEN field = 'total_quantity' AND {_lost("e", "a")} AND held THEN 'DECIMAL_SEPARATOR_LOST'
  WHEN expected <> actual AND alike THEN 'SEMANTIC_EQUIVALENCE'
  WHEN eq THEN NULL WHEN coalesce(expected, '') = '' THEN 'FINAL_VALUE_MISMATCH'
  WHEN field = 'expense_category' AND regexp_matches(text, '식대|식사|음식|메뉴|식당|주문') THEN 'CATEGORY_INFERENCE_ERROR'
  WHEN field = 'transaction_date' AND contains(text, expected) AND contains(text, actual) THEN 'TRANSACTION_DATE_SELECTION_ERROR'
  WHEN NOT held AND field = 'supply_amount' AND fault = 10 THEN 'CALCULATED_AMOUNT_MISMATCH'
  WHEN NOT held AND num THEN 'OCR_NUMBER_ERROR' WHEN NOT held THEN 'OCR_TEXT_MISSING'
  WHEN num AND coalesce(actual, '') = '' AND coalesce(model, '') = '' THEN 'VALUE_MISSING'
  WHEN num AND abs(e - m) < 0.01 THEN 'POSTPROCESSING_CHANGED_CORRECT_VALUE'
  WHEN field = 'total_amount' AND len(list_filter(item_amounts, lambda n: abs(n - a) < 0.01)) > 0 THEN 'SUMMARY_AMOUNT_SELECTION_ERROR'
  WHEN num THEN 'NUMERIC_VALUE_ERROR' WHEN field = 'merchant' THEN 'MERCHANT_DETAIL_DROPPED' ELSE 'FINAL_VALUE_MISMATCH' END AS code FROM judged),
"""
_SHOWN = {"quantity": "QUANTITY_ERROR", "unit_price": "UNIT_PRICE_ERROR", "total_amount": "ITEM_AMOUNT_ERROR"}


def _struct(expression: str) -> str:
    """The sides' structs in DuckDB's words."""
    inner = expression.format(s="struct_pack")
    for f in ("name", "quantity", "unit_price", "total_amount"):
        inner = inner.replace(f"'{f}', ", f"{f} := ")
    return inner


_ITEMS = f"""
sides AS (SELECT sample, item, {_struct(TRUTH)} AS t, {_struct(MODEL)} AS m, {_struct(FINAL)} AS f FROM told UNION ALL
  SELECT sample, -1 - item, NULL, struct_pack(name := CASE fault {" ".join(f"WHEN {k} THEN {n}" for k, n in EXTRAS.items())} END, quantity := 1.0, unit_price := 1.0, total_amount := 999999999.0), NULL FROM told WHERE fault IN (7, 8, 9, 10)),
seen AS (SELECT *, coalesce(m, f) AS s, t IS NOT NULL AS here, coalesce({_plain("t.name")} <> '' AND contains(words, {_plain("t.name")}), false) AS named FROM sides JOIN texts USING (sample)),
caused AS (
  SELECT sample, item, CASE WHEN named THEN 'ITEM_MISSING' ELSE 'ITEM_TEXT_MISSING' END AS code, NULL AS field FROM seen WHERE here AND m IS NULL
  UNION ALL SELECT sample, item, 'OCR_CHARACTER_CONFUSION', 'name' FROM seen WHERE here AND s IS NOT NULL AND {_plain("t.name")} <> {_plain("s.name")} AND regexp_matches(t.name, '[0-9]') AND translate({_plain("t.name")}, 'oilzsb', '011258') = translate({_plain("s.name")}, 'oilzsb', '011258') AND contains(words, {_plain("s.name")})
  UNION ALL SELECT sample, item, 'SEMANTIC_EQUIVALENCE', 'name' FROM seen WHERE here AND t.name <> f.name AND {_plain("t.name")} = {_plain("f.name")}
  UNION ALL SELECT sample, item, CASE WHEN regexp_matches(m.name, '할인|쿠폰|적립금|캐시백') THEN 'DISCOUNT_AS_ITEM' WHEN regexp_matches(m.name, '합계|소계|결제|승인|공급가액|부가세|세액') THEN 'TOTAL_ROW_AS_ITEM' WHEN NOT contains(words, {_plain("m.name")}) AND len(list_filter(nums, lambda n: abs(n - m.total_amount) < 0.01)) = 0 THEN 'LLM_HALLUCINATION' ELSE 'EXTRA_ITEM' END, NULL FROM seen WHERE NOT here AND m IS NOT NULL
  UNION ALL SELECT sample, item, 'POSTPROCESSING_DROPPED_CORRECT_ITEM', NULL FROM seen WHERE here AND m IS NOT NULL AND f IS NULL
  UNION ALL SELECT sample, item, 'POSTPROCESSING_ADDED_UNSUPPORTED_ITEM', NULL FROM seen WHERE NOT here AND m IS NULL AND f IS NOT NULL
  {" ".join(f"UNION ALL SELECT sample, item, 'OCR_NUMBER_ERROR', '{k}' FROM seen WHERE here AND named AND t.{k} IS NOT NULL AND len(list_filter(nums, lambda n: abs(n - t.{k}) < 0.01)) = 0 UNION ALL SELECT sample, item, '{v}', '{k}' FROM seen WHERE here AND s IS NOT NULL AND t.{k} IS NOT NULL AND NOT coalesce(abs(t.{k} - s.{k}) < 0.01, false) AND NOT ({'true' if k == 'quantity' else 'false'} AND {_lost(f't.{k}', f's.{k}')} AND len(list_filter(nums, lambda n: abs(n - t.{k}) < 0.01)) > 0)" for k, v in _SHOWN.items())}
  UNION ALL SELECT sample, item, 'DECIMAL_SEPARATOR_LOST', 'quantity' FROM seen WHERE here AND s IS NOT NULL AND {_lost("t.quantity", "s.quantity")} AND len(list_filter(nums, lambda n: abs(n - t.quantity) < 0.01)) > 0),
wrong AS (SELECT sample, item, f IS NULL OR {" OR ".join(f"t.{k} IS NOT NULL AND NOT coalesce(abs(t.{k} - f.{k}) < 0.01, false)" for k in _SHOWN)} AS failed FROM seen WHERE here),
left_over AS (SELECT sample, item, 'ITEM_FIELD_MISMATCH' AS code, unnest(['quantity', 'unit_price', 'total_amount']) AS field, unnest([abs(t.quantity - f.quantity) >= 0.01, abs(t.unit_price - f.unit_price) >= 0.01, abs(t.total_amount - f.total_amount) >= 0.01]) AS off FROM seen WHERE here AND (sample, item) NOT IN (SELECT sample, item FROM caused WHERE code <> 'SEMANTIC_EQUIVALENCE')),
all_items AS (SELECT sample, item, code, field FROM caused UNION ALL SELECT sample, item, code, field FROM left_over WHERE off),
results AS (SELECT sample, coalesce(list_sum(list_transform(fs, lambda f: f.total_amount)), 0) AS s, coalesce(fs, []) AS fs, a AS total FROM judged LEFT JOIN (SELECT sample, list(f) AS fs FROM sides WHERE f IS NOT NULL GROUP BY sample) USING (sample) WHERE field = 'total_amount'),
taxes AS (SELECT sample, {_amount(f"CAST({FIELDS['supply_amount'][1]} AS VARCHAR)")} AS supply, CAST(total - supply AS DOUBLE) AS tax FROM orders_),
sums AS (SELECT sample, 'ITEM_SUM_MISMATCH' AS code FROM results WHERE len(fs) > 0 AND abs(s - total) >= 0.01
  UNION ALL SELECT sample, 'SUPPLY_TAX_MISMATCH' FROM results JOIN taxes USING (sample) WHERE abs(supply + tax - total) > 10
  UNION ALL SELECT sample, 'DUPLICATE_ITEM' FROM results WHERE len(list_distinct(list_transform(fs, lambda f: {_plain("f.name")}))) < len(fs)),
every AS (SELECT sample, code, 'sample' AS scope, field FROM fields_ UNION ALL SELECT sample, code, 'items[' || item || ']', field FROM all_items UNION ALL SELECT sample, code, 'sample', NULL FROM sums),
failing AS (SELECT sample, max(bad) AS failed FROM (SELECT sample, NOT eq AS bad FROM fields_ UNION ALL SELECT sample, failed FROM wrong UNION ALL SELECT sample, code = 'OCR_CHARACTER_CONFUSION' FROM all_items) GROUP BY sample),
causes(code, category, confidence) AS (VALUES {", ".join(f"('{c}', '{s}', {n})" for c, (s, n) in A.CAUSES.items())}),
tags AS (SELECT DISTINCT sample, category, code, scope, field, CAST(confidence AS DOUBLE) AS confidence, CASE WHEN confidence >= 0.9 THEN 'AUTO' WHEN confidence >= 0.6 THEN 'NEEDS_REVIEW' ELSE 'UNKNOWN' END AS decision
  FROM every JOIN failing USING (sample) JOIN causes USING (code) WHERE failed OR code IN ('DECIMAL_SEPARATOR_LOST', 'SEMANTIC_EQUIVALENCE'))
"""


@query(_BASE + _ITEMS + "SELECT * FROM tags")
def failure_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What went wrong with each field and item of the readings, and at which stage."""
    return A.attribute(*readings(spark, sf_dir))[0]


@query(_BASE + _ITEMS + ", counted AS (SELECT sample, category, count(*) AS n, count(*) FILTER (decision <> 'AUTO') AS unsure FROM tags GROUP BY ALL), best AS (SELECT sample, arg_min(category, struct_pack(n := -n, c := category)) AS primary_category, sum(unsure) > 0 AS needs_review, CAST(sum(n) AS BIGINT) AS tags FROM counted GROUP BY sample) SELECT sample, CASE WHEN failed THEN 'FAILED' ELSE 'SUCCESS' END AS status, primary_category, coalesce(needs_review, false) AS needs_review, coalesce(tags, 0) AS tags FROM failing LEFT JOIN best USING (sample)")
def failure_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a reading failed, mostly at which stage, and whether a person should look."""
    return A.attribute(*readings(spark, sf_dir))[1]
