"""Why a reading failed: tags for wrong fields and items, each with the stage that is to blame and how sure that is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.numbers import separator_lost
from quillspark.functions.text import all_but, compact
from quillspark.operators.grounding import likeness
from quillspark.operators.receipts import canonical_category

# Numeric fields, labels that stand before them, words that tell of a category, and letters read for digits.
NUMBERS = ("quantity", "unit_price", "total_amount", "supply_amount", "tax_amount", "total_quantity", "discount_amount")
LABELS = {"total_amount": r"(?i)합계|결제|승인|받을\s*금액|총\s*구매", "supply_amount": "(?i)공급가액|공급액", "tax_amount": "(?i)부가세|세액", "discount_amount": "(?i)할인|쿠폰", "total_quantity": r"(?i)총\s*(?:수량|매수)"}
CATEGORY_WORDS = {
    "외식/식사": "식대|식사|음식|메뉴|식당|주문|포케|떡볶이|고기|파스타",
    "카페/음료": "카페|음료|커피|라떼|아메리카노|스무디|주스|공차|투썸|베이커리",
    "식품/장보기": "식품|마트|편의점|슈퍼|장보기|과자|라면|생수|봉투",
    "생활용품": "생활|물티슈|세제|주방|욕실|청소|종량제|스펀지",
    "의류/패션": "의류|패션|셔츠|가디건|저지|원피스|바지|재킷|신발|가방",
    "취미/선물": "취미|선물|꽃|식물|공예|게임|소품",
    "미용/뷰티": "미용|헤어|네일|뷰티|화장품|립|스킨|트리트먼트",
    "도서": "도서|서적|책|문고",
    "전자제품/문구": "전자|가전|컴퓨터|휴대폰|케이블|문구|사무용품|노트|펜",
    "대중교통": "버스|택시|철도|korail|ktx|승차권|운임",
    "주유/차량": "주유소|유종|휘발유|경유|주유|정비|oil|lpg",
    "의료": "병원|의원|약국|의료|진료",
    "문화": "문화|공연|영화|전시",
    "레저/스포츠": "레저|여가|스포츠|골프|숙박|호텔|리조트",
}
CONFUSED, MEANT = "oilzsb", "011258"
DISCOUNT_ITEM, TOTAL_ITEM = "(?i)할인|쿠폰|적립금|캐시백", r"(?i)합계|소계|결제|승인|총\s*구매|공급가액|부가세|세액"
DATE = r"(?<!\d)(\d{2,4})\s*(?:년\s*|[-./]\s*)(\d{1,2})\s*(?:월\s*|[-./]\s*)(\d{1,2})\s*일?(?!\d)"
ALIKE, AUTO, REVIEW = 0.72, 0.9, 0.6
# The code of each cause, the stage that it is put down to, and its confidence.
CAUSES = {
    "DECIMAL_SEPARATOR_LOST": ("NORMALIZATION_ERROR", 0.99),
    "SEMANTIC_EQUIVALENCE": ("NORMALIZATION_ERROR", 1.0),
    "OCR_CHARACTER_CONFUSION": ("OCR_ERROR", 0.98),
    "OCR_NUMBER_ERROR": ("OCR_ERROR", 0.9),
    "OCR_TEXT_MISSING": ("OCR_ERROR", 0.72),
    "ITEM_TEXT_MISSING": ("OCR_ERROR", 0.72),
    "CATEGORY_INFERENCE_ERROR": ("LLM_ERROR", 0.96),
    "TRANSACTION_DATE_SELECTION_ERROR": ("LLM_ERROR", 0.98),
    "VALUE_MISSING": ("LLM_ERROR", 0.94),
    "SUMMARY_AMOUNT_SELECTION_ERROR": ("LLM_ERROR", 0.98),
    "NUMERIC_VALUE_ERROR": ("LLM_ERROR", 0.91),
    "MERCHANT_DETAIL_DROPPED": ("LLM_ERROR", 0.98),
    "ITEM_MISSING": ("LLM_ERROR", 0.96),
    "QUANTITY_ERROR": ("LLM_ERROR", 0.9),
    "UNIT_PRICE_ERROR": ("LLM_ERROR", 0.9),
    "ITEM_AMOUNT_ERROR": ("LLM_ERROR", 0.9),
    "DISCOUNT_AS_ITEM": ("LLM_ERROR", 0.94),
    "TOTAL_ROW_AS_ITEM": ("LLM_ERROR", 0.94),
    "LLM_HALLUCINATION": ("LLM_ERROR", 0.94),
    "EXTRA_ITEM": ("LLM_ERROR", 0.94),
    "DUPLICATE_ITEM": ("LLM_ERROR", 0.91),
    "FINAL_VALUE_MISMATCH": ("LLM_ERROR", 0.9),
    "ITEM_FIELD_MISMATCH": ("LLM_ERROR", 0.9),
    "CALCULATED_AMOUNT_MISMATCH": ("VALIDATION_ERROR", 0.9),
    "POSTPROCESSING_CHANGED_CORRECT_VALUE": ("VALIDATION_ERROR", 0.99),
    "POSTPROCESSING_DROPPED_CORRECT_ITEM": ("VALIDATION_ERROR", 0.98),
    "POSTPROCESSING_ADDED_UNSUPPORTED_ITEM": ("VALIDATION_ERROR", 0.96),
    "ITEM_SUM_MISMATCH": ("VALIDATION_ERROR", 1.0),
    "SUPPLY_TAX_MISMATCH": ("VALIDATION_ERROR", 1.0),
    "UNKNOWN": ("UNKNOWN", 0.0),
}
ITEM_CODES = {"quantity": "QUANTITY_ERROR", "unit_price": "UNIT_PRICE_ERROR", "total_amount": "ITEM_AMOUNT_ERROR"}


def as_amount(value: Column) -> Column:
    """A number of two decimals from text with units and commas; null if it holds none."""
    left = F.regexp_replace(value, f"{all_but('0-9.+-', hangul=False)}+", "")
    # A cast that fails costs an exception, so only what is a number comes to it.
    whole = F.try_element_at(F.regexp_extract_all(left, F.lit(r"^[+-]?(?:\d+\.?\d*|\.\d+)$"), 0), F.lit(1))
    # Most are plain digits, which need none of this.
    return F.when(value.rlike(r"^\d{1,15}$"), value.cast("double")).otherwise(F.round(whole.try_cast("double"), 2))


def numbers_in(text: Column) -> Column:
    """The numbers that a text spells."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\d[\d,.]*"), 0), as_amount)


def read_texts(samples: DataFrame) -> DataFrame:
    """Rows with text, and what causes are judged by: the `numbers` that it spells, and its bare `words`.

    Both are dear and the same for all fields and items of a sample, so add them to samples before those are dealt out.
    """
    return samples.withColumns({"numbers": numbers_in(F.col("text")), "words": compact(F.col("text"))})


def _read(rows: DataFrame) -> DataFrame:
    return rows if {"numbers", "words"} <= set(rows.columns) else read_texts(rows)


def same_amount(a: Column, b: Column) -> Column:
    return F.coalesce(F.abs(a - b) < 0.01, F.lit(False))


def _among(values: Column, amount: Column) -> Column:
    return F.coalesce(F.exists(values, lambda v: F.abs(v - amount) < 0.01), F.lit(False))


def _parts(date: Column) -> Column:
    return F.transform(F.slice(F.regexp_extract_all(F.coalesce(date, F.lit("")), F.lit(r"\d+"), 0), 1, 3), lambda p: p.cast("int"))


def same_date(a: Column, b: Column) -> Column:
    """Equal year, month and day, however they are written."""
    return (F.size(_parts(a)) == 3) & (_parts(a) == _parts(b))


def date_in(text: Column, date: Column) -> Column:
    """Whether a text has a date, its year in four digits or two."""
    want = _parts(date)
    years = F.array(want[0], want[0] % 100)
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(DATE), 0)
    return (F.size(want) == 3) & F.coalesce(F.exists(F.transform(found, _parts), lambda p: F.array_contains(years, p[0]) & (p[1] == want[1]) & (p[2] == want[2])), F.lit(False))


def similar(a: Column, b: Column) -> Column:
    """Whether one text holds the other, letters and digits alone, or they are alike."""
    return _similar(compact(a), compact(b))


def _similar(x: Column, y: Column) -> Column:
    both = (x != "") & (y != "")
    return F.coalesce(both & (F.contains(x, y) | F.contains(y, x) | (likeness(F.when(both, x), F.when(both, y), ALIKE) >= ALIKE)), F.lit(False))


def confused(expected: Column, observed: Column) -> Column:
    """Whether two names differ only in letters that are read for digits."""
    return _confused(compact(expected), compact(observed))


def _confused(a: Column, b: Column) -> Column:
    return F.coalesce((a != "") & (b != "") & (a != b) & a.rlike("[0-9]") & (F.translate(a, CONFUSED, MEANT) == F.translate(b, CONFUSED, MEANT)), F.lit(False))


def tagged(code: Column, scope: Column, field: Column) -> Column:
    """Struct of a cause: what CAUSES says of the code, and the decision that its confidence allows."""
    stage = F.create_map(*[F.lit(x) for code, (stage, _) in CAUSES.items() for x in (code, stage)])
    sure = F.create_map(*[F.lit(x) for code, (_, sure) in CAUSES.items() for x in (code, sure)])
    c = sure[code]
    return F.struct(stage[code].alias("category"), code.alias("code"), scope.alias("scope"), field.alias("field"), c.alias("confidence"), F.when(c >= AUTO, "AUTO").when(c >= REVIEW, "NEEDS_REVIEW").otherwise("UNKNOWN").alias("decision"))


def field_causes(rows: DataFrame) -> DataFrame:
    """Rows (sample, field, expected, actual, model, source, text, item_amounts) with equal and code: why a summary field is wrong.

    Values are texts; text is what was read.  A field that is right can still be tagged as written in
    another way; one without an expected value is wrong for no cause that can be told.
    Columns that `read_texts` has added are used as they are.
    """
    number = F.col("field").isin(*NUMBERS)
    of_category = F.when(F.col("field") == "expense_category", canonical_category(F.col("expected")))
    step = _read(rows).withColumns({"_e": F.when(number, as_amount(F.col("expected"))), "_a": F.when(number, as_amount(F.col("actual"))), "_m": F.when(number, as_amount(F.col("model"))), "_ce": compact(F.col("expected")), "_ca": compact(F.col("actual")), "_category": of_category})
    category = (F.col("field") == "expense_category") & F.coalesce(F.col("_category") == canonical_category(F.col("actual")), F.lit(False))
    step = step.withColumn("_alike", ~number & (((F.col("_ce") != "") & (F.col("_ce") == F.col("_ca"))) | category))
    loose = ~F.col("field").isin("merchant", "transaction_date") & ~number
    equal = F.when(number, same_amount(F.col("_e"), F.col("_a"))).when(F.col("field") == "transaction_date", same_date(F.col("expected"), F.col("actual"))).otherwise(F.col("_alike") | (loose & _similar(F.when(loose, F.col("_ce")), F.when(loose, F.col("_ca")))))
    held = F.when(number, _among(F.col("numbers"), F.col("_e"))).otherwise(F.coalesce((F.col("_ce") != "") & F.contains(F.col("words"), F.col("_ce")), F.lit(False)))
    step = step.withColumns({"equal": F.coalesce(equal, F.lit(False)), "_held": held, "_empty": F.coalesce(F.col("expected"), F.lit("")) == ""})
    lost = (F.col("field") == "total_quantity") & separator_lost(F.col("_e"), F.col("_a")) & F.col("_held")
    worded = F.lit(False)
    for name, pattern in CATEGORY_WORDS.items():
        worded |= (F.col("_category") == name) & F.col("text").rlike(f"(?i){pattern}")
    labelled = F.coalesce(*[F.when(F.col("field") == f, F.col("text").rlike(pattern)) for f, pattern in LABELS.items()], F.lit(False))
    reordered = F.coalesce(F.col("expected") != F.col("actual"), F.lit(False)) & F.col("_alike")
    calculated = F.col("field").isin("supply_amount", "tax_amount") & F.coalesce(F.col("source") == "CALCULATED_TAXABLE", F.lit(False))
    wrong = (
        F.when((F.col("field") == "expense_category") & F.coalesce(worded, F.lit(False)), "CATEGORY_INFERENCE_ERROR")
        .when((F.col("field") == "transaction_date") & date_in(F.col("text"), F.col("expected")) & date_in(F.col("text"), F.col("actual")), "TRANSACTION_DATE_SELECTION_ERROR")
        .when(~F.col("_held") & calculated, "CALCULATED_AMOUNT_MISMATCH")
        .when(~F.col("_held") & number & labelled, "OCR_NUMBER_ERROR")
        .when(~F.col("_held"), "OCR_TEXT_MISSING")
        .when(number & (F.coalesce("actual", F.lit("")) == "") & (F.coalesce("model", F.lit("")) == ""), "VALUE_MISSING")
        .when(number & same_amount(F.col("_e"), F.col("_m")), "POSTPROCESSING_CHANGED_CORRECT_VALUE")
        .when((F.col("field") == "total_amount") & _among(F.col("item_amounts"), F.col("_a")), "SUMMARY_AMOUNT_SELECTION_ERROR")
        .when(number, "NUMERIC_VALUE_ERROR")
        .when(F.col("field") == "merchant", "MERCHANT_DETAIL_DROPPED")
        .otherwise("FINAL_VALUE_MISMATCH")
    )
    code = F.when(lost, "DECIMAL_SEPARATOR_LOST").when(reordered, "SEMANTIC_EQUIVALENCE").when(F.col("equal"), F.lit(None)).when(F.col("_empty"), "FINAL_VALUE_MISMATCH").otherwise(wrong)
    return step.select(*rows.columns, "equal", code.alias("code"))


def item_causes(rows: DataFrame) -> DataFrame:
    """Rows (sample, item, truth, model, final, text) with causes, an array of (code, field), and `failed`.

    truth, model and final are structs (name, quantity, unit_price, total_amount) of one item as it is, as the model
    told it and as it came out; null where a side lacks it.  A row of a model's or a final
    item alone is one that nothing matches.  Columns that `read_texts` has added are used as they are.
    """
    fields = ("quantity", "unit_price", "total_amount")
    step = _read(rows).withColumn("_seen", F.coalesce("model", "final"))

    def read(bare: Column) -> Column:
        return F.coalesce((bare != "") & F.contains(F.col("words"), bare), F.lit(False))

    # Names are made bare once; those that are told alike needn't be again.
    bared = lambda name: F.when(name == F.col("truth.name"), F.col("_truth")).otherwise(compact(name))
    step = step.withColumn("_truth", compact(F.col("truth.name"))).withColumns({"_seen_name": bared(F.col("_seen.name")), "_final_name": bared(F.col("final.name"))})
    step = step.withColumn("_named", read(F.col("_truth")))
    here, seen = F.col("truth").isNotNull(), F.col("_seen").isNotNull()
    alone = ~here & F.col("model").isNotNull()
    name = F.coalesce(F.col("model.name"), F.lit(""))
    extra = F.when(name.rlike(DISCOUNT_ITEM), "DISCOUNT_AS_ITEM").when(name.rlike(TOTAL_ITEM), "TOTAL_ROW_AS_ITEM").when(~read(F.col("_seen_name")) & ~_among(F.col("numbers"), F.col("model.total_amount")), "LLM_HALLUCINATION").otherwise("EXTRA_ITEM")
    causes = [
        (here & F.col("model").isNull(), F.when(F.col("_named"), "ITEM_MISSING").otherwise("ITEM_TEXT_MISSING"), None),
        (here & seen & _confused(F.col("_truth"), F.col("_seen_name")) & read(F.col("_seen_name")), F.lit("OCR_CHARACTER_CONFUSION"), "name"),
        (here & F.coalesce(F.col("truth.name") != F.col("final.name"), F.lit(False)) & (F.col("_truth") != "") & (F.col("_truth") == F.col("_final_name")), F.lit("SEMANTIC_EQUIVALENCE"), "name"),
        (alone, extra, None),
        (here & F.col("model").isNotNull() & F.col("final").isNull(), F.lit("POSTPROCESSING_DROPPED_CORRECT_ITEM"), None),
        (~here & F.col("model").isNull() & F.col("final").isNotNull(), F.lit("POSTPROCESSING_ADDED_UNSUPPORTED_ITEM"), None),
    ]
    for f in fields:
        expected, got = F.col(f"truth.{f}"), F.col(f"_seen.{f}")
        lost = F.lit(f == "quantity") & separator_lost(expected, got) & _among(F.col("numbers"), expected)
        causes.append((here & expected.isNotNull() & F.col("_named") & ~_among(F.col("numbers"), expected), F.lit("OCR_NUMBER_ERROR"), f))
        causes.append((here & seen & expected.isNotNull() & ~same_amount(expected, got) & ~lost, F.lit(ITEM_CODES[f]), f))
        causes.append((here & seen & lost, F.lit("DECIMAL_SEPARATOR_LOST"), f))
    each = [F.when(condition, F.struct(code.alias("code"), F.lit(field).cast("string").alias("field"))) for condition, code, field in causes]
    failed = here & F.col("final").isNull()
    for f in fields:
        failed |= here & F.col(f"truth.{f}").isNotNull() & ~same_amount(F.col(f"truth.{f}"), F.col(f"final.{f}"))
    told = step.withColumn("causes", F.array_compact(F.array(*each)))
    plain = F.size(F.filter("causes", lambda c: c["code"] != "SEMANTIC_EQUIVALENCE")) == 0
    left = F.array_compact(F.array(*[F.when(failed & plain & F.coalesce(~same_amount(F.col(f"truth.{f}"), F.col(f"final.{f}")), F.lit(False)), F.struct(F.lit("ITEM_FIELD_MISMATCH").alias("code"), F.lit(f).alias("field"))) for f in fields]))
    return told.select(*rows.columns, F.concat("causes", left).alias("causes"), F.coalesce(failed, F.lit(False)).alias("failed"))


def sum_causes(finals: DataFrame) -> DataFrame:
    """Rows (sample, item_amounts, total, discount, supply, tax, names) with causes: sums of the result that don't agree, and names it has twice."""
    item_sum = F.aggregate("item_amounts", F.lit(0.0), lambda s, a: s + F.coalesce(a, F.lit(0.0)))
    step = finals.withColumn("_s", item_sum)
    off = (F.size("item_amounts") > 0) & (F.abs(F.col("_s") - F.col("total")) >= 0.01) & (F.abs(F.col("_s") - F.coalesce("discount", F.lit(0.0)) - F.col("total")) >= 0.01)
    split = ((F.col("supply") != 0) | (F.col("tax") != 0)) & (F.abs(F.col("supply") + F.col("tax") - F.col("total")) > 10)
    bare = F.filter(F.transform("names", compact), lambda n: n != "")
    twice = F.size(bare) > F.size(F.array_distinct(bare))
    each = [F.when(c, F.lit(code)) for c, code in ((off, "ITEM_SUM_MISMATCH"), (split, "SUPPLY_TAX_MISMATCH"), (twice, "DUPLICATE_ITEM"))]
    return step.select(*finals.columns, F.array_compact(F.array(*each)).alias("causes"))


def attribute(fields: DataFrame, items: DataFrame, finals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tags (sample, category, code, scope, field, confidence, decision), and reports (sample, status, primary_category, needs_review, tags).

    `fields`, `items` and `finals` are what field_causes, item_causes and sum_causes take.  Only a sample with a wrong
    field or item, or a tag that isn't about spelling, has failed; others keep tags of spelling alone.
    A failed sample without a tag is UNKNOWN.  The primary category has most tags, the first by name of equals.
    """
    summary, told, sums = field_causes(fields), item_causes(items), sum_causes(finals)
    of_fields = summary.select("sample", F.col("code"), F.lit("sample").alias("scope"), "field", (~F.col("equal")).alias("wrong")).withColumn("early", F.col("code").isin("DECIMAL_SEPARATOR_LOST", "SEMANTIC_EQUIVALENCE"))
    scope = F.concat(F.lit("items["), F.col("item").cast("string"), F.lit("]"))
    of_items = told.select("sample", scope.alias("scope"), "failed", F.explode_outer("causes").alias("c")).select("sample", F.col("c.code").alias("code"), "scope", F.col("c.field").alias("field"), F.col("failed").alias("wrong"), F.col("c.code").eqNullSafe("OCR_CHARACTER_CONFUSION").alias("_confusion"))
    of_items = of_items.select("sample", "code", "scope", "field", (F.col("wrong") | F.col("_confusion")).alias("wrong"), F.col("code").isin("DECIMAL_SEPARATOR_LOST", "SEMANTIC_EQUIVALENCE").alias("early"))
    of_sums = sums.select("sample", F.explode("causes").alias("code"), F.lit("sample").alias("scope"), F.lit(None).cast("string").alias("field"), F.lit(False).alias("wrong"), F.lit(False).alias("early"))
    every = of_fields.select("sample", "code", "scope", "field", "wrong", "early").union(of_items).union(of_sums)
    # Dealt by sample once: what is told of one stands in one row.
    found = every.groupBy("sample").agg(F.max("wrong").alias("failed"), F.collect_set(F.when(F.col("code").isNotNull(), F.struct("code", "scope", "field", "early"))).alias("causes"))
    kept = found.withColumn("causes", F.when(F.col("failed"), F.col("causes")).otherwise(F.filter("causes", lambda c: c["early"])))
    unknown = F.array(F.struct(F.lit("UNKNOWN").alias("code"), F.lit("sample").alias("scope"), F.lit(None).cast("string").alias("field"), F.lit(False).alias("early")))
    kept = kept.withColumn("causes", F.when(F.col("failed") & (F.size("causes") == 0), unknown).otherwise(F.col("causes")))
    tags = kept.select("sample", F.inline("causes")).select("sample", tagged(F.col("code"), F.col("scope"), F.col("field")).alias("t")).select("sample", "t.*")

    stage, sure = (F.create_map(*[F.lit(x) for code, told in CAUSES.items() for x in (code, told[i])]) for i in (0, 1))
    counted = kept.withColumns({"_stages": F.transform("causes", lambda c: stage[c["code"]]), "needs_review": F.exists("causes", lambda c: sure[c["code"]] < AUTO)})
    most = F.array_min(F.transform(F.array_distinct("_stages"), lambda s: F.struct((-F.size(F.filter("_stages", lambda t: t == s))).alias("n"), s.alias("category"))))
    reports = counted.select("sample", F.when(F.col("failed"), "FAILED").otherwise("SUCCESS").alias("status"), most["category"].alias("primary_category"), F.coalesce("needs_review", F.lit(False)).alias("needs_review"), F.coalesce(F.size("causes").cast("long"), F.lit(0)).alias("tags"))
    return tags, reports
