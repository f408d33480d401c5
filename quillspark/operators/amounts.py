"""Amounts that a receipt's labels give, where each was said, and how sure the total is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import MONEY
from quillspark.operators.receipts import TOLERANCE

# The labels of each amount, lines from which on only the final payment counts, and words of the kind of tax.
TAXED = "(?:부가세과세(?:물품|상품)?(?:가액|금액|합계|매출|액)|과세(?:물품|상품)?(?:가액|금액|합계|매출|액))"
LABELLED = {
    "supply_amount": "공급(?:가액|액)",
    "taxable_supply_amount": TAXED,
    "tax_exempt_amount": "면세(?:물품|상품)?(?:가액|금액|합계|매출|액)",
    "tax_amount": "(?:부가가치세(?!법)|부가세(?:액|포함)?(?!과세|면세)|(?<!과)세액|VAT)",
    "total_amount": r"(?:(?:최종)?카드(?:결제|승인)(?:금액|액)?|(?:최종|총)?결제(?:금액|요금|액)?|승인금액|받을금액|구매금액|총액|합계금액|TOTAL(?:\(INCL\.?VAT\))?)",
    "discount_amount": "(?:총할인(?:금액|액)?|할인금액)",
    "rounding_adjustment": "(?:절사금액|절삭금액|반올림)",
}
FINAL = "최종카드|최종결제|카드전표|신용카드매출전표"
AMOUNT = r"(-?\d{1,3}(?:[,.]\d{3})+|-?\d{1,8})(?:원)?(?![\d*xX])"
MIXED = "과세.{0,8}면세|면세.{0,8}과세"
ALL_EXEMPT = "전액면세|면세전용|면세상품|도서.*면세|면세.*도서"
WORDS = "array<struct<value: long, line: int>>"


def _said(field: str) -> Column:
    """The amounts after a field's labels, with their lines, in the lines that count."""
    pattern = F.lit(f"(?i){LABELLED[field]}[()\\[\\]:：]*{AMOUNT}")
    of_line = F.transform("_lines", lambda line, i: F.transform(F.regexp_extract_all(line, pattern, 1), lambda v: F.struct(F.regexp_replace(v, "[,.]", "").try_cast("long").alias("value"), i.alias("line"))))
    return F.filter(F.flatten(of_line), lambda s: s["line"] >= F.col("_from")).cast(WORDS)


def amount_evidence(receipts: DataFrame) -> DataFrame:
    """Receipts (id, text, ...) with final, conflicts, and a struct (value, line, said, labelled) for each of LABELLED.

    An amount counts on its label's own line, blanks apart.  If a line tells of the final payment and an amount
    of it follows, only what stands from there on counts.  Several different amounts of a label conflict and
    give no value; `line` is where the value was said first and `said` how often, `labelled` whether the label is there at all.
    """
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), r"\r?\n"), lambda s: F.regexp_replace(s, r"(?U)\s+", ""))
    step = receipts.withColumn("_lines", lines).withColumn("_from", F.lit(0))
    anchors = F.filter(F.transform("_lines", lambda line, i: F.when(line.rlike(FINAL), i)), lambda i: i.isNotNull())
    step = step.withColumns({"_anchor": F.get(anchors, F.lit(0)), "_total": _said("total_amount")})
    final = F.coalesce(F.exists("_total", lambda s: s["line"] >= F.col("_anchor")), F.lit(False))
    step = step.withColumn("final", final).withColumn("_from", F.when(F.col("final"), F.col("_anchor")).otherwise(0))
    step = step.withColumns({f"_{f}": _said(f) for f in LABELLED})

    def told(field: str) -> Column:
        said = F.col(f"_{field}")
        values = F.array_distinct(F.transform(said, lambda s: s["value"]))
        label = F.exists(F.slice("_lines", F.col("_from") + 1, F.size("_lines")), lambda line: line.rlike(f"(?i){LABELLED[field]}"))
        return F.struct(F.when(F.size(values) == 1, values[0]).alias("value"), F.when(F.size(values) == 1, said[0]["line"]).alias("line"), F.size(said).alias("said"), label.alias("labelled"))

    conflicts = F.array_compact(F.array(*[F.when(F.size(F.array_distinct(F.transform(f"_{f}", lambda s: s["value"]))) > 1, F.lit(f)) for f in LABELLED]))
    return step.select(*receipts.columns, "final", conflicts.alias("conflicts"), *[told(f).alias(f) for f in LABELLED])


def total_confidence(evidence: DataFrame) -> DataFrame:
    """What amount_evidence gives, of receipts with model_total and item_amounts, with total, support, confirmed and treatment.

    The total is the labelled one, else the model's.  It is confirmed if its label says it, without a conflict, or
    if the text has it as any amount (not the tax) and the model or the items' sum agree.  treatment is
    MIXED, EXEMPT, TAXABLE or UNKNOWN, by the amounts of either kind and what the text says of them.
    """
    explicit = F.col("total_amount.value").cast("double")
    total = F.coalesce(explicit, F.col("model_total"))
    amounts = F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(MONEY), 0), lambda v: F.regexp_replace(v, "[,.]", "").try_cast("double"))
    items = F.aggregate("item_amounts", F.lit(0.0), lambda s, a: s + a)
    whole = (F.size("item_amounts") > 0) & ~F.exists("item_amounts", lambda a: a.isNull() | (a < 0))
    step = evidence.withColumns({"total": total, "_seen": F.array_contains(amounts, total) & ~F.coalesce(total == F.col("tax_amount.value"), F.lit(False)), "_sum": F.coalesce(whole & (F.abs(items - total) <= TOLERANCE), F.lit(False)), "_explicit": explicit})
    said = F.coalesce(F.col("_explicit") == F.col("total"), F.lit(False))
    support = F.when(F.col("total") >= 0, F.array_compact(F.array(F.when(said, "EXPLICIT_PAYMENT_OCR"), F.when(F.col("model_total") == F.col("total"), "LLM_TOTAL"), F.when(~said & F.col("_seen"), "OCR_AMOUNT_CANDIDATE"), F.when(F.col("_sum"), "ITEM_SUM"))))
    step = step.withColumn("support", F.coalesce(support, F.array().cast("array<string>")))
    sure = ~F.array_contains("conflicts", "total_amount") & (F.array_contains("support", "EXPLICIT_PAYMENT_OCR") | (F.array_contains("support", "OCR_AMOUNT_CANDIDATE") & (F.size("support") >= 2)))
    taxed, exempt = F.col("taxable_supply_amount.value"), F.col("tax_exempt_amount.value")
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s+", "")
    both = F.when(taxed.isNotNull() & exempt.isNotNull(), (taxed > 0) & (exempt > 0)).otherwise(plain.rlike(MIXED))
    free = plain.rlike(ALL_EXEMPT) | F.coalesce((exempt == F.col("total")) & (F.coalesce(taxed, F.lit(0)) == 0) & (F.coalesce(F.col("tax_amount.value"), F.lit(0)) == 0), F.lit(False))
    some = F.coalesce(taxed > 0, F.lit(False)) | F.coalesce(F.col("tax_amount.value") > 0, F.lit(False))
    return step.select(*evidence.columns, "total", "support", sure.alias("confirmed"), F.when(both, "MIXED").when(free, "EXEMPT").when(some, "TAXABLE").otherwise("UNKNOWN").alias("treatment"))
