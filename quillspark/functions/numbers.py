"""Numbers: lenient casts, money, rounding rules, tax, scores, vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_number(value: Column) -> Column:
    """A double from text with commas, currency or blanks; null if there is none."""
    return F.regexp_replace(value.cast("string"), r"[,\s원₩]", "").try_cast("double")


def number_or_zero(value: Column) -> Column:
    """As `as_number`, but null and unreadable are 0: how scoring compares amounts."""
    return F.coalesce(as_number(value), F.lit(0.0))


def parse_money(token: Column) -> Column:
    """Whole units of a token: its digits, whatever stands between or around them; 0 without any."""
    return F.coalesce(F.nullif(F.regexp_replace(token.cast("string"), r"\D", ""), F.lit("")).try_cast("long"), F.lit(0))


def half_even(value: Column, places: int = 0) -> Column:
    """Round ties to even."""
    return F.bround(value, places)


def half_up(value: Column) -> Column:
    """Round ties up."""
    return F.floor(value + 0.5)


def tax_split(total: Column, rate: float) -> Column:
    """Struct of supply and tax: a tenth of the total, ties up, at rate 0.1; no tax at rate 0."""
    tax = half_up(total * rate)
    return F.struct((total - tax).alias("supply"), tax.alias("tax"))


def inclusive_tax(total: Column) -> Column:
    """The tax part of a total that includes a tenth: an eleventh, ties to even."""
    return half_even(total / 11)


def separator_lost(a: Column, b: Column) -> Column:
    """Whether one positive number is the other times a thousand."""
    return F.coalesce((a > 0) & (b > 0) & ((F.abs(a * 1000 - b) < 0.01) | (F.abs(b * 1000 - a) < 0.01)), F.lit(False))


def speed_score(mean_ms: Column, p95_ms: Column) -> Column:
    """0 to 3 points for a mean under two minutes, 1 at most if the 95th percentile is over three; 0 without a mean."""
    points = F.greatest(F.lit(0.0), F.least(F.lit(3.0), (120 - mean_ms / 1000) / 30))
    return F.when(mean_ms.isNull(), 0.0).when(p95_ms > 180_000, F.least(points, F.lit(1.0))).otherwise(points)


def sigmoid(value: Column) -> Column:
    """Logistic function."""
    return 1 / (1 + F.exp(-value))


def dot(a: Column, b: Column) -> Column:
    """Sum of products of two vectors, in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Length of a vector."""
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors within 0 and 1; null if either has no length."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(dot(a, b), norm(a) * norm(b))))


def resolve_operands(values: Column) -> Column:
    """Struct of quantity, unit and amount if exactly one order of three numbers fits quantity times unit; else null."""
    orders = [(0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)]
    each = F.array(*[F.struct(values[i].alias("quantity"), values[j].alias("unit"), values[k].alias("amount")) for i, j, k in orders])
    fits = F.array_distinct(F.filter(each, lambda x: (F.abs(x["quantity"] * x["unit"] - x["amount"]) <= 1) & (x["quantity"] == F.floor(x["quantity"])) & x["quantity"].between(1, 100) & (x["quantity"] <= x["unit"])))
    return F.when((F.size(values) == 3) & (F.size(fits) == 1), fits[0])
