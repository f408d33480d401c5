"""Receipts: evidence in their texts, amounts, categories, and scores against the truth."""

from __future__ import annotations

import difflib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.text import MONEY, compact

# Categories, names that they had, and the kind of document each belongs to.
CATEGORIES = ("외식/식사", "카페/음료", "식품/장보기", "생활용품", "의류/패션", "취미/선물", "미용/뷰티", "도서", "전자제품/문구", "대중교통", "주유/차량", "의료", "문화", "레저/스포츠")
FORMER = {
    "교통비": "대중교통", "여비교통비": "대중교통", "차량유지비": "주유/차량", "도서인쇄비": "도서", "도서인쇄": "도서", "복리후생": "외식/식사", "복리후생비(간식)": "식품/장보기",
    "복리후생비(식대)": "외식/식사", "출장식비": "외식/식사", "출장식대": "외식/식사", "출장식사": "외식/식사", "회의비": "외식/식사", "교통": "대중교통", "주유/교통": "주유/차량",
    "미용": "미용/뷰티", "미용/생활": "미용/뷰티", "뷰티/쇼핑": "미용/뷰티", "전자제품": "전자제품/문구", "식비": "외식/식사", "식비/주류": "식품/장보기", "식비/생활": "식품/장보기",
    "생활/식비": "식품/장보기", "식비/쇼핑": "식품/장보기", "식품/쇼핑": "식품/장보기", "생활/쇼핑": "생활용품", "의류/쇼핑": "의류/패션", "꽃/식물": "취미/선물", "취미/쇼핑": "취미/선물",
    "레저": "레저/스포츠", "비품비": "전자제품/문구", "소모품비": "전자제품/문구", "비품": "전자제품/문구", "소모품": "전자제품/문구", "사무용품": "전자제품/문구",
}
TRAVEL, PURCHASE = ("대중교통", "주유/차량"), ("생활용품", "의류/패션", "취미/선물", "전자제품/문구")
# How receipts tell what was paid with, what isn't about paying, and words of payments.
NOT_PAYING = "환불|반품|교환|혜택|프로모션|적립|할인행사|가능|안내|미발급|발급불가|발급대상"
BY_CARD = r"신용카드|신용[.·]?승인|체크카드|카드(?:결제|승인|번호)|(?:신한|현대|삼성|롯데|국민|하나|우리|농협|비씨|bc)카드|credit|debit"
BY_CASH = r"현금영수증|현금(?:결제|수납)|(?<![a-z])cash(?![a-z])"
PAYMENTS = {"cash": ("cash", "현금", "현금결제"), "credit_card": ("creditcard", "card", "카드", "신용카드", "카드결제", "법인카드"), "debit_card": ("debitcard", "checkcard", "체크카드"), "bank_transfer": ("banktransfer", "transfer", "계좌이체", "이체")}
# Words before an item's name that praise it, and tokens that don't count.
PRAISE = r"(?i)^\s*\+?\s*(?:(?:초강추|강추|추천|best)\s*[:：\-]?\s*)+"
IGNORED = ("diy", "도안", "상품", "제품", "best", "추천", "강추", "초강추", "오리지널")
#: Points of a receipt's parts; they add up to 100.
RUBRIC = {"merchant": 8, "transaction_date": 8, "supply_amount": 5, "tax_amount": 5, "discount_amount": 5, "total_amount": 15, "payment_method": 5, "item_name_f1": 12, "item_unit_price": 8, "item_quantity": 8, "item_total_amount": 11, "category": 10}
TOLERANCE = 10.0


def _bare(text: str) -> str:
    return "".join(c for c in text.lower() if c.isascii() and c.isalnum() or "가" <= c <= "힣")


def canonical_category(value: Column) -> Column:
    """The present name of a category, separators and case apart; null for unknown ones."""
    names = {_bare(c): c for c in CATEGORIES}
    known = {_bare(old): new for old, new in FORMER.items()} | names
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), compact(value))


def document_type(category: Column) -> Column:
    """The kind of document that a present category belongs to; null for none."""
    return F.when(category.isin(*TRAVEL), "TRAVEL_EXPENSE").when(category.isin(*PURCHASE), "PURCHASE_REQUEST").when(category.isin(*CATEGORIES), "WELFARE_BENEFIT")


def payment_from_text(text: Column) -> Column:
    """Struct of method and reason: card or cash if a receipt's lines tell of one alone."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda s: F.lower(F.regexp_replace(s, r"(?U)\s+", "")))
    told = F.filter(lines, lambda s: (s != "") & ~s.rlike(NOT_PAYING) & ~s.rlike(r"(?:카드|현금|cash)(?:결제|금액)?[:：]?(?:0|0\.00)원?$"))
    card = F.exists(told, lambda s: s.rlike(BY_CARD) | s.rlike(r"^카드(?:[:：]?[0-9,]+원?)?$"))
    cash = F.exists(told, lambda s: s.rlike(BY_CASH) | s.rlike(r"^현금(?:[:：]?[0-9,]+원?)?$"))
    return F.struct(F.when(card & ~cash, "카드").when(cash & ~card, "현금").alias("method"), F.when(card & cash, "CONFLICT").when(card | cash, "UNIQUE").otherwise("MISSING").alias("reason"))


def canonical_payment(value: Column) -> Column:
    """A payment method's standard name; other texts in lower case with single blanks."""
    bare = compact(value)
    named = F.coalesce(*[F.when(bare.isin(*words), name) for name, words in PAYMENTS.items()])
    loose = F.when(bare.rlike("체크카드|checkcard|debitcard"), "debit_card").when(bare.rlike("카드승인|카드결제|카드$|card$"), "credit_card")
    return F.coalesce(named, loose, F.trim(F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), r"(?U)\s+", " ")))


def item_name(value: Column) -> Column:
    """An item's name without list number, words of praise and product codes; its spelling stays."""
    text = F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"(?U)\s+", " "))
    text = F.regexp_replace(text, r"^\s*\d{1,3}\s*[).:\-]\s*", "")
    plain = F.regexp_replace(text, PRAISE, "")
    plain = F.when(text.rlike(PRAISE), F.regexp_replace(plain, r"(?i)^\s*오리지널\s+", "")).otherwise(plain)
    return F.trim(F.regexp_replace(plain, r"(?i)\s+(?:[A-Z]{1,5}\d{6,}|\d{8,})\s*$", ""))


def item_tokens(value: Column) -> Column:
    """Distinct numbers and words of an item's name that say what it is."""
    return _tokens(item_name(value))


def _tokens(name: Column) -> Column:
    return F.filter(F.array_distinct(F.regexp_extract_all(F.lower(name), F.lit(r"[0-9]+(?:[.,][0-9]+)?|[a-z]+|[가-힣]+"), 0)), lambda t: ~t.isin(*IGNORED))


def preflight(text: Column) -> Column:
    """Why a receipt's text should be reviewed before it is read."""
    clean = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    return F.array_compact(F.array(F.when(F.length(clean) < 40, "OCR_TEXT_TOO_SHORT"), F.when(~clean.rlike(MONEY), "NO_MONEY_EVIDENCE"), F.when(F.length(clean) > 20_000, "OCR_TEXT_TOO_DENSE")))


def labelled_amount(text: Column, label: str) -> Column:
    """Struct of value and conflict: the one amount that follows a label on its line; several values conflict and give none."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda s: F.regexp_replace(s, r"(?U)\s+", ""))
    pattern = rf"(?i){label}[()\[\]:：]*(-?\d{{1,3}}(?:[,.]\d{{3}})+|-?\d{{1,8}})(?:원)?(?![\d*xX])"
    said = F.flatten(F.transform(lines, lambda s: F.regexp_extract_all(s, F.lit(pattern), 1)))
    values = F.array_distinct(F.transform(said, lambda a: F.regexp_replace(a, "[,.]", "").try_cast("long")))
    return F.struct(F.when(F.size(values) == 1, values[0]).alias("value"), (F.size(values) > 1).alias("conflict"))


def reconcile_amounts(total: Column, supply: Column, tax: Column, exempt: Column, taxed: Column, confirmed: Column) -> Column:
    """Struct of supply, tax and basis, filled from a confirmed total where one side or both lack.

    The missing one of supply and tax is the rest of the total.  Where both lack, an exempt
    receipt is all supply, and a taxed one holds an eleventh of tax, ties to even.  Nothing is
    filled from a total that isn't confirmed, and what is given stays.
    """
    both, neither = supply.isNotNull() & tax.isNotNull(), supply.isNull() & tax.isNull()
    usable = F.coalesce(confirmed, F.lit(False)) & total.isNotNull()
    eleventh = F.bround(total / 11)
    basis = F.when(both, "GIVEN").when(~usable, "UNRESOLVED").when(supply.isNotNull(), "TAX_IS_REST").when(tax.isNotNull(), "SUPPLY_IS_REST").when(exempt, "EXEMPT").when(taxed, "ELEVENTH").otherwise("UNRESOLVED")
    filled_tax = F.when(basis == "TAX_IS_REST", total - supply).when(basis == "EXEMPT", F.lit(0.0)).when(basis == "ELEVENTH", eleventh).otherwise(tax)
    filled_supply = F.when(basis == "SUPPLY_IS_REST", total - tax).when(basis == "EXEMPT", total).when(basis == "ELEVENTH", total - eleventh).otherwise(supply)
    return F.struct(filled_supply.alias("supply"), filled_tax.alias("tax"), basis.alias("basis"))


def amount_relation(total: Column, supply: Column, tax: Column, discount: Column) -> Column:
    """How supply and tax relate to the total: after the discount, before it, not at all, or not to be told."""
    off = F.abs(supply + tax - total)
    before = F.abs(supply + tax - discount - total)
    known = supply.isNotNull() & tax.isNotNull() & total.isNotNull()
    return F.when(~known, "NOT_CHECKABLE").when(off <= TOLERANCE, "AFTER_DISCOUNT").when((F.coalesce(discount, F.lit(0.0)) != 0) & (before <= TOLERANCE), "BEFORE_DISCOUNT").otherwise("MISMATCH")


def item_reasons(items: Column, total: Column, discount: Column) -> Column:
    """Why items (quantity, unit_price, total_amount) should be reviewed against their receipt's total; each reason once."""
    amounts = F.filter(F.transform(items, lambda x: x["total_amount"]), lambda a: a >= 0)
    item_sum = F.aggregate(amounts, F.lit(0.0), lambda s, a: s + a)
    whole = F.size(amounts) == F.size(items)
    less = F.coalesce(discount, F.lit(0.0))
    off = F.least(F.abs(item_sum - total), F.abs(item_sum - total - less))
    odd = F.exists(items, lambda x: F.coalesce(F.abs(x["quantity"] * x["unit_price"] - x["total_amount"]) > 1, F.lit(False)))
    some = F.size(items) > 0
    return F.array_compact(
        F.array(
            F.when(some & ~whole, "ITEM_TOTALS_INCOMPLETE"),
            F.when(some & (F.size(amounts) > 0) & ((whole & (off > TOLERANCE)) | (item_sum - total - less > TOLERANCE)), "ITEM_SUM_TOTAL_MISMATCH"),
            F.when(odd, "ITEM_ARITHMETIC_MISMATCH"),
        )
    )


@lru_cache(maxsize=1 << 16)
def _ratio(x: str, y: str) -> float:
    return difflib.SequenceMatcher(None, x, y).ratio()


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of two texts; null where either is.  A worker keeps those of the pairs that it met last: names come again on many receipts."""
    return pd.Series([None if x is None or y is None else _ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def may_reach(a: Column, b: Column, least: float) -> Column:
    """Whether the similarity of two texts can be `least` by their lengths and letters: false only where `ratio` is less."""
    common = F.least(F.length(a) - F.length(F.call_function("translate", a, b, F.lit(""))), F.length(b) - F.length(F.call_function("translate", b, a, F.lit(""))))
    return 2 * common >= F.lit(least) * (F.length(a) + F.length(b)) - 1e-9


#: Pairs of texts that a worker looks at together.
PAIRS = 1 << 19


def _close(keys: pa.Array, others: pa.Array, least: float, short: int) -> pa.Array:
    """What `close_pairs` gives for arrays of lists.  Lengths and letters, which bound the similarity, leave few pairs to be compared."""
    sizes = [pc.list_value_length(c).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in (keys, others)]
    row = np.repeat(np.arange(len(sizes[0])), sizes[0])
    first, second = np.cumsum(sizes[0]) - sizes[0], np.cumsum(sizes[1]) - sizes[1]
    told = pa.concat_arrays([keys.flatten(), others.flatten()]).dictionary_encode()
    texts = told.dictionary.to_pylist()
    code = told.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    left, right, count = code[: len(row)], code[len(row) :], len(texts)
    length = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = np.bincount(np.repeat(np.arange(count), length) * 64 + points % 64, minlength=count * 64).reshape(count, 64).astype(np.uint16 if len(points) < 1 << 16 else np.int64)

    wide = sizes[1][row]
    ends = np.cumsum(wide)
    at, scores = [np.empty(0, np.int64)] * 2, np.empty(0)
    found, begin = [(*at, scores)], 0
    while begin < len(row):
        stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + PAIRS, side="right")))
        mine = wide[begin:stop]
        i = np.repeat(np.arange(begin, stop), mine)
        j = np.arange(len(i)) - np.repeat(np.cumsum(mine) - mine, mine)
        a, b = left[i], right[j + second[row[i]]]
        both = (a >= 0) & (b >= 0)
        score = np.where(both & (a == b), 1.0, 0.0)
        fewer, more = np.minimum(length[a], length[b]), np.maximum(length[a], length[b])
        open_ = np.flatnonzero(both & (a != b) & (fewer >= short) & (2 * fewer >= least * (fewer + more) - 1e-9))
        pairs, back = np.unique(a[open_] * count + b[open_], return_inverse=True)
        x, y = np.divmod(pairs, max(1, count))
        may = np.flatnonzero(2 * np.minimum(letters[x], letters[y]).sum(axis=1, dtype=np.int64) >= least * (length[x] + length[y]) - 1e-9)
        alike = np.zeros(len(pairs))
        alike[may] = [_ratio(texts[m], texts[n]) for m, n in zip(x[may].tolist(), y[may].tolist(), strict=True)]
        score[open_] = alike[back]
        kept = np.flatnonzero((score >= least) & both)
        found.append((i[kept], j[kept], score[kept]))
        begin = stop
    i, j, score = map(np.concatenate, zip(*found, strict=True))
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row[i], minlength=len(sizes[0])))])
    each = pa.StructArray.from_arrays([pa.array((i - first[row[i]]).astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(score)], names=["i", "j", "score"])
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), each)


def close_pairs(keys: Column, others: Column, least: float, short: int = 0) -> Column:
    """Array of structs i, j, score: the pairs of two arrays' texts, by their places from 0, with a `ratio` of `least` or more.

    Equal texts score 1; those of under `short` letters make no other pairs, and null ones none.
    """

    @F.arrow_udf(T.ArrayType(T.StructType([T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("score", T.DoubleType())])))
    def close(a: pa.Array, b: pa.Array) -> pa.Array:
        return _close(a, b, least, short)

    return close(keys, others)


def same_number(a: Column, b: Column) -> Column:
    """Equal to two decimals; null is 0."""
    return F.round(F.coalesce(a, F.lit(0.0)), 2) == F.round(F.coalesce(b, F.lit(0.0)), 2)


def with_forms(rows: DataFrame, name: str) -> DataFrame:
    """Rows with what item names are compared by: `_text`, `_bare` (compact), `_digits` and `_words`; each step is taken once."""
    number = r"^[0-9]+(?:[.,][0-9]+)?$"
    step = rows.withColumn("_name", item_name(F.col(name))).withColumns({"_text": F.lower("_name"), "_tokens": _tokens(F.col("_name"))})
    step = step.withColumns({"_bare": compact(F.col("_text")), "_digits": F.array_sort(F.filter("_tokens", lambda w: w.rlike(number))), "_words": F.filter("_tokens", lambda w: ~w.rlike(number))})
    return step.drop("_name", "_tokens")


def names_match(a: Column, b: Column, alike: Column) -> Column:
    """Whether two items' names, structs of `with_forms`, mean the same: equal, alike, one within the other, or mostly of the same words; unequal numbers never."""
    clash = (F.size(a["digits"]) > 0) & (F.size(b["digits"]) > 0) & (a["digits"] != b["digits"])
    within = (F.least(F.length(a["bare"]), F.length(b["bare"])) >= 2) & (F.contains(a["bare"], b["bare"]) | F.contains(b["bare"], a["bare"]))
    fewer = F.least(F.size(a["words"]), F.size(b["words"]))
    overlap = (fewer >= 2) & (F.size(F.array_intersect(a["words"], b["words"])) >= 0.75 * fewer)
    open_ = (a["text"] != "") & (b["text"] != "") & ~clash
    return (a["text"] == b["text"]) | (open_ & (alike | within | overlap))


def _paired(expected: DataFrame, said: DataFrame, key: str) -> DataFrame:
    """(key, n_expected, n_said, taken): how many items either side has, and the pairs of them, for each key of either."""
    fields = ("name", "quantity", "unit_price", "total_amount")

    def listed(rows: DataFrame, index: str, side: str) -> DataFrame:
        forms = with_forms(rows.select(key, index, "name", *[F.round(F.coalesce(f, F.lit(0.0)), 2).alias(f) for f in fields[1:]]), "name")
        each = F.struct(F.col(index).cast("int").alias("at"), *[F.col(f"_{f}").alias(f) for f in ("text", "bare", "digits", "words")], *fields[1:])
        # Items without a key meet no other: they are counted only.
        return forms.groupBy(key).agg(F.count("*").alias(f"n_{side}"), F.collect_list(F.when(F.col(key).isNotNull(), each)).alias(side))

    held = listed(expected, "index", "expected").join(listed(said, "said_index", "said").hint("merge"), key, "full_outer")
    held = held.withColumn("_alike", close_pairs(F.col("expected.bare"), F.col("said.bare"), 0.72))
    held = held.withColumn("_alike", F.transform("_alike", lambda p: p["i"].cast("long") * F.size("said") + p["j"]))

    def pair(x: Column, i: Column, y: Column, j: Column) -> Column:
        return F.struct(x["at"].alias("index"), y["at"].alias("said_index"), names_match(x, y, F.array_contains("_alike", i.cast("long") * F.size("said") + j)).alias("name"), *[(x[f] == y[f]).alias(f) for f in fields[1:]])

    pairs = F.flatten(F.transform("expected", lambda x, i: F.transform("said", lambda y, j: pair(x, i, y, j))))
    score = lambda p: 3 * p["name"].cast("int") + p["quantity"].cast("int") + p["unit_price"].cast("int") + p["total_amount"].cast("int")
    held = held.withColumn("_pairs", pairs).withColumn("_pairs", F.sort_array(F.transform("_pairs", lambda p: F.struct(score(p).alias("score"), p["index"].alias("index"), p["said_index"].alias("said_index"), *[p[f].alias(f) for f in fields])), False))
    kind = "array<struct<score: int, index: int, said_index: int, name: boolean, quantity: boolean, unit_price: boolean, total_amount: boolean>>"
    free = lambda acc, x: ~F.exists(acc, lambda y: (y["index"] == x["index"]) | (y["said_index"] == x["said_index"]))
    taken = F.aggregate(F.col("_pairs").cast(kind), F.array().cast(kind), lambda acc, x: F.when(free(acc, x), F.concat(acc, F.array(x))).otherwise(acc))
    return held.select(key, *[F.coalesce(f"n_{side}", F.lit(0)).alias(f"n_{side}") for side in ("expected", "said")], taken.alias("taken"))


def match_items(expected: DataFrame, said: DataFrame, key: str) -> DataFrame:
    """(key, index, said_index, name, quantity, unit_price, total_amount): the pairs of items and which fields agree.

    `expected` numbers a receipt's items by index, `said` by said_index.

    Pairs of a receipt score 3 for the name and 1 for each equal number.  They are taken from
    the highest score on, each item once; of equal scores the higher indexes come first, and
    pairs without any agreement are taken too.  A receipt's items are few, so they stand in one
    row, and its pairs are sorted and folded in one array.
    """
    fields = ("name", "quantity", "unit_price", "total_amount")
    return _paired(expected, said, key).select(key, F.explode("taken").alias("m")).select(key, "m.index", "m.said_index", *[f"m.{f}" for f in fields])


def item_scores(expected: DataFrame, said: DataFrame, key: str) -> DataFrame:
    """(key, n_expected, n_said, name_f1, unit_price, quantity, total_amount): shares of expected items that agree; two empty lists agree fully."""
    e, s = F.col("n_expected"), F.col("n_said")
    right = lambda f: F.when(F.col("taken").isNotNull(), F.size(F.filter("taken", lambda m: m[f]))).otherwise(0)
    share = lambda f: F.when(e > 0, right(f) / e).when(s > 0, 0.0).otherwise(1.0)
    f1 = F.when(e + s > 0, 2 * right("name") / (e + s)).otherwise(1.0)
    return _paired(expected, said, key).select(key, e, s, f1.alias("name_f1"), *[share(f).alias(f) for f in ("unit_price", "quantity", "total_amount")])


def rubric_points(parts: dict[str, Column]) -> Column:
    """Points out of 100 from the share of each part of RUBRIC; a part that lacks or is null gives none."""
    return sum((F.coalesce(parts[name].cast("double"), F.lit(0.0)) * weight for name, weight in RUBRIC.items() if name in parts), F.lit(0.0))
