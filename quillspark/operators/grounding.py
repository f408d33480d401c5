"""Receipt items grounded in what was read where: names found in cells, the numbers beside them, and items aligned with rows."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.text import all_but
from quillspark.operators.lines import receipt_lines
from quillspark.operators.receipts import close_pairs, may_reach, ratio

# What Unicode has for blanks, a number with its unit, product codes, what isn't an item, and the heads of columns.
BLANKS = r"[ \t-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
NUMBER = r"(?i)^[₩￦]?(-?(?:\d{1,3}(?:[,.]\d{3})+|\d+)(?:\.\d+)?)(개|ea|원)?$"
GROUPED = r"^-?\d{1,3}(?:[,.]\d{3})+$"
PRODUCT_CODE = r"^0\d{4,}$"
NOT_ITEM = r"(?i)할인|쿠폰|취소|반품|환불|공급가액|부가세|과세|면세|합계|소계|결제|승인|사업자|카드|현금|subtotal|total"
HEADERS = {
    "name": r"^(?:상품명|품명|품목|메뉴|메뉴명|제품명|상품)$",
    "quantity": r"(?i)^(?:수량|qty)$",
    "unit_price": r"(?i)^(?:단가|판매가|unitprice)$",
    "total_amount": r"(?i)^(?:금액|합계|amount)$",
    "discount": r"^(?:할인|할인액)$",
}
# Least likeness of a name, least confidence of its cells and of numbers, and margins that tell two candidates apart.
ALIKE, NAME_CONFIDENCE, NUMBER_CONFIDENCE, MARGIN = 0.88, 0.8, 0.85, 0.12
ROW_ALIKE, SHORT_NAME, LARGEST = 0.8, 4, 100_000_000
#: Cells that a name is put together from, and items of a receipt that are aligned.
NAME_CELLS, ITEMS = 4, 50
FIELDS = ("quantity", "unit_price", "total_amount")


def bare(text: Column) -> Column:
    """Lower case without blanks."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, ""))


def name_key(name: Column) -> Column:
    """What names are compared by: letters, digits and syllables; the l of a volume that was read as 1 is put right."""
    return F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(name, F.lit("")), r"(?i)(?<=\d)m1\b", "ml")), f"{all_but('a-z0-9')}+", "")


def cell_number(text: Column) -> Column:
    """A cell's number; null for product codes, other texts and numbers beyond LARGEST."""
    return token_number(bare(text))


def token_number(token: Column) -> Column:
    """As `cell_number`, of a text that is `bare`."""
    digits = F.regexp_extract(token, NUMBER, 1)
    # A cast that fails costs an exception, so only what is a number comes to it.
    value = F.when(digits != "", F.when(digits.rlike(GROUPED), F.regexp_replace(digits, "[,.]", "")).otherwise(F.replace(digits, F.lit(","), F.lit("")))).try_cast("double")
    return F.when(~token.rlike(PRODUCT_CODE) & (F.abs(value) <= LARGEST), value)


def likeness(a: Column, b: Column, least: float) -> Column:
    """Ratcliff-Obershelp similarity of two texts that may reach `least`; 0 for those that by length or letters can't."""
    open_ = (a != b) & may_reach(a, b, least)
    return F.when(a == b, 1.0).otherwise(F.coalesce(ratio(F.when(open_, a), F.when(open_, b)), F.lit(0.0)))


def judged_cells(cells: DataFrame) -> DataFrame:
    """As `read_cells`, with every row and what else it has, and with `told`: whether a cell has a text and a box with an area."""
    said = cells.withColumn("_token", bare(F.col("text")))
    token = F.col("_token")
    said = said.withColumns({"told": F.coalesce((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")) & (token != ""), F.lit(False)), "value": token_number(token)})
    # What is a number has no letters but its unit's: it is neither a head nor a label.
    text = F.col("value").isNull()
    role = F.coalesce(*[F.when(text & token.rlike(pattern), role) for role, pattern in HEADERS.items()])
    said = said.withColumns(
        {
            "confidence": F.coalesce("confidence", F.lit(1.0)), "pieces": token.rlike(r"(?:개|ea)$"), "role": role, "excluded": text & token.rlike(NOT_ITEM),
            "x": (F.col("x0") + F.col("x1")) / 2, "y": (F.col("y0") + F.col("y1")) / 2, "h": F.col("y1") - F.col("y0"),
        }
    ).drop("_token")
    letters = F.length(F.regexp_replace(F.lower("text"), f"{all_but('a-z')}+", "")) >= 2
    named = text & ~F.col("excluded") & letters
    return said.withColumn("named", named).withColumn("key", F.when(F.col("named"), name_key(F.col("text"))))


def read_cells(cells: DataFrame) -> DataFrame:
    """Cells (receipt, cell, text, confidence, x0, y0, x1, y1) with value, pieces, role, excluded, x, y and h; cells without a text or a box with an area go.

    `named` are those that may bear a name; `key` is what names are compared by.
    """
    return judged_cells(cells).where("told").drop("told")


def held_cell() -> Column:
    """Struct of what is held of a cell that was read."""
    return F.struct("cell", "text", "key", "confidence", "x0", "x1", "x", "y", "h", "value", "pieces", "role", "excluded", "named")


def asked_item(item: Column) -> Column:
    """Struct of what is held of an item (index, name, quantity, unit_price, total_amount); `key` is null if its name can't be an item's."""
    key = name_key(item["name"])
    return F.struct(*[item[f].alias(f) for f in ("index", *FIELDS)], F.when((F.length(key) >= 2) & ~bare(item["name"]).rlike(NOT_ITEM), key).alias("key"))


def upright(pages: DataFrame) -> DataFrame:
    """Pages (receipt, cells) with cells that have their `level`: how far down they stand on a receipt that isn't tilted.

    The tilt is the median slope from the first name header to the heads right of it and near; 0 beyond a fifth or without.
    """
    heads = F.filter("cells", lambda c: c["role"].isNotNull())
    first = F.array_min(F.transform(F.filter("_heads", lambda c: c["role"] == "name"), lambda c: F.struct(c["cell"], c["x"], c["y"], c["h"])))
    peers = F.filter("_heads", lambda c: (c["role"] != "name") & (c["x"] > F.col("_name.x")) & (F.abs(c["y"] - F.col("_name.y")) <= 3 * F.greatest(c["h"], F.col("_name.h"))))
    slope = _median(F.transform(peers, lambda c: (c["y"] - F.col("_name.y")) / (c["x"] - F.col("_name.x"))))
    found = pages.withColumn("_heads", heads).withColumn("_name", first).withColumn("_s", slope)
    found = found.withColumns({"_slope": F.when(F.abs("_s") <= 0.2, F.col("_s")).otherwise(0.0), "_origin": F.coalesce("_name.x", F.lit(0.0))})
    return found.withColumn("cells", F.transform("cells", lambda c: c.withField("level", c["y"] - F.col("_slope") * (c["x"] - F.col("_origin"))))).drop("_name", "_s", "_slope", "_origin")


def _median(values: Column) -> Column:
    """Median of an array's numbers; null if it has none."""
    middle = lambda v: (F.get(v, ((F.size(v) - 1) / 2).cast("int")) + F.get(v, (F.size(v) / 2).cast("int"))) / 2
    return F.get(F.transform(F.filter(F.array(F.sort_array(values)), lambda v: F.size(v) > 0), middle), F.lit(0))


def lined(pages: DataFrame, kinds: dict[str, Column]) -> DataFrame:
    """Pages with an array for each of `kinds`, of arrays of cells: the lines that cells of this kind stand on, each from left to right."""
    fields = ("x0", "cell", "x", "level", "h", "confidence", "text", "key", "value", "pieces", "role", "x1")
    held = pages.withColumns({f"_of_{k}": F.transform(cells, lambda c: F.struct(*[c[n].alias(n) for n in fields])) for k, cells in kinds.items()})
    placed = held.withColumns({f"_in_{k}": receipt_lines(F.transform(f"_of_{k}", lambda c: F.struct(*[c[n].cast("double").alias(n) for n in ("level", "h", "x0", "x1")], c["cell"].alias("cell")))) for k in kinds})

    def lines(kind: str) -> Column:
        return F.transform(f"_in_{kind}", lambda line: F.sort_array(F.transform(line, lambda i: F.get(f"_of_{kind}", i))))

    found = {k: lines(k) for k in kinds}
    return placed.withColumns(found).drop(*[f"_{p}_{k}" for p in ("of", "in") for k in kinds])


def columns_of(lines: Column) -> Column:
    """Array of (role, x): the middles of heads, of the first line with a name's and another head; null without one."""
    heads = F.transform(lines, lambda line: F.filter(line, lambda c: c["role"].isNotNull()))

    def rightmost(line: Column, role: str) -> Column:
        held = F.filter(line, lambda c: c["role"] == role)
        return F.when(F.size(held) > 0, F.struct(F.lit(role).alias("role"), F.try_element_at(held, F.lit(-1))["x"].alias("x")))

    anchors = F.transform(F.filter(heads, lambda line: F.size(line) > 1), lambda line: F.array_compact(F.array(*[rightmost(line, role) for role in HEADERS])))
    return F.get(F.filter(anchors, lambda line: (F.size(line) >= 2) & F.exists(line, lambda a: a["role"] == "name")), F.lit(0))


def name_windows(lines: Column) -> Column:
    """Array of (key, y, h, ids) of every run of up to NAME_CELLS neighbouring cells that were read surely enough, by line and place, the shorter first."""
    part = lambda line, start, width: F.slice(line, start, width)
    runs = F.flatten(F.transform(lines, lambda line: F.flatten(F.transform(F.sequence(F.lit(1), F.size(line)), lambda start: F.transform(F.sequence(F.lit(1), F.least(F.lit(NAME_CELLS), F.size(line) - start + 1)), lambda width: part(line, start, width))))))
    sure = F.filter(runs, lambda run: ~F.exists(run, lambda c: c["confidence"] < NAME_CONFIDENCE))
    return F.transform(sure, lambda run: F.struct(F.array_join(run["key"], "").alias("key"), _median(run["level"]).alias("y"), _median(run["h"]).alias("h"), run["cell"].alias("ids")))


def match_names(asked: DataFrame) -> DataFrame:
    """Items (i, item, windows, pairs: places and scores of items and windows that are alike) with `match`, the window that bears the item's name, and why there is none: `_name_reason`.

    A window matches from ALIKE on, names of under SHORT_NAME letters only if equal.  The best is
    taken, of equals the first by line and place, unless one elsewhere comes within MARGIN.
    """
    own = F.filter("pairs", lambda p: p["i"] == F.col("i"))
    best = F.array_min(F.transform("_own", lambda p: F.struct((-p["score"]).alias("cost"), p["j"].alias("j"), p["score"].alias("score"))))
    step = asked.withColumn("_own", own).withColumn("_best", best).withColumn("_window", F.get("windows", F.col("_best.j")))
    rival = F.exists("_own", lambda p: (F.col("_best.score") - p["score"] < MARGIN) & ~F.arrays_overlap(F.get("windows", p["j"])["ids"], F.col("_window.ids")))
    reason = F.when(F.col("item.key").isNull(), "unsupported_item_name").when(F.col("_best").isNull(), "name_not_grounded").when(rival, "ambiguous_name").otherwise("matched")
    return step.withColumn("_name_reason", reason).withColumn("match", F.when(F.col("_name_reason") == "matched", F.col("_window"))).drop("_own", "_best", "_window", "windows", "pairs")


def beside(matched: DataFrame) -> DataFrame:
    """Items (match, numbers: rows (line, y, least_confidence, cells), labels: levels) with line, cells and `_row_reason`.

    The nearest row of numbers from 0.55 heights over the name to 1.4 under it, unless the next is
    nearer than 0.35 heights to it, one of its numbers is unsure, or a label of sums or
    discounts stands within 0.75 heights of it.
    """
    y, h = F.col("match.y"), F.col("match.h")
    near = F.filter("numbers", lambda r: (r["y"] - y >= -0.55 * h) & (r["y"] - y <= 1.4 * h))
    two = F.slice(F.sort_array(F.transform(near, lambda r: F.struct(F.abs(r["y"] - y).alias("away"), r["line"].alias("line"), r["y"].alias("row_y"), r["least_confidence"].alias("least_confidence"), r["cells"].alias("cells")))), 1, 2)
    step = matched.withColumn("_two", F.when(F.col("match").isNotNull(), two))
    first, second = F.get("_two", F.lit(0)), F.get("_two", F.lit(1))
    spoilt = F.exists("labels", lambda level: F.abs(level - first["row_y"]) <= 0.75 * h)
    reason = F.when(F.coalesce(F.size("_two"), F.lit(0)) <= 0, "no_nearby_numbers").when(second["away"] - first["away"] < 0.35 * h, "ambiguous_numeric_row").when(first["least_confidence"] < NUMBER_CONFIDENCE, "low_numeric_confidence").when(spoilt, "summary_or_discount_row").otherwise("matched")
    step = step.withColumn("_row_reason", reason)
    return step.withColumns({"line": F.when(F.col("_row_reason") == "matched", first["line"]), "cells": F.when(F.col("_row_reason") == "matched", first["cells"])}).drop("_two", "numbers", "labels")


def resolve_rows(rows: DataFrame) -> DataFrame:
    """Rows (cells, anchors as of `columns_of`, height and other columns) with `resolved`: reason, quantity, unit_price and total_amount.

    A number in pieces is the quantity; others belong to the column whose head is within two
    heights, and half a height nearer than the next.  Three numbers are needed of which
    exactly one order has quantity times price the amount and agrees with the columns.
    """
    heads = F.coalesce(F.filter("anchors", lambda e: e["role"] != "name"), F.array().cast("array<struct<role: string, x: double>>"))
    away = F.transform("cells", lambda c: F.array_sort(F.transform("_heads", lambda e: F.struct(F.abs(c["x"] - e["x"]).alias("away"), e["role"].alias("role")))))
    told = F.zip_with("_away", "cells", lambda d, c: F.struct(F.when(c["pieces"], "quantity").otherwise(_nearest(d, F.col("height"))).alias("role"), c["value"].alias("value")))
    kinds = (*FIELDS, "discount")

    def values_of(kind: str) -> Column:
        return F.transform(F.filter("_told", lambda t: t["role"] == kind), lambda t: t["value"])

    step = rows.withColumn("_heads", heads).withColumn("_away", away).withColumn("_told", told)
    step = step.withColumns({f"_{k}": values_of(k) for k in kinds} | {"_usable": F.filter(F.transform("cells", lambda c: c["value"]), lambda v: v > 0)})
    q, u, a = (F.get(f"_{f}", F.lit(0)) for f in FIELDS)
    orders = [(0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)]
    each = F.array(*[F.struct(*[F.get("_usable", F.lit(i)).alias(f) for f, i in zip(FIELDS, order, strict=True)]) for order in orders])
    step = step.withColumns({"_q": q, "_u": u, "_a": a, "_orders": each})

    def fits(x: Column) -> Column:
        whole = (x["quantity"] > 0) & (x["quantity"] <= 100) & (x["quantity"] == F.floor(x["quantity"])) & (F.abs(x["quantity"] * x["unit_price"] - x["total_amount"]) <= 1)
        for f, given in zip(FIELDS, ("_q", "_u", "_a"), strict=True):
            whole &= F.coalesce(F.col(given) == x[f], F.lit(True))
        return whole

    step = step.withColumn("_fit", F.array_distinct(F.filter("_orders", fits)))
    twice = F.greatest(*[F.size(f"_{k}") for k in kinds]) > 1
    reason = (
        F.when((F.size("cells") > 4) | F.exists("cells", lambda c: c["value"] < 0), "complex_or_negative_row")
        .when(twice, "ambiguous_column")
        .when(F.get("_discount", F.lit(0)) != 0, "discounted_row")
        .when((F.col("_q") <= 0) | (F.col("_q") > 100) | (F.col("_q") != F.floor("_q")), "invalid_quantity")
        .when(F.size("_usable") != 3, "insufficient_numeric_evidence")
        .when(F.size("_fit") != 1, "arithmetic_conflict_or_ambiguity")
        .otherwise("unique_arithmetic_with_geometry")
    )
    step = step.withColumn("_reason", F.when(F.col("cells").isNotNull(), reason))
    sure = F.col("_reason") == "unique_arithmetic_with_geometry"
    return step.select(*rows.columns, F.struct(F.col("_reason").alias("reason"), *[F.when(sure, F.col("_fit")[0][f]).alias(f) for f in FIELDS]).alias("resolved"))


def _nearest(distances: Column, height: Column) -> Column:
    first, second = F.get(distances, F.lit(0)), F.get(distances, F.lit(1))
    return F.when((first["away"] <= 2 * height) & F.coalesce(second["away"] - first["away"] >= 0.5 * height, F.lit(True)), first["role"])


def consistent(row: dict[str, Column]) -> Column:
    """Whether quantity times price is the amount, none negative."""
    q, u, a = (row[f] for f in FIELDS)
    return F.coalesce((q > 0) & (u >= 0) & (a >= 0) & (F.abs(q * u - a) <= 1), F.lit(False))


def ground_items(cells: DataFrame, items: DataFrame) -> DataFrame:
    """Items (receipt, index, name, quantity, unit_price, total_amount) with reason, line, and the fields that the receipt itself shows.

    An item whose numbers agree stays as it is (`model_arithmetic_consistent`).  Another gets
    those of the row beside its name, if name and row are beyond doubt and the row's numbers
    agree in one way only; a row that two items claim, or that an item in agreement
    stands on, goes to none (`shared_numeric_row`).  `corrected` says whether a field changed.
    Receipts without cells, null ones too, ground no name.  A receipt's cells and items are few and stand in one row, so
    they are dealt out by receipt and nothing else; receipts spread by key.
    """
    pages = read_cells(cells).groupBy("receipt").agg(F.collect_list(held_cell()).alias("cells"))
    # Items of null receipts may be many: they needn't stand in one row.
    apart = F.when(F.col("receipt").isNull(), F.hash("index", "name"))
    asked = items.select("receipt", apart.alias("_apart"), asked_item(F.struct("index", "name", *FIELDS)).alias("item")).groupBy("receipt", "_apart").agg(F.collect_list("item").alias("items"))
    return ground_listed(asked.join(pages.hint("merge"), "receipt", "left"))


def ground_listed(receipts: DataFrame) -> DataFrame:
    """As `ground_items`, of rows (receipt, items, cells): arrays of what `asked_item` and `held_cell` make; no cells where the receipt is null."""
    page = upright(receipts)
    headed = F.exists("_heads", lambda c: c["role"] == "name") & F.exists("_heads", lambda c: c["role"] != "name")
    kinds = {"names": F.filter("cells", lambda c: c["named"]), "_numbers": F.filter("cells", lambda c: c["value"].isNotNull()), "_lines": F.when(headed, F.col("cells"))}
    # Made by a generator, windows stay apart from the function that takes them: Spark doesn't plan one function in another's place.
    page = lined(page, kinds).select("*", F.explode(F.array(name_windows(F.col("names")))).alias("windows"))
    numbers = F.transform("_numbers", lambda cells, line: F.struct(line.alias("line"), _median(cells["level"]).alias("y"), F.array_min(cells["confidence"]).alias("least_confidence"), cells.alias("cells")))
    labels = F.transform(F.filter("cells", lambda c: c["excluded"] & c["role"].isNull()), lambda c: c["level"])
    page = page.select(
        "receipt", "items", "windows", close_pairs(F.col("items.key"), F.col("windows.key"), ALIKE, SHORT_NAME).alias("pairs"),
        numbers.alias("numbers"), labels.alias("labels"), columns_of(F.col("_lines")).alias("anchors"), _median(F.col("cells.h")).alias("height"),
    )

    found = beside(match_names(page.select("receipt", F.posexplode("items").alias("i", "item"), "windows", "pairs", "numbers", "labels", "anchors", "height")))
    agrees = consistent({f: F.col(f"item.{f}") for f in FIELDS})
    rows = resolve_rows(found.withColumn("_agrees", agrees).withColumn("cells", F.when(~F.col("_agrees"), F.col("cells"))))
    own = F.when(F.col("_name_reason") != "matched", F.col("_name_reason")).when(F.col("_row_reason") != "matched", F.col("_row_reason")).otherwise(F.coalesce("resolved.reason", F.lit("name_not_grounded")))
    reasoned = rows.select("receipt", "item.*", "line", F.col("resolved").alias("_n"), F.when(F.col("_agrees"), "model_arithmetic_consistent").otherwise(own).alias("reason"))
    holds = F.col("line").isNotNull() & F.col("reason").isin("model_arithmetic_consistent", "unique_arithmetic_with_geometry")
    reasoned = reasoned.withColumn("_claims", F.count_if(holds).over(Window.partitionBy("receipt", "line")))
    proposed = (F.col("reason") == "unique_arithmetic_with_geometry") & (F.col("_claims") == 1)
    reason = F.when((F.col("reason") == "unique_arithmetic_with_geometry") & ~proposed, "shared_numeric_row").otherwise(F.col("reason"))
    fields = {f: F.when(proposed, F.col(f"_n.{f}")).otherwise(F.col(f)) for f in FIELDS}
    changed = F.lit(False)
    for f in FIELDS:
        changed |= ~fields[f].eqNullSafe(F.col(f))
    return reasoned.select("receipt", "index", reason.alias("reason"), F.when(F.col("reason") != "model_arithmetic_consistent", F.col("line")).alias("line"), *[c.alias(f) for f, c in fields.items()], changed.alias("corrected"))


def aligned(options: list[tuple[int, int, int, float]]) -> dict[int, tuple[int, float]]:
    """Rows of items, from candidates (item, row, page, score) within the margin of each item's best.

    An item with one good candidate has it.  Another gets the only free candidate between the
    rows of the nearest items before and after it that have a row of their own, all on one page.
    """
    of: dict[int, list[tuple[int, int, float]]] = {}
    for item, row, page, score in sorted(options):
        of.setdefault(item, []).append((row, page, score))
    settled = {i: rows[0] for i, rows in of.items() if len(rows) == 1 and rows[0][2] >= ALIKE}
    used = Counter(row for row, _, _ in settled.values())
    for item in of:
        alone = [i for i, (row, _, _) in settled.items() if used[row] == 1]
        before, after = max((i for i in alone if i < item), default=None), min((i for i in alone if i > item), default=None)
        if item in settled or before is None or after is None:
            continue
        (low, page, _), (high, other, _) = settled[before], settled[after]
        free = [r for r in of[item] if low < r[0] < high and not used[r[0]] and r[1] == page == other]
        if len(free) == 1:
            settled[item] = free[0]
            used[free[0][0]] += 1
    return {i: (row, score) for i, (row, _, score) in settled.items()}


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("row", T.IntegerType()), T.StructField("score", T.DoubleType())])))
def _rows_of(indexes: pa.Array, options: pa.Array) -> pa.Array:
    """For each item of a receipt its row and score, from candidates (i, row, page, score); null without one."""
    told = []
    for own, each in zip(indexes.to_pylist(), options.to_pylist(), strict=True):
        best: dict[int, float] = {}
        for o in each or []:
            best[o["i"]] = max(o["score"], best.get(o["i"], 0.0))
        found = aligned([(o["i"], o["row"], o["page"], o["score"]) for o in each or [] if best[o["i"]] - o["score"] < MARGIN])
        told.append([{"row": found[i][0], "score": found[i][1]} if i in found else None for i in own])
    return pa.array(told, pa.list_(pa.struct([("row", pa.int32()), ("score", pa.float64())])))


def told_item(index: Column, name: Column) -> Column:
    """Struct of an item's index, and of what its name is compared by; null if it isn't aligned."""
    key = name_key(name)
    return F.struct(index.alias("index"), F.when((index < ITEMS) & (F.length(key) >= 2), key).alias("key"))


def told_row(row: Column, page: Column, name: Column) -> Column:
    """Struct of a row's number and page, and of what its name is compared by."""
    key = name_key(name)
    return F.struct(row.cast("int").alias("row"), page.cast("int").alias("page"), F.when(F.length(key) >= 2, key).alias("key"))


def align_listed(receipts: DataFrame) -> DataFrame:
    """As `align_items`, of rows (receipt, items, rows): arrays of what `told_item` and `told_row` make."""
    pairs = receipts.withColumn("_pairs", close_pairs(F.col("items.key"), F.col("rows.key"), ROW_ALIKE, SHORT_NAME))

    def option(p: Column) -> Column:
        row = F.get("rows", p["j"])
        return F.struct(F.get("items", p["i"])["index"].cast("int").alias("i"), row["row"].alias("row"), row["page"].alias("page"), p["score"].alias("score"))

    # Made by a generator, options stay apart from the function that takes them: Spark doesn't plan one function in another's place.
    options = pairs.select("receipt", "items", F.explode(F.array(F.transform("_pairs", option))).alias("_options"))
    found = options.withColumn("_found", _rows_of(F.col("items.index"), F.col("_options")))
    each = F.transform("items", lambda x, k: F.struct(x["index"].alias("index"), F.get("_found", k)["row"].alias("row"), F.get("_found", k)["score"].alias("score")))
    return found.select("receipt", F.inline(each))


def align_items(items: DataFrame, rows: DataFrame) -> DataFrame:
    """Items (receipt, index, name) with row and score: each of the first ITEMS aligned with rows (receipt, row, page, name), by names and order.

    Null for items without a row.  A candidate scores ROW_ALIKE or more, names of under SHORT_NAME
    letters only if equal, and comes within MARGIN of the item's best.  A receipt's items and rows are few and stand in one row.
    """
    # Items of null receipts may be many: they needn't stand in one row.
    apart = F.when(F.col("receipt").isNull(), F.hash("index", "name"))
    asked = items.select("receipt", apart.alias("_apart"), told_item(F.col("index"), F.col("name")).alias("item")).groupBy("receipt", "_apart").agg(F.collect_list("item").alias("items"))
    held = rows.select("receipt", told_row(F.col("row"), F.col("page"), F.col("name")).alias("row")).groupBy("receipt").agg(F.collect_list("row").alias("rows"))
    return align_listed(asked.join(held.hint("merge"), "receipt", "left"))
