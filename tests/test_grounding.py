"""Lines of cells and grounded items against plain Python."""

from __future__ import annotations

import difflib
import random
import re
from collections import Counter, defaultdict
from statistics import median

import pyarrow as pa
import pytest

from quillspark.operators import grounding as N
from quillspark.operators import lines as L
from quillspark.operators import receipts as R
from quillspark.plans import grounding as plans


def brute_lines(cells, back, share, least, middle, overlap=None, by_top=True, least_height=1.0):
    """cells: (cell, x0, y0, x1, y1), of one page; the lines as lists of cells."""
    lines = []
    top = lambda c: c[2] if by_top else (c[2] + c[4]) / 2
    for c in sorted((c for c in cells if None not in c), key=lambda c: (top(c), c[1], c[0])):
        y, h = (c[2] + c[4]) / 2, max(least_height, c[4] - c[2])
        for line in reversed(lines[-back:]):
            ys, hs = [(m[2] + m[4]) / 2 for m in line], [max(least_height, m[4] - m[2]) for m in line]
            if middle == "mean":
                at = ys[0]
                for n, v in enumerate(ys[1:], 2):
                    at = (at * (n - 1) + v) / n
                high = max(hs)
            else:
                at, high = (ys[0], hs[0]) if middle == "first" else (median(ys), median(hs))
            clash = overlap is not None and any(min(c[3], m[3]) - max(c[1], m[1]) > overlap * min(c[3] - c[1], m[3] - m[1]) for m in line)
            if abs(at - y) <= max(least, share * min(high, h)) and not clash:
                line.append(c)
                break
        else:
            lines.append([c])
    return lines + [[c] for c in sorted((c for c in cells if None in c), key=lambda c: (c[1] is None, c[1] or 0, c[0]))]


RULES = [(L.TEXT, (4, 0.65, 5.0, "mean")), (L.PRIVATE, (4, 0.7, 5.0, "first")), (L.RECEIPT, (3, 0.75, 0.0, "median", 0.25, False, 0.0))]


@pytest.mark.parametrize(("rule", "terms"), RULES)
def test_lines_of_the_whole_table(spark, sf, rule, terms):
    cells = plans._cells(spark, sf)
    pages = defaultdict(list)
    for r in cells.collect():
        pages[r["page"]].append((r["cell"], r["x0"], r["y0"], r["x1"], r["y1"]))
    found = defaultdict(lambda: defaultdict(list))
    for r in L.visual_lines(cells, "page", "cell", rule).collect():
        found[r["page"]][r["line"]].append((r["cell"], r["x0"], r["y0"], r["x1"], r["y1"]))
    assert len(found) == len(pages)
    for page, held in pages.items():
        assert [sorted(found[page][i]) for i in range(len(found[page]))] == [sorted(line) for line in brute_lines(held, *terms)], page


@pytest.mark.parametrize(("rule", "terms"), RULES)
def test_lines_of_odd_pages(spark, rule, terms):
    """Null pages, cells without boxes, equal places, equal rows, clashing column names and a long page."""
    rng = random.Random(7)
    rows = [(p, i, *((None, None, None, None) if i % 13 == 5 else (x := rng.randrange(40), y := rng.randrange(60) / 2, x + 9, y + rng.randrange(1, 12)))) for p in (None, 1, 2) for i in range(120)]
    rows += [(1, 500, 3, 7.0, 9, 12.0)] * 3 + [(3, i, i % 7 * 10, i // 7 * 4.0, i % 7 * 10 + 9, i // 7 * 4.0 + 10) for i in range(4000)]
    cells = spark.createDataFrame([(p, i, *map(lambda v: None if v is None else float(v), b), "t", "n") for p, i, *b in rows], "page int, cell int, x0 double, y0 double, x1 double, y1 double, text string, _line string")
    pages = defaultdict(list)
    for p, *c in rows:
        pages[p].append(tuple(c))
    found = defaultdict(lambda: defaultdict(list))
    for r in L.visual_lines(cells, "page", "cell", rule).collect():
        found[r["page"]][r["line"]].append((r["cell"], r["x0"], r["y0"], r["x1"], r["y1"]))
    for page, held in pages.items():
        assert [Counter(found[page][i]) for i in range(len(found[page]))] == [Counter(line) for line in brute_lines(held, *terms)], page
    assert L.visual_lines(cells.limit(0), "page", "cell", rule).collect() == []


def test_line_texts(spark):
    cells = spark.createDataFrame([(1, 1, 5.0, " b ", 0), (1, 2, 1.0, "a", 0), (1, 3, None, "last", 0), (1, 4, 0.0, " ", 1), (2, 5, 0.0, None, 0)], "page int, cell int, x0 double, text string, line int")
    assert [tuple(r) for r in L.line_texts(cells, "page", "cell").collect()] == [(1, 0, "a | b | last")]


# The receipts' rules once more, over lists.


def number(text):
    token = re.sub(r"\s+", "", text).lower()
    m = re.fullmatch(r"[₩￦]?(-?(?:\d{1,3}(?:[,.]\d{3})+|\d+)(?:\.\d+)?)(개|ea|원)?", token)
    if not m or re.fullmatch(r"0\d{4,}", token):
        return None
    n = float(re.sub("[,.]", "", m[1]) if re.fullmatch(r"-?\d{1,3}(?:[,.]\d{3})+", m[1]) else m[1].replace(",", ""))
    return (n, m[2] in ("개", "ea")) if abs(n) <= 1e8 else None


def key_of(name):
    return re.sub("[^a-z0-9가-힣]", "", re.sub(r"(?<=\d)m1\b", "ml", name, flags=re.IGNORECASE).lower())


NOT_ITEM = re.compile("할인|쿠폰|합계|결제|카드|total", re.IGNORECASE)
HEADS = {"품명": "name", "수량": "quantity", "단가": "unit_price", "금액": "total_amount", "할인": "discount"}


def brute_ground(cells, items):
    """(index, reason, fields) of a receipt's items."""
    mid = lambda c: ((c["x0"] + c["x1"]) / 2, (c["y0"] + c["y1"]) / 2)
    heads = [c for c in cells if c["text"] in HEADS]
    name = next((c for c in sorted(heads, key=lambda c: c["cell"]) if HEADS[c["text"]] == "name"), None)
    slope = origin = 0.0
    if name:
        origin = mid(name)[0]
        slopes = [(mid(c)[1] - mid(name)[1]) / (mid(c)[0] - origin) for c in heads if HEADS[c["text"]] != "name" and mid(c)[0] > origin and abs(mid(c)[1] - mid(name)[1]) <= 30]
        slope = median(slopes) if slopes and abs(median(slopes)) <= 0.2 else 0.0
    level = lambda c: mid(c)[1] - slope * (mid(c)[0] - origin)

    def rows(kept):
        straight = [(c["cell"], c["x0"], level(c) - 5, c["x1"], level(c) + 5) for c in kept]
        by_id = {c["cell"]: c for c in kept}
        return [sorted((by_id[c[0]] for c in line), key=lambda c: (c["x0"], c["cell"])) for line in brute_lines(straight, 3, 0.75, 0.0, "median", 0.25, False, 0.0)]

    names = rows([c for c in cells if number(c["text"]) is None and len(re.findall("[a-z가-힣]", c["text"].lower())) >= 2 and not NOT_ITEM.search(c["text"].replace(" ", ""))])
    numbers = rows([c for c in cells if number(c["text"])])
    anchors = {HEADS[c["text"]]: mid(c)[0] for c in heads} if name else {}
    windows = [(r, s, row[s : s + w]) for r, row in enumerate(names) for s in range(len(row)) for w in range(1, min(4, len(row) - s) + 1)]
    found = {}
    for item in items:
        i, k = item["index"], key_of(item["name"])
        if len(k) < 2 or NOT_ITEM.search(item["name"].replace(" ", "")):
            found[i] = ("unsupported_item_name", None, None)
            continue
        hits = []
        for r, s, w in windows:
            other = key_of(" ".join(c["text"] for c in w))
            score = 1.0 if k == other else difflib.SequenceMatcher(None, k, other).ratio()
            if min(c["confidence"] for c in w) >= 0.8 and score >= 0.88 and (score == 1 or min(len(k), len(other)) >= 4):
                hits.append((-score, r, s, len(w), w))
        hits.sort(key=lambda h: h[:4])
        if not hits:
            found[i] = ("name_not_grounded", None, None)
            continue
        ids = {c["cell"] for c in hits[0][4]}
        if any(not ids & {c["cell"] for c in h[4]} and h[0] - hits[0][0] < 0.12 for h in hits):
            found[i] = ("ambiguous_name", None, None)
            continue
        y = median(level(c) for c in hits[0][4])
        near = sorted((abs(median(map(level, row)) - y), n) for n, row in enumerate(numbers) if -5.5 <= median(map(level, row)) - y <= 14.0)
        row = numbers[near[0][1]] if near else None
        if not near:
            found[i] = ("no_nearby_numbers", None, None)
        elif len(near) > 1 and near[1][0] - near[0][0] < 3.5:
            found[i] = ("ambiguous_numeric_row", None, None)
        elif min(c["confidence"] for c in row) < 0.85:
            found[i] = ("low_numeric_confidence", None, None)
        elif any(NOT_ITEM.search(c["text"].replace(" ", "")) and c["text"] not in HEADS and abs(level(c) - median(map(level, row))) <= 7.5 for c in cells):
            found[i] = ("summary_or_discount_row", None, None)
        else:
            found[i] = (*brute_fields(row, anchors, mid), near[0][1])
    claims = Counter()
    agree = {}
    for item in items:
        q, u, a = (item[f] for f in N.FIELDS)
        agree[item["index"]] = q > 0 and u >= 0 and a >= 0 and abs(q * u - a) <= 1
        reason, _, row = found[item["index"]]
        if row is not None and (agree[item["index"]] or reason == "unique_arithmetic_with_geometry"):
            claims[row] += 1
    for item in items:
        reason, fields, row = found[item["index"]]
        told = tuple(item[f] for f in N.FIELDS)
        if agree[item["index"]]:
            yield item["index"], "model_arithmetic_consistent", told
        elif reason == "unique_arithmetic_with_geometry":
            yield (item["index"], reason, fields) if claims[row] == 1 else (item["index"], "shared_numeric_row", told)
        else:
            yield item["index"], reason, told


def brute_fields(row, anchors, mid):
    values = [number(c["text"]) for c in row]
    if len(row) > 4 or any(n < 0 for n, _ in values):
        return "complex_or_negative_row", None
    roles = defaultdict(list)
    for c, (n, pieces) in zip(row, values, strict=True):
        far = sorted((abs(mid(c)[0] - x), r) for r, x in anchors.items() if r != "name")
        role = "quantity" if pieces else far[0][1] if far and far[0][0] <= 20 and far[1][0] - far[0][0] >= 5 else None
        if role:
            roles[role].append(n)
    if any(len(v) > 1 for v in roles.values()):
        return "ambiguous_column", None
    if roles.get("discount", [0])[0]:
        return "discounted_row", None
    q = roles.get("quantity", [1])[0]
    if not 0 < q <= 100 or q != int(q):
        return "invalid_quantity", None
    usable = [n for n, _ in values if n > 0]
    if len(usable) != 3:
        return "insufficient_numeric_evidence", None
    fit = set()
    for i, j in [(0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1)]:
        q, u, a = x = (usable[i], usable[j], usable[3 - i - j])
        if 0 < q <= 100 and q == int(q) and abs(q * u - a) <= 1 and all(roles.get(r, [v])[0] == v for r, v in zip(N.FIELDS, x, strict=True)):
            fit.add(x)
    return ("unique_arithmetic_with_geometry", fit.pop()) if len(fit) == 1 else ("arithmetic_conflict_or_ambiguity", None)


REASONS = {"unsupported_item_name", "name_not_grounded", "ambiguous_name", "no_nearby_numbers", "ambiguous_numeric_row", "low_numeric_confidence", "summary_or_discount_row", "complex_or_negative_row", "ambiguous_column", "discounted_row",
           "invalid_quantity", "insufficient_numeric_evidence", "arithmetic_conflict_or_ambiguity", "unique_arithmetic_with_geometry", "shared_numeric_row", "model_arithmetic_consistent"}


def test_grounded_items_of_the_whole_table(spark, sf):
    cells, items = plans.read_receipts(spark, sf)
    held, said = defaultdict(list), defaultdict(list)
    for r in cells.collect():
        held[r["receipt"]].append(r.asDict())
    for r in items.collect():
        said[r["receipt"]].append(r.asDict())
    found = {(r["receipt"], r["index"]): r for r in plans.grounded_items(spark, sf).collect()}
    assert len(found) == sum(map(len, said.values()))
    reached = Counter()
    for receipt, mine in said.items():
        for index, reason, fields in brute_ground(held[receipt], mine):
            r = found[receipt, index]
            assert (r["reason"], tuple(r[f] for f in N.FIELDS)) == (reason, fields), (receipt, index)
            reached[reason] += 1
    assert set(reached) == REASONS
    assert sum(r["corrected"] for r in found.values()) > 100


def test_grounding_of_nothing(spark):
    cells = spark.createDataFrame([], "receipt long, cell long, text string, confidence double, x0 double, y0 double, x1 double, y1 double")
    items = spark.createDataFrame([(1, 0, None, None, 2.0, 3.0), (1, 1, "tea cup", 2.0, 3.0, 6.0), (None, 2, "tea cup", 2.0, 3.0, 9.0)], "receipt long, index int, name string, quantity double, unit_price double, total_amount double")
    found = {r["index"]: r for r in N.ground_items(cells, items).collect()}
    assert {i: r["reason"] for i, r in found.items()} == {0: "unsupported_item_name", 1: "model_arithmetic_consistent", 2: "name_not_grounded"}
    assert N.ground_items(cells, items.limit(0)).collect() == []


def brute_align(items, rows):
    keys = {j: key_of(n) for j, _, n in rows}
    page = {j: p for j, p, _ in rows}
    near = {}
    for i, name in sorted(items):
        k = key_of(name)
        scored = [(j, 1.0 if k == o else difflib.SequenceMatcher(None, k, o).ratio()) for j, o in keys.items() if len(o) >= 2]
        scored = [(j, s) for j, s in scored if s >= 0.8 and (s == 1 or min(len(k), len(keys[j])) >= 4)]
        if i < 50 and len(k) >= 2 and scored:
            near[i] = [(j, s) for j, s in scored if max(s for _, s in scored) - s < 0.12]
    got = {i: o[0] for i, o in near.items() if len(o) == 1 and o[0][1] >= 0.88}
    use = Counter(j for j, _ in got.values())
    for i in sorted(near):
        if i in got:
            continue
        sure = [k for k in got if use[got[k][0]] == 1]
        if any(k < i for k in sure) and any(k > i for k in sure):
            a, b = got[max(k for k in sure if k < i)][0], got[min(k for k in sure if k > i)][0]
            open_ = [(j, s) for j, s in near[i] if a < j < b and use[j] == 0 and page[a] == page[j] == page[b]]
            if len(open_) == 1:
                got[i] = open_[0]
                use[open_[0][0]] += 1
    return got


def test_aligned_items(spark):
    """Repeated names between sure neighbours, misread ones, short ones, other pages and spare rows."""
    rng = random.Random(11)
    words = ["americano", "americano ice", "cafe latte", "latte", "tea", "te", "green tea", "cheese cake", "choco cake", "water 500ml"]
    items, rows = [], []
    for receipt in range(150):
        n = rng.randrange(2, 14)
        names = [rng.choice(words) for _ in range(n)]
        items += [(receipt, i, name) for i, name in enumerate(names)]
        rows += [(receipt, i, i // 9, name.replace("e", "c", 1) if rng.random() < 0.3 else name) for i, name in enumerate(names) if rng.random() < 0.9]
    items += [(0, 60, "water 500ml"), (500, 0, "latte")]
    found = N.align_items(spark.createDataFrame(items, "receipt int, index int, name string"), spark.createDataFrame(rows, "receipt int, row int, page int, name string")).collect()
    assert len(found) == len(items)
    bracketed = 0
    for receipt in {r for r, _, _ in items}:
        want = brute_align([(i, n) for r, i, n in items if r == receipt], [(j, p, n) for r, j, p, n in rows if r == receipt])
        got = {r["index"]: (r["row"], r["score"]) for r in found if r["receipt"] == receipt and r["row"] is not None}
        assert got == {i: (j, pytest.approx(s)) for i, (j, s) in want.items()}, receipt
        bracketed += sum(1 for i, (j, s) in want.items() if sum(n == dict((a, b) for r, a, b in items if r == receipt)[i] for r, _, n in items if r == receipt) > 1)
    assert bracketed > 10


def test_likeness_is_never_cut_where_it_counts(spark):
    rng = random.Random(3)
    rows = [("".join(rng.choices("abcde", k=rng.randrange(9))), "".join(rng.choices("abcde", k=rng.randrange(9)))) for _ in range(2000)]
    from pyspark.sql import functions as F

    for a, b, got in spark.createDataFrame(rows, "a string, b string").select("a", "b", N.likeness(F.col("a"), F.col("b"), 0.6)).collect():
        true = 1.0 if a == b else difflib.SequenceMatcher(None, a, b).ratio()
        assert got == pytest.approx(true) if true >= 0.6 else got < 0.6


def brute_table(cells):
    """(row, column, text) of a page's table, by lists."""
    cells = [dict(c, text=(c["text"] or "").strip(), x=(c["x0"] + c["x1"]) / 2, h=max(1.0, c["y1"] - c["y0"])) for c in cells]
    near = max(6.0, int(median(c["h"] for c in cells) * 0.65))
    lines = []
    for c in sorted(cells, key=lambda c: ((c["y0"] + c["y1"]) / 2, c["x0"], c["cell"])):
        y = (c["y0"] + c["y1"]) / 2
        line = next((line for line in reversed(lines[-3:]) if abs(line["y"] - y) <= near), None)
        if line:
            line["cells"].append(c)
            n = len(line["cells"])
            line["y"] = (line["y"] * (n - 1) + y) / n
        else:
            lines.append({"y": y, "cells": [c]})
    rows = [sorted(line["cells"], key=lambda c: (c["x0"], c["cell"])) for line in lines if len(line["cells"]) >= 2]
    if len(rows) < 3:
        return []
    wide = max(12.0, int(median(c["h"] for row in rows for c in row) * 1.8))
    groups = []
    for at in sorted(round(c["x"]) for row in rows for c in row):
        if groups and at - groups[-1][-1] <= wide:
            groups[-1].append(at)
        else:
            groups.append([at])
    hits = {a: n for a in (round(sum(g) / len(g)) for g in groups) if (n := sum(any(abs(c["x"] - a) <= wide for c in row) for row in rows)) >= 3}
    anchors = sorted(hits)
    if len(anchors) >= 3:
        gaps = [b - a for a, b in zip(anchors, anchors[1:], strict=False)]
        parts = [[anchors[0]]]
        for a, gap in zip(anchors[1:], gaps, strict=True):
            if median(gaps) > 0 and gap > 1.5 * median(gaps):
                parts.append([a])
            else:
                parts[-1].append(a)
        good = [p for p in parts if len(p) >= 2]
        anchors = max(good, key=lambda p: sum(hits[a] for a in p)) if good else anchors
    if not 2 <= len(anchors) <= 12:
        return []
    table = []
    for row in rows:
        filled = defaultdict(list)
        for c in row:
            k = min(range(len(anchors)), key=lambda i: abs(anchors[i] - c["x"]))
            if abs(anchors[k] - c["x"]) <= wide:
                filled[k].append(c["text"])
        if len(filled) >= 2:
            table.append({k: " ".join(t for t in v if t) for k, v in filled.items()})
    if len(table) < 3 or len({k for row in table for k, v in row.items() if v}) < 2:
        return []
    return [(i + 1, k + 1, v) for i, row in enumerate(table) for k, v in row.items()]


def test_tables_of_the_whole_table(spark, sf):
    pages = defaultdict(list)
    for r in plans.printed_tables(spark, sf).collect():
        pages[r["page"]].append(r.asDict())
    found = defaultdict(list)
    for r in plans.tables_found(spark, sf).collect():
        found[r["page"]].append((r["row"], r["column"], r["text"]))
    for page, cells in pages.items():
        assert sorted(found[page]) == sorted(brute_table(cells)), page
    assert not any(found[p] for p in pages if p % 5 == 0)
    whole = [p for p in pages if found[p] and p % 7 and p % 5]
    assert len(whole) > 300 and any("note" in str(found[p]) for p in pages) is not all("note" in str(found[p]) for p in pages if p % 3 == 0)


def test_no_tables(spark):
    cells = spark.createDataFrame([(None, 1, None, 0.0, 0.0, 1.0, 1.0), (1, 1, "a", None, 0.0, 1.0, 1.0)], "page int, cell int, text string, x0 double, y0 double, x1 double, y1 double")
    from quillspark.operators.tables import borderless_tables

    assert borderless_tables(cells).collect() == [] and borderless_tables(cells.limit(0)).collect() == []


def test_lines_hand_on_only_what_is_asked_for(spark, sf):
    from quillspark.operators.lines import TEXT, visual_lines
    from quillspark.plans.grounding import _cells

    cells = _cells(spark, sf)
    few = visual_lines(cells, "page", "cell", TEXT, keep=("page", "cell"))
    assert few.columns == ["page", "cell", "line"]
    assert few.exceptAll(visual_lines(cells, "page", "cell").select("page", "cell", "line")).isEmpty()


def test_steps_of_grounding_are_written_in_columns(spark, sf):
    from quillspark.operators.grounding import ground_items
    from quillspark.plans.grounding import read_receipts

    assert "ExistingRDD" not in ground_items(*read_receipts(spark, sf))._jdf.queryExecution().sparkPlan().toString()


def shuffles(frame):
    return frame._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_pages_are_dealt_out_once_before_and_once_after_their_lines(spark, sf):
    found = plans.tables_found(spark, sf)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert shuffles(found) == 2 and "Join" not in plan and "ExistingRDD" not in plan


def test_tables_are_dealt_out_before_their_cells(spark, sf):
    from quillspark.plans.chunks import table_texts

    plan = table_texts(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan


def test_cells_are_made_after_their_page_is_dealt_out(spark, sf):
    plan = plans.first_cell_lines(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(l_orderkey" in plan and "hashpartitioning(page" not in plan.split("MapInArrow")[1]


@pytest.mark.parametrize(("rule", "terms"), RULES)
@pytest.mark.parametrize(("at_once", "few"), [(1, 1), (7, 1), (50, 3), (1 << 17, 1), (1 << 17, 1 << 30)])
def test_pages_side_by_side_are_folded_as_each_alone(monkeypatch, rule, terms, at_once, few):
    import pyarrow as pa

    monkeypatch.setattr(L, "AT_ONCE", at_once)
    monkeypatch.setattr(L, "FEW", few)
    rnd = random.Random(at_once + few)
    rows = []
    for page in (None, 3, 4, 9, 11):
        cells = [(None if rnd.random() < 0.1 else rnd.randrange(60) / 2, rnd.randrange(1, 12) * 1.0, rnd.randrange(40) * 1.0) for _ in range(rnd.choice((1, 5, 40)))]
        rows += [(page, *c, c[2] + 9.0) for c in cells]
    key, y, h, x0, x1 = zip(*rows, strict=True)
    held = pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), *[pa.array(c, pa.float64()) for c in (y, h, x0, x1)]], names=["p", "y", "h", "x0", "x1"])
    batches = [held.slice(at, 3) for at in range(0, len(rows), 3)]
    places = [1, 2, 3, 4] if rule.overlap else [1, 2]
    found = [int(n) for _, _, lines, *_ in L._numbered(iter(batches), rule, 0, places) for n in lines]
    want, current, state = [], object(), None
    for page, *cell in zip(*[held.column(i).to_pylist() for i in (0, *places)], strict=True):
        if page != current:
            current, state = page, L.Page(rule)
        want.append(state.line(*cell))
    assert found == want


def test_line_sizes_are_those_of_the_lines(spark, sf):
    from pyspark.sql import functions as F

    cells = plans._cells(spark, sf).where("page < 300").withColumn("page", F.when(F.col("page") % 7 > 0, F.col("page") % 40)).withColumn("y0", F.when(F.col("cell") % 5 > 0, F.col("y0"))).withColumn("cell", F.when(F.col("cell") % 9 > 0, F.col("cell")))
    for rule in (L.TEXT, L.PRIVATE):
        want = L.visual_lines(cells, "page", "cell", rule).groupBy("page", "line").agg(F.count("*").alias("cells"), F.min("cell").alias("first_cell"))
        found = L.line_sizes(cells, "page", "cell", rule)
        assert found.columns == want.columns
        assert Counter((r["page"], r["line"], r["cells"]) for r in found.collect()) == Counter((r["page"], r["line"], r["cells"]) for r in want.collect())
    assert L.line_sizes(cells.limit(0), "page", "cell").collect() == []


@pytest.mark.parametrize("at_once", [1, 5, 1000])
def test_line_sizes_across_batches(spark, monkeypatch, at_once):
    import pyarrow as pa

    cells = spark.createDataFrame([(p, i, 10.0 * (i % 4), 5.0 * (i // 3), 10.0 * (i % 4) + 8, 5.0 * (i // 3) + 6) for p in (1, 2, 3) for i in range(30)], "page long, cell long, x0 double, y0 double, x1 double, y1 double").coalesce(1)
    monkeypatch.setattr(L, "AT_ONCE", at_once)
    taken = {}
    monkeypatch.setattr(type(cells), "mapInArrow", lambda self, run, kinds: taken.setdefault("f", (self, run)) and self)
    L.line_sizes(cells, "page", "cell", L.PRIVATE)
    monkeypatch.undo()
    monkeypatch.setattr(L, "AT_ONCE", at_once)
    frame, run = taken["f"]
    told = pa.Table.from_batches(list(run(iter(frame.toArrow().to_batches(max_chunksize=3))))).to_pylist()
    monkeypatch.undo()
    want = Counter((r["page"], r["line"]) for r in L.visual_lines(cells, "page", "cell", L.PRIVATE).collect())
    assert Counter({(r["page"], r["line"]): r["cells"] for r in told}) == want and len(told) == len(want)


def test_line_sizes_need_no_second_shuffle(spark, sf):
    assert shuffles(plans.first_cell_lines(spark, sf)) == 1


def test_receipts_are_dealt_out_once_for_grounding(spark, sf):
    """Cells and items come from one shuffle by receipt, nothing is written between, and only what was told is dealt out again, by row of numbers."""
    plan = plans.grounded_items(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "written-" not in plan and "Broadcast" not in plan
    assert plan.count("Exchange hashpartitioning(receipt") == 2 and plan.count("Exchange hashpartitioning(l_partkey") == 2


@pytest.mark.parametrize("wide", [1, 5, 64])
def test_lines_of_receipts_held_whole(spark, monkeypatch, wide):
    monkeypatch.setattr(L, "WIDE", wide)
    rng = random.Random(5)
    pages = [[(float(y := rng.randrange(40)), rng.randrange(1, 12) / 1.0, float(x := rng.randrange(60)), x + rng.randrange(1, 20) / 1.0, i) for i in range(rng.choice([0, 1, 3, 20, 90]))] for _ in range(60)]
    pages[7] = None
    kind = pa.list_(pa.struct([("level", pa.float64()), ("h", pa.float64()), ("x0", pa.float64()), ("x1", pa.float64()), ("cell", pa.int64())]))
    names = ("level", "h", "x0", "x1", "cell")
    held = pa.array([p and [dict(zip(names, c, strict=True)) for c in p] for p in [[], *pages]], kind).slice(1)
    for page, got in zip(pages, L.receipt_lines.func(held).to_pylist(), strict=True):
        fold, lines = L.Page(L.RECEIPT), defaultdict(list)
        for i in sorted(range(len(page or [])), key=lambda i: (page[i][0], page[i][2], page[i][4])):
            lines[fold.line(*page[i][:4])].append(i)
        assert [sorted(line) for line in got] == [sorted(lines[k]) for k in range(len(lines))]


@pytest.mark.parametrize("at_once", [1, 7, 1 << 19])
@pytest.mark.parametrize(("least", "short"), [(0.6, 0), (0.88, 4)])
def test_close_pairs_are_those_of_the_plain_ratio(monkeypatch, at_once, least, short):
    monkeypatch.setattr(R, "PAIRS", at_once)
    rng = random.Random(1)
    text = lambda: None if rng.random() < 0.1 else "".join(rng.choices("abcde한", k=rng.randrange(9)))
    keys, others = ([None if rng.random() < 0.1 else [text() for _ in range(rng.randrange(6))] for _ in range(150)] for _ in range(2))
    found = R._close(*(pa.array(x, pa.list_(pa.string())) for x in (keys, others)), least, short).to_pylist()
    for k, o, got in zip(keys, others, found, strict=True):
        scored = [(i, j, 1.0 if a == b else difflib.SequenceMatcher(None, a, b).ratio(), a == b or min(len(a), len(b)) >= short) for i, a in enumerate(k or []) for j, b in enumerate(o or []) if a is not None and b is not None]
        assert [(p["i"], p["j"], p["score"]) for p in got] == [(i, j, s) for i, j, s, open_ in scored if s >= least and open_]


def test_receipts_are_dealt_out_once_for_alignment(spark, sf):
    plan = plans.aligned_items(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("Exchange") == 3 and plan.count("Exchange hashpartitioning(receipt") == 1


def test_aligned_items_of_the_whole_table(spark, sf):
    """The query, made of whole receipts, gives what the operator gives for rows of items and names."""
    from pyspark.sql import functions as F

    cells, items = plans.read_receipts(spark, sf)
    rows = defaultdict(list)
    for c in cells.where("cell >= 10 AND cell % 10 < 2 AND x0 < 120").orderBy("cell").collect():
        rows[c["receipt"], c["cell"] // 10 - 1].append(c["text"])
    told = [(receipt, row, row // 4, " ".join(texts)) for (receipt, row), texts in rows.items() if (row * 7 + receipt) % 20 > 0]
    want = N.align_items(items, spark.createDataFrame(told, "receipt long, row int, page int, name string")).withColumn("score", F.round("score", 6))
    found = plans.aligned_items(spark, sf)
    assert Counter(map(tuple, found.select("receipt", "index", "row", "score").collect())) == Counter(map(tuple, want.select("receipt", "index", "row", "score").collect()))


def test_items_without_a_receipt_are_not_aligned(spark):
    items = spark.createDataFrame([(None, 0, "green tea"), (1, 0, "green tea"), (1, 60, "green tea"), (1, 1, None)], "receipt int, index int, name string")
    rows = spark.createDataFrame([(None, 0, 0, "green tea"), (1, 3, 0, "green tea"), (2, 0, 0, "tea")], "receipt int, row int, page int, name string")
    assert {tuple(r) for r in N.align_items(items, rows).collect()} == {(None, 0, None, None), (1, 0, 3, 1.0), (1, 60, None, None), (1, 1, None, None)}
