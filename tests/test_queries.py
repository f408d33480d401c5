"""Registered queries against the SQL that gives the same rows, and against plain Python where SQL can't say it."""

from __future__ import annotations

import difflib
import math
import re
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import receipts as P
from quillspark.operators.filters import split_groups
from quillspark.plans.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    held = duckdb.connect()
    for file in Path(sf).glob("*.parquet"):
        held.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return held


def plain(value):
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, float) or type(value).__name__ == "Decimal":
        return None if math.isnan(value) else round(float(value), 5)
    return value


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf, duck, name):
    found = QUERIES[name](spark, sf)
    want = duck.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(found.columns)
    want = Counter(tuple(plain(v) for v in row) for row in want.fetchall())
    assert Counter(tuple(plain(v) for v in row) for row in found.select(*columns).collect()) == want


def alike(a, b):
    """Two item names without decorations, compared as receipts' names are."""
    tokens = [re.findall(r"[0-9]+(?:[.,][0-9]+)?|[a-z]+", x.lower()) for x in (a, b)]
    digits, words = ([[w for w in t if w[0].isdigit() == d] for t in tokens] for d in (True, False))
    x, y = (re.sub("[^0-9a-z]", "", v.lower()) for v in (a, b))
    if a.lower() == b.lower():
        return True
    if all(digits) and set(digits[0]) != set(digits[1]):
        return False
    if min(len(x), len(y)) >= 2 and (x in y or y in x) or difflib.SequenceMatcher(None, x, y).ratio() >= 0.72:
        return True
    fewer = min(len(set(w)) for w in words)
    return fewer >= 2 and len(set(words[0]) & set(words[1])) >= 0.75 * fewer


def test_matched_items_whole_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").join(spark.read.parquet(f"{sf}/part.parquet").selectExpr("p_partkey AS l_partkey", "p_name"), "l_partkey").collect()
    by = defaultdict(list)
    for r in rows:
        by[r["l_orderkey"]].append(r)
    found = {r["id"]: r for r in QUERIES["matched_items"](spark, sf).collect()}
    assert set(found) == set(by)
    for key, lines in by.items():
        lines.sort(key=lambda r: (r["l_linenumber"], r["l_partkey"], r["l_suppkey"]))
        want = [(r["p_name"], r["l_quantity"], r["l_extendedprice"], r["l_tax"]) for r in lines]
        said = [(r["p_name"][::-1] if r["l_partkey"] % 5 == 0 else r["p_name"].upper(), r["l_quantity"] + (r["l_partkey"] % 3 == 0), *w[2:]) for r, w in zip(lines, want, strict=True) if r["l_partkey"] % 7]
        same = lambda a, b: (alike(a[0], b[0]), *(round(x, 2) == round(y, 2) for x, y in zip(a[1:], b[1:], strict=True)))
        scored = sorted(((3 * s[0] + sum(s[1:]), i, j, s) for i, a in enumerate(want) for j, b in enumerate(said) for s in [same(a, b)]), reverse=True)
        left, right, taken = set(), set(), []
        for _, i, j, s in scored:
            if i not in left and j not in right:
                left.add(i), right.add(j), taken.append(s)
        got = found[key]
        assert (got["n_expected"], got["n_said"]) == (len(want), len(said))
        assert got["name_f1"] == round(2 * sum(s[0] for s in taken) / (len(want) + len(said)), 6)
        for f, at in (("quantity", 1), ("unit_price", 2), ("total_amount", 3)):
            assert got[f] == round(sum(s[at] for s in taken) / len(want), 6)


def test_item_matching_ties_and_empty_sides(spark):
    kind = "id int, {} int, name string, quantity double, unit_price double, total_amount double"
    want = spark.createDataFrame([(1, 0, "a", 1.0, 1.0, 1.0), (1, 1, "a", 1.0, 1.0, 1.0), (2, 0, "tea", None, None, 5.0)], kind.format("index"))
    said = spark.createDataFrame([(1, 0, "a", 1.0, 1.0, 1.0), (2, 0, "tee", 0.0, 1.0, 5.0), (3, 0, "odd", 1.0, 1.0, 1.0)], kind.format("said_index"))
    pairs = {(r["id"], r["index"], r["said_index"], r["name"], r["quantity"], r["unit_price"]) for r in P.match_items(want, said, "id").collect()}
    assert pairs == {(1, 1, 0, True, True, True), (2, 0, 0, False, True, False)}
    scores = {r["id"]: (r["name_f1"], r["quantity"]) for r in P.item_scores(want, said, "id").collect()}
    assert scores[3] == (0.0, 0.0) and scores[2] == (0.0, 1.0) and abs(scores[1][0] - 2 / 3) < 1e-9
    assert P.item_scores(want.where("false"), said.where("false"), "id").count() == 0


def test_split_groups_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    found = {r["node"]: r["group"] for r in split_groups(edges).collect()}
    assert found == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_bounded_text_keeps_first_last_and_amount_lines(spark):
    lines = [f"line {i}" + (" 1,000" if i == 40 else "") for i in range(100)]
    row = spark.createDataFrame([(lines, ["a", "b"], [])], "l array<string>, s array<string>, n array<string>")
    big, small, none = row.select(T.bounded_text(F.col("l"), 1000), T.bounded_text(F.col("s")), T.bounded_text(F.col("n"))).first()
    numbered = [f"L{i + 1:03d} | {x}" for i, x in enumerate(lines)]
    wanted = [numbered[i] for i in [*range(25), 40, *range(65, 100)]]
    while sum(len(x) + 1 for x in wanted) > 1000:
        wanted.pop()
    assert (big["text"], big["truncated"]) == ("\n".join(wanted), True)
    assert (small["text"], small["lines"], small["truncated"]) == ("L001 | a\nL002 | b", 2, False) and none["text"] == ""


def test_titles(spark):
    lines = ["Abstract view", "A study of things: part one", "see https://x.kr", "01 | page", "one, two, three, four", "12345", "대학교 소개 자료집"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, x string")
    found = {r["x"]: r["s"] for r in rows.select("x", T.title_score(F.col("x"), F.col("i")).alias("s")).collect()}
    assert found[lines[1]] == len(lines[1]) + 35 and found[lines[0]] == len(lines[0]) + 20
    assert all(found[x] is None for x in lines[2:])


def test_items_are_matched_without_a_broadcast_of_parts(spark, sf):
    """Both sides come from one shuffle by receipt; nothing else is dealt out, and nothing is sent to the driver."""
    plan = QUERIES["matched_items"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("Exchange hashpartitioning(id") == 2 and plan.count("Exchange") == 6


def test_items_without_a_receipt_are_counted_only(spark):
    want = spark.createDataFrame([(None, 0, "a", 1.0, 1.0, 1.0)] * 2, "id int, index int, name string, quantity double, unit_price double, total_amount double")
    said = want.limit(1).withColumnRenamed("index", "said_index")
    assert P.match_items(want, said, "id").collect() == []
    assert sorted((r["n_expected"], r["n_said"], r["name_f1"], r["quantity"]) for r in P.item_scores(want, said, "id").collect()) == [(0, 1, 0.0, 0.0), (2, 0, 0.0, 0.0)]
