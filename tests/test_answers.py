"""Exact splits, evidence, causes of failures, categories and JSON leaves on small odd inputs."""

from __future__ import annotations

import json
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.operators import attribution as A
from quillspark.operators import chunks as C
from quillspark.operators import evidence as V
from quillspark.operators import taxonomy as X
from quillspark.operators.leaves import json_leaves


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab1가.)!? \n•①", max_size=200), st.integers(1, 30), st.integers(0, 20))
def test_spans_partition_a_text(text, target, more):
    most = target + more
    spans = C.exact_spans(text, target, most)
    assert "".join(text[a:z] for a, z in spans) == text
    assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert all(z - a <= most for a, z in spans)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab1가.)!? \n•①", max_size=120), st.integers(1, 20), st.integers(0, 10))
def test_spans_equal_a_recursive_split(text, target, more):
    most = target + more
    rules = [r"(?m)^(?=(?:[①-⑳•●▪]|\d+[.)]|[가-하][.)])\s)", r"\n\s*\n", r"(?<=[.!?。！？])\s+"]

    def split(part, level):
        if len(part) <= most:
            return [part]
        if level == 3:
            return [part[i : i + target] for i in range(0, len(part), target)]
        cuts = [0, *(m.end() for m in re.finditer(rules[level], part) if 0 < m.end() < len(part)), len(part)]
        return [x for a, z in zip(cuts, cuts[1:], strict=False) for x in split(part[a:z], level + 1)]

    want = []
    for part in split(text, 0):
        if want and len(text) > most and len(want[-1]) + len(part) <= target:
            want[-1] += part
        else:
            want.append(part)
    assert [text[a:z] for a, z in C.exact_spans(text, target, most)] == want


def test_parts_of_odd_texts(spark):
    rows = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (2, "", "x"), (None, "a" * 95, "x")], "doc_id int, text string, part string")
    found = sorted(((r["doc_id"] or 0, r["part"], r["start"], r["length"]) for r in C.exact_parts(rows, "doc_id", "text", 40, 50).collect()))
    assert found == [(0, 0, 0, 40), (0, 1, 40, 40), (0, 2, 80, 15), (2, 0, 0, 0), (2, 0, 0, 0)]
    with pytest.raises(ValueError, match="target"):
        C.exact_parts(rows, "doc_id", "text", 60, 50)


def test_chunks_lead_with_their_heading(spark):
    lines = ["first words", "제 1 장 시작", "가" * 30, "나" * 30, " ", "제 1 절 다음", "다" * 5]
    rows = spark.createDataFrame([(1, i, t, None) for i, t in enumerate(lines)] + [(2, 0, None, None)], "doc int, at int, text string, chunk string").drop("chunk")
    found = [tuple(r) for r in C.section_chunks(rows, "doc", "at", "text", F.lit("T"), target=40).orderBy("chunk").collect()]
    assert [(r[1], r[2], r[3], r[4]) for r in found] == [(0, None, [], None), (1, "제 1 장 시작", ["제 1 장 시작"], 1), (2, "제 1 장 시작", ["제 1 장 시작"], 1), (3, "제 1 절 다음", ["제 1 장 시작", "제 1 절 다음"], 2)]
    assert found[0][5] == "[문서 제목] T\nfirst words"
    assert found[2][5].split("\n") == ["[문서 제목] T", "[섹션] 제 1 장 시작", "[장절항 경로] 제 1 장 시작", "[섹션] 제 1 장 시작", "나" * 30]


def test_facets(spark):
    asked = ["퇴사를 하려면 며칠 전에 알려야 하나요?", "연차는 몇 일까지 가능한가요", "출장비 3만원 초과를 승인해 주나요?", "우리 회사 어디야", None]
    rows = V.facets(spark.createDataFrame(list(enumerate(asked)), "query_id int, query string")).orderBy("query_id").collect()
    assert rows[0]["subjects"][0] == "퇴직" and rows[0]["units"] == ["일"]
    assert rows[1]["tokens"] == ["연차"] and rows[1]["units"] == ["일"]
    assert rows[2]["conditions"] == ["30000원"] and "출장비" in rows[2]["tokens"] and "30000원" in rows[2]["tokens"]
    assert rows[3]["tokens"] == [] and rows[4]["tokens"] == []


def test_every_verdict_of_the_gate(spark):
    questions = [(1, "출장 규정 5일"), (2, "출장 규정 5일"), (3, "출장"), (4, "표의 열 이름 알려줘"), (5, "출장"), (6, "출장 3일"), (7, "우리 회사 어디야")]
    passages = [(1, 1, "출장 규정은 5일 이상"), (2, 1, "출장 규정은 9일 이상"), (3, 1, "다른 말"), (4, 1, "[표 테이블 열 컬럼명] 1열: a"), (5, 1, "  "), (7, 1, "회사 소개")]
    told = V.facets(spark.createDataFrame(questions, "query_id int, query string"))
    found = spark.createDataFrame(passages, "query_id int, doc_id int, content string")
    by_words = V.unit_scores(told, found)
    verdicts = {r["query_id"]: r["reason"] for r in V.gate(told, found, by_words).collect()}
    assert verdicts == {1: "SUPPORTED", 2: "CONDITION_NOT_SUPPORTED", 3: "UNLIKE", 4: "TABLE", 5: "NO_EVIDENCE", 6: "NO_PASSAGES", 7: "UNLIKE"}
    by_model = by_words.withColumns({"score": F.lit(0.9), "best_subject": F.lit(0.1)})
    verdicts = {r["query_id"]: r["reason"] for r in V.gate(told, found, by_model).collect()}
    assert verdicts[3] == "NO_SUBJECT" and verdicts[7] == "NO_HITS"


def test_literal_hits_come_first(spark):
    told = V.facets(spark.createDataFrame([(1, "출장 규정 안내"), (2, "출장")], "query_id int, query string"))
    found = spark.createDataFrame([(1, 7, 1), (1, 8, 2), (2, 7, 1)], "query_id int, doc_id int, rank int")
    lexical = spark.createDataFrame([(1, 8, "출장 규정", 2.0), (1, 9, "출장 규정 안내", 1.0), (1, 7, "출장", 9.0), (2, 9, "출장", 1.0)], "query_id int, doc_id int, content string, score double")
    got = sorted((r["query_id"], r["rank"], r["doc_id"]) for r in V.promoted(told, found, lexical).collect())
    assert got == [(1, 1, 9), (1, 2, 8), (1, 3, 7), (2, 1, 7)]


def test_boosts_count_real_hits(spark):
    asked = spark.createDataFrame([(1, "학력 및 경력은 무엇?")], "query_id int, query string")
    found = spark.createDataFrame([(1, 1, "학력: 경력", 0.1), (1, 2, "없음", 0.3), (1, 3, None, 0.2)], "query_id int, doc_id int, content string, similarity double")
    got = {r["doc_id"]: (r["similarity"], r["rank"]) for r in V.boosted(asked, found, {"학력": ("학력", "대학교"), "경력": ("경력",)}).collect()}
    assert got[1] == (pytest.approx(0.1 + 0.14 + 0.08), 1) and got[2] == (0.3, 2)


def test_causes_of_odd_readings(spark):
    schema = "sample int, field string, expected string, actual string, model string, source string, text string, item_amounts array<double>"
    rows = [
        (1, "total_amount", "12,000원", "12000", None, None, "합계 12,000", []),
        (1, "tax_amount", "1000", None, None, None, None, None),
        (1, "transaction_date", "2024년 3월 5일", "2024-03-05", None, None, "24.3.5", []),
        (1, "merchant", None, "A", None, None, "A", []),
        (1, "payment_method", "credit card", "credit-card visa", None, None, "", []),
        (1, "expense_category", "교통", "대중교통", None, None, "", []),
    ]
    found = {r["field"]: (r["equal"], r["code"]) for r in A.field_causes(spark.createDataFrame(rows, schema)).collect()}
    assert found == {"total_amount": (True, None), "tax_amount": (False, "OCR_TEXT_MISSING"), "transaction_date": (True, None), "merchant": (False, "FINAL_VALUE_MISMATCH"), "payment_method": (True, None), "expense_category": (True, "SEMANTIC_EQUIVALENCE")}


def test_a_right_reading_has_no_tags(spark):
    fields = spark.createDataFrame([(1, "merchant", "A", "A", None, None, "A", [])], "sample int, field string, expected string, actual string, model string, source string, text string, item_amounts array<double>")
    item = "struct<name: string, quantity: double, unit_price: double, total_amount: double>"
    one = ("tea", 1.0, 2.0, 2.0)
    items = spark.createDataFrame([(1, 0, one, one, one, "tea 1 2 2")], f"sample int, item int, truth {item}, model {item}, final {item}, text string")
    finals = spark.createDataFrame([(1, [2.0], 2.0, None, None, None, ["tea"])], "sample int, item_amounts array<double>, total double, discount double, supply double, tax double, names array<string>")
    tags, reports = A.attribute(fields, items, finals)
    assert tags.collect() == [] and [tuple(r) for r in reports.collect()] == [(1, "SUCCESS", None, False, 0)]


def test_dates_in_texts(spark):
    rows = [("샀다 24년 3월 5일", "2024-03-05"), ("2024/3/5", "2024.03.05"), ("2024/3/51", "2024-3-5"), (None, "2024-3-5"), ("1 2 3", None)]
    assert [r[0] for r in spark.createDataFrame(rows, "t string, d string").select(A.date_in(F.col("t"), F.col("d"))).collect()] == [True, True, False, False, False]


def test_categories_by_evidence(spark):
    rows = [("식비", None, "외식/식사"), (None, "카페", None), ("취미/쇼핑", "유니클로", "의류/패션"), ("취미/쇼핑", "세제", "생활용품"), ("취미/쇼핑", "", "취미/선물"), ("교통", "경유 20L", "주유/차량"), ("교통", "버스", "대중교통"), ("식비", "p0s 단가 수량 금액", "외식/식사"), ("식비", "gs 25 바코드", "식품/장보기"), ("식비", "focus cup 커피", "외식/식사"), ("식비", "스타벅스 아메리카노 gs 25", "카페/음료")]
    assert [r[0] for r in spark.createDataFrame(rows, "c string, t string, want string").select(X.refine_category(F.col("c"), F.col("t"))).collect()] == [r[2] for r in rows]


def test_json_leaves_of_any_depth(spark):
    deep = current = {}
    for i in range(30):
        current["a"] = [i, {}]
        current = current["a"][1]
    bodies = [json.dumps(deep), None, "{", "7", '"x"', "[]", '{"a b": [null, [true, 1.5]], "é": ""}']
    found = [tuple(r) for r in json_leaves(spark.createDataFrame(list(enumerate(bodies)), "id int, body string"), "id", "body").collect()]

    def leaves(value, path):
        if isinstance(value, dict):
            return [x for k, v in value.items() for x in leaves(v, f"{path}.{k}")]
        if isinstance(value, list):
            return [x for i, v in enumerate(value) for x in leaves(v, f"{path}[{i}]")]
        return [(path, value if value is None else value if isinstance(value, str) else json.dumps(value))]

    assert sorted(found, key=str) == sorted(((i, *x) for i, b in enumerate(bodies) if b not in (None, "{") for x in leaves(json.loads(b), "$")), key=str)


def test_amounts_of_odd_texts(spark):
    told = ["12", "1,234.567원", "-3.", ".5", "+7", "2001.01.02", "1-2", "", "Shop", ".", "-", None, "00012.10"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(told)], "i int, t string").select("i", A.as_amount(F.col("t")).alias("a"))
    assert [r["a"] for r in rows.orderBy("i").collect()] == [12.0, 1234.57, -3.0, 0.5, 7.0, None, None, None, None, None, None, None, 12.1]


def test_texts_are_read_once_a_sample(spark, sf):
    from quillspark.plans.attribution import readings

    fields, items, _ = readings(spark, sf)
    for rows, judged in ((fields, A.field_causes(fields)), (items, A.item_causes(items))):
        assert {"numbers", "words"} <= set(rows.columns)
        plan = judged._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("AS numbers") == 1
    plain = A.field_causes(fields.drop("numbers", "words")).select("sample", "field", "equal", "code")
    assert plain.exceptAll(A.field_causes(fields).select("sample", "field", "equal", "code")).isEmpty()


def test_statutes_are_dealt_out_once(spark, sf):
    from quillspark.plans.chunks import statute_chunks

    plan = statute_chunks(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan and "Aggregate" not in plan


def test_chunks_of_documents_across_batches(spark):
    rows = [(d, i, f"제 {i} {'장절항'[i // 5 % 3]} t" if i % 5 == 0 else " 1.2.3.4 deep" if i % 11 == 0 else f"line {i} of the document" if i % 7 else " ") for d in (None, 1, 2) for i in range(60)]
    lines = spark.createDataFrame(rows, "doc long, at long, text string")
    found = []
    for size in ("10000", "4"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        found.append({(r["doc"], r["chunk"]): tuple(r[2:]) for r in C.section_chunks(lines, "doc", "at", "text", F.lit("T"), target=60).collect()})
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found[0] == found[1]
    for doc in (None, 1, 2):
        chunks = [found[0][doc, i] for i in range(sum(d == doc for d, _ in found[0]))]
        bodies = [line for c in chunks for line in c[3].split("\n") if not line.startswith("[")]
        assert bodies == [text.strip() for d, _, text in rows if d == doc and text.strip()]
        assert chunks[0][:3] == ("제 0 장 t", ["제 0 장 t"], 1)
    held = {tuple(c[1]): c[2] for c in found[0].values()}
    assert held["제 15 장 t", "제 20 절 t", "1.2.3.4 deep"] == 4 and ("제 15 장 t", "제 20 절 t", "제 25 항 t") in held


def test_heading_levels_of_odd_lines(spark):
    from quillspark.functions.text import heading_level

    lines = {
        "제 3 장 총칙": 1, "제3절": 2, "  제 1 항": 3, "제 1 장정": 2, "제 조": None, "| - 결론 : -": 2, "1 a": 1, "1.2) b": 2, "1.2.3.4. c": 4, "1.2.3.4.5 c": None, "12": None, "1.2": None, "１ a": None,
        "INTRO TEXT": 2, "Abc def": None, "ABC": 2, "AB": None, "-·학력·-": 2, "학력사항 및 기타": 2, "a | b": None, "METHODS | |": 2, "학력 | b | c": None, "1 a | b | c": None, "": None, " |:- ": None, "1\u3000a\nb": 1, "A" * 42: None, "1 " + "x" * 99: None, "1 " + "x" * 98: 1,
    }
    found = spark.createDataFrame([(x,) for x in lines], "x string").select("x", heading_level(F.col("x")).alias("level"))
    assert {r["x"]: r["level"] for r in found.collect()} == lines


def test_causes_are_dealt_out_once(spark, sf):
    """Fields, items and sums are made of one row of a sample; what is told of a sample is dealt out once, without a checkpoint."""
    from quillspark.plans.attribution import failure_reports, failure_tags

    for run in (failure_tags, failure_reports):
        plan = run(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "ExistingRDD" not in plan and "Broadcast" not in plan
        assert plan.count("Exchange hashpartitioning(l_orderkey") == 3 and plan.count("Exchange hashpartitioning(sample") == 4


def test_classes_of_all_but_some_letters(spark):
    from quillspark.functions.text import all_but, compact
    from quillspark.operators.grounding import BLANKS

    every = [(i, f"a{chr(i)}1") for i in [*range(0xD800), *range(0xE000, 0x10000), 0x1F600, 0x10FFFF]]
    rows = spark.createDataFrame(every, "i int, t string")
    for mine, plain in ((all_but("0-9a-z"), "[^0-9a-z가-힣]"), (all_but("a-z"), "[^a-z가-힣]"), (all_but("0-9.+-", hangul=False), "[^0-9.+-]"), (BLANKS, r"(?U)\s")):
        assert rows.where(F.regexp_replace("t", f"(?:{mine})+", "_") != F.regexp_replace("t", f"(?:{plain})+", "_")).isEmpty(), plain
    assert rows.where(compact(F.col("t")) != F.regexp_replace(F.lower("t"), "[^0-9a-z가-힣]", "")).isEmpty()
    assert spark.createDataFrame([("12",), ("12\n",), ("1234567890123456",), ("12.345",)], "t string").select(A.as_amount(F.col("t")).alias("a")).collect() == [(12.0,), (12.0,), (1234567890123456.0,), (12.35,)]


def test_spelling_alone_is_no_failure(spark):
    field = "sample int, field string, expected string, actual string, model string, source string, text string, item_amounts array<double>"
    item = "struct<name: string, quantity: double, unit_price: double, total_amount: double>"
    fields = spark.createDataFrame([(1, "merchant", "A", "A", None, None, "A", []), (2, "merchant", "Shop A", "shop-a", None, None, "shop a", [])], field)
    one, other = ("tea", 1.0, 2.0, 2.0), ("tea", 1.0, 2.0, None)
    items = spark.createDataFrame([(1, 0, one, one, other, "tea 1 2 2")], f"sample int, item int, truth {item}, model {item}, final {item}, text string")
    finals = spark.createDataFrame([], "sample int, item_amounts array<double>, total double, discount double, supply double, tax double, names array<string>")
    tags, reports = A.attribute(fields, items, finals)
    assert {(r["sample"], r["code"], r["decision"]) for r in tags.collect()} == {(1, "ITEM_FIELD_MISMATCH", "AUTO"), (2, "SEMANTIC_EQUIVALENCE", "AUTO")}
    assert {tuple(r) for r in reports.collect()} == {(1, "FAILED", "LLM_ERROR", False, 1), (2, "SUCCESS", "NORMALIZATION_ERROR", False, 1)}
