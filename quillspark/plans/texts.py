"""Text, date and JSON functions as queries; Korean texts are given to rows of the supplied tables in turn."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import dates as D
from quillspark.functions import json as J
from quillspark.functions import numbers as N
from quillspark.functions import text as T
from quillspark.operators.leaves import json_leaves
from quillspark.plans.registry import StandIn, choice, query

ANSWERS = StandIn("orders", {"id": "o_orderkey", "answer": choice("o_orderkey", "근거가 없습니다", "문서에 없는 내용", "제공되지 않은 자료", "확인할 수 없어요", "정답은 3일입니다", "알 수\t없음", "Plain ANSWER")})


@query(f"SELECT id, regexp_matches(regexp_replace(lower(coalesce(answer, '')), '\\s+', '', 'g'), '{'|'.join(T.REJECTIONS)}') AS rejected FROM {ANSWERS.sql}")
def answer_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that say they have no basis."""
    return ANSWERS.rows(spark, sf_dir).select("id", T.is_rejection(F.col("answer")).alias("rejected"))


READINGS = StandIn("part", {"id": "p_partkey", "expected": "'B-' || cast(p_partkey as string)", "observed": "translate('b' || cast(p_partkey as string), '0158', 'oIsB')", "amount": "cast(p_size as string) || '.' || lpad(cast(p_partkey % 1000 as string), 3, '0') || CASE WHEN p_size % 3 = 0 THEN ' 원' ELSE '' END", "low": "cast(p_size as double)", "high": "cast(p_size * CASE WHEN p_size % 4 = 0 THEN 1000 ELSE 10 END as double)"})


@query(
    f"""WITH r AS (SELECT *, regexp_replace(lower(expected), '[^0-9a-z]', '', 'g') AS a, regexp_replace(lower(observed), '[^0-9a-z]', '', 'g') AS b FROM {READINGS.sql})
SELECT id, a <> b AND translate(a, 'oilzsb', '011258') = translate(b, 'oilzsb', '011258') AS confused, CAST(regexp_replace(amount, '[^0-9]', '', 'g') AS BIGINT) AS units, low > 0 AND (abs(low * 1000 - high) < 0.01 OR abs(high * 1000 - low) < 0.01) AS lost FROM r"""
)
def misread_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters read for digits, amounts in whole units, lost decimal separators."""
    return READINGS.rows(spark, sf_dir).select("id", T.digit_confusion(F.col("expected"), F.col("observed")).alias("confused"), N.parse_money(F.col("amount")).alias("units"), N.separator_lost(F.col("low"), F.col("high")).alias("lost"))


CELLS = StandIn("customer", {"id": "c_custkey", "cell": "CASE c_custkey % 5 WHEN 0 THEN '  =' WHEN 1 THEN '@' WHEN 2 THEN '-' WHEN 3 THEN ' ' ELSE '' END || c_name", "kind": choice("c_custkey", "EXPENSE_REPORT", "TRAVEL_EXPENSE", "OTHER"), "owner": "upper(c_name) || '@x.kr'"})


@query(
    f"""SELECT id, CASE WHEN regexp_matches(cell, '^\\s*[=+@-]') THEN '''' || cell ELSE cell END AS safe,
CASE kind WHEN 'EXPENSE_REPORT' THEN 'EXP' WHEN 'TRAVEL_EXPENSE' THEN 'TRV' END || '-20240229-' || lpad(CAST(list_sum(list_transform(range(1, length(owner) + 1), lambda i: i * ord(substr(lower(owner), i, 1)))) % 1000000 AS VARCHAR), 6, '0') AS number FROM {CELLS.sql}"""
)
def workbook_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells safe from being taken for formulas, and document numbers."""
    return CELLS.rows(spark, sf_dir).select("id", T.excel_safe(F.col("cell")).alias("safe"), T.document_number(F.col("kind"), F.col("owner"), F.lit("2024-02-29").cast("date")).alias("number"))


REWRITES = StandIn("orders", {"id": "o_orderkey", "asked": choice("o_orderkey", "휴가 3일은 안 되나요", "10,000원 이상 5개월", "연차는 없나요", "그냥 질문"), "rewritten": choice("o_orderkey % 7", "휴가 3일은 되나요", "5개월 10,000원 이상", "연차는 불가한가요", "그냥 질문", "휴가 3일은 안 됨", "")})


@query(
    f"""WITH r AS (SELECT id, coalesce(asked, '') AS a, coalesce(rewritten, '') AS b FROM {REWRITES.sql}),
n AS (SELECT id, b <> '' AND list_sort(list_distinct(regexp_extract_all(a, '\\d+(?:[.,:]\\d+)*(?:원|일|개월|시간|분|%|퍼센트)?'))) = list_sort(list_distinct(regexp_extract_all(b, '\\d+(?:[.,:]\\d+)*(?:원|일|개월|시간|분|%|퍼센트)?'))) AS same, regexp_matches(a, '{'|'.join(T.NEGATIONS)}') AS x, regexp_matches(b, '{'|'.join(T.NEGATIONS)}') AS y FROM r) SELECT id, same AND (NOT x OR y) AS allowed FROM n"""
)
def rewrite_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether rewritten questions keep numbers and negation."""
    return REWRITES.rows(spark, sf_dir).select("id", T.rewrite_allowed(F.col("asked"), F.col("rewritten")).alias("allowed"))


PRIVATE_ASKED = StandIn("customer", {"id": "c_custkey", "asked": choice("c_custkey", "이 사람 전화번호 알려 줘", "주소" + "가" * 58 + "보여줘", "주소" + "가" * 59 + "보여줘", "서울시 강남구 역삼로 12길", "메일 a.b@c.kr 확인", "900101-1234567", "나이가 궁금해", "알려줘 그의 연봉", "학력을 알려줘", "찾아 줘 이메일 e-mail")})


@query(
    f"""WITH q AS (SELECT id, coalesce(asked, '') AS t FROM {PRIVATE_ASKED.sql}),
starts AS (SELECT id, t, list_filter(range(1, length(t) + 1), lambda i: regexp_matches(substr(t, i), '^(전화번호|주소|나이|이메일|e-mail)')) AS f, list_filter(range(1, length(t) + 1), lambda i: regexp_matches(substr(t, i), '^(알려\\s*줘|보여\\s*줘|찾아\\s*줘)')) AS r FROM q)
SELECT id, regexp_matches(t, '서울|@c.kr|900101-1234567') OR len(list_filter(f, lambda a: len(list_filter(r, lambda b: abs(a - b) <= 60)) > 0)) > 0 AS sensitive FROM starts"""
)
def sensitive_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions for private data."""
    return PRIVATE_ASKED.rows(spark, sf_dir).select("id", T.is_sensitive_query(F.col("asked")).alias("sensitive"))


RECEIPT_TEXTS = StandIn("orders", {"id": "o_orderkey", "said": "'상호 ' || cast(o_custkey as string) || '\n2024-0' || cast(o_orderkey % 10 as string) || '-1' || cast(o_custkey % 10 as string) || '\n' || CASE o_orderkey % 4 WHEN 0 THEN '승인 번호: ' WHEN 1 THEN '주문번호 ' WHEN 2 THEN '거래번호：' ELSE '번호 ' END || cast(o_orderkey as string) || '\n합계 ' || cast(1000 + o_custkey as string)"})


@query(
    f"""WITH r AS (SELECT id, regexp_extract(said, '(승인|거래|주문)\\s*번호\\s*[:：]?\\s*([0-9A-Za-z*-]{{4,}})', 2) AS ref, try_cast(regexp_extract(said, '20\\d\\d-\\d\\d-\\d\\d') AS DATE) AS day, list_max(list_transform(regexp_extract_all(said, '\\d{{3,8}}'), lambda x: CAST(x AS BIGINT))) AS total FROM {RECEIPT_TEXTS.sql})
SELECT id, CAST(day AS VARCHAR) AS day, total, CASE WHEN length(ref) >= 4 THEN sha256(ref || '|' || coalesce(CAST(day AS VARCHAR), '') || '|' || CAST(total AS VARCHAR)) END AS key FROM r"""
)
def receipt_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity keys of receipts by their reference number, day and largest amount."""
    told = RECEIPT_TEXTS.rows(spark, sf_dir).select("id", "said", T.receipt_hints(F.col("said")).alias("h"))
    return told.select("id", F.col("h.day").cast("string").alias("day"), F.col("h.total").alias("total"), T.identity_key(F.col("said"), F.col("h.day"), F.col("h.total")).alias("key"))


FILES = StandIn("orders", {"id": "o_orderkey", "filename": "'Scan ' || cast(o_custkey as string) || CASE WHEN o_orderkey % 3 = 0 THEN ' (2).jpg' WHEN o_orderkey % 3 = 1 THEN '.JPG' ELSE '' END", "day": "CASE WHEN o_orderkey % 5 > 0 THEN cast(o_orderdate as date) END", "total": "cast(round(o_totalprice, 0) as double)", "tax": "cast(round(o_totalprice / 11, 2) as double)"})


@query(
    f"""WITH f AS (SELECT *, regexp_replace(regexp_replace(lower(filename), '\\s*\\(\\d+\\)(\\.[^.]+)$', '\\1'), '[^0-9a-z]', '', 'g') AS name FROM {FILES.sql})
SELECT id, CASE WHEN day IS NOT NULL AND total > 0 THEN name || '|' || CAST(day AS VARCHAR) || '|0.0|' || regexp_replace(CAST(CAST(tax AS DECIMAL(18,2)) AS VARCHAR), '0$', '') || '|' || regexp_replace(CAST(CAST(total AS DECIMAL(18,2)) AS VARCHAR), '0$', '') END AS key FROM f"""
)
def receipt_legacy_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of receipts by file name, day and amounts."""
    return FILES.rows(spark, sf_dir).select("id", T.legacy_key(F.col("filename"), F.col("day"), F.lit(None).cast("double"), F.col("tax"), F.col("total")).alias("key"))


LINES = StandIn("orders", {"id": "o_orderkey", "said": "'Shop\n 감사합니다 \nshop\nitem ' || cast(o_custkey as string) || '  1,000\n감사합니다 ' || cast(o_orderkey as string) || '\n\nwww.x.kr\nS H O P\nitem ' || cast(o_custkey % 3 as string)"})


@query(
    f"""SELECT id, ['Shop', 'item ' || custkey || ' 1,000'] || CASE WHEN id > 99 AND id <= 99999999 THEN ['감사합니다 ' || id] ELSE [] END || ['item ' || CAST(CAST(custkey AS BIGINT) % 3 AS VARCHAR)] AS lines FROM (SELECT id, split_part(split_part(said, 'item ', 2), ' ', 1) AS custkey FROM {LINES.sql})""",
    joined=("lines",),
)
def receipt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct lines of receipts without noise."""
    return LINES.rows(spark, sf_dir).select("id", T.clean_lines(F.col("said")).alias("lines"))


CARDS = StandIn("customer", {"id": "c_custkey", "said": choice("c_custkey", "카드번호: 1234-56**-****-7890", "Card No. 1234 5678 xxxx 9999", "1234-56**-****-7890", "카드번호 1234-5678-9012-3456", "카드 번호 1234****5678**** 카드번호：1111****2222****", "카드no. ****1234****"), "mask": choice("c_custkey % 4", "1234-****-12", "**34", ""), "held": choice("c_custkey", "12349999 12", "12340000-13", "1234", "5534", "")})


@query(
    f"""SELECT id, CASE id % 7 WHEN 0 THEN '1234-56**-****-7890' WHEN 1 THEN '12345678xxxx9999' WHEN 5 THEN '****1234****' END AS card, CASE id % 7 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 5 THEN NULL WHEN 4 THEN 'AMBIGUOUS' ELSE 'MISSING' END AS reason,
coalesce(regexp_replace(mask, '[^0-9*]', '', 'g') <> '' AND regexp_full_match(regexp_replace(held, '[^0-9*]', '', 'g'), replace(regexp_replace(mask, '[^0-9*]', '', 'g'), '*', '.')), false) AS fits FROM {CARDS.sql}"""
)
def masked_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked card numbers of receipts, and whether numbers fit a mask."""
    rows = CARDS.rows(spark, sf_dir).withColumn("c", T.masked_card(F.col("said")))
    return rows.select("id", F.col("c.value").alias("card"), F.col("c.reason").alias("reason"), T.mask_match(F.col("mask"), F.col("held")).alias("fits"))


HEADINGS = StandIn("part", {"id": "p_partkey", "line": choice("p_partkey", "제 3 장 총칙", "제2절 범위", "제 10 항", "1.2.3 Scope", "2) Aim", "| Introduction |", "경력사항 요약", "MAIN PART", "plain text line", "제 4 조 정의", "A | B | C", "Larger type"), "height": "cast(CASE WHEN p_size % 2 = 0 THEN 14 ELSE 10 END as double)"})


@query(f"SELECT id, CAST(CASE id % 13 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 3 WHEN 4 THEN 1 WHEN 5 THEN 2 WHEN 6 THEN 2 WHEN 7 THEN 2 WHEN 10 THEN NULL WHEN 12 THEN NULL ELSE CASE WHEN height >= 13.5 THEN 2 END END AS INTEGER) AS level FROM {HEADINGS.sql}")
def heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of section headings."""
    return HEADINGS.rows(spark, sf_dir).select("id", T.heading_level(F.col("line"), F.col("height"), F.lit(10.0)).alias("level"))


QUESTIONS = StandIn("orders", {"id": "o_orderkey", "asked": choice("o_orderkey", "연차는 며칠인가요?", "한도가 몇 원 이상이야", "표의 열 이름 알려줘", "출장비 3만원 1,200 원 한 달", "재택 이틀. 사흘 가능! 네", "  "), "evidence": choice("o_orderkey % 5", "한도는 10일 이하", "30000원 초과 3일", "1일 5일", "")})


@query(
    f"""SELECT id, CASE id % 7 WHEN 0 THEN '연차는 며칠 인가요?' ELSE asked END AS split, CASE id % 7 WHEN 0 THEN '연차는 며칠인가요?' WHEN 1 THEN '한도가 몇 원 이상이야' WHEN 2 THEN '표의 열 이름 알려줘' WHEN 3 THEN '출장비 30000원 1200원 1개월' WHEN 4 THEN '재택 2일. 3일 가능! 네' ELSE '' END AS normal,
CAST(CASE id % 7 WHEN 0 THEN 2 WHEN 4 THEN 3 WHEN 5 THEN 0 WHEN 6 THEN 0 ELSE 1 END AS INTEGER) AS units, CASE id % 7 WHEN 0 THEN ['일'] WHEN 1 THEN ['원'] ELSE [] END AS requested, id % 7 = 2 AS about_table, CASE (id % 5) % 5 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN true ELSE false END AS supported, round(least(0.45, 0.07 * (id % 4) + 0.04 * (id % 9))::DOUBLE, 6) AS boost FROM {QUESTIONS.sql}""",
    joined=("requested",),
)
def question_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal forms, evidence units, requested units and supported conditions of questions."""
    asked, evidence = F.col("asked"), F.col("evidence")
    supported = F.coalesce(T.condition_supported(F.lit("3일"), evidence), F.lit(False))
    boost = F.round(T.lexical_boost(F.col("id") % 4, F.col("id") % 9), 6)
    units = F.size(T.evidence_units(asked))
    return QUESTIONS.rows(spark, sf_dir).select("id", T.split_question_ending(asked).alias("split"), T.normalize_evidence(asked).alias("normal"), units.alias("units"), F.coalesce(T.requested_units(asked), F.array().cast("array<string>")).alias("requested"), T.is_table_query(asked).alias("about_table"), supported.alias("supported"), boost.alias("boost"))


WRITTEN = StandIn("orders", {"id": "o_orderkey", "day": "cast(o_orderdate as date)", "ym": "cast(o_orderdate as string)", "written": "CASE o_orderkey % 8 WHEN 0 THEN replace(substr(cast(o_orderdate as string), 1, 10), '-', '') WHEN 1 THEN replace(substr(cast(o_orderdate as string), 1, 10), '-', ' / ') WHEN 2 THEN substr(cast(o_orderdate as string), 1, 4) || '년 ' || substr(cast(o_orderdate as string), 6, 2) || '월 ' || substr(cast(o_orderdate as string), 9, 2) || '일 10:20' WHEN 3 THEN replace(substr(cast(o_orderdate as string), 3, 8), '-', '.') WHEN 4 THEN substr(cast(o_orderdate as string), 6, 2) || '/' || substr(cast(o_orderdate as string), 9, 2) || '/' || substr(cast(o_orderdate as string), 1, 4) WHEN 5 THEN '2024-02-30' WHEN 6 THEN 'no day' END"})


@query(
    f"""SELECT id, CASE WHEN id % 8 < 3 OR id % 8 = 4 THEN CAST(day AS VARCHAR) WHEN id % 8 = 3 THEN '20' || substr(CAST(day AS VARCHAR), 3) END AS normal, coalesce(id % 8 IN (0, 1, 2, 3), false) AS in_text,
strftime(day, '%Y-%m-%d') || 'T00:00:00Z' AS utc, CAST(day AS TIMESTAMP) + INTERVAL 1439 MINUTE AS due, CAST(day AS TIMESTAMP) - INTERVAL 1 MINUTE AS all_day_end, CAST(day AS TIMESTAMP) + INTERVAL 1439 MINUTE <= TIMESTAMP '1995-06-01 00:00:00' + INTERVAL 2 DAY AND id % 3 > 0 AS urgent, CAST(CAST(day + INTERVAL 1 DAY AS DATE) AS VARCHAR) AS kst_day FROM {WRITTEN.sql}"""
)
def date_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates read from several ways to write them, due times, urgency, Korean days."""
    day = F.col("day")
    status = F.when(F.col("id") % 3 == 0, "DONE").otherwise("OPEN")
    late = F.concat(day.cast("string"), F.lit("T15:00:00Z"))
    return WRITTEN.rows(spark, sf_dir).select(
        "id", D.normal_date(F.col("written")).cast("string").alias("normal"), D.date_in_text(F.col("written"), day).alias("in_text"), D.utc_text(day.cast("timestamp_ntz")).alias("utc"), D.due_time(day).alias("due"),
        D.all_day_end(day).alias("all_day_end"), D.is_urgent(D.due_time(day), F.to_timestamp_ntz(F.lit("1995-06-01 00:00:00")), status).alias("urgent"), D.kst_day_of_text(late).cast("string").alias("kst_day"),
    )


ANSWER_JSON = StandIn("customer", {"id": "c_custkey", "reply": "CASE c_custkey % 4 WHEN 0 THEN '{\"total_amount\":\"5\",\"merchant\":\"' || c_name || '\",\"items\":[]}' WHEN 1 THEN '{\"상호\":\"' || c_name || '\",\"b\":\"2\",\"a\":\"1\"}' WHEN 2 THEN '[1]' END", "change": "'{\"a\":\"9\",\"z\":\"0\"}'"})


@query(
    f"""SELECT id, round(CASE id % 4 WHEN 0 THEN 3 / 9 ELSE 0 END, 6) AS share, CASE id % 4 WHEN 0 THEN sha256('{{"items":"[]","merchant":"' || name || '","total_amount":"5"}}') WHEN 1 THEN sha256('{{"a":"1","b":"2","상호":"' || name || '"}}') END AS digest,
CASE WHEN id % 4 < 2 THEN name END AS merchant, CASE id % 4 WHEN 0 THEN 'a=9,items=[],merchant=' || name || ',total_amount=5,z=0' WHEN 1 THEN 'a=9,b=2,z=0,상호=' || name ELSE 'a=9,z=0' END AS merged, CASE WHEN id % 2 = 0 THEN ['TOTAL_MISSING', 'X'] ELSE ['X', 'TOTAL_MISSING'] END AS reasons
FROM (SELECT id, regexp_extract(reply, 'Customer[^"]*') AS name FROM {ANSWER_JSON.sql})""",
    joined=("reasons",),
)
def json_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required keys, canonical digests, aliases, merges and distinct reasons of JSON texts."""
    held = J.entries(F.col("reply"))
    both = F.array_join(F.transform(F.array_sort(F.map_entries(J.merged(held, J.entries(F.col("change"))))), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    reasons = F.when(F.col("id") % 2 == 0, F.array(F.lit("NO_TOTAL"), F.lit("X"), F.lit("TOTAL_MISSING"))).otherwise(F.array(F.lit("X"), F.lit("NO_TOTAL"), F.lit("X")))
    return ANSWER_JSON.rows(spark, sf_dir).select("id", F.round(J.key_share(F.col("reply")), 6).alias("share"), F.sha2(J.canonical(F.col("reply")), 256).alias("digest"), J.first_of(held, "상호", "merchant").alias("merchant"), both.alias("merged"), J.distinct_reasons(reasons, {"NO_TOTAL": "TOTAL_MISSING"}).alias("reasons"))


#: Events as nested objects and arrays, some broken or empty.
NESTED = StandIn("events", {"id": "event_id", "body": """CASE WHEN event_id % 97 = 0 THEN '{broken' WHEN event_id % 89 = 0 THEN '[]' WHEN event_id % 83 = 0 THEN cast(user_id as string) ELSE '{"user": {"id": ' || cast(user_id as string) || ', "tags": [' || cast(event_id % 5 as string) || ', {"deep": [[' || cast(event_id % 3 as string) || '], ' || props || ']}]}, "kind": "' || event_type || '", "none": null, "on": true}' END"""})


@query(f"SELECT n.id, fullkey AS path, CASE WHEN type = 'NULL' THEN NULL ELSE atom ->> '$' END AS value FROM {NESTED.sql} AS n, json_tree(CASE WHEN json_valid(body) THEN CAST(body AS JSON) END) WHERE type NOT IN ('OBJECT', 'ARRAY')")
def json_leaf_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path and value of every leaf of the events' nested texts."""
    return json_leaves(NESTED.rows(spark, sf_dir), "id", "body")
