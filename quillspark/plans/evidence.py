"""Questions answered from documents, or not: benchmark texts ask, documents with rules on days and amounts answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import evidence as V
from quillspark.operators import retrieval as R
from quillspark.plans.queries import BM25
from quillspark.plans.registry import query
from quillspark.session import checkpointed
from quillspark.sources.tables import table

#: Questions and documents in both engines' words: the first words of a text, with amounts made of other columns.
ASKED = "substr(text, 1, 60) || CASE WHEN item_id % 3 = 0 THEN ' ' || cast(length(text) % 400 as string) || '일 초과 처리는 며칠인가요?' WHEN item_id % 3 = 1 THEN ' 퇴사를 하려면 한 달 어떻게 해?' ELSE ' 표의 열 이름 알려줘' END"
SAID = "coalesce(text, '') || '\n기준 ' || cast(n_chars % 300 + 150 as string) || '일 이상, 한도 ' || cast(n_chars % 7 + 1 as string) || '만원. 퇴직 1개월' || CASE WHEN n_chars % 11 = 0 THEN ' [표 테이블 열 컬럼명] 1열: a' ELSE '' END"


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.expr(ASKED).alias("query"))


_ENDING = r"(알려주세요|알려줄래|알려줘|무엇이야|뭔가요|뭐야|인가요|언제야|어디야|진행해|어떻게\s*하나요|어떻게\s*해)([?!？！.。]*)\s*$"


def _normal(value: str) -> str:
    """The normal form of evidence in the other engine's words; amounts of ten thousands are whole here."""
    text = f"lower({value})"
    for spelt, digits in T.DURATIONS.items():
        text = f"replace({text}, '{spelt}', '{digits}')"
    return rf"trim(regexp_replace(regexp_replace(regexp_replace({text}, '(\d+)\s*만원', '\g1' || '0000원', 'g'), '(\d)\s*원', '\1원', 'g'), '\s+', ' ', 'g'))".replace(r"'\g1' || ", "'\\1' || ")


def _one_of(words: tuple[str, ...]) -> str:
    return "'(" + "|".join(words) + ")$'"


_TOKEN = rf"""list_transform(list_transform(words, lambda w: struct_pack(w := w, b := regexp_replace(regexp_replace(w, '{_ENDING}', ''), '({T.EVIDENCE_PARTICLES})$', ''))), lambda s: struct_pack(w := s.w, b := CASE WHEN regexp_matches(s.b, {_one_of(V.STEM_ENDINGS)}) THEN CASE WHEN length(regexp_replace(s.b, {_one_of(V.STEM_ENDINGS)}, '')) >= 2 THEN regexp_replace(s.b, {_one_of(V.STEM_ENDINGS)}, '') ELSE '' END ELSE s.b END))"""
FACETS = rf"""
questions AS (SELECT item_id AS query_id, {ASKED} AS query FROM benchmark),
split AS (SELECT *, CASE WHEN regexp_matches(query, '{_ENDING}') THEN regexp_replace(regexp_replace(query, '{_ENDING}', ''), '\s+$', '') || ' ' || regexp_replace(regexp_extract(query, '{_ENDING}', 1), '^어떻게\s*', '어떻게 ') || regexp_extract(query, '{_ENDING}', 2) ELSE query END AS q FROM questions),
asked_ AS (SELECT query_id, query, {_normal("q")} AS asked FROM split),
cut AS (SELECT *, regexp_extract_all(regexp_replace(asked, '(?:며칠|몇\s*(?:원|일|개월|시간|시|퍼센트|%))(?:에|까지|이나|이|을|은)?(\s|[?!.]|$)', ' \1', 'g'), '\d+(?:{T.UNITS})?|[가-힣a-zA-Z]+') AS words, regexp_extract_all(asked, '\d+(?:{T.UNITS})') AS conditions FROM asked_),
stemmed AS (SELECT *, {_TOKEN} AS stems FROM cut),
kept AS (SELECT *, list_distinct(list_transform(list_filter(stems, lambda s: length(s.b) >= 2 AND s.b NOT IN ({", ".join(f"'{w}'" for w in {*V.STOP_WORDS, *V.INTERROGATIVES})}) AND NOT (regexp_matches(s.b, {_one_of(V.PREDICATE_ENDINGS)}) AND NOT (regexp_matches(s.w, '(을|를)$') AND regexp_matches(s.b, {_one_of(V.NOMINAL_ENDINGS)})))), lambda s: s.b)) AS tokens FROM stemmed),
facets AS (SELECT *, list_transform(list_filter(tokens, lambda t: NOT regexp_matches(t, '^\d+({T.UNITS})$') AND NOT regexp_matches(t, {_one_of(V.NOT_SUBJECTS)})), lambda t: CASE t WHEN '퇴사' THEN '퇴직' ELSE t END) AS subjects FROM kept)
"""


@query(f"WITH {FACETS} SELECT query_id, asked, array_to_string(list_sort(tokens), '|') AS tokens, array_to_string(conditions, '|') AS conditions, array_to_string(list_sort(subjects), '|') AS subjects FROM facets")
def question_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What questions ask about and under which conditions."""
    found = V.facets(_asked(spark, sf_dir))
    return found.select("query_id", "asked", *[F.array_join(F.array_sort(c) if c != "conditions" else F.col(c), "|").alias(c) for c in ("tokens", "conditions", "subjects")])


_UNIT = "regexp_replace(regexp_extract({q}, '(원|일|개월|시간|퍼센트|%)$', 1), '^%$', '퍼센트')"
EVIDENCE = BM25.replace("FROM benchmark", f"FROM (SELECT item_id, {ASKED} AS text FROM benchmark)").replace("FROM documents", f"FROM (SELECT doc_id, {SAID} AS text FROM documents)") + rf""",
{FACETS},
contents AS (SELECT doc_id, {SAID} AS content FROM documents),
base AS (SELECT query_id, doc_id, content, score / max(score) OVER (PARTITION BY query_id) * 0.5 AS similarity FROM lexical JOIN contents USING (doc_id)),
worded AS (SELECT query_id, list_filter(list_distinct(regexp_split_to_array(translate(lower(query), '?.', '  '), '\s+')), lambda t: length(t) >= 2 AND t NOT IN ('어떻게', '알려줘', '알려주세요', '무엇', '뭐야', '지원자', '지원자의')) AS terms FROM questions),
lifted AS (SELECT query_id, doc_id, content, round(least(1.0, similarity + least(0.45, 0.04 * len(list_filter(terms, lambda t: contains(lower(content), regexp_replace(t, '[은는이가을를의]+$', '')))))), 9) AS similarity FROM base JOIN worded USING (query_id)),
passages AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, doc_id) AS rank FROM lifted QUALIFY rank <= {V.KEPT}),
told AS (SELECT query_id, doc_id, {_normal("content")} AS content FROM passages),
pieces AS (SELECT query_id, content, list_filter(list_transform(regexp_split_to_array(content, '[\n.!?]+'), lambda s: trim(s)), lambda s: length(s) >= 4) AS s FROM told WHERE content <> ''),
units AS (SELECT DISTINCT query_id, unnest(list_concat([content], s[1 : 2])) AS unit FROM pieces),
judged AS (SELECT query_id, unit, tokens, conditions, subjects, CASE WHEN len(tokens) > 0 THEN len(list_filter(tokens, lambda t: contains(unit, t))) / len(tokens) ELSE 0 END AS score FROM units JOIN facets USING (query_id)),
asked_for AS (SELECT query_id, unit, score, unnest(conditions) AS c FROM judged),
bounds AS (SELECT query_id, unit, c, TRY_CAST(regexp_extract(c, '^(\d+)', 1) AS DOUBLE) AS n, {_UNIT.format(q="c")} AS u, regexp_extract_all(unit, '\d+(?:{T.UNITS})(?:을|를|이|가|은|는)?\s*(?:초과|이상|이하|미만|한도)') AS bs, list_filter(regexp_extract_all(unit, '\d+(?:{T.UNITS})'), lambda q: {_UNIT.format(q="q")} = {_UNIT.format(q="c")}) AS qs FROM asked_for),
met AS (SELECT query_id, unit, c, contains(unit, c) OR len(list_filter(bs, lambda b: regexp_replace(regexp_extract(b, '^\d+({T.UNITS})', 1), '^%$', '퍼센트') = u AND CASE regexp_extract(b, '(초과|이상|이하|미만|한도)$', 1) WHEN '초과' THEN n > CAST(regexp_extract(b, '^\d+') AS DOUBLE) WHEN '이상' THEN n >= CAST(regexp_extract(b, '^\d+') AS DOUBLE) WHEN '이하' THEN n <= CAST(regexp_extract(b, '^\d+') AS DOUBLE) WHEN '미만' THEN n < CAST(regexp_extract(b, '^\d+') AS DOUBLE) ELSE true END)) > 0
  OR coalesce(len(list_distinct(list_transform(qs, lambda q: CAST(regexp_extract(q, '^\d+') AS DOUBLE)))) >= 2 AND list_min(list_transform(qs, lambda q: CAST(regexp_extract(q, '^\d+') AS DOUBLE))) <= n AND n <= list_max(list_transform(qs, lambda q: CAST(regexp_extract(q, '^\d+') AS DOUBLE))), false) AS ok FROM bounds),
linked AS (SELECT query_id, max(score >= {V.QUESTION_LIKE} AND coalesce(ok, true)) AS linked FROM judged LEFT JOIN (SELECT query_id, unit, bool_and(ok) AS ok FROM met GROUP BY ALL) USING (query_id, unit) GROUP BY query_id),
per AS (SELECT query_id, max(score) AS best, max(len(list_filter(subjects, lambda s: contains(unit, s))) > 0) AS literal FROM judged GROUP BY query_id),
hit AS (SELECT query_id, count(DISTINCT t) AS hits FROM (SELECT query_id, unnest(list_filter(tokens, lambda t: contains(unit, t))) AS t FROM judged) GROUP BY query_id),
tables AS (SELECT query_id, count(*) AS passages, max(contains(content, '[표 테이블 열 컬럼명]')) AS listed FROM told GROUP BY query_id),
verdicts AS (SELECT f.query_id, coalesce(hits, 0) AS hits, coalesce(passages, 0) AS passages, CASE WHEN passages IS NULL THEN 'NO_PASSAGES' WHEN best IS NULL THEN 'NO_EVIDENCE'
  WHEN regexp_matches(replace(lower(query), ' ', ''), '열|컬럼|행|헤더') AND (regexp_matches(query, '표|테이블') OR regexp_matches(replace(lower(query), ' ', ''), '(?:열|컬럼)(?:이름|명|구성)|헤더')) AND listed THEN 'TABLE' WHEN best < {V.QUESTION_LIKE} THEN 'UNLIKE' WHEN len(subjects) > 0 AND NOT literal THEN 'NO_SUBJECT'
  WHEN len(conditions) > 0 AND NOT linked THEN 'CONDITION_NOT_SUPPORTED' WHEN coalesce(hits, 0) = 0 AND len(conditions) = 0 THEN 'NO_HITS' ELSE 'SUPPORTED' END AS reason FROM facets f LEFT JOIN per USING (query_id) LEFT JOIN linked USING (query_id) LEFT JOIN hit USING (query_id) LEFT JOIN tables USING (query_id))
"""


@query(EVIDENCE + "SELECT query_id, reason IN ('TABLE', 'SUPPORTED') AS accepted, reason, hits, passages FROM verdicts")
def answered_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the best passages for each question carry an answer: BM25, boosts by literal hits, the best four, the gate."""
    asked = _asked(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(SAID).alias("text"))
    found = R.bm25(asked.select("query_id", F.col("query").alias("text")), docs)
    top = found.groupBy("query_id").agg(F.max("score").alias("_top"))
    likely = found.join(top, "query_id").select("query_id", "doc_id", (F.col("score") / F.col("_top") * 0.5).alias("similarity"))
    # A dozen rows a question go to the texts, not the texts of all documents to them.
    scored = docs.withColumnRenamed("text", "content").join(F.broadcast(likely), "doc_id")
    passages = V.boosted(asked, scored.select("query_id", "doc_id", "content", "similarity")).where(F.col("rank") <= V.KEPT)
    told, passages = V.facets(asked), checkpointed(passages)
    return V.gate(told, passages, V.unit_scores(told, passages))
