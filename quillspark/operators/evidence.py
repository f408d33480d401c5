"""From a question to the passages that answer it, or to none: facets, boosts from real hits, and the gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T

# Words that ask for nothing in particular, words that ask, endings of verbs, and terms for one thing.
STOP_WORDS = ("회사", "사내", "직원", "우리", "오늘", "무엇", "뭘", "몇", "어떻게", "얼마", "하나요", "인가요", "되나요", "있나요", "해요", "해야", "가능", "최대", "진행", "정보", "내용", "문서", "관련", "대한", "대해", "질문", "답변")
INTERROGATIVES = ("언제", "언제야", "어디", "어디야", "누구", "왜", "무엇", "뭘", "어떻게", "몇", "얼마")
STEM_ENDINGS = ("가능한가요", "하려면", "하나요", "해야", "해서")
PREDICATE_ENDINGS = ("하다", "한다", "하나요", "인가요", "되나요", "있나요", "해야", "해요", "해서", "하려면", "되면", "내야", "쉬게", "넘게", "주나요", "가능한가요", "게", "면", "해")
NOMINAL_ENDINGS = ("서", "게", "면", "해")
NOT_SUBJECTS = ("아서", "어서", "려고", "짜리")
SAME_SUBJECT = {"퇴사": "퇴직"}
ASKED_AMOUNT = r"(?:며칠|몇\s*(?:원|일|개월|시간|시|퍼센트|%))(?:에|까지|이나|이|을|은)?(?=\s|[?!.]|$)"
TABLE_MARK = "[표 테이블 열 컬럼명]"
# The least likeness of the question and of a subject to a passage, and passages that are kept.
QUESTION_LIKE, SUBJECT_LIKE, KEPT = 0.55, 0.60, 4


def facet_token(token: Column) -> Column:
    """What a word of a question asks about; empty for short and empty words, stop words and verbs.

    A word that an object particle marked is kept although it ends like a verb's link.
    """
    bare = T.evidence_token(token, STEM_ENDINGS, (*STOP_WORDS, *INTERROGATIVES))
    ends = f"({'|'.join(PREDICATE_ENDINGS)})$"
    saved = token.rlike("(을|를)$") & bare.rlike(f"({'|'.join(NOMINAL_ENDINGS)})$")
    return F.when(bare.rlike(ends) & ~saved, "").otherwise(bare)


def facets(questions: DataFrame) -> DataFrame:
    """Questions (query_id, query) with asked (normal form), tokens, conditions, units and subjects."""
    step = questions.withColumn("asked", T.normalize_evidence(T.split_question_ending(F.coalesce("query", F.lit("")))))
    words = F.regexp_extract_all(F.regexp_replace("asked", ASKED_AMOUNT, " "), F.lit(rf"\d+(?:{T.UNITS})?|[가-힣a-zA-Z]+"), 0)
    step = step.withColumns({"tokens": F.array_distinct(F.filter(F.transform(words, facet_token), lambda t: t != "")), "conditions": T.conditions(F.col("asked")), "units": T.requested_units(F.col("asked"))})
    subject = F.filter("tokens", lambda t: ~t.rlike(rf"^\d+(?:{T.UNITS})$") & ~t.rlike(f"({'|'.join(NOT_SUBJECTS)})$"))
    known = F.create_map(*[F.lit(x) for pair in SAME_SUBJECT.items() for x in pair])
    return step.withColumn("subjects", F.transform(subject, lambda t: F.coalesce(F.try_element_at(known, t), t)))


def boosted(asked: DataFrame, found: DataFrame, sections: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Passages (query_id, doc_id, content, similarity) with what literal hits of the question's words and sections add; ranked again, ties by doc_id.

    asked has query_id and query; `sections` gives the keywords of a section that a question may name.
    """
    compact = F.regexp_replace(F.lower(F.col("query")), r"(?U)\s+", "")
    words = F.filter(F.array_distinct(F.split(F.translate(F.lower("query"), "?.", "  "), r"(?U)\s+")), lambda t: (F.length(t) >= 2) & ~t.isin("어떻게", "알려줘", "알려주세요", "무엇", "뭐야", "지원자", "지원자의"))
    named = F.flatten(F.array_compact(F.array(*[F.when(F.contains(compact, F.lit(name)), F.array(*map(F.lit, keys))) for name, keys in (sections or {}).items()]))) if sections else F.array().cast("array<string>")
    held = found.join(asked.select("query_id", words.alias("_words"), named.alias("_keys")), "query_id")
    section_hits = F.size(F.filter("_keys", lambda k: F.contains(F.lower("content"), k)))
    lifted = F.least(F.lit(1.0), F.col("similarity") + T.lexical_boost(section_hits, T.term_hits(F.col("_words"), F.col("content"))))
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), F.asc("doc_id"))
    return held.select("query_id", "doc_id", "content", F.round(lifted, 9).alias("similarity")).withColumn("rank", F.row_number().over(order))


def share_of(tokens: Column, unit: Column) -> Column:
    """Share of tokens that stand in a unit of evidence; 0 without tokens."""
    return F.when(F.size(tokens) > 0, F.size(F.filter(tokens, lambda t: F.contains(unit, t))) / F.size(tokens)).otherwise(0.0)


def unit_scores(told: DataFrame, passages: DataFrame) -> DataFrame:
    """(query_id, unit, score, best_subject): each unit of the passages with its likeness to the question, by words.

    Where a model's vectors are at hand, pass rows of the same form with cosines to `gate` instead.
    """
    units = passages.select("query_id", F.explode(T.evidence_units(F.col("content"))).alias("unit")).distinct()
    score = share_of(F.col("tokens"), F.col("unit"))
    return units.join(told.select("query_id", "tokens", "subjects"), "query_id").select("query_id", "unit", score.alias("score"), F.coalesce(F.array_max(F.transform("subjects", lambda s: F.contains(F.col("unit"), s).cast("double"))), F.lit(0.0)).alias("best_subject"))


def gate(told: DataFrame, passages: DataFrame, scores: DataFrame) -> DataFrame:
    """(query_id, accepted, reason, hits, passages) of every question, told as `facets` gives them.

    Accepted if the question is about a table's columns and a passage lists them (TABLE); else the passages must
    have a unit like the question, a subject literally or by likeness, all conditions supported by one
    unit that is like the question, and a word or condition of the question at all.
    """
    content = passages.groupBy("query_id").agg(F.count("*").alias("passages"), F.max(F.contains(T.normalize_evidence(F.col("content")), F.lit(TABLE_MARK))).alias("_table"))
    asked = told.select("query_id", "query", "tokens", "conditions", "subjects")
    units = scores.join(asked, "query_id")
    supported = F.forall("conditions", lambda c: T.condition_supported(c, F.col("unit")))
    per = units.groupBy("query_id").agg(
        F.max("score").alias("_best"),
        F.max("best_subject").alias("_near"),
        F.max((F.col("score") >= QUESTION_LIKE) & supported).alias("_linked"),
        F.array_distinct(F.flatten(F.collect_list(F.filter("tokens", lambda t: F.contains(F.col("unit"), t))))).alias("_hits"),
        F.max(F.exists("subjects", lambda s: F.contains(F.col("unit"), s))).alias("_literal"),
    )
    step = asked.join(content, "query_id", "left").join(per, "query_id", "left")
    hits = F.coalesce(F.size("_hits"), F.lit(0))
    reason = (
        F.when(F.col("passages").isNull(), "NO_PASSAGES")
        .when(F.col("_best").isNull(), "NO_EVIDENCE")
        .when(T.is_table_query(F.col("query")) & F.col("_table"), "TABLE")
        .when(F.col("_best") < QUESTION_LIKE, "UNLIKE")
        .when((F.size("subjects") > 0) & ~F.col("_literal") & (F.col("_near") < SUBJECT_LIKE), "NO_SUBJECT")
        .when((F.size("conditions") > 0) & ~F.col("_linked"), "CONDITION_NOT_SUPPORTED")
        .when((F.size("_hits") == 0) & (F.size("conditions") == 0), "NO_HITS")
        .otherwise("SUPPORTED")
    )
    return step.select("query_id", reason.isin("TABLE", "SUPPORTED").alias("accepted"), reason.alias("reason"), F.greatest(hits, F.lit(0)).cast("long").alias("hits"), F.coalesce("passages", F.lit(0)).alias("passages"))


def promoted(told: DataFrame, found: DataFrame, lexical: DataFrame) -> DataFrame:
    """Passages (query_id, doc_id, rank) ranked anew: lexical ones (query_id, doc_id, content, score) that hold two subjects or more come first.

    They come by subjects held, then score; the others keep their order.  Questions of fewer than two subjects stay as they are.
    """
    terms = told.select("query_id", F.array_distinct("subjects").alias("_s")).where(F.size("_s") >= 2)
    held = lexical.join(terms, "query_id").withColumn("_n", F.size(F.filter("_s", lambda s: F.contains(T.normalize_evidence(F.col("content")), s)))).where("_n >= 2")
    first = held.groupBy("query_id", "doc_id").agg(F.max(F.struct("_n", "score")).alias("_k"))
    every = found.select("query_id", "doc_id", "rank").join(first, ["query_id", "doc_id"], "full_outer")
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("_k"), F.asc_nulls_last("rank"), F.asc("doc_id"))
    return every.select("query_id", "doc_id", F.col("_k._n").alias("subjects"), F.row_number().over(order).alias("rank"))
