"""Categories and document types of receipts whose texts are put together from a part's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import receipts as P
from quillspark.operators import taxonomy as X
from quillspark.plans.registry import StandIn, choice, query

#: Each part's text has five pieces, each by another column; what it says in all is nowhere listed.
_PIECES = (
    choice("p_partkey", "GS 25 역삼점", "스타벅스 강남", "김밥천국", "이마트", "동네 cu", "유니클로 명동", "주유소"),
    choice("p_size", "POS 01", "메뉴명", "상품코드 880", "주문번호 12", "바코드", "P0S", "테이블 3"),
    choice("cast(floor(p_partkey / 7) as bigint)", "단가 수량 금액", "단가 금액", "수량"),
    choice("cast(floor(p_partkey / 31) as bigint)", "김치찌개 국밥 치킨", "아메리카노", "커피 라떼 쿠키", "소주 생맥주", "물티슈", "휘발유 20.5 L", "바지"),
    choice("cast(floor(p_partkey / 11) as bigint)", "밀크티", "재사용 봉투", "피자", "종량제", "주스"),
)
TEXT = " || ' ' || ".join(f"coalesce({p}, p_name)" for p in _PIECES)
TOLD = StandIn(
    "part",
    {
        "id": "p_partkey", "text": TEXT, "category": choice("cast(floor(p_partkey / 3) as bigint)", "식비", "식품 / 장보기", "카페/음료", "취미/쇼핑", "교통", "도서", "외식/식사", "의료", "??", "주유/차량"),
        "told": choice("cast(floor(p_partkey / 5) as bigint)", "welfare_benefit ", "TRAVEL_EXPENSE", "expense_report", "PURCHASE_REQUEST"), "found": choice("cast(floor(p_partkey / 13) as bigint)", "WELFARE_BENEFIT", "TRAVEL_EXPENSE", "", "purchase_request"),
        "source": choice("cast(floor(p_partkey / 17) as bigint)", "FILENAME_BUSINESS_CONTEXT", "OCR"), "review": "p_size % 5 = 0", "trusted": "p_size % 7 = 0",
    },
)


def _count(pattern: str, most: int) -> str:
    return f"least({most}, len(regexp_extract_all(t, '{pattern}')))"


_NAMED = f"CASE {' '.join(f"WHEN b = '{P._bare(c)}' THEN '{c}'" for c in P.CATEGORIES)} {' '.join(f"WHEN b = '{P._bare(old)}' THEN '{new}'" for old, new in P.FORMER.items())} END"
_OF = f"CASE WHEN named IN ({', '.join(f"'{c}'" for c in P.TRAVEL)}) THEN 'TRAVEL_EXPENSE' WHEN named IN ({', '.join(f"'{c}'" for c in P.PURCHASE)}) THEN 'PURCHASE_REQUEST' WHEN named IS NOT NULL THEN 'WELFARE_BENEFIT' END"
_KNOWN = "CASE WHEN upper(trim(coalesce({c}, ''))) IN ('EXPENSE_REPORT', 'TRAVEL_EXPENSE', 'PURCHASE_REQUEST', 'WELFARE_BENEFIT') THEN upper(trim({c})) END"
_BASE = f"""WITH told_ AS (SELECT *, lower(text) AS t, regexp_replace(lower(coalesce(category, '')), '[^0-9a-z가-힣]', '', 'g') AS b FROM {TOLD.sql}), named_ AS (SELECT *, {_NAMED} AS named FROM told_),
flags AS (SELECT *, regexp_matches(t, '메뉴명|주문메뉴|메뉴내역') AS menu, regexp_matches(t, '(^|[^0-9a-z_가-힣])pos([^0-9a-z_가-힣]|$)|p0s') AS pos FROM named_),
s AS (SELECT *, pos AND contains(t, '단가') AND contains(t, '수량') AND contains(t, '금액') AS tab, CASE WHEN menu THEN 2 ELSE 0 END + CASE WHEN regexp_matches(t, '주문금액|주문내역|주문번호|테이블|홀주문') THEN 2 ELSE 0 END + CASE WHEN menu AND pos THEN 2 ELSE 0 END + CASE WHEN pos AND contains(t, '단가') AND contains(t, '수량') AND contains(t, '금액') THEN 3 ELSE 0 END + {_count(X.DISHES, 3)} AS r,
  CASE WHEN regexp_matches(t, '마트|편의점|슈퍼|식자재|food\\s*market|gs\\s*25|(^|[^a-z])cu([^a-z]|$)|세븐일레븐|홈플러스|코스트코') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(t, '상품코드|바코드|종량제|재사용.*봉투') THEN 1 ELSE 0 END AS g,
  CASE WHEN regexp_matches(t, '{X.CAFES}') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(t, '{X.CAFE_GOODS}') THEN 2 ELSE 0 END + {_count(X.DRINKS, 2)} AS c FROM flags)
"""


@query(
    _BASE
    + """SELECT id, CAST(r AS INTEGER) AS restaurant, CAST(g AS INTEGER) AS grocery, CAST(c AS INTEGER) AS cafe, tab AS item_table, CASE WHEN named IS NULL THEN NULL
WHEN named IN ('식품/장보기', '외식/식사', '카페/음료') THEN CASE WHEN (tab OR r >= 3) AND r > c AND (r > g OR tab AND r = g) THEN '외식/식사' WHEN c > r AND (c >= 3 AND c >= g OR c >= 2 AND g = 0) THEN '카페/음료' WHEN g >= 3 AND g > r AND g > c THEN '식품/장보기' ELSE named END
WHEN b = '취미쇼핑' THEN CASE WHEN regexp_matches(t, '유니클로|(^|[^0-9a-z_가-힣])cos([^0-9a-z_가-힣]|$)|의류|셔츠|가디건|원피스|바지|재킷|신발|가방') THEN '의류/패션' WHEN regexp_matches(t, '물티슈|세제|생활용품|생활잡화|종량제|재사용.*봉투|스펀지|주방|욕실|청소') THEN '생활용품' ELSE '취미/선물' END
WHEN b = '교통' AND regexp_matches(t, '주유소|유종|휘발유|경유|등유|lpg|유류|리터|[0-9]+(\\.[0-9]+)?\\s*[lℓ]') THEN '주유/차량' ELSE named END AS refined FROM s"""
)
def refined_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories put right by the texts of receipts, with the scores that decide."""
    s = X.food_scores(F.lower("text"))
    return TOLD.rows(spark, sf_dir).withColumn("s", s).select("id", "s.restaurant", "s.grocery", "s.cafe", F.col("s.table").alias("item_table"), X.refine_category(F.col("category"), F.col("text")).alias("refined"))


@query(
    _BASE
    + f""", kinds AS (SELECT id, named, {_OF} AS kind, {_KNOWN.format(c="told")} AS mine, {_KNOWN.format(c="found")} AS rules, source, review, trusted FROM named_),
cases AS (SELECT *, CASE WHEN trusted AND mine IS NOT NULL AND named IS NOT NULL THEN 1 WHEN named IS NULL THEN CASE WHEN review THEN 2 ELSE 3 END WHEN review THEN 4 WHEN coalesce(mine <> kind, false) OR coalesce(rules <> kind, false) THEN 5 WHEN mine IS NULL AND rules IS NULL THEN 6 ELSE 7 END AS k FROM kinds)
SELECT id, CASE k WHEN 1 THEN mine WHEN 2 THEN NULL WHEN 3 THEN coalesce(rules, mine) WHEN 4 THEN coalesce(rules, kind) WHEN 5 THEN CASE WHEN source = 'FILENAME_BUSINESS_CONTEXT' AND rules IS NOT NULL THEN rules ELSE kind END ELSE kind END AS type, named AS category, k BETWEEN 2 AND 5 AS review,
CASE k WHEN 2 THEN 'model_requested_review' WHEN 3 THEN 'invalid_expense_category' WHEN 4 THEN 'model_requested_review' WHEN 5 THEN 'category_document_type_conflict' WHEN 6 THEN 'document_type_derived_from_category' END AS reason FROM cases"""
)
def validated_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document types that agree with their categories, and why others go to review."""
    rows = TOLD.rows(spark, sf_dir)
    return rows.select("id", X.validate_classification(*[F.col(c) for c in ("told", "category", "review", "found", "source", "trusted")]).alias("v")).select("id", "v.*")
