"""Expense categories from what a receipt tells of the place, and document types that have to agree with them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.text import compact
from quillspark.operators.receipts import canonical_category, document_type

# What a receipt of a restaurant, a shop for food or a café says, and what each is worth.
MENU, ORDER, POS, ITEM_TABLE = "메뉴명|주문메뉴|메뉴내역", "주문금액|주문내역|주문번호|테이블(?:번호)?|홀주문", r"(?U)\bpos\b|p0s", ("단가", "수량", "금액")
DISHES, MOST_DISHES = "국밥|찌개|탕|돈까스|치킨|닭강정|떡볶이|라볶이|파스타|피자|버거|햄버거|스테이크|삼겹|냉삼|소세지|소시지|어묵|감자튀김|꼬치|포케|하이볼|생맥주|소주", 3
SHOPS = r"마트|편의점|슈퍼|식자재|food\s*market|gs\s*25|(?<![a-z])cu(?![a-z])|세븐일레븐|이마트|홈플러스|롯데마트|코스트코"
SHOP_SIGNS = "상품코드|바코드|종량제|재사용.*봉투"
CAFES = "카페|coffee|공차|투썸|스타벅스|팀홀튼|커피빈|메가커피|컴포즈"
CAFE_GOODS = "아메리카노|카페라떼|밀크티|스무디|휘낭시에|마카롱|마들렌|스콘|케이크|크루아상"
DRINKS, MOST_DRINKS = "커피|라떼|주스|블랙티|아이스티|에이드|쿠키|디저트|베이커리", 2
CLOTHES = r"(?U)유니클로|\bcos\b|의류|셔츠|가디건|원피스|바지|재킷|신발|가방"
HOUSEHOLD = "물티슈|세제|생활용품|생활잡화|종량제|재사용.*봉투|스펀지|주방|욕실|청소"
FUEL = r"주유소|유종|휘발유|경유|등유|lpg|유류|리터|\d+(?:\.\d+)?\s*[lℓ]"
FOOD = ("식품/장보기", "외식/식사", "카페/음료")
DOCUMENT_TYPES = ("EXPENSE_REPORT", "TRAVEL_EXPENSE", "PURCHASE_REQUEST", "WELFARE_BENEFIT")
BY_NAME = "FILENAME_BUSINESS_CONTEXT"


def _worth(text: Column, pattern: str, points: int) -> Column:
    return F.when(text.rlike(pattern), points).otherwise(0)


def food_scores(text: Column) -> Column:
    """Struct restaurant, grocery, cafe and table: what a lower-cased text says for each, and whether a till printed a table of items."""
    menu, pos = text.rlike(MENU), text.rlike(POS)
    table = pos & text.rlike(ITEM_TABLE[0]) & text.rlike(ITEM_TABLE[1]) & text.rlike(ITEM_TABLE[2])
    restaurant = _worth(text, MENU, 2) + _worth(text, ORDER, 2) + F.when(menu & pos, 2).otherwise(0) + F.when(table, 3).otherwise(0) + F.least(F.lit(MOST_DISHES), F.regexp_count(text, F.lit(DISHES)))
    cafe = _worth(text, CAFES, 2) + _worth(text, CAFE_GOODS, 2) + F.least(F.lit(MOST_DRINKS), F.regexp_count(text, F.lit(DRINKS)))
    return F.struct(restaurant.alias("restaurant"), (_worth(text, SHOPS, 3) + _worth(text, SHOP_SIGNS, 1)).alias("grocery"), cafe.alias("cafe"), table.alias("table"))


def refine_category(value: Column, text: Column) -> Column:
    """A category, in its present name, put right by a receipt's text: among the three for food by scores, and two former ones by what was bought; null for unknown ones."""
    low = F.lower(F.coalesce(text, F.lit("")))
    s, named, raw = food_scores(low), canonical_category(value), compact(value)
    r, g, c = s["restaurant"], s["grocery"], s["cafe"]
    food = (
        F.when(s["table"] & (r >= g) & (r > c), "외식/식사")
        .when((r >= 3) & (r > g) & (r > c), "외식/식사")
        .when((c >= 3) & (c > r) & (c >= g), "카페/음료")
        .when((c >= 2) & (g == 0) & (c > r), "카페/음료")
        .when((g >= 3) & (g > r) & (g > c), "식품/장보기")
        .otherwise(named)
    )
    hobby = F.when(low.rlike(CLOTHES), "의류/패션").when(low.rlike(HOUSEHOLD), "생활용품").otherwise("취미/선물")
    return F.when(named.isNull(), F.lit(None)).when(named.isin(*FOOD), food).when(raw == "취미쇼핑", hobby).when((raw == "교통") & low.rlike(FUEL), "주유/차량").otherwise(named)


def known_type(value: Column) -> Column:
    """A document type in capitals; null for others."""
    name = F.upper(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(name.isin(*DOCUMENT_TYPES), name)


def validate_classification(told: Column, category: Column, review: Column, found: Column, source: Column, trusted: Column) -> Column:
    """Struct type, category, review and reason, from the type and category that a model told, and the type that rules found.

    The category decides the type.  Both types have to agree with it, or the document goes to review; a type
    found by the file's name stays even so.  A user's own choice of both (`trusted`) stands.
    """
    mine, rules, named = known_type(told), known_type(found), canonical_category(category)
    of = document_type(named)
    asked = F.coalesce(review, F.lit(False))
    clash = F.coalesce(mine != of, F.lit(False)) | F.coalesce(rules != of, F.lit(False))
    case = (
        F.when(F.coalesce(trusted, F.lit(False)) & mine.isNotNull() & named.isNotNull(), "trusted")
        .when(asked & named.isNull(), "nothing")
        .when(named.isNull(), "invalid_expense_category")
        .when(asked, "model_requested_review")
        .when(clash, "category_document_type_conflict")
        .when(mine.isNull() & rules.isNull(), "document_type_derived_from_category")
        .otherwise("agreed")
    )
    kind = F.when(case == "trusted", mine).when(case == "nothing", F.lit(None)).when(case == "invalid_expense_category", F.coalesce(rules, mine)).when(case == "model_requested_review", F.coalesce(rules, of)).when((case == "category_document_type_conflict") & F.coalesce(source == BY_NAME, F.lit(False)) & rules.isNotNull(), rules).otherwise(of)
    reason = F.when(case == "nothing", "model_requested_review").when(~case.isin("trusted", "agreed"), case)
    return F.struct(kind.alias("type"), named.alias("category"), case.isin("nothing", "invalid_expense_category", "model_requested_review", "category_document_type_conflict").alias("review"), reason.alias("reason"))
