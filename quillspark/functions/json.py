"""JSON texts: checks, canonical digests, aliases, merges, leaves."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keys that a receipt's answer must have.
RECEIPT_KEYS = ("merchant", "transaction_date", "expense_category", "supply_amount", "tax_amount", "discount_amount", "total_amount", "payment_method", "items")


def entries(text: Column) -> Column:
    """An object's top-level members as a map of texts; null if it isn't an object."""
    return F.when(F.coalesce(text, F.lit("")).rlike(r"^\s*\{"), F.from_json(text, "map<string, string>"))


def key_share(text: Column, keys: tuple[str, ...] = RECEIPT_KEYS) -> Column:
    """Share of the keys that the object has, with whatever value; 0 for what isn't one."""
    held = F.coalesce(F.map_keys(entries(text)), F.array().cast("array<string>"))
    return F.size(F.array_intersect(held, F.array(*map(F.lit, keys)))) / len(keys)


def canonical(text: Column) -> Column:
    """The object with its top-level members in order of their names; values as text."""
    pairs = F.array_sort(F.map_entries(entries(text)))
    return F.when(entries(text).isNotNull(), F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda e: F.concat(F.lit('"'), e["key"], F.lit('":"'), F.coalesce(e["value"], F.lit("null")), F.lit('"'))), ","), F.lit("}")))


def first_of(members: Column, *names: str) -> Column:
    """The value of the first of several names that a map has."""
    return F.coalesce(*[F.try_element_at(members, F.lit(name)) for name in names])


def merged(base: Column, change: Column) -> Column:
    """Members of both maps, those of the change where both have one; a null map has none."""
    none = F.create_map().cast("map<string, string>")
    base, change = F.coalesce(base, none), F.coalesce(change, none)
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys(change), k)), change)


def distinct_reasons(reasons: Column, aliases: dict[str, str]) -> Column:
    """Codes by their present names, each once, in order of first appearance."""
    named = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.array_distinct(F.transform(reasons, lambda r: F.coalesce(F.try_element_at(named, r), r)))
