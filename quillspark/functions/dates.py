"""Dates: lenient parsing, Korean days, due times, periods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ways to write a date: a pattern and the places of year, month and day in it; a two-digit year is of this century.
FORMS = (
    (r"^(\d{4})(\d{2})(\d{2})$", (1, 2, 3)),
    (r"^(\d{4})\s*[-/.]\s*(\d{1,2})\s*[-/.]\s*(\d{1,2})(?:[ T]\d{1,2}:\d{2}(?::\d{2})?)?$", (1, 2, 3)),
    (r"^(\d{4})\s*년\s*(\d{1,2})\s*월\s*(\d{1,2})\s*일(?:\s+\d{1,2}:\d{2}(?::\d{2})?)?$", (1, 2, 3)),
    (r"^(\d{2})\s*[-/.]\s*(\d{1,2})\s*[-/.]\s*(\d{1,2})$", (1, 2, 3)),
    (r"^(\d{1,2})\s*/\s*(\d{1,2})\s*/\s*(\d{4})$", (3, 1, 2)),
)


def normal_date(value: Column) -> Column:
    """A date from one of several ways to write it; null for others and for days that don't exist."""
    text = F.trim(F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"(?U)\s+", " "))

    def read(pattern: str, places: tuple[int, int, int]) -> Column:
        year, month, day = (F.regexp_extract(text, pattern, i) for i in places)
        return F.try_to_date(F.concat_ws("-", F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")

    return F.coalesce(*[F.when(text.rlike(pattern), read(pattern, places)) for pattern, places in FORMS])


def date_in_text(text: Column, day: Column) -> Column:
    """Whether a text holds the day, its year in four or two digits, with separators or without."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"\D+", "-")
    held = F.concat(F.lit("-"), bare, F.lit("-"))
    forms = [F.date_format(day, f) for f in ("yyyy-MM-dd", "yyyy-M-d", "yy-MM-dd", "yy-M-d", "yyyyMMdd")]
    found = F.lit(False)
    for form in forms:
        found = found | F.contains(held, F.concat(F.lit("-"), form, F.lit("-")))
    return F.coalesce(found, F.lit(False))


def kst_day_of_text(value: Column) -> Column:
    """The Korean day of an ISO time (UTC where no zone is given); of other texts their first ten characters as a date."""
    iso = F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"), value)
    zoned = F.when(iso.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), iso).otherwise(F.concat(iso, F.lit("Z")))
    return F.coalesce(F.to_date(F.from_utc_timestamp(F.try_to_timestamp(zoned), "Asia/Seoul")), F.try_to_date(F.substring(value, 1, 10), "yyyy-MM-dd"))


def due_time(day: Column) -> Column:
    """The last minute of a day."""
    return F.to_timestamp_ntz(F.concat(day.cast("string"), F.lit(" 23:59:00")))


def is_urgent(due: Column, now: Column, status: Column) -> Column:
    """Whether what isn't done is due within two days from now."""
    return F.coalesce((due <= now + F.expr("INTERVAL 2 DAYS")) & (F.coalesce(status, F.lit("")) != "DONE"), F.lit(False))


def all_day_end(end_day: Column) -> Column:
    """The last minute of an all-day event whose end day isn't part of it."""
    return due_time(F.date_sub(end_day, 1))


def utc_text(ts: Column) -> Column:
    """A UTC time in ISO form, to the second."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
