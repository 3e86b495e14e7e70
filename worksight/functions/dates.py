"""Dates as they stand in documents, orders, records and collectors, whose formats and bounds differ; unreadable ones are NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words for numbers in tender documents.
NUMBER_WORDS = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12,
    "fifteen": 15, "eighteen": 18, "twenty four": 24, "thirty": 30,
}
#: Headings before a period of completion, and what ends the passage after one.
PERIOD_HEADING = r"period\s+of\s+completion|time\s+(?:allowed\s+)?for\s+completion|stipulated\s+period|completion\s+period|time\s+limit"
PERIOD_END = r"(?i)defects?\s+liability|bid\s+validity|validity\s+period|final\s+payment|Note\s*:"


def _day_month_year(c: Column, shape: str, first: int, last: int) -> Column:
    part = lambda k: F.regexp_extract(c, shape, k).try_cast("int")
    parts = F.transform(F.array(F.struct(part(3).alias("y"), part(2).alias("m"), part(1).alias("d"))), lambda p: F.struct((p["y"] + F.when(p["y"] < 100, 2000).otherwise(0)).alias("y"), p["m"].alias("m"), p["d"].alias("d")))
    read = F.transform(parts, lambda p: F.when(p["y"].between(first, last), F.try_to_date(F.concat_ws("-", p["y"], p["m"], p["d"]), "y-M-d")))
    return F.when(c.rlike(shape), F.get(read, F.lit(0)))  # through arrays of one, so that each part is read once


def document_date(c: Column) -> Column:
    """Day, month and year alone, of 2005 to 2030; years of two digits are of this century."""
    return _day_month_year(c, r"^(\d{1,2})[./-](\d{1,2})[./-](\d{2,4})$", 2005, 2030)


def order_date(c: Column) -> Column:
    """At the start of a text, blanks between its parts allowed, of 2005 to 2035."""
    return _day_month_year(c, r"^(\d{1,2})\s*[./-]\s*(\d{1,2})\s*[./-]\s*(\d{2,4})", 2005, 2035)


def _month_named(c: Column) -> Column:
    """Month names as the parser wants them, whatever their case."""
    return F.initcap(F.regexp_replace(c, "-", " "))


def _first_layout(c: Column, layouts: tuple[tuple[str, str], ...]) -> Column:
    tries = []
    for shape, layout in layouts:
        text = _month_named(c) if "MMM" in layout else c
        tries.append(F.when(c.rlike(shape), F.try_to_date(text, layout.replace("-", " ") if "MMM" in layout else layout)))
    return F.coalesce(*tries)


_ISO, _NAMED = (r"^\d{4}-\d{1,2}-\d{1,2}$", "y-M-d"), (r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "d-MMM-y")


def record_date(c: Column) -> Column:
    """Four layouts after a line break and what follows it are cut off; after 1950."""
    text = F.trim(F.substring(F.trim(F.regexp_replace(c, r"(?s)<br\s*/?>.*", "")), 1, 11))
    day = _first_layout(text, (_ISO, _NAMED, (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-y"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/y")))
    return F.when(F.year(day) > 1950, day)


def collector_date(c: Column) -> Column:
    """ISO text of two layouts; empty, never NULL, when unreadable."""
    return F.coalesce(_first_layout(F.substring(F.trim(c), 1, 11), (_ISO, _NAMED)).cast("string"), F.lit(""))


def iso_date(c: Column) -> Column:
    """Of the first ten characters."""
    head = F.substring(c, 1, 10)
    return F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(head, "yyyy-MM-dd"))


def add_days(day: Column, n: Column) -> Column:
    return F.date_add(day, n.cast("int"))


def whole_units(later: Column, earlier: Column, days: int) -> Column:
    """Whole months of 30 or years of 365 days between two dates, rounded down also when negative."""
    return F.floor(F.datediff(later, earlier) / F.lit(days)).cast("int")


def quarter_end(day: Column) -> Column:
    return F.last_day(F.add_months(F.trunc(day, "quarter"), 2))


def quarters(first: Column, last: Column) -> Column:
    """Array of (begin, end): the first window begins at first, the others at a quarter's distance; the last is cut at last."""
    month = F.trunc(first, "month")
    begins = F.filter(F.sequence(month, F.greatest(month, last), F.expr("INTERVAL 3 MONTH")), lambda b: b <= last)
    return F.transform(begins, lambda b: F.struct(F.greatest(b, first).alias("begin"), F.least(F.date_sub(F.add_months(b, 3), 1), last).alias("end")))


def completion_period(c: Column) -> Column:
    """Struct (days, text) of the period of completion that a tender document states after such a heading, or NULL.

    Months have 30 days; periods of a week to four years count, and passages on other periods end the search.
    """
    windows = F.regexp_extract_all(c, F.lit(rf"(?i)(?:{PERIOD_HEADING})(?=([\s\S]{{0,900}}))"), F.lit(1))
    number = r"(?i)(\d{1,3})\s*(?:\(\s*[a-z ]+\s*\))?\s*(calendar\s+)?(days?|months?)\b"
    word = rf"(?i)\b({'|'.join(NUMBER_WORDS)})\s*(calendar\s+)?(days?|months?)\b"
    values = F.create_map(*(F.lit(x) for pair in NUMBER_WORDS.items() for x in pair))

    def read(window: Column, pattern: str) -> Column:
        n = F.lower(F.regexp_extract(window, pattern, 1))
        n = F.coalesce(n.try_cast("int"), F.try_element_at(values, n))
        days = n * F.when(F.lower(F.regexp_extract(window, pattern, 3)).startswith("month"), 30).otherwise(1)
        text = F.trim(F.regexp_replace(F.regexp_extract(window, pattern, 0), r"\s+", " "))
        return F.when(window.rlike(pattern) & days.between(7, 1460), F.struct(days.alias("days"), text.alias("text")))

    cut = F.transform(windows, lambda w: F.element_at(F.split(w, PERIOD_END), 1))
    found = F.transform(cut, lambda w: F.coalesce(read(w, number), read(w, word)))
    return F.try_element_at(F.filter(found, lambda x: x.isNotNull()), F.lit(1))
