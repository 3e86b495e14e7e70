"""Column -> Column text functions: names, references, tags and displayed amounts. NULL in, NULL out unless said otherwise."""

from __future__ import annotations

import html
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words that carry no content in a work's description, and such that carry none in a firm's name.
STOP = tuple(
    "a an and the of in to for at on by from with near opp opposite other works work various including incl etc no nos ward wards sub division"
    " area areas surrounding surroundings road roads improvements improvement development developments developmental providing construction"
    " comprehensive allied as per year tender call package pkg constituency layout assembly old new main cross".split()
)
NAME_STOP = tuple(
    "m s sri shri the and pvt ltd limited private co company constructions construction enterprises enterprise engineering engineers works infra"
    " infrastructure infrastructures associates contractor contractors india escrow a c account electricals electrical consultants consultant".split()
)
#: Spellings that mean another word. An area's own are added by its configuration.
SPELLINGS = {
    "blcok": "block", "drian": "drain", "drians": "drains", "improvments": "improvements", "comprohensive": "comprehensive", "comprehesive": "comprehensive",
    "maintainance": "maintenance", "maintanance": "maintenance", "footpaths": "footpath", "drains": "drain",
}
#: Kinds of work and the patterns that name them in normalised text.
WORK_TYPES = {
    "road": r"asphalt|road|cc road|cement concrete|cobble|paver|pothole|white ?topping",
    "drain": r"drain|culvert|swd|desilt|slab",
    "footpath": r"footpath|foot path",
    "water": r"borewell|bore well|water supply|drinking water|\bro plant|pipeline|pipe line|sump|rain ?water",
    "light": r"street ?light|lighting|\bled\b|high mast|electri",
    "park": r"\bpark|garden|playground|play ground|gazebo|badminton",
    "building": r"building|bhavan|school|office|toilet|hall|canteen|nursery|reading room",
    "burial": r"burial|cremat",
    "waste": r"waste|garbage|dust ?bin|shredder|compost",
    "signage": r"name ?board|sign ?board|signage",
}
#: Common words by which readable English is told from a misread page.
COMMON = tuple("the of and to work for in is by as per with rs amount no dated your above this be on at from total rate qty quantity road engineer".split())
NUMBER = r"(?<![\w.])\d[\d,]*(?:\.\d+)?(?![\w])"
#: The pattern of a schedule-of-rates code, and books' other spellings.
CODE = r"(?i)\b(KS?R{1,2}B|KBSR|KPWD|SR|MORTH|M\s*O\s*R\s*T\s*H)\s*[-:.]?\s*([A-Z]?\s?\d{1,4}(?:[.\-]\d{1,3}){0,3})"
BOOKS = {"KRRB": "KSRRB", "KRB": "KSRB"}


def _literal_map(values: Mapping[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def _none_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def base_tender(c: Column) -> Column:
    """A tender's number without its call; NULL counts as empty."""
    return F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"(?i)/CALL-\d+$", "")


def call_number(c: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.coalesce(c, F.lit("")), r"(?i)/CALL-(\d+)$", 1).try_cast("int"), F.lit(1))


def words(c: Column, spellings: Mapping[str, str] = SPELLINGS) -> Column:
    """Lower-case words of letters and digits, other spellings replaced; an empty array for NULL."""
    split = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " ")), " ")
    known = _literal_map(spellings) if spellings else None
    respelt = F.transform(split, lambda w: F.coalesce(F.try_element_at(known, w), w)) if spellings else split
    return F.filter(respelt, lambda w: w != "")


def norm(c: Column, spellings: Mapping[str, str] = SPELLINGS) -> Column:
    return F.array_join(words(c, spellings), " ")


def content_words(c: Column, spellings: Mapping[str, str] = SPELLINGS, stop: Sequence[str] = STOP) -> Column:
    """Words of two letters or more that say something about the work; long numbers don't."""
    return F.filter(words(c, spellings), lambda w: ~w.isin(*stop) & ~w.rlike(r"^\d{4,}$") & (F.length(w) > 1))


def name_words(c: Column) -> Column:
    """The distinct words by which a firm is known."""
    return F.array_distinct(F.filter(words(c), lambda w: (F.length(w) > 2) & ~w.isin(*NAME_STOP) & ~w.rlike(r"^\d+$")))


def norm_name(c: Column) -> Column:
    """A person's or firm's name without titles, legal forms and a portal's numbering; empty for NULL."""
    x = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\(\s*\d+\s*\)", " ")
    x = F.regexp_replace(x, "[^a-z0-9 ]+", " ")
    x = F.regexp_replace(x, r"\b(m\s*/?\s*s|messrs|mr|mrs|ms|sri|shri|smt|the|and|&)\b", " ")
    x = F.regexp_replace(x, r"\b(pvt|private|ltd|limited|llp|co|company)\b", " ")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def person_and_firm(c: Column) -> Column:
    """Struct (person, firm) of a display name ``PERSON( FIRM )``; firm is NULL without one."""
    shape = r"^\s*(.*?)\s*\(\s*(.*?)\s*\)\s*$"
    inner = F.trim(F.regexp_extract(c, shape, 2))
    split = c.rlike(shape) & ~inner.rlike(r"^\d+$")
    person = F.when(split, F.regexp_extract(c, shape, 1)).otherwise(c)
    return F.struct(norm_name(person).alias("person"), F.when(split, _none_if_empty(norm_name(inner))).alias("firm"))


def tags(c: Column, patterns: Mapping[str, str]) -> Column:
    """Sorted names of the patterns that a text holds."""
    return F.array_sort(F.array_compact(F.array(*(F.when(c.rlike(p), F.lit(name)) for name, p in patterns.items()))))


def work_types(c: Column, spellings: Mapping[str, str] = SPELLINGS) -> Column:
    return tags(norm(c, spellings), WORK_TYPES)


def place_keys(c: Column, localities: Mapping[str, str] | None = None, spellings: Mapping[str, str] = SPELLINGS) -> Column:
    """Sorted keys of the blocks, mains, crosses and named localities in a text: block5, main17g, cross3."""
    t = norm(c, spellings)
    blocks = F.transform(F.regexp_extract_all(t, F.lit(r"\b(\d{1,2})(?:st|nd|rd|th)?\s*([a-d])?\s*block\b"), F.lit(1)), lambda n: F.concat(F.lit("block"), n))
    street = r"\b(\d{1,2})(?:st|nd|rd|th)\s*([a-h])?\s*(main|cross)\b"
    numbers, letters, kinds = (F.regexp_extract_all(t, F.lit(street), F.lit(k)) for k in (1, 2, 3))
    streets = F.transform(F.arrays_zip(kinds.alias("k"), numbers.alias("n"), letters.alias("l")), lambda x: F.concat(x["k"], x["n"], x["l"]))
    named = tags(t, localities) if localities else F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.concat(blocks, streets, named)))


def with_equivalents(numbers: Column, classes: Sequence[Sequence[str]]) -> Column:
    """Sorted numbers and all that are equal to one of them."""
    groups = [F.when(F.arrays_overlap(numbers, F.array(*map(F.lit, g))), F.array(*map(F.lit, g))).otherwise(F.array().cast("array<string>")) for g in classes]
    return F.array_sort(F.array_distinct(F.concat(numbers, *groups)))


def ward_numbers(c: Column, classes: Sequence[Sequence[str]] = ()) -> Column:
    """Sorted ward numbers of a list such as ``ward No 147 A, 148 B and 173``, with those that equal them."""
    head = r"(?i)wards?\s*(?:no|nos|number)?s?\.?\s*[:\-]?\s*(\d{1,3})(?=([\s\S]{0,90}))"
    firsts, tails = F.regexp_extract_all(c, F.lit(head), F.lit(1)), F.regexp_extract_all(c, F.lit(head), F.lit(2))
    cut = F.transform(tails, lambda t: F.element_at(F.split(t, r"(?i)\b(?:in|of|under|for|package|pkg)\b"), 1))
    rest = F.flatten(F.transform(cut, lambda t: F.regexp_extract_all(t, F.lit(r"\b(\d{2,3})\b"), F.lit(1))))
    old = F.regexp_extract_all(c, F.lit(r"(?i)old\s*no\.?\s*(\d{1,3})"), F.lit(1))
    return with_equivalents(F.array_distinct(F.concat(firsts, rest, old)), classes)


def title_case(c: Column) -> Column:
    """Every run of letters begins with a capital, also after an apostrophe or a dot."""
    runs = F.regexp_extract_all(c, F.lit("[A-Za-z]+|[^A-Za-z]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1_000_000)))), "")


def extract_locations(c: Column, pattern: str, upper: Sequence[str] = (), most: int = 6) -> Column:
    """The first distinct places that a pattern finds, in title case; ordinals and the words in upper keep their usual case."""

    def shown(place: Column) -> Column:
        x = title_case(F.trim(F.regexp_replace(place, r"\s+", " "), F.lit(" ,")))
        for suffix in ("St", "Nd", "Rd", "Th"):
            x = F.regexp_replace(x, rf"(\d){suffix}\b", f"$1{suffix.lower()}")
        for word in upper:
            x = F.regexp_replace(x, rf"\b{word.title()}\b", word.upper())
        return x

    return F.slice(F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(f"(?i)(?:{pattern})"), F.lit(0)), shown)), 1, most)


def search_text(*columns: Column) -> Column:
    return F.lower(F.array_join(F.array_compact(F.array(*(_none_if_empty(c) for c in columns))), " "))


def rate_code(c: Column) -> Column:
    """The first schedule-of-rates code in a text, in one spelling, or NULL."""
    book = F.regexp_replace(F.upper(F.regexp_extract(c, CODE, 1)), "[^A-Z]", "")
    book = F.coalesce(F.try_element_at(_literal_map(BOOKS), book), book)
    return F.when(c.rlike(CODE), F.concat(book, F.lit(" "), F.upper(F.regexp_replace(F.regexp_extract(c, CODE, 2), r"\s+", ""))))


def number_tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(NUMBER), F.lit(0))


@F.pandas_udf(StringType())
def html_unescape(c: pd.Series) -> pd.Series:
    """Named and numeric entities become characters; the table of names is Python's."""
    return c.map(html.unescape, na_action="ignore")


def url_base_name(c: Column) -> Column:
    """The decoded last part of a web address; what can't be decoded stays as it is."""
    last = F.element_at(F.split(c, "/"), -1)
    return F.coalesce(F.try_url_decode(last), last)


def english_words(c: Column) -> Column:
    """How many common words a text holds; near 0 for a page read upside down."""
    return F.size(F.filter(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z]+"), F.lit(0)), lambda w: w.isin(*COMMON)))


def long_words(c: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("[A-Za-z]{4,}"), F.lit(0)))


def _scaled(c: Column, crore: int, lakh: int) -> Column:
    x = c.cast("double")
    shown = lambda v, places, unit: F.concat(F.lit("₹"), F.format_number(v, places), F.lit(unit))
    return F.when(F.abs(x) >= 1e7, shown(x / 1e7, crore, " Cr")).when(F.abs(x) >= 1e5, shown(x / 1e5, lakh, " L")).otherwise(shown(x, 0, ""))


def rupees(c: Column) -> Column:
    """₹ with crore or lakh to two places; NULL stays NULL."""
    return F.when(c.isNotNull(), _scaled(c, 2, 2))


def rupees_in_case(c: Column) -> Column:
    """As cases show it: lakh to one place, NULL as unknown."""
    return F.when(c.isNull(), "unknown").otherwise(_scaled(c, 2, 1))


def rupees_in_chart(c: Column) -> Column:
    """As charts show it: crore to one place, lakh to none, NULL as nothing."""
    return _scaled(F.coalesce(c.cast("double"), F.lit(0.0)), 1, 0)


def rupees_in_full(c: Column) -> Column:
    """Whole rupees, grouped by a thousand and then by hundreds."""
    digits = F.bround(c.cast("double"), 0).cast("bigint").cast("string")
    return F.concat(F.lit("₹"), F.regexp_replace(digits, r"(?<=\d)(?=(?:\d\d)*\d{3}$)", ","))


def quantity(c: Column) -> Column:
    """Two places at most, without zeros at the end."""
    return F.regexp_replace(F.format_number(c.cast("double"), 2), r"\.?0+$", "")


def day_text(c: Column) -> Column:
    """``05 Jan 2024`` for a date in ISO form; other text as it is."""
    text = _none_if_empty(c.cast("string"))
    return F.coalesce(F.date_format(F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"), "dd MMM yyyy"), text)


def fact_text(field: Column, value: Column, money: Sequence[str], dates: Sequence[str]) -> Column:
    """How a fact's value is displayed."""
    days = F.floor(value.try_cast("double"))
    months = F.when(days >= 60, F.concat(F.lit(" (~"), F.bround(days / 30, 0).cast("int").cast("string"), F.lit(" months)"))).otherwise("")
    return (
        F.when(value.isNull(), F.lit(None).cast("string"))
        .when(field.isin(*money), rupees(value.try_cast("double")))
        .when(field.isin(*dates), day_text(value))
        .when(field == "period_days", F.concat(days.cast("string"), F.lit(" days"), months))
        .when(field == "paid_vs_contract", F.concat(F.format_number(100 * value.try_cast("double"), 0), F.lit("%")))
        .when(field == "tender_calls", F.when(value == "1", "1 (first call)").otherwise(F.concat(value, F.lit(" calls"))))
        .otherwise(value)
    )


def status_class(c: Column) -> Column:
    s = F.lower(F.coalesce(c, F.lit("")))
    return F.when(s.contains("completed"), "done").when(s.contains("running") | s.contains("awarded"), "active").when(s.contains("evaluation"), "pending").otherwise("unknown")
