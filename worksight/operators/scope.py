"""Whether a record belongs to an area, what kind of work it is, and which ward map its job number refers to.

What makes the rules about one area is its configuration, a JSON file; the rules are columns built from it.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, fields
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worksight.functions.text import extract_locations

#: Titles that are no public work.
NOT_A_WORK = (
    r"(?i)ganesh|immersion|illumination to|temporary illumination|festival|rajyotsava|grant in aid|grant-in-aid|"
    r"hiring of|hire of|manpower|man power|operator|data entry|housekeeping|fire extinguisher|"
    r"consultan|\bPMC\b|DPR\b|survey work|control room|"
    r"modular kitchen|wardrobe|mosquito|masquito|curtain rod|qtrs|quarters no|judicial block|"
    r"c ?& ?d (type|group) quarters|krishna block|sharavathi block|varada block|arkavathi"
)
#: Categories of works, the first whose pattern fits; a category may stand twice.
CATEGORIES = (
    ("Drains & storm-water", r"\bswd\b|storm ?water|primary drain|secondary drain|tertiary drain|box drain|rcc drain|desilt|culvert|retaining wall"),
    ("Water supply & sewerage", r"water supply|sewer|\bugd\b|pipe ?line|borewell|bore well|\bstp\b|\bDI\b|fhtc"),
    (
        "Buildings & civic facilities",
        r"building|school|hospital|bhavan|bhavana|toilet|canteen|burial|cremat|crematorium|compound wall|shed|market|library|anganwadi|community hall|quarters|nursery|multipurpose",
    ),
    ("Street lighting & electrical", r"street ?light|lighting|high mast|electri|\bLT\b|\bHT\b|transformer|substation|C&R panel"),
    ("Footpaths & pedestrian", r"footpath|foot path|pedestrian|skywalk|sky walk|subway"),
    ("Junctions, flyovers & grade separators", r"flyover|fly over|grade separator|underpass|junction|signal"),
    ("Roads", r"road|asphalt|pothole|pot hole|white ?topping|tender ?sure|cobble|paver|street name|name board|carriage ?way|resurfac"),
    ("Drains & storm-water", r"drain"),
    ("Parks & playgrounds", r"park|playground|play ground|garden|horticult|lake|tree|landscap"),
    ("Solid waste infrastructure", r"waste|garbage|\bswm\b|dry waste|recycling"),
    ("General civic works", r"improvement|development|maintenance|repair|construction|providing"),
)
COMBINED, COMBINED_PARTS = "Roads, drains & footpaths (combined)", (r"\broads?\b|asphalt|cobble", r"drain", r"footpath|foot path")
MAJOR_DRAIN = r"(?i)\bswd\b|storm ?water|primary drain|secondary drain"
#: The ward map whose numbers job numbers begin with, the map by a job's year, and where departments' codes begin.
PREFIX_MAP, FIRST_DEPARTMENT = "198", 300
#: Words after a ward number that are no name of a place.
NOT_A_NAME = tuple(
    "and of in the for under package pkg south zone east west north sub division constituency old new no nos ward wards at on to with jurisdiction limits limit area areas s w name work works".split()
)
WARD_NAME = r"(?i)ward\s*(?:no)?\.?\s*[:\-]?\s*\d{1,3}\s*[(\-,]?\s*([A-Za-z][A-Za-z .]{3,30})"
NEVER = r"(?!x)x"


@dataclass(frozen=True)
class Area:
    area_name: str
    slug: str
    locality_regex: str
    ward_maps: dict[str, list[str]]
    exclude_regex: str | None = None
    not_city_regex: str | None = None
    ward_equivalents: list[list[str]] = field(default_factory=list)
    sub_localities: list[str] = field(default_factory=list)
    localities: dict[str, str] = field(default_factory=dict)
    spellings: dict[str, str] = field(default_factory=dict)
    upper_words: list[str] = field(default_factory=list)

    def __post_init__(self):
        for pattern in (self.locality_regex, self.exclude_regex, self.not_city_regex, *self.sub_localities, *self.localities.values()):
            re.compile(pattern or NEVER, re.I)  # a bad pattern fails here, not in a task

    @property
    def locations_regex(self) -> str:
        return "|".join(self.sub_localities) or NEVER


@lru_cache(maxsize=None)
def load_area(path: str) -> Area:
    """An area's JSON file; keys that the rules don't use are left out."""
    with open(path, encoding="utf-8") as f:
        raw = json.load(f)
    return Area(**{x.name: raw[x.name] for x in fields(Area) if x.name in raw})


def _ward(c: Column) -> Column:
    return F.ltrim(F.trim(c), F.lit("0"))


def job_prefix(job: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(job, "R-", ""), "-"), 1)


def is_area_ward(area: Area, regime: Column, ward: Column, job: Column) -> Column:
    """Booked to one of the area's wards under its map; job numbers tell wards of one map alone."""
    out = F.lit(False)
    for name, wards in area.ward_maps.items():
        by_job = _ward(job_prefix(job)).isin(wards) if name == PREFIX_MAP else F.lit(False)
        out = out | ((regime == name) & (F.coalesce(_ward(ward).isin(wards), F.lit(False)) | F.coalesce(by_job, F.lit(False))))
    return F.coalesce(out, F.lit(False))


def scope_reason(area: Area, text: Column, regime: Column, ward: Column, job: Column) -> Column:
    """Why a record is in scope, or NULL: its ward, or a text that names the area otherwise than by an excluded name."""
    text = F.coalesce(text, F.lit(""))
    locality = f"(?i)(?:{area.locality_regex})"
    rest = F.regexp_replace(text, f"(?i)(?:{area.exclude_regex or NEVER})", "")
    begin, size = F.regexp_instr(rest, F.lit(locality)) - 1, F.length(F.regexp_extract(rest, f"({locality})", 1))
    head = F.greatest(begin - 40, F.lit(0))
    snippet = F.trim(F.substring(rest, head + 1, begin + size + 30 - head))
    first = F.create_map(*(F.lit(x) for name, wards in area.ward_maps.items() for x in (name, sorted(wards)[0])))
    booked = F.concat(F.lit(f"Booked to {area.area_name} ward ("), F.try_element_at(first, regime), F.lit(" under the "), regime, F.lit("-ward map)"))
    return (
        F.when(text.rlike(f"(?i)(?:{area.not_city_regex or NEVER})"), F.lit(None).cast("string"))
        .when(is_area_ward(area, regime, ward, job), booked)
        .when(text.rlike(locality) & rest.rlike(locality), F.concat(F.lit(f'Work description names {area.area_name}: "…'), snippet, F.lit('…"')))
    )


def _alternatives(pattern: str) -> list[str]:
    """What a pattern's outermost bars part."""
    out, depth = [""], 0
    for c in pattern.removeprefix("(?i)"):
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def any_of(patterns: tuple[str, ...]) -> str:
    """A pattern that finds something just where one of these does, whatever the case; alternatives are grouped by how they begin, since each group is tried at every letter."""
    groups: dict[str, list[str]] = {}
    for x in dict.fromkeys(a for p in patterns for a in _alternatives(p)):
        begin = r"\b" if x.startswith(r"\b") else x[0].lower()
        if not (begin == r"\b" or begin.isalnum()) or x[1:2] in tuple("?*+{"):  # no letter that must be there
            begin = ""
        groups.setdefault(begin, []).append(x[len(begin) :])
    return "(?i)" + "|".join(f"{begin}(?:{'|'.join(rest)})" for begin, rest in groups.items())


def classify(text: Column) -> Column:
    """The category of a work, or NULL for what is none; the rules are tried only on texts that hold a word of any category."""
    text = F.coalesce(text, F.lit(""))
    return F.when(text.rlike(any_of(tuple(p for _, p in CATEGORIES) + COMBINED_PARTS)), _ladder(text))


def _ladder(text: Column) -> Column:
    parts = sum((text.rlike(f"(?i){p}").cast("int") for p in COMBINED_PARTS), F.lit(0))
    ladder = F.when(text.rlike(NOT_A_WORK), F.lit(None).cast("string")).when((parts >= 2) & ~text.rlike(MAJOR_DRAIN), COMBINED)
    for name, pattern in CATEGORIES:
        ladder = ladder.when(text.rlike(f"(?i){pattern}"), name)
    return ladder


def ward_map_of(prefix: Column, year: Column) -> Column:
    """Map in force when a job number was given: by its year of two digits, or dept for departments' codes."""
    y = year.try_cast("int")
    dept = F.coalesce(prefix.try_cast("int") >= FIRST_DEPARTMENT, F.lit(False))
    return F.when(y.isNull(), F.lit(None).cast("string")).when(dept, "dept").when(y <= 22, "198").when(y == 23, "243").otherwise("225")


def grid_scope(rows: DataFrame, area: Area) -> DataFrame:
    """Payment rows (description, ward_prefix, job_year, job_number) with regime, scope_reason and scope_basis.

    A description that names the area counts before the ward; a ward counts unless another place is named beside its number.
    """
    none = F.lit(None).cast("string")
    regime = ward_map_of(F.col("ward_prefix"), F.col("job_year"))
    out = rows.withColumn("regime", regime)
    mapped = F.when(F.col("regime").isin("198", "225", "243"), F.col("regime"))
    by_text = scope_reason(area, F.col("description"), none, none, none)
    by_ward = scope_reason(area, F.lit(""), mapped, F.col("ward_prefix"), F.when(F.col("regime") == PREFIX_MAP, F.col("job_number")))
    name = F.lower(F.trim(F.regexp_extract(F.coalesce("description", F.lit("")), WARD_NAME, 1)))
    other = (name != "") & ~F.element_at(F.split(name, r"\s+"), 1).isin(*NOT_A_NAME) & ~name.rlike(f"(?i)(?:{area.locality_regex})")
    out = out.withColumns({"__text": by_text, "__ward": by_ward, "__other": other})
    in_ward = F.col("__ward").isNotNull()
    reason = F.coalesce("__text", F.when(~F.col("__other"), F.concat("__ward", F.lit(" (ward map inferred from the job-code year)"))))
    basis = F.when(F.col("__text").isNotNull(), "description").when(in_ward & ~F.col("__other"), "ward_prefix").when(in_ward, "ward_conflict")
    return out.withColumns({"scope_reason": reason, "scope_basis": basis}).drop("__text", "__ward", "__other")


def document_scope(area: Area, text: Column, ward: Column, regime: Column) -> Column:
    """Scope of an archived document's row: as scope_reason, else its ward column alone."""
    none = F.lit(None).cast("string")
    listed = F.coalesce(*(F.when((regime == name) & _ward(ward).isin(wards), F.concat(F.lit(f"Listed under {area.area_name} ward "), _ward(ward))) for name, wards in area.ward_maps.items()))
    return F.coalesce(scope_reason(area, text, regime, ward, none), listed)


def locations(area: Area, text: Column) -> Column:
    return extract_locations(text, area.locations_regex, tuple(area.upper_words))
