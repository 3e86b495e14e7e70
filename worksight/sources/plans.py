"""Archived planning documents: rows of works that run over lines and pages, read by a grammar for each kind of document.

Texts are rows (file, page, text), files are rows (file, kind, title, url, published_date, fy, ocr). Texts become numbered lines; a record
begins at a line that fits its kind's first pattern and takes what follows until the next one, whatever page it is on. Lines are dealt
into chunks of ``CHUNK``: counts and neighbours are found inside a chunk, and one summary row a chunk carries them from one chunk to the
next, so a file that holds most of all lines is no single task. Notices alone are cut between marks that stand anywhere in a text,
so such a file's text is one row.

Files of a kind without a parser, lines before a file's first record and records that don't fit their row's pattern give no rows; null
and empty texts have no lines. Rows without scope or without a category of work are dropped. Repeated texts give repeated rows. Columns of
files and texts other than those named are not carried.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from worksight.functions import parsing as P
from worksight.operators import scope as S
from worksight.tables import once

CHUNK, PAGE = 4096, 1 << 24
FILE = "file string, kind string, title string, url string, published_date date, fy string, ocr boolean"
#: States of a work in a programme, and layout lines that are no part of a row.
STATES = "File Under Process|File in Process|Tender in Process|Work Order Issued|Works? Completed|Works? in Progress|Yet to Start"
LAYOUT = r"^(SL|Page|BRUHAT|POW|No of|\d{2}\s+\d{2})"
#: The period that ends a notice's entry, its tail that is read, its amounts, and what is no part of a description.
DAYS, NOTICE_TAIL = r"(?i)(\d{2,3})\s*[D0O]\s*ays", 420
NOTICE_NOISE = (r"\(\s*(SC|ST|Others)[^)]*\)?", r"\b\d{1,3}\.\d{2}\b|\d[\d,]{2,}\s*/-|[|\[\]{}~=_—;]", r"(?U)^\W*\d{1,3}\s*\W*\s*\d{3}\s*\W")
GRANT_NOISE = r"[|\[\]{}~=_—;@#:]|\b\d{1,3}[.,]\d{2}\b"
NOTIFIED, TENDERED = "Tender notified (outcome not in this document)", "Tendered (L1 bidder listed)"
ROW = {
    "row": "int", "job_number": "string", "description": "string", "ward": "string", "ward_name": "string", "regime": "string", "ecv": "double", "contract_value": "double", "contractor": "string", "office": "string",
    "budget_head": "string", "period_days": "int", "period_text": "string", "tender_number": "string", "base": "string", "status_text": "string", "plan_status": "string", "scope_reason": "string",
}


@dataclass(frozen=True)
class Place:
    """What an area's documents call it; patterns."""

    area: S.Area
    zone: str = "South"
    constituency: str = r"[A-Z][A-Za-z .]+?"
    wards: tuple[str, ...] = ()
    own_ward: str | None = None
    own_ward_as_read: str = S.NEVER
    noticed: str = S.NEVER
    notice_number: str = S.NEVER
    notice_layout: str = "%s/%s"
    programme: str = "POW"
    grant: str = "grant"


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(file, page, text, ocr) of text files beside documents: x.ocr.txt is preferred to x.txt."""
    got = spark.read.text(f"{folder}/*.txt", wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))
    got = got.select(F.regexp_replace("name", r"(\.ocr)?\.txt$", "").alias("file"), F.col("name").endswith(".ocr.txt").alias("ocr"), "text")
    return got.groupBy("file").agg(F.max_by(F.struct("text", "ocr"), "ocr").alias("x")).select("file", F.lit(0).alias("page"), "x.text", "x.ocr")


def lines_of(texts: DataFrame) -> DataFrame:
    """(file, n, line): lines in the order of pages."""
    each = texts.filter("text IS NOT NULL").select("file", "page", F.posexplode(F.split("text", r"\r?\n")).alias("at", "line"))
    return each.select("file", (F.col("page").cast("long") * PAGE + F.col("at")).alias("n"), "line")


def assembled(rows: DataFrame, starts: Column, key: str = "file") -> DataFrame:
    """rows (key, n, ...) with record, the number of the record that a row is of (0 before the first), within its key."""
    own = Window.partitionBy(key, "__chunk").orderBy("n")
    marked = rows.withColumns({"__chunk": F.floor(F.col("n") / CHUNK), "__start": F.coalesce(starts, F.lit(False)).cast("long")})
    chunks = marked.groupBy(key, "__chunk").agg(F.sum("__start").alias("__starts"))
    chunks = chunks.select(key, "__chunk", (F.sum("__starts").over(Window.partitionBy(key).orderBy("__chunk")) - F.col("__starts")).alias("__before"))
    out = marked.withColumn("__within", F.sum("__start").over(own)).join(chunks, [key, "__chunk"])
    return out.withColumn("record", F.col("__before") + F.col("__within")).drop("__chunk", "__start", "__within", "__before")


def with_neighbours(lines: DataFrame) -> DataFrame:
    """lines (file, n, line) with before and after, the lines next to each in its file; "" at its ends."""
    own, chunks = Window.partitionBy("file", "__chunk").orderBy("n"), Window.partitionBy("file").orderBy("__chunk")
    marked = lines.withColumn("__chunk", F.floor(F.col("n") / CHUNK))
    ends = marked.groupBy("file", "__chunk").agg(F.min_by("line", "n").alias("__first"), F.max_by("line", "n").alias("__last"))
    ends = ends.select("file", "__chunk", F.lag("__last").over(chunks).alias("__b"), F.lead("__first").over(chunks).alias("__a"))
    out = marked.withColumns({"__lag": F.lag("line").over(own), "__lead": F.lead("line").over(own)}).join(ends, ["file", "__chunk"])
    return out.select("file", "n", "line", F.coalesce("__lag", "__b", F.lit("")).alias("before"), F.coalesce("__lead", "__a", F.lit("")).alias("after"))


def _records(lines: DataFrame, starts: str, glue: str, skips: str = S.NEVER) -> DataFrame:
    """(file, text): each record's lines, trimmed and joined."""
    line = F.trim("line")
    used = assembled(lines, F.col("line").rlike(starts)).filter((F.col("record") > 0) & (F.col("line").rlike(starts) | ((line != "") & ~line.rlike(skips))))
    held = used.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))).alias("x"))
    return held.select("file", F.array_join("x.line", glue).alias("text"))


def _fields(records: DataFrame, pattern: str, names: tuple[str, ...]) -> DataFrame:
    """records that fit a pattern, with its groups as columns."""
    return records.filter(F.col("text").rlike(pattern)).select("*", *(F.regexp_extract("text", pattern, i + 1).alias(n) for i, n in enumerate(names)))


def _rows(found: DataFrame, **columns: Column) -> DataFrame:
    return found.select("file", *(columns.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in ROW.items()))


def _lakh(c: Column) -> Column:
    return F.round(F.replace(c, F.lit(","), F.lit(".")).cast("double") * 1e5, 2)


def _scope(place: Place, text: Column, regime: str, ward: Column) -> Column:
    return S.scope_reason(place.area, text, F.lit(regime), ward, F.lit(None).cast("string"))


def sanctioned(texts: DataFrame, place: Place) -> DataFrame:
    """Ward lists of sanctioned works: number and ward, job number, description, and at last the estimate with office and budget head."""
    lines = lines_of(texts)
    head = rf"^\s*\d+\s+{place.zone}\s+{place.constituency}"
    row = rf"(?s)^\s*(\d+)\s+{place.zone}\s+{place.constituency}\s+([A-Za-z ]+?)\s*\n({P.JOB})\s*\n(.*?)\n\s*(\d+\.\d{{2}})\s*/\s*(.*)$"
    x = _fields(_records(lines, head, "\n"), row, ("no", "ward_name", "job", "about", "estimate", "rest"))
    parts = F.transform(F.split(P.clean(F.col("rest")), r"\s*/\s*"), P.clean)
    others = F.nullif(F.array_join(F.filter(F.slice(parts, 2, 1000), lambda p: p.isNotNull()), " / "), F.lit(""))
    x = once(x.withColumnRenamed("about", "as_read"), about=P.clean(F.col("as_read")))  # as scope and class ask for it many times
    about, ward = F.col("about"), F.substring("job", 1, 3)
    return _rows(x, row=F.col("no"), job_number=F.col("job"), description=about, ward=ward, ward_name=P.clean(F.col("ward_name")), regime=F.lit("198"), ecv=F.col("estimate"), office=F.get(parts, F.lit(0)), budget_head=others, scope_reason=_scope(place, about, "198", ward))


def financial_years(texts: DataFrame) -> DataFrame:
    """(file, fy): the first year that a text names as its financial one."""
    pattern = r"(?i)(?:FIN YEAR|fy)\s*(\d{2}-\d{2})"
    named = lines_of(texts).withColumn("fy", F.regexp_extract("line", pattern, 1)).filter("fy <> ''")
    return named.groupBy("file").agg(F.concat(F.lit("20"), F.min_by("fy", "n")).alias("named_fy"))


def programme(texts: DataFrame, place: Place) -> DataFrame:
    """Programme of works: rows wrapped over lines, with ward, description, amount in lakh and state; a long tail belongs to the description."""
    row = rf"(?s)^\s*(\d{{1,3}})\s+{place.constituency}\s+(\d{{3}})\s+(.+?)\s+(\d{{1,4}}\.\d{{2}})\s+({STATES})\b(.*)$"
    x = _records(lines_of(texts), r"^\s*\d{1,3}\s+[A-Z][A-Za-z .]+?\s+\d{3}\s", " ", LAYOUT)
    x = _fields(x, row, ("no", "ward", "about", "amount", "state", "tail"))
    x = once(x.withColumnRenamed("about", "as_read"), about=P.clean(F.when(F.length("tail") > 10, F.concat_ws(" ", "as_read", "tail")).otherwise(F.col("as_read"))))
    about = F.col("about")
    return _rows(x, row=F.col("no"), description=about, ward=F.col("ward"), regime=F.lit("243"), ecv=_lakh(F.col("amount")), plan_status=F.col("state"), status_text=F.concat("state", F.lit(f" ({place.programme})")), scope_reason=_scope(place, about, "243", F.col("ward")))


def noticed(texts: DataFrame, place: Place) -> DataFrame:
    """Tender notices: what stands between one period of completion and the next, of entries that name the place."""
    whole = texts.filter("text IS NOT NULL").groupBy("file").agg(F.array_join(F.array_sort(F.collect_list(F.struct("page", "text"))).getField("text"), "\n").alias("text"))
    numbers = F.regexp_extract_all("text", F.lit(place.notice_number), F.lit(1)), F.regexp_extract_all("text", F.lit(place.notice_number), F.lit(2))
    number = F.when(F.size(numbers[0]) > 0, F.format_string(place.notice_layout, F.get(numbers[0], F.lit(0)), F.get(numbers[1], F.lit(0)))).otherwise(F.col("file"))
    marks, days = (F.regexp_extract_all("text", F.lit(DAYS), F.lit(k)) for k in (0, 1))
    each = whole.select("file", number.alias("number"), F.posexplode(F.slice(F.arrays_zip(F.split("text", DAYS, -1).alias("chunk"), marks.alias("mark"), days.alias("days")), F.lit(1), F.size(marks))).alias("at", "x"))
    each = each.select("file", "number", "at", F.right("x.chunk", F.lit(NOTICE_TAIL)).alias("chunk"), "x.mark", "x.days").filter(F.col("chunk").rlike(place.noticed))
    about = F.col("chunk")
    for pattern in NOTICE_NOISE:
        about = F.regexp_replace(about, pattern, " ")
    about = P.clean(F.element_at(F.split(about, "\n\n"), -1))
    each = each.withColumn("about", about).filter(F.length("about") >= 15)
    named = F.col("chunk").rlike(place.own_ward_as_read)
    amount = F.try_element_at(F.regexp_extract_all("chunk", F.lit(r"\b(\d{1,3}\.\d{2})\b"), F.lit(1)), F.lit(-1))
    own, none = F.lit(place.own_ward), F.lit(None).cast("string")
    reason = F.when(named, _scope(place, F.concat("about", F.lit(f" ward {place.own_ward}")), "198", own)).otherwise(_scope(place, F.col("about"), "198", none))
    base = F.concat("number", F.lit("#"), F.row_number().over(Window.partitionBy("file").orderBy("at")).cast("string"))
    return _rows(each, description=F.right("about", F.lit(300)), ward=F.when(named, own), regime=F.lit("198"), ecv=_lakh(amount), period_days=F.col("days"), period_text=F.col("mark"), tender_number=F.col("number"), base=base, status_text=F.lit(NOTIFIED), scope_reason=reason)


def granted(texts: DataFrame, place: Place) -> DataFrame:
    """Grant lists: a line with number, ward and amount in lakh; the description also takes the lines before and after."""
    row = rf"(?U)^\W*(\d{{1,3}})\s+({'|'.join(place.wards) or S.NEVER})\W{{0,4}}\s*(.+?)\s(\d{{1,3}}[.,]\d{{2}})\b(.*)$"
    x = _fields(with_neighbours(lines_of(texts)).withColumn("text", F.col("line")), row, ("no", "ward", "about", "amount"))
    x = once(x.withColumnRenamed("about", "as_read"), about=P.clean(F.regexp_replace(F.concat_ws(" ", F.trim("before"), F.trim("as_read"), F.trim("after")), GRANT_NOISE, " ")))
    about = F.col("about")
    return _rows(x, row=F.col("no"), description=F.substring(about, 1, 300), ward=F.col("ward"), regime=F.lit("198"), ecv=_lakh(F.col("amount")), status_text=F.lit(f"Sanctioned under {place.grant}"), scope_reason=_scope(place, about, "198", F.col("ward")))


#: By kind of document: its parser.
PARSERS: dict[str, Callable[[DataFrame, Place], DataFrame]] = {"sanction": sanctioned, "pow": programme, "notice": noticed, "grant": granted}


def sheet_groups(cells: DataFrame, place: Place) -> DataFrame:
    """Rows of a sheet (file, n, cells) whose merged cells hold for the rows below: works of a park group, with the parks of its rows.

    Cells: number, zone, ward, group, park, area, estimate, tendered amount, lowest bidder.
    """
    cell = lambda i: P.clean(F.get("cells", F.lit(i)))
    x = assembled(cells, cell(0).rlike(r"^\d+(\.\d+)?$") & cell(2).isNotNull()).filter("record > 0")
    first = lambda i: F.min_by(cell(i), "n")
    parks = F.array_sort(F.collect_list(F.when(cell(4).isNotNull(), F.struct("n", cell(4).alias("park")))))
    x = x.groupBy("file", "record").agg(F.min("n").alias("n"), *(first(i).alias(c) for i, c in ((2, "ward"), (3, "about"), (6, "estimate"), (7, "tendered"), (8, "bidder"))), parks.getField("park").alias("parks"))
    x = x.withColumn("ward", F.regexp_replace("ward", r"\.0+$", ""))
    about = F.format_string("%s (%s)", F.coalesce("about", F.lit("None")), F.array_join(F.slice("parks", 1, 6), ", "))
    named = F.concat_ws(" ", F.array_join("parks", " "), "about").rlike(f"(?i)(?:{place.area.locality_regex})")
    booked = F.concat(F.lit(f"Booked to {place.area.area_name} ward ("), F.lit(place.own_ward), F.lit(")"))
    x = x.filter(named | F.coalesce(F.col("ward") == F.lit(place.own_ward), F.lit(False)))
    bidder = P.contractor(F.get(F.split("bidder", r",|\n|#"), F.lit(0)))
    return _rows(x, row=F.col("n"), description=about, ward=F.col("ward"), regime=F.lit("198"), ecv=P.money(F.col("estimate")), contract_value=P.money(F.col("tendered")), contractor=bidder, status_text=F.lit(TENDERED), scope_reason=F.coalesce(_scope(place, about, "198", F.col("ward")), booked))


def plan_rows(files: DataFrame, texts: DataFrame, place: Place, cells: DataFrame | None = None) -> DataFrame:
    """Rows of works of all documents, each read by the parser of its kind: columns of files and ROW, with category; base and tender_number are never null."""
    kinds = files.select("file", "kind")
    found = [f(texts.join(kinds.filter(F.col("kind") == k).select("file"), "file", "left_semi"), place) for k, f in PARSERS.items()]
    if cells is not None:
        found.append(sheet_groups(cells.join(kinds.filter("kind = 'hort'").select("file"), "file", "left_semi"), place))
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    rows = once(rows.filter("scope_reason IS NOT NULL"), category=S.classify(F.col("description"))).filter("category IS NOT NULL")
    described = files.join(financial_years(texts), "file", "left").withColumn("fy", F.coalesce("fy", "named_fy")).drop("named_fy")
    base = F.coalesce("base", F.concat("file", F.lit("#"), F.col("row").cast("string")))
    return rows.join(described, "file").withColumns({"base": base, "tender_number": F.coalesce("tender_number", base), "source": F.concat(F.lit("WB-"), F.upper("kind"))})
