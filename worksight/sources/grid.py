"""Payment grid of the paying office: one JSON file for each window of payment dates, to rows, to the area's bills, to what they add to known ones.

Files that are no JSON give no rows; an empty folder of windows gives none. A window file is one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from worksight.functions import parsing as P
from worksight.operators.publication import without_phone
from worksight.operators.scope import Area, grid_scope
from worksight.tables import once

#: Fields of a window's file and of its rows.
WINDOW = (
    "`from` string, `to` string, url string, complete boolean, "
    "rows array<struct<slno:string, id:string, wodetails:string, contractor:string, brnumber:string, amount:string, nett:string, deduction:string>>"
)
#: Fixed value: where a row's link names its job.
JOB_IN_LINK = r"vssFillData\(\d+,\s*'([^']+)'\)"


def read_windows(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.schema(WINDOW).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)


def _reference(c: Column, name: str, digits: str = r"\d") -> tuple[Column, Column]:
    """Number and date after a label; either may be blank. A label isn't read out of a longer one that ends in it."""
    pattern = rf"(?<![A-Za-z]){name}\s*-\s*({digits}*)\s*/\s*(\d{{1,2}}-[A-Za-z]{{3}}-\d{{4}})?"
    # the pattern leaves one layout, so the parser of all layouts, which swells the generated code, isn't needed
    day = F.try_to_date(F.initcap(F.replace(F.regexp_extract(c, pattern, 2), F.lit("-"), F.lit(" "))), "d MMM yyyy")
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit("")), F.when(F.year(day).between(P.FIRST_YEAR, P.LAST_YEAR), day)


def grid_rows(windows: DataFrame) -> DataFrame:
    """One row for each bill and window; place orders them by window and position. NULL where a cell can't be read."""
    r = windows.select("from", "to", "url", F.posexplode("rows").alias("at", "r"))
    r = once(r, details=F.coalesce("r.wodetails", F.lit("")), glued=F.replace(F.coalesce("r.brnumber", F.lit("")), F.lit("<br/>"), F.lit(" ")))
    details, glued = F.col("details"), F.col("glued")
    r = once(r, job_number=P.norm_job(F.regexp_extract(details, JOB_IN_LINK, 1)), payee=without_phone(F.col("r.contractor")))
    (br_no, br_date), (cbr_no, cbr_date), (rtgs_no, rtgs_date) = _reference(glued, "BR"), _reference(glued, "CBR", r"[\d-]"), _reference(glued, "Rtgs")
    rows = r.select(
        F.struct("from", "at").alias("place"), F.concat_ws("..", "from", "to").alias("window"), F.col("r.id").alias("bill_id"), "job_number",
        P.html_text(F.regexp_replace(details, r"(?s)^.*?<br/>", "")).alias("description"), P.contractor(F.col("payee")).alias("contractor"),
        br_no.alias("br_no"), br_date.alias("br_date"), cbr_no.alias("cbr_no"), cbr_date.alias("cbr_date"), rtgs_no.alias("rtgs_no"), rtgs_date.alias("rtgs_date"),
        P.money(F.col("r.amount")).alias("gross"), P.money(F.col("r.nett")).alias("nett"), P.money(F.col("r.deduction")).alias("deduction"), F.col("url").alias("source_url"),
    )
    parts = F.split(F.regexp_replace("job_number", "R-", ""), "-")
    return rows.withColumns({"ward_prefix": F.get(parts, 0), "job_year": F.get(F.split("job_number", "-"), 1)})


def area_bills(rows: DataFrame, area: Area) -> DataFrame:
    """The area's rows, one for each bill_id: its first in order of windows, with all its payment dates in order.

    A bill that is released in parts stands in several windows; rows without an id are one bill.
    """
    held = grid_scope(rows, area).filter("scope_reason IS NOT NULL")
    others = [c for c in held.columns if c not in ("bill_id", "place")]
    first = F.min_by(F.struct(*others), "place").alias("r")
    return held.groupBy("bill_id").agg(first, F.array_sort(F.collect_set("rtgs_date")).alias("payment_dates")).select("bill_id", "r.*", "payment_dates")


def as_bills(bills: DataFrame) -> DataFrame:
    """Bills of the grid in the registers' schema; a bill counts as paid at its first release."""
    paid = F.col("rtgs_no").isNotNull()
    return bills.select(
        F.lit("payment_grid").alias("kind"), "job_number", "description", F.col("ward_prefix").alias("ward"), "contractor", "gross", "nett", "deduction", "br_no", "br_date",
        F.when(paid, F.concat(F.lit("RTGS "), "rtgs_no")).alias("payment_ref"), F.array_min("payment_dates").alias("payment_date"), F.when(paid, "Paid (RTGS)").alias("payment_status"),
        "regime", "scope_reason", "scope_basis", F.col("bill_id").alias("ifms_id"), F.col("source_url").alias("grid_url"),
    )


def discovery(bills: DataFrame, known: DataFrame, works: DataFrame, details: DataFrame) -> DataFrame:
    """The grid's bills with whether their job and id were known before, their work, and office and bill type from the direct record.

    known (job_number, ifms_id), works (slug, job_numbers), details (bill_id, office, bill_type); of a job's works the last slug counts.
    """
    jobs = known.select("job_number").filter("job_number IS NOT NULL").distinct().withColumn("known_job", F.lit(True))
    ids = known.select(F.col("ifms_id").alias("bill_id")).filter("bill_id IS NOT NULL").distinct().withColumn("known_bill", F.lit(True))
    slugs = works.select("slug", F.explode("job_numbers").alias("job_number")).groupBy("job_number").agg(F.max("slug").alias("slug"))
    out = bills.join(jobs, "job_number", "left").join(ids, "bill_id", "left").join(slugs, "job_number", "left").join(details.dropDuplicates(["bill_id"]), "bill_id", "left")
    return out.withColumns({"known_job": F.coalesce("known_job", F.lit(False)), "known_bill": F.coalesce("known_bill", F.lit(False)), "payment_dates": F.array_join(F.transform("payment_dates", lambda d: d.cast("string")), ",")})


def denominators(rows: DataFrame, known: DataFrame, direct: DataFrame, since: str) -> DataFrame:
    """One row of counts: does the grid hold what other sources say was paid?

    known (job_number, ifms_id, payment_ref, payment_date), direct (bill_id, rtgs); exports count from since on.
    """
    seen = rows.select("bill_id").distinct()
    whole = rows.agg(F.count("*").alias("grid_rows"), F.count_distinct("bill_id").alias("grid_bills"), F.min("rtgs_date").alias("first_payment"))
    recent = known.filter(F.col("payment_date") >= F.lit(since).cast("date"))
    paid = recent.filter("ifms_id IS NOT NULL AND payment_ref IS NOT NULL").withColumnRenamed("ifms_id", "bill_id")
    jobs = recent.select("job_number").filter("job_number IS NOT NULL").distinct()
    of_direct = direct.filter("coalesce(rtgs, '') <> ''").select("bill_id").distinct()
    n = lambda df, name: df.agg(F.count("*").alias(name))
    counts = [
        n(paid, "export_bills"), n(paid.join(seen, "bill_id", "left_semi"), "export_bills_in_grid"), n(jobs, "known_jobs"), n(jobs.join(rows, "job_number", "left_semi"), "known_jobs_in_grid"),
        n(of_direct, "direct_bills"), n(of_direct.join(seen, "bill_id", "left_semi"), "direct_bills_in_grid"),
    ]
    for one in counts:
        whole = whole.crossJoin(one)  # one row on either side
    return whole
