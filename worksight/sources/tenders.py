"""Tenders: nested JSON notices of the portal, and archived lists in CSV with an index of their addresses, in one schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from worksight.functions import parsing as P
from worksight.functions import text as T
from worksight.functions.dates import completion_period
from worksight.operators.scope import PREFIX_MAP, Area, classify, scope_reason
from worksight.sources.registers import cell, read_cells, with_header

#: Fields of a notice.
NOTICE = (
    "search struct<nitId:string, tenderNumber:string, title:string, description:string, deptName:string, locationName:string, status:string, statusText:string, "
    "workCategoryName:string, publishedDate:string, tenderClosureDate:string, ecv:string>, "
    "full struct<tenderSchedule:struct<ecv:string, provisionalAmount:string, fileNumber:string>, "
    "tenderAwardDatesDTO:struct<awardedDates:string, listOfBidderDonePBGDTO:array<struct<name:string>>>>, "
    "selected_bid struct<supplierName:string, supplierId:string, bidValue:string, negotiatedValue:string>, files array<struct<fileName:string>>"
)


def read_notices(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Files that are no JSON or have no search part give no rows."""
    raw = spark.read.schema(NOTICE).option("multiLine", True).json(path)
    return raw.filter("search.nitId IS NOT NULL")


def notices(raw: DataFrame) -> DataFrame:
    """Flat notices. The contract's value is what was negotiated, else the bid; zero counts as none. The cost in the schedule goes before the search's."""
    some = lambda c: F.nullif(P.money(F.col(c)), F.lit(0).cast("decimal(18,2)"))
    s, schedule, award, bid = "search.", "full.tenderSchedule.", "full.tenderAwardDatesDTO.", "selected_bid."
    guarantor = F.get(f"{award}listOfBidderDonePBGDTO", 0)["name"]
    return raw.select(
        F.col(s + "nitId").alias("nit_id"), F.col(s + "tenderNumber").alias("tender_number"), P.clean(F.col(s + "title")).alias("description"), P.clean(F.col(s + "description")).alias("long_description"),
        F.col(s + "deptName").alias("dept"), F.col(s + "locationName").alias("office"), F.col(s + "status").alias("status"), F.col(s + "statusText").alias("status_text"), F.col(s + "workCategoryName").alias("work_category"),
        P.parse_date(F.col(s + "publishedDate")).alias("published_date"), P.parse_date(F.col(s + "tenderClosureDate")).alias("closing_date"),
        F.when(F.col(schedule + "ecv").isNotNull(), P.money(F.col(schedule + "ecv"))).otherwise(P.money(F.col(s + "ecv"))).alias("ecv"),
        P.money(F.col(schedule + "provisionalAmount")).alias("provisional_amount"), F.col(schedule + "fileNumber").alias("file_number"),
        F.coalesce(P.clean(F.col(bid + "supplierName")), P.clean(guarantor)).alias("contractor"), F.col(bid + "supplierId").alias("supplier_id"), P.money(F.col(bid + "bidValue")).alias("bid_value"),
        P.money(F.col(bid + "negotiatedValue")).alias("negotiated_value"), F.coalesce(some(bid + "negotiatedValue"), P.money(F.col(bid + "bidValue"))).alias("contract_value"),
        P.epoch_ms_date(F.col(award + "awardedDates")).alias("awarded_date"), F.coalesce(F.col("files.fileName"), F.array().cast("array<string>")).alias("files"),
    )


def _in_scope(area: Area, text: Column) -> Column:
    none = F.lit(None).cast("string")
    return F.regexp_replace(scope_reason(area, text, none, none, none), "^Work description", "Tender title")


def load_notices(raw: DataFrame, area: Area, base_url: str = "") -> DataFrame:
    """The area's notices by title, description and office, with base number, call, category and addresses."""
    flat = notices(raw).withColumn("scope_reason", _in_scope(area, F.concat_ws(" ", "description", "long_description", "office"))).filter("scope_reason IS NOT NULL")
    return flat.select(
        "*", F.lit("portal").alias("source"), T.base_tender(F.col("tender_number")).alias("base"), T.call_number(F.col("tender_number")).alias("call"), classify(F.col("description")).alias("category"),
        F.concat(F.lit(f"{base_url}/"), "nit_id", F.lit("/works-tender-full-view")).alias("url"), F.concat(F.lit(f"{base_url}/bids/"), "nit_id", F.lit("/tender-category/WORKS/get-selected-bid-for-lumpsum")).alias("bid_url"),
    )


def with_enrichment(tenders: DataFrame, documents: DataFrame) -> DataFrame:
    """Period and its source from documents (nit_id, at, text, file, url): the first file in order of at whose text yields a period."""
    found = documents.withColumn("period", completion_period(F.col("text"))).filter("period IS NOT NULL")
    first = found.groupBy("nit_id").agg(F.min_by(F.struct(F.col("period.days").alias("period_days"), F.col("period.text").alias("period_text"), F.col("file").alias("period_doc"), F.col("url").alias("period_url")), "at").alias("p")).select("nit_id", "p.*")
    return tenders.join(first, "nit_id", "left")


def read_lists(spark: SparkSession, index: str, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Cells of the lists and the index (file, url) from a file with a tab between name and address."""
    lines = spark.read.text(index).filter(F.col("value").contains("\t"))
    urls = lines.select(F.substring_index("value", "\t", 1).alias("name"), F.regexp_replace("value", r"^[^\t]*\t", "").alias("url"))
    return read_cells(spark, paths), urls


def load_lists(cells: DataFrame, urls: DataFrame, area: Area, dept: str | None = None) -> DataFrame:
    """The area's works of lists that the index names; titles that name one of the area's wards by number count as well."""
    rows = with_header(cells, None)
    title = F.coalesce(T.html_unescape(P.clean(cell("Tender Title"))), F.lit(""))
    wards = "|".join(area.ward_maps.get(PREFIX_MAP, []))
    ward = F.regexp_extract("description", rf"(?i)(?:ward\s*no\.?\s*[:\-]?\s*|\bw-?)({wards or '(?!x)x'})\b", 1)
    city = ~F.col("description").rlike(f"(?i)(?:{area.not_city_regex or '(?!x)x'})")
    by_ward = F.when((ward != "") & city, F.concat(F.lit("Tender title names ward "), ward, F.lit(f" ({area.area_name} on the {PREFIX_MAP}-ward map)")))
    name = F.element_at(F.split(F.try_url_decode("file"), "/"), -1)
    flat = rows.withColumn("name", name).join(urls.dropDuplicates(["name"]), "name").filter(F.upper(cell("Category")) == "WORKS").select(
        F.lit("list").alias("source"), F.coalesce(cell("Tender Number"), F.lit("")).alias("tender_number"), title.alias("description"), F.lit(dept).cast("string").alias("dept"), cell("Department-Location").alias("office"),
        P.parse_date(cell("Published Date")).alias("published_date"), P.parse_date(cell("Last Date")).alias("closing_date"), F.lit("Tender published (outcome not in this list)").alias("status_text"),
        P.money(cell("Tender Value in Rs")).alias("ecv"), cell("Sub-Category").alias("work_category"), "url", "row", F.col("name").alias("file"),
    )
    reasoned = flat.withColumn("scope_reason", F.coalesce(_in_scope(area, F.col("description")), by_ward)).filter("scope_reason IS NOT NULL")
    return reasoned.withColumns({"base": T.base_tender(F.col("tender_number")), "call": T.call_number(F.col("tender_number")), "category": classify(F.col("description"))})


def load_tenders(*parts: DataFrame) -> DataFrame:
    """Notices and lists in one schema; what a source lacks is NULL."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out
