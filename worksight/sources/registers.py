"""CSV registers of bills and estimates, each kind projected to one bill schema; every cell is read as text.

A file is never split, since descriptions hold line breaks, so one task reads one export. Headers are found at run time, file by
file, and joined back by file name; that side has one row per file of the manifest.
Empty files give no rows, rows without a valid job number go, unreadable values are NULL, and a header named twice means its last column.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from worksight.functions import parsing as P

#: Cells that records are first read for; wider ones widen the reading.
WIDTH = 64
_QUOTED = r'"(?:[^"]|"")*"'


def read_cells(spark: SparkSession, path: str | list[str], width: int = WIDTH) -> DataFrame:
    """file, ord (place in the file), cells (array of text) and n_cells as counted in the raw record.

    The widest record is looked for first; if it has more cells than width, all are read that wide, so no column is lost.
    """
    rows = _cells(spark, path, width)
    # with its cells, as the reader counts them only in records that it parses whole
    widest = (rows.agg(F.max(F.struct("n_cells", "cells"))["n_cells"].alias("n")).first()["n"]) or 0
    return rows if widest <= width else _cells(spark, path, widest)


def _cells(spark: SparkSession, path: str | list[str], width: int) -> DataFrame:
    schema = ", ".join(f"c{i} string" for i in range(width)) + ", raw string"
    reader = spark.read.schema(schema).option("multiLine", True).option("header", False).option("escape", '"').option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "raw")
    rows = reader.csv(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"), F.array(*[f"c{i}" for i in range(width)]).alias("cells"), "raw")
    n = F.when(F.col("raw").isNull(), width).otherwise(F.size(F.split(F.regexp_replace("raw", _QUOTED, "q"), ",", -1)))
    return rows.select("file", F.row_number().over(W.partitionBy("file").orderBy("at")).alias("ord"), "cells", n.alias("n_cells"))


def with_header(cells: DataFrame, mark: str | None, fold: bool = False) -> DataFrame:
    """Rows after the header of their file: its first row, or the first that holds the cell `mark`. row counts from 1 after it."""
    tidy = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "^﻿", ""))
    names = F.transform("cells", lambda c: F.lower(tidy(c)) if fold else tidy(c))
    heads = cells.filter(F.array_contains(names, mark) if mark else F.col("ord") == 1)
    heads = heads.groupBy("file").agg(F.min_by(F.struct(F.col("ord").alias("head_ord"), names.alias("header"), F.col("n_cells").alias("n_header")), "ord").alias("h")).select("file", "h.*")
    return cells.join(heads, "file").filter("ord > head_ord").withColumn("row", (F.col("ord") - F.col("head_ord")).cast("int"))


def cell(name: str) -> Column:
    at = F.array_position(F.reverse("header"), name).cast("int") - 1
    return P.clean(F.get(F.reverse("cells"), at))


def _bill(rows: DataFrame, job: Column, **values: Column) -> DataFrame:
    out = rows.select(F.col("file").alias("source_file"), F.col("row").alias("source_row"), P.norm_job(job).alias("job_number"), *[c.alias(k) for k, c in values.items()])
    return out.filter("job_number IS NOT NULL")


def _rtgs(number: Column) -> Column:
    return F.concat(F.lit("RTGS "), number)


def _found(c: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def public_view(cells: DataFrame) -> DataFrame:
    """A preamble of any length comes before the header; rows shorter than the header go."""
    rows = with_header(cells, "Job Number").filter("n_cells >= n_header")
    return _bill(
        rows, cell("Job Number"), description=cell("Name of Work"), ward=_found(cell("Ward"), r"^(\d+)", 1), ward_name=F.coalesce(cell("Ward"), F.lit("")), office=cell("Office"), budget_head=cell("Budget Head"),
        contractor=P.contractor(cell("Contractor")), contractor_code=P.contractor_code(cell("Contractor")), bill_type=cell("Bill Type"), wo_no=cell("Order Number"), wo_date=P.parse_date(cell("Order Date")),
        br_no=cell("BR Number"), br_date=P.parse_date(cell("BR Date")), payment_ref=cell("CBR Number"), payment_date=P.parse_date(cell("CBR Date")), payment_status=cell("Payment"),
        start_date=P.parse_date(cell("Start Date")), end_date=P.parse_date(cell("End Date")), gross=P.money(cell("Gross")), deduction=P.money(cell("Deduction")), nett=P.money(cell("Nett")),
    )


def work_details(cells: DataFrame) -> DataFrame:
    """Job and description share a cell, split by a closing link; bill and payment references are glued into one string."""
    rows, details = with_header(cells, None, fold=True), cell("wodetails")
    br, rtgs = r"(?<![CS])BR\s*-\s*(\d+)\s*/\s*(\d{1,2}-[A-Za-z]{3}-\d{4})", r"Rtgs\s*-\s*(\d+)\s*/\s*(\d{1,2}-[A-Za-z]{3}-\d{4})"
    glued = cell("brnumber")
    paid = _found(glued, rtgs, 1)
    return _bill(
        rows.filter(details.contains("</a>")), F.substring_index(details, "</a>", 1), description=P.clean(F.regexp_replace(details, r"(?s)^.*?</a>", "")), ward=F.coalesce(cell("ward"), cell("ward num"), cell("ward no")),
        contractor=P.contractor(cell("contractor")), contractor_code=P.contractor_code(cell("contractor")), br_no=_found(glued, br, 1), br_date=P.parse_date(_found(glued, br, 2)),
        payment_ref=_rtgs(paid), payment_date=P.parse_date(_found(glued, rtgs, 2)), payment_status=F.when(paid.isNotNull(), "Paid (RTGS)"),
        gross=P.money(cell("amount")), nett=P.money(cell("nett")), deduction=P.money(cell("deduction")), ifms_id=cell("id"),
    )


def department(cells: DataFrame) -> DataFrame:
    """Rows of fewer than nine cells go."""
    rows = with_header(cells, None).filter("n_cells >= 9")
    return _bill(
        rows, cell("Job Number"), description=cell("Work Order Details"), ward=cell("Ward"), contractor=P.contractor(cell("Contractor")), wo_no=cell("Work Order Number"), wo_date=P.parse_date(cell("Work Order Date")),
        gross=P.money(cell("Total Amount in Rs")), deduction=P.money(cell("Deduction in Rs")), nett=P.money(cell("Net Payment in Rs")),
    )


def bill_register(cells: DataFrame) -> DataFrame:
    """Amounts come in lakh; a payment number says that the bill was paid."""
    number = cell("RTGS_No")
    lakh = lambda name: P.money(cell(name), 100_000)
    return _bill(
        with_header(cells, None), cell("Job_Code"), description=cell("Job_Description"), ward=cell("Ward_No"), ward_name=cell("Ward_Name"), contractor=P.contractor(cell("Contractor_Name")), budget_head=cell("Budget_Head"),
        office=cell("Engineer Details"), wo_no=cell("Work_ Order"), wo_date=P.parse_date(cell("Work_Order_Date")), br_no=cell("Bill Register No"), br_date=P.parse_date(cell("Bill Register Date")),
        payment_ref=_rtgs(number), payment_date=P.parse_date(cell("RTGS_Date")), payment_status=F.when(number.isNotNull(), "Paid (RTGS)"),
        gross=lakh("Gross_ Amount In Lakhs"), deduction=lakh("Deduction In Lakhs"), nett=lakh("Nett_ Amount In Lakhs"),
    )


def job_codes(cells: DataFrame) -> DataFrame:
    """Estimates, not bills."""
    return _bill(with_header(cells, None), cell("Job_Code"), description=cell("Job_Description"), ward=cell("Ward_No"), ward_name=cell("Ward_Name"), budget_head=cell("Budget_Head"), estimate=P.money(cell("Amount in Rs.")), estimate_date=P.parse_date(cell("Date")))


def scheme_payments(cells: DataFrame) -> DataFrame:
    """Dates are wrapped over lines; the ward is the third token of the job number from the right."""
    joined = lambda name: F.regexp_replace(F.coalesce(cell(name), F.lit("")), r"-\s+", "-")
    pair, br, rtgs = r"^(\d+)\s*/\s*(\S+)", joined("BR"), joined("RTGS")
    paid = _found(rtgs, pair, 1)
    return _bill(
        with_header(cells, None), cell("Job Code"), description=cell("Name of work"), ward=F.try_element_at(F.split(P.norm_job(cell("Job Code")), "-"), F.lit(-3)), contractor=P.contractor(cell("Name of contractor")),
        budget_head=cell("Budget head"), office=cell("DDO"), br_no=_found(br, pair, 1), br_date=P.parse_date(_found(br, pair, 2)),
        payment_ref=_rtgs(paid), payment_date=P.parse_date(_found(rtgs, pair, 2)), payment_status=F.when(paid.isNotNull(), "Paid (RTGS)"), gross=P.money(cell("Gross")),
    )


PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {"public_view": public_view, "work_details": work_details, "department": department, "bill_register": bill_register, "job_codes": job_codes, "scheme_payments": scheme_payments}


def load_registers(spark: SparkSession, paths: dict[str, str | list[str]]) -> tuple[DataFrame, DataFrame]:
    """Bills of all kinds in one schema, and estimates by job, of which the last wins."""
    parts = [PARSERS[kind](read_cells(spark, path)).withColumn("kind", F.lit(kind)) for kind, path in paths.items()]
    everything = parts[0]
    for part in parts[1:]:
        everything = everything.unionByName(part, allowMissingColumns=True)
    if "estimate" not in everything.columns:
        everything = everything.withColumn("estimate", F.lit(None).cast("decimal(18,2)"))
    is_estimate = F.col("kind") == "job_codes"
    estimates = everything.filter(is_estimate).groupBy("job_number").agg(F.max_by("estimate", F.struct("source_file", "source_row")).alias("estimate"))
    return everything.filter(~is_estimate).drop("estimate"), estimates
