"""Sheets of workbooks as rows of cells, and the statements and groups that are read from them.

Spark lists the files and parses the sheets' XML; only the archive around it is opened in Python, a file at a time. A workbook's first sheet is read. Files that
are no workbook give no rows, as do empty sheets; cells without a value are NULL, and numbers are their text.
"""

from __future__ import annotations

import io
import re
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

SHEET = "sheetData struct<row: array<struct<_r: int, c: array<struct<_r: string, _t: string, v: string, is: struct<t: string>>>>>>, mergeCells struct<mergeCell: array<struct<_ref: string>>>"
STRINGS = "si array<struct<t: string, r: array<struct<t: string>>>>"
#: Where names may stand in a comparative statement, what marks its rows, and how a total is written.
NAMES_WITHIN, FIRST_BIDDER, NOT_NAMES, TOTAL = 12, 10, "Quoted", "Total Bid Amount"
BID = r"^\s*([\d.]+)\s*(?:\((L\d+)\))?"


@F.pandas_udf(StructType([StructField("sheet", StringType()), StructField("strings", StringType())]))
def _opened(contents: pd.Series) -> pd.DataFrame:
    """The first sheet and the shared strings of each workbook."""

    def parts(data: bytes) -> tuple[str | None, str | None]:
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                names = z.namelist()
                sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.sub(r"\D", "", n)))
                text = lambda n: z.read(n).decode("utf-8", "replace")
                return text(sheets[0]) if sheets else None, text("xl/sharedStrings.xml") if "xl/sharedStrings.xml" in names else None
        except zipfile.BadZipFile:
            return None, None

    return pd.DataFrame([parts(x) for x in contents], columns=["sheet", "strings"])


def _place(reference: Column) -> Column:
    """The column of a cell's reference, from 0: letters are digits to the base of 26."""
    letters = F.split(F.regexp_extract(reference, "^([A-Z]+)", 1), "")
    return F.aggregate(F.filter(letters, lambda c: c != ""), F.lit(0), lambda n, c: n * 26 + F.ascii(c) - 64) - 1


def read_sheets(spark: SparkSession, path: str | list[str], fill: bool = False) -> DataFrame:
    """(file, n, cells) of the rows of each workbook; n is the row's number in its sheet.

    fill: cells of a merged range that goes down have the value of its first one, else they are empty, as in the file.
    """
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split(F.try_url_decode("path"), "/"), -1).alias("file"), _opened("content").alias("x"))
    options = {"ignoreNamespace": "true", "mode": "PERMISSIVE"}
    files = files.filter("x.sheet IS NOT NULL").select("file", F.from_xml("x.sheet", SHEET, options).alias("sheet"), F.from_xml("x.strings", STRINGS, options).alias("strings"))
    shared = F.transform("strings.si", lambda s: F.coalesce(s["t"], F.array_join(F.transform(s["r"], lambda r: F.coalesce(r["t"], F.lit(""))), "")))
    rows = files.select("file", shared.alias("shared"), F.coalesce("sheet.mergeCells.mergeCell._ref", F.array().cast("array<string>")).alias("merged"), F.explode("sheet.sheetData.row").alias("row"))
    text = lambda c: F.when(c["_t"] == "s", F.get("shared", c["v"].try_cast("int"))).when(c["_t"] == "inlineStr", c["is"]["t"]).otherwise(c["v"])
    placed = F.transform(F.coalesce("row.c", F.array().cast("array<struct<_r: string, _t: string, v: string, is: struct<t: string>>>")), lambda c: F.struct(_place(c["_r"]).alias("at"), text(c).alias("value")))
    x = rows.select("file", F.col("row._r").alias("n"), "merged", placed.alias("placed"))
    width = F.coalesce(F.array_max(F.transform("placed", lambda p: p["at"])) + 1, F.lit(0))
    cells = F.when(width > 0, F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.try_element_at(F.filter("placed", lambda p: p["at"] == i), F.lit(1))["value"])).otherwise(F.array().cast("array<string>"))
    x = x.select("file", "n", cells.alias("cells"), "merged")
    return _filled(x) if fill else x.drop("merged")


def _filled(rows: DataFrame) -> DataFrame:
    corner = lambda r, k: F.regexp_extract(r, r"^([A-Z]+)(\d+):([A-Z]+)(\d+)$", k)
    spans = rows.select("file", F.explode("merged").alias("r")).distinct()
    spans = spans.select("file", _place(corner(F.col("r"), 1)).alias("at"), corner(F.col("r"), 2).try_cast("int").alias("first"), corner(F.col("r"), 4).try_cast("int").alias("last")).filter("last > first")
    source = rows.select("file", F.col("n").alias("first"), "cells")
    values = spans.join(source, ["file", "first"]).select("file", "at", F.get("cells", F.col("at")).alias("value"), F.explode(F.sequence(F.col("first") + 1, F.col("last"))).alias("n"))
    given = values.groupBy("file", "n").agg(F.map_from_entries(F.collect_list(F.struct("at", "value"))).alias("given"), F.max("at").alias("furthest"))
    x = rows.drop("merged").join(given, ["file", "n"], "left")
    width = F.greatest(F.size("cells") - 1, F.coalesce("furthest", F.lit(-1)))
    full = F.when(width >= 0, F.transform(F.sequence(F.lit(0), width), lambda i: F.coalesce(F.get("cells", i), F.try_element_at("given", i)))).otherwise(F.col("cells"))
    return x.select("file", "n", full.alias("cells"))


def comparative_statements(rows: DataFrame) -> DataFrame:
    """(file, position, name, amount, rank) of the bidders in comparative statements: names in one of the first rows, totals in the row that says so.

    rows: file, n, cells. A bidder's total stands beside its name's column or in it; bidders without one are left out.
    """
    some = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    worded = lambda c: some(c) & ~F.coalesce(c.rlike(r"^\s*-?[\d.]+(?:[eE][+-]?\d+)?\s*$"), F.lit(False))
    behind = F.when(F.size("cells") > FIRST_BIDDER, F.slice("cells", FIRST_BIDDER + 1, F.size("cells"))).otherwise(F.array().cast("array<string>"))
    says = lambda mark: F.exists("cells", lambda c: F.coalesce(F.contains(c, F.lit(mark)), F.lit(False)))
    names = F.min_by("cells", F.when((F.col("n") <= NAMES_WITHIN) & F.exists(behind, worded) & ~says(NOT_NAMES), F.col("n")))
    totals = F.min_by("cells", F.when(says(TOTAL), F.col("n")))
    x = rows.groupBy("file").agg(names.alias("names"), totals.alias("totals")).filter("names IS NOT NULL AND totals IS NOT NULL")
    x = x.select("file", "totals", F.posexplode("names").alias("position", "name")).filter((F.col("position") >= FIRST_BIDDER) & worded(F.col("name")))
    beside, own = F.get("totals", F.col("position") + 1), F.get("totals", F.col("position"))
    total = F.when(some(beside), beside).otherwise(own)
    return x.filter(total.rlike(BID)).select("file", "position", F.trim("name").alias("name"), F.regexp_extract(total, BID, 1).try_cast("double").alias("amount"), F.nullif(F.regexp_extract(total, BID, 2), F.lit("")).alias("rank"))
