"""Work slips and comparative statements: what was tendered and what was executed, row by row and in the headings; and the documents of a job.

A statement's row has no fixed columns once it was scanned, so its numbers are found by what must hold between them: quantity times rate is
the amount, the executed quantity times the same rate is the actual amount, and the difference of both amounts is a saving or an excess.
Each row is searched on its own. A row of more than ``WIDEST`` numbers is no statement's row and gives none; neither do rows without the
first two products, null and empty texts, or pages without lines.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType
from pyspark.sql.window import Window

from worksight.functions import amounts as A
from worksight.functions import text as T
from worksight.functions.amounts import LEAST_AMOUNT, LEAST_QUANTITY, LEAST_RATE, NEAR_RUPEES, NEAR_SHARE, UNIT_AMOUNT
from worksight.operators import documents as D

WIDEST = 64
#: How far executed quantities and amounts may lie from the tendered ones, and what each check is called.
MOST_TIMES, MOST_DERIVED, SAME_QUANTITY, WHOLE, CENT = 20, 50, 0.011, 1e-6, 0.01
TENDERED = "tender qty x rate = amount"
EXECUTED, SPLIT, NOTHING = "executed qty x rate = actual amount", "executed = up to 125 % + above 125 % (each qty x rate = amount)", "executed 0, savings = tender amount"
DERIVED = "executed qty = actual amount / rate (printed qty unreadable)"
SAVED, EXCEEDED, RESTORED = "tender - actual = savings", "actual - tender = excess", " (decimal restored)"
#: What a statement's headings say.
HEADINGS = {
    "sanctioned_estimate": r"sanctioned\s+estimate\s+amount\s*[:\-]?\s*Rs\.?\s*([\d,]+\.?\d*)",
    "sanctioned_tender": r"sanctioned\s+tender\s+amount\s*[:\-]?\s*Rs\.?\s*([\d,]+\.?\d*)",
    "tender_premium": r"tender\s+premium\s*[:\-]?\s*((?:above|below|less|excess)\s*[\d.]+\s*%)",
    "agreement_amount": r"agreement\s+amount\s*[=:\-]?\s*(?:Rs\.?\s*)?([\d,]+\.?\d*)",
    "work_slip_excess": r"work\s*slip\s+cost\s*\(?\s*excess\s*\)?\s*[\[\|=:\-_\s]*([\d,]+\.?\d*)",
    "excess_percent": r"(?:EIRL|percentage\s+of\s+excess)[^\n]{0,60}?\[?\s*(\d{1,2}\.\d{1,2})\s*%",
}
UNIT_WORD = r"(?i)\b(sq\.?\s*m\w*|sqm\w*|cu\.?\s*m\w*|cum\w*|r\.?m\.?t?|rmt|m[23²³]|mtrs?|metres?|meters?|km|kms|nos?\.?|each|kgs?|tonnes?|tons?|ltrs?|litres?|l\.?s\.?|sft|rft|days?|m)\b"


def _agrees(product: float, amount: float) -> bool:
    return amount > 0 and abs(product - amount) <= max(NEAR_RUPEES, NEAR_SHARE * amount)


def _sensible(q: float, r: float, a: float) -> bool:
    return a >= LEAST_AMOUNT and q >= LEAST_QUANTITY and r >= LEAST_RATE and (min(q, r) > 1 or a >= UNIT_AMOUNT)


def _products(v: list[float], decimal: list[bool]) -> Iterator[tuple[int, int, int]]:
    """Places (amount, quantity, rate) of all products among a row's numbers, two of each three printed with decimals; by amount, then in order."""
    for k in range(2, len(v)):
        a = v[k]
        if not a >= LEAST_AMOUNT:
            continue
        for i in range(k - 1):
            q = v[i]
            if not q >= LEAST_QUANTITY:
                continue
            for j in range(i + 1, k):
                if _agrees(q * v[j], a) and decimal[k] + decimal[i] + decimal[j] >= 2 and _sensible(q, v[j], a):
                    yield k, i, j


def _in_two_parts(v: list[float], products: Iterator[tuple[int, int, int]], after: int, rate: float) -> tuple[float, float, int] | None:
    """Executed quantity, amount and place of a row that splits them at 125 %: a quantity, then products whose quantities add up to it."""
    if after >= len(v) or not v[after] > 0:
        return None
    chain, begin = [], after + 1
    for k, i, j in products:
        if i >= begin:
            chain.append((k, i, j))
            begin = k + 1
    for n, (k, i, j) in enumerate(chain):
        for k2, i2, _ in chain[n + 1 :] if abs(v[j] - rate) <= NEAR_SHARE * rate else []:
            if abs(v[i] + v[i2] - v[after]) <= SAME_QUANTITY:
                return v[after], v[k] + v[k2], k2
    return None


def _executed(v: list[float], after: int, q: float, rate: float, amount: float) -> tuple[float, float, int, str] | None:
    """Of what stands after the tendered amount: the largest quantity whose amount is there, or that an amount alone gives."""
    rest = v[after:]
    found = [(x, y, after + at, EXECUTED) for n, x in enumerate(rest) for at, y in enumerate(rest[n + 1 :], n + 1) if _agrees(x * rate, y)]
    for y, x in enumerate(rest):
        times = x / rate
        if x > max([amount, *(a for _, a, _, _ in found)]) and abs(x - rate) > CENT and times <= MOST_DERIVED * max(q, 1) and abs(times - round(times, 2)) < WHOLE and not any(_agrees(x, a) for _, a, _, _ in found):
            found.append((round(times, 2), x, after + y, DERIVED))
    if found:
        best = max(found, key=lambda f: (f[0], -f[2]))
        confirmed = any(at != best[2] and _agrees(n, best[0]) for n, _, at, _ in found)
        return *best[:3], EXECUTED if confirmed or best[3] == EXECUTED and not any(f[3] == DERIVED for f in found) else DERIVED
    if 0 in rest and any(_agrees(x, amount) for x in rest):
        return 0.0, 0.0, after + rest.index(0), NOTHING
    return None


def _difference(v: list[float], digits: list[str], after: int, rate: float, gap: float) -> tuple[float, str] | None:
    """The first number behind that is the gap between the amounts, or its digits without their point."""
    if not gap > 0:
        return None
    whole = f"{gap:.2f}".replace(".", "").lstrip("0") or None
    for x, shown in zip(v[after + 1 :], digits[after + 1 :]):
        if abs(x - rate) <= CENT or not math.isfinite(x):
            continue
        if _agrees(gap, x) or abs(gap - x) <= NEAR_RUPEES:
            return x, ""
        if shown == whole:
            return float(np.round(gap, 2)), RESTORED
    return None


_ROW = StructType([*(StructField(c, DoubleType()) for c in ("tender_qty", "rate", "tender_amount", "executed_qty", "actual_amount", "excess", "savings")), StructField("checks", ArrayType(StringType())), StructField("confidence", StringType())])


def statement_row(v: list[float], decimal: list[bool], digits: list[str]) -> tuple | None:
    """A row's tendered and executed quantities with the checks that hold, or None."""
    products = _products(v, decimal)
    first = next(products, None)
    if first is None:
        return None
    k, i, j = first
    q, rate, amount = v[i], v[j], v[k]
    split = _in_two_parts(v, products, k + 1, rate)
    got = (*split, SPLIT) if split else _executed(v, k + 1, q, rate, amount)
    if got is None or got[0] > MOST_TIMES * max(q, 1):
        return None
    executed, actual, at, how = got
    gap = _difference(v, digits, at, rate, abs(amount - actual))
    saved = amount > actual
    checks = [TENDERED, how] + ([(SAVED if saved else EXCEEDED) + gap[1]] if gap else [])
    sure = "high" if gap and how != DERIVED else "medium"
    return q, rate, amount, executed, actual, gap[0] if gap and not saved else None, gap[0] if gap and saved else None, checks, sure


@F.pandas_udf(_ROW)
def _statement_rows(values: pd.Series, decimals: pd.Series, digits: pd.Series) -> pd.DataFrame:
    """Rows are short, so plain numbers are searched; a row's own loops end at what they look for."""
    none = (None,) * 9
    out = [none if v is None else statement_row(v.tolist(), d.tolist(), list(s)) or none for v, d, s in zip(values, decimals, digits)]
    return pd.DataFrame(out, columns=["tender_qty", "rate", "tender_amount", "executed_qty", "actual_amount", "excess", "savings", "checks", "confidence"])


def statement_rows(pages: DataFrame) -> DataFrame:
    """pages (file, page, text, ...) without text, with line, the row's numbers, unit, code, description, raw, checks and confidence.

    Lines since the row before, five at most, are its context: the code and the description come from there as well.
    """
    keys = [c for c in pages.columns if c != "text"]
    lines = pages.select(*keys, F.posexplode(F.split("text", r"\r?\n")).alias("line", "raw"))
    tokens = T.number_tokens(F.col("raw"))
    tokens = F.when(F.size(tokens).between(3, WIDEST), tokens)
    x = lines.withColumn("x", _statement_rows(*A.printed_numbers(tokens))).withColumn("found", F.col("x.rate").isNotNull())
    own = Window.partitionBy("file", "page").orderBy("line")
    block = F.coalesce(F.sum(F.col("found").cast("int")).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = Window.partitionBy("file", "page", "block").orderBy("line").rowsBetween(-5, 0)
    x = x.withColumn("block", block).withColumn("context", F.array_join(F.collect_list("raw").over(within), " ")).filter("found")
    before = F.call_function("substring_index", F.col("raw"), F.element_at(T.number_tokens(F.col("raw")), 1), F.lit(1))
    units = F.array_compact(F.transform(F.regexp_extract_all(before, F.lit(UNIT_WORD), F.lit(1)), A.unit))
    codes = F.transform(F.regexp_extract_all("context", F.lit(T.CODE), F.lit(0)), T.rate_code)
    words = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("context", r"[|\[\]{}]", " "), T.NUMBER, " "), r"\s+", " "))
    return x.select(*keys, "line", "x.*", F.try_element_at(units, F.lit(-1)).alias("unit"), F.try_element_at(codes, F.lit(-1)).alias("code"), F.right(words, F.lit(220)).alias("description"), F.substring(F.trim("raw"), 1, 260).alias("raw"))


def headings(pages: DataFrame) -> DataFrame:
    """(file, field, value, number, page, raw): each heading where it first stands; number is NULL for the premium, which is text."""
    each = [F.struct(F.lit(name).alias("field"), F.regexp_extract("text", f"(?i){p}", 1).alias("value"), F.regexp_extract("text", f"(?i){p}", 0).alias("raw")) for name, p in HEADINGS.items()]
    x = pages.select("file", "page", F.explode(F.array(*each)).alias("x")).select("file", "page", "x.*").filter("raw <> ''")
    x = x.groupBy("file", "field").agg(F.min_by(F.struct("value", "page", "raw"), "page").alias("x"))
    number = F.when(F.col("field") != "tender_premium", A.number(F.replace("x.value", F.lit(","), F.lit(""))))
    return x.select("file", "field", "x.value", number.alias("number"), "x.page", "x.raw")


def first_of_each(rows: DataFrame, by: list[str], values: list[str], order: list[str]) -> DataFrame:
    """Of rows with the same values, rounded to two places and NULL as 0, the first; the same sheet is often filed with several bills."""
    key = [F.round(F.coalesce(F.col(v), F.lit(0.0)), 2).alias(f"__{v}") for v in values]
    least = F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("x")
    return rows.groupBy(*by, *key).agg(least).select("x.*")


def case_documents(attachments: DataFrame, bill_types: tuple[str, ...] = ("M.B.", "Bill Form")) -> DataFrame:
    """(job, file, kind, type, url, bills): files of a job that can confirm or explain a case, once each, with the bills that carry it.

    attachments: job, bill, position, file, type, url, final_bill. A file is a final bill's if any of its bills is final; else its kind is that of
    the first bill that makes it one.
    """
    kind = D.document_kind(F.col("file"), F.col("type"), F.col("final_bill"), bill_types)
    x = attachments.withColumn("kind", kind).filter(F.col("kind").isNotNull() & ~placeholder_name(F.col("file")))
    first = F.min_by(F.struct("kind", "type", "url"), F.struct("bill", "position")).alias("x")
    out = x.groupBy("job", "file").agg(first, F.array_sort(F.collect_set("bill")).alias("bills"), F.bool_or(F.col("kind") == "final_bill").alias("closes"))
    return out.select("job", "file", F.when(F.col("closes"), "final_bill").otherwise(F.col("x.kind")).alias("kind"), "x.type", "x.url", "bills")


def placeholder_name(name: Column) -> Column:
    """Whether a file's name says that nothing is in it."""
    return F.coalesce(name.rlike(r"(?i)not\s*applicable|\bn\.?a\b|emty|empty|nil\b|blank"), F.lit(False))


def case_evidence(documents: DataFrame, pages: DataFrame) -> dict[str, DataFrame]:
    """What a job's documents say: ``documents`` with status and rows, ``statement_rows`` and ``final_rows`` of the job without repeats, ``headings``.

    documents: as case_documents gives them. pages: file, page, text; a file without pages was not read.
    """
    read = pages.select("file").distinct().withColumn("read", F.lit(True))
    of = lambda kind: pages.join(documents.filter(F.col("kind") == kind).select("file").distinct(), "file", "left_semi")
    slips = statement_rows(of("variation").select("file", "page", "text"))
    priced = D.priced_rows(of("final_bill").select("file", "page", F.lit("abstract").alias("kind"), "text")).drop("kind")
    counted = slips.select("file").unionByName(priced.select("file")).groupBy("file").agg(F.count("*").alias("n"))
    told = documents.join(read, "file", "left").join(counted, "file", "left").withColumns({"status": F.when(F.col("read"), "read").otherwise("not downloaded"), "rows": F.when(F.col("read"), F.coalesce("n", F.lit(0)))}).drop("read", "n")
    jobs = documents.select("job", "file", "url", "bills")
    heads = headings(of("variation")).join(jobs, "file").groupBy("job", "field").agg(F.min_by(F.struct("value", "number", "file", "page", "raw"), F.struct("file", "page")).alias("x"))
    return {
        "documents": told,
        "statement_rows": first_of_each(slips.join(jobs, "file"), ["job"], ["tender_qty", "rate", "executed_qty"], ["file", "page", "line"]),
        "final_rows": first_of_each(priced.join(jobs, "file"), ["job"], ["quantity", "rate", "to_date_quantity"], ["file", "page", "line"]),
        "headings": heads.select("job", "field", "x.*"),
    }


def amount_multiples(items: DataFrame, pages: DataFrame) -> DataFrame:
    """Executed quantities of items whose statement row can't be read: two amounts T and E of a line, whole multiples of the item's rate, that lie the planned amount apart.

    items: job, item, quantity, rate. pages: job, file, page, text, of statements. Gives item's first hit: job, item, tender_qty, rate,
    executed_qty = T / rate, excess_qty, file, page, line, raw, confidence and checks. Differences of a line's numbers meet the items by the
    rupee that they lie in, so neither all lines nor all items of a job are compared; a line has at most ``WIDEST`` numbers.
    """
    lines = pages.select("job", "file", "page", F.posexplode(F.split("text", r"\r?\n")).alias("line", "raw"))
    numbers = F.filter(F.transform(T.number_tokens(F.col("raw")), A.number), lambda v: v > 0)
    lines = lines.withColumn("v", numbers).filter(F.size("v").between(2, WIDEST)).withColumn("d", F.array_distinct("v"))
    pairs = F.flatten(F.transform("d", lambda t: F.transform(F.filter(F.col("d"), lambda e: e < t), lambda e: F.struct(t.alias("t"), e.alias("e")))))
    pairs = lines.select("job", "file", "page", "line", "raw", F.explode(pairs).alias("p")).select("job", "file", "page", "line", "raw", "p.t", "p.e", F.floor(F.col("p.t") - F.col("p.e")).alias("rupee"))
    apart, slack = F.col("quantity") * F.col("rate"), WHOLE * F.col("rate")
    wanted = items.filter("quantity > 0 AND rate > 0").select("job", "item", "quantity", "rate", F.explode(F.sequence(F.floor(apart - slack).cast("long"), F.floor(apart + slack).cast("long"))).alias("rupee"))
    times = lambda c: F.col(c) / F.col("rate")
    whole = lambda c: F.abs(times(c) - F.rint(times(c))) < WHOLE
    hit = (F.col("e") > F.col("rate")) & whole("t") & whole("e") & (F.abs(times("t") - times("e") - F.col("quantity")) < WHOLE) & (times("t") > F.col("quantity"))
    found = pairs.join(wanted, ["job", "rupee"]).filter(hit)
    first = F.min_by(F.struct("quantity", "rate", "t", "e", "file", "page", "line", "raw"), F.struct("file", "page", "line", "t", "e")).alias("x")
    out = found.groupBy("job", "item").agg(first).select("job", "item", "x.*")
    shown = lambda c: F.regexp_replace(F.format_string("%.6f", times(c)), r"\.?0+$", "")
    checks = F.array(F.concat(F.lit("total amount = "), shown("t"), F.lit(" x rate")), F.concat(F.lit("excess amount = "), shown("e"), F.lit(" x rate")), F.lit("total - excess = Schedule B quantity"))
    return out.select("job", "item", F.col("quantity").alias("tender_qty"), "rate", times("t").alias("executed_qty"), times("e").alias("excess_qty"), "file", "page", "line", F.substring(F.trim("raw"), 1, 240).alias("raw"), F.lit("medium").alias("confidence"), checks.alias("checks"))
