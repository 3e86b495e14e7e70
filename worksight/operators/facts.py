"""The catalogue of facts: for each work what was planned, awarded, paid and completed, how sure that is, and what it rests on.

``base_facts`` reads bills, the primary tender, plans, estimates and sanction lists; ``with_records`` lays direct records, mined documents
and photos over them; ``with_entities``, ``with_extensions``, ``with_quantities`` and ``with_imagery`` add what other operators found.
Each input is reduced to one row a work before it is joined, and each work's facts come out of one row. Values are text. A fact without a
value is unknown; later layers replace a field as a whole. Empty text and NULL are alike; amounts of zero count as absent, except sums.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from worksight.tables import exploded

FACT = "field string, stage string, value string, confidence string, explanation string, via string, evidence array<string>"
#: Which source's tender is primary among equals, and those that are plans.
SOURCE_RANK = {"portal": 0, "tender-list": 1}
PLAN_SOURCES = ("plan-programme", "plan-grant")
RUNNING, FINAL, PAID = "Running bill only (no final bill found)", "Completed (final bill)", "Bills paid; completion not stated"
PENALTIES = ("fine", "withheld", "audit_recovery", "mobilizationadvance")
WORK_DOCUMENT = r"(?i)measurement|\bm\.?\s?b\b|completion|quality|inspection|lab|test|road history"


def _text(c: Column) -> Column:
    return F.nullif(c.cast("string"), F.lit(""))


def _some(c: Column) -> Column:
    return F.nullif(c, F.lit(0).cast("double"))


def _fact(field: str, stage: str, value: Column, confidence: Column | str, explanation: Column | str, evidence: Column | None = None, via: Column | None = None) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    value = _text(value)
    none = F.array().cast("array<string>")
    return F.struct(
        F.lit(field).alias("field"), F.lit(stage).alias("stage"), value.alias("value"), F.when(value.isNull(), "unknown").otherwise(lit(confidence)).alias("confidence"),
        lit(explanation).alias("explanation"), (via if via is not None else F.lit(None).cast("string")).alias("via"), F.coalesce(evidence, none).alias("evidence") if evidence is not None else none.alias("evidence"),
    )


def _unknown(field: str, stage: str, why: Column | str) -> Column:
    return _fact(field, stage, F.lit(None).cast("string"), "unknown", why)


def _ref() -> Column:
    return F.concat_ws(" row ", "source_id", F.col("source_row").cast("string"))


def bill_facts(bills: DataFrame) -> DataFrame:
    """One row a work: sums, dates, the payees by amount, and the bills that settle its state."""
    kind = F.lower(F.coalesce("bill_type", F.lit("")))
    order = F.struct(F.coalesce("br_date", "wo_date", "payment_date"), "source_row")
    day = lambda c: F.col(c).cast("string")
    b = bills.withColumns({"kind": kind, "ref": _ref(), "money": F.col("gross").cast("decimal(18,2)"), "order": order})
    exact = F.col("dedupe_key").isin("IFMS", "BR", "id")
    final = F.struct(F.coalesce(day("end_date"), day("br_date"), F.lit("")).alias("when"), F.coalesce(day("br_date"), day("payment_date"), day("end_date"), F.lit("yes")).alias("value"), day("end_date").alias("end"), "bill_type", "ref")
    sums = b.groupBy("work").agg(
        F.count("*").alias("n"), F.count("money").alias("n_gross"), F.sum("money").alias("gross"), F.count("nett").alias("n_nett"), F.sum(F.col("nett").cast("decimal(18,2)")).alias("nett"),
        F.bool_and(F.when(F.col("money").isNotNull(), F.coalesce(exact, F.lit(False)))).alias("exact"), F.min("payment_date").alias("first_paid"), F.max("payment_date").alias("last_paid"),
        F.min(F.when(F.col("wo_date").isNotNull(), F.struct("wo_date", "wo_no", "ref"))).alias("order_"), F.min(F.when(F.col("start_date").isNotNull(), F.struct("start_date", "ref"))).alias("start"),
        F.max(F.when(F.col("kind").contains("final"), final)).alias("final"), F.max(F.when(F.col("kind") == "running", F.struct("order", "ref"))).alias("running"),
        F.min("order").alias("first_order"), F.slice(F.array_sort(F.collect_set("ref")), 1, 12).alias("refs"),
    )
    paid = b.filter("contractor <> ''").groupBy("work", "contractor").agg(F.sum(F.coalesce("money", F.lit(0))).alias("amount"), F.min("order").alias("seen"))
    ranked = paid.groupBy("work").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("amount")).alias("a"), "seen", "contractor"))), lambda x: x["contractor"]).alias("payees"))
    return sums.join(ranked, "work", "left")


def tender_facts(links: DataFrame) -> DataFrame:
    """One row a work: its primary tender, the best of its links, exact ones first; and the best plan.

    links: work, base, source, exact, score, via and a tender's columns, one row a call.
    """
    rank = F.coalesce(*(F.when(F.col("source") == s, r) for s, r in SOURCE_RANK.items()), F.lit(9))
    key = F.struct((~F.col("exact")).alias("guess"), rank.alias("rank"), (-F.coalesce("score", F.lit(9.0))).alias("score"), "source", "base")
    plans = links.filter(F.col("source").isin(*PLAN_SOURCES))
    own = links.filter(~F.col("source").isin(*PLAN_SOURCES)).withColumn("key", key)
    prim = own.withColumn("best", F.min("key").over(Window.partitionBy("work"))).filter("key = best")
    last = lambda cols, having: F.max(F.when(having, F.struct("call", *cols)))
    has = lambda c: _text(F.col(c)).isNotNull() & (_text(F.col(c)) != "0.0")
    ref = F.concat(F.lit("tender "), F.col("tender_number")).alias("ref")
    per = prim.groupBy("work").agg(
        F.first("exact").alias("exact"), F.first("via").alias("via"), F.max(F.struct("call", "status", "status_text", "source")).alias("last"), F.min(F.struct("call", "published_date", ref)).alias("first"), F.max("call").alias("calls"),
        last(["ecv", "source", ref], has("ecv")).alias("ecv"), last(["provisional_amount", ref], has("provisional_amount")).alias("provisional"), last(["period_days", "period_text", ref], has("period_days")).alias("period"),
        last(["contractor", "contract_value", "negotiated_value", "awarded_date", ref], has("contractor")).alias("award"), last([F.size("bidders").alias("n"), ref], F.size("bidders") > 0).alias("bids"),
    )
    plan = plans.groupBy("work").agg(F.max_by(F.struct("ecv", "status_text", "via"), F.struct("score", "call")).alias("plan"))
    return per.join(plan, "work", "full")


def base_facts(works: DataFrame, bills: DataFrame, links: DataFrame, estimates: DataFrame | None = None, sanctions: DataFrame | None = None, fields: Collection[str] | None = None) -> DataFrame:
    """(work, field, ...) of works (work, title, locations, wards, job_number).

    estimates: job_number, estimate, ref. sanctions: job_number, ecv, fy, office, ref; of several the last by ref counts.
    fields: those to find; all without it.
    """
    spark = works.sparkSession
    estimates = estimates if estimates is not None else spark.createDataFrame([], "job_number string, estimate double, ref string")
    sanctions = sanctions if sanctions is not None else spark.createDataFrame([], "job_number string, ecv double, fy string, office string, ref string")
    e = estimates.groupBy("job_number").agg(F.max(F.struct("ref", "estimate")).alias("e"))
    s = sanctions.groupBy("job_number").agg(F.max(F.struct("ref", "ecv", "fy", "office")).alias("s"))
    b, t = bill_facts(bills), tender_facts(links)
    x = works.join(e, "job_number", "left").join(s, "job_number", "left")  # while rows are narrow
    x = x.join(b.select("work", F.struct(*(c for c in b.columns if c != "work")).alias("b")), "work", "left").join(t.select("work", F.struct(*(c for c in t.columns if c != "work")).alias("t")), "work", "left")
    col, lit = F.col, F.lit
    billed, tendered = F.coalesce(col("b.n") > 0, lit(False)), col("t.last").isNotNull()
    sure = F.when(F.coalesce(col("t.exact"), lit(False)), "confirmed").otherwise("inferred")
    via, one = col("t.via"), lambda c: F.array(c)
    refs, paid_sure = col("b.refs"), F.when(col("b.exact"), "confirmed").otherwise("inferred")
    total = col("b.gross").cast("double")
    value = _some(col("t.award.contract_value"))
    order_date, awarded = col("b.order_.wo_date"), F.to_date(col("t.award.awarded_date"))
    start, period = F.coalesce(order_date, awarded), _some(col("t.period.period_days").cast("double"))
    final, running = col("b.final"), col("b.running")
    portal_state = F.coalesce(F.when(col("t.last.status") == "AWARDED", "Tender awarded").when(col("t.last.status") == "UNDER_EVALUATION", "Tender under evaluation"), col("t.last.status_text"))
    repeat = F.when(col("b.exact"), "").otherwise("; some rows were de-duplicated by matching amounts, so the total may include a repeat")
    others = F.slice(col("b.payees"), 2, 3)
    rules: dict[str, Column] = {
        "description": _fact("description", "planned", col("title"), "confirmed", "Work description as written in the source record", F.slice(refs, 1, 1)),
        "location": F.when(F.size("locations") > 0, _fact("location", "planned", F.array_join("locations", "; "), "inferred", "Place names read from the work description text")).otherwise(_unknown("location", "planned", "No place name could be read from the description")),
        "ward": F.when(F.size("wards") > 0, _fact("ward", "planned", F.array_join("wards", ", "), "confirmed", "Ward the bills are booked to", F.slice(refs, 1, 3))),
        "estimated_cost": F.when(col("e").isNotNull(), _fact("estimated_cost", "planned", col("e.estimate"), "confirmed", "Estimate on the job code", one(col("e.ref"))))
        .when(_some(col("s.ecv")).isNotNull(), _fact("estimated_cost", "planned", col("s.ecv"), "confirmed", F.concat(lit("Estimate on the ward works list FY "), F.coalesce(col("s.fy"), lit("")), lit(" for this job code")), one(col("s.ref"))))
        .when(col("t.ecv").isNotNull(), _fact("estimated_cost", "planned", col("t.ecv.ecv"), sure, "Estimated contract value in the tender", one(col("t.ecv.ref")), via))
        .otherwise(_unknown("estimated_cost", "planned", "No estimate published for this work in the sources used")),
        "provisional_amount": F.when(col("t.provisional").isNotNull(), _fact("provisional_amount", "planned", col("t.provisional.provisional_amount"), sure, "Provisional amount in the tender schedule", one(col("t.provisional.ref")), via)),
        "tender_published": F.when(tendered, _fact("tender_published", "planned", col("t.first.published_date"), sure, "Date the first call of the tender was published", one(col("t.first.ref")), via)).otherwise(_unknown("tender_published", "planned", "No tender found or matched for this work")),
        "tender_calls": F.when(tendered, _fact("tender_calls", "planned", col("t.calls"), sure, F.when(col("t.calls") > 1, "Number of times the tender was called").otherwise("Tender awarded or listed on its first call"), one(col("t.first.ref")), via)),
        "period_days": F.when(period.isNotNull(), _fact("period_days", "planned", col("t.period.period_days"), sure, F.concat(lit("Stipulated period of completion (“"), F.coalesce(col("t.period.period_text"), lit("")), lit("”)")), one(col("t.period.ref")), via))
        .otherwise(_unknown("period_days", "planned", F.when(tendered, "Tender document not available or period not stated").otherwise("No tender document found or matched"))),
        "sanctioned": F.when(col("s").isNotNull(), _fact("sanctioned", "planned", F.coalesce(F.concat(lit("FY "), _text(col("s.fy"))), lit("listed")), "confirmed", "Listed with this job code on the ward works list", one(col("s.ref")))),
        "planned_amount": F.when(col("t.plan").isNotNull(), _fact("planned_amount", "planned", col("t.plan.ecv"), "inferred", "Amount in the plan", None, col("t.plan.via"))),
        "plan_status": F.when(_text(col("t.plan.status_text")).isNotNull(), _fact("plan_status", "planned", col("t.plan.status_text"), "inferred", "Approval status at the time of the document", None, col("t.plan.via"))),
        "contractor": F.when(F.size(col("b.payees")) > 0, _fact("contractor", "awarded", F.element_at(col("b.payees"), 1), "confirmed", F.concat(lit("Payee with the largest billed amount under this job number"), F.when(F.size(others) > 0, F.concat(lit("; also billed: "), F.array_join(others, ", "))).otherwise(""), F.coalesce(F.concat(lit(". Tender awarded to: "), col("t.award.contractor")), lit(""))), refs))
        .when(col("t.award").isNotNull(), _fact("contractor", "awarded", col("t.award.contractor"), sure, "Awarded (selected) bidder on the tender", one(col("t.award.ref")), via))
        .otherwise(_unknown("contractor", "awarded", "No contractor named in any source yet")),
        "contract_value": F.when(value.isNotNull(), _fact("contract_value", "awarded", value, sure, F.when(_some(col("t.award.negotiated_value")).isNotNull(), "Negotiated value of the awarded bid").otherwise("Quoted value of the awarded bid"), one(col("t.award.ref")), via))
        .otherwise(_unknown("contract_value", "awarded", F.when(_text(col("t.last.status")).isNotNull() & (col("t.last.status") != "AWARDED"), "Tender not yet awarded").otherwise("Contract value is not published in bill data and no awarded tender was matched"))),
        "awarded_date": F.when(awarded.isNotNull(), _fact("awarded_date", "awarded", awarded, sure, "Tender award date", one(col("t.award.ref")), via)),
        "bidders": F.when(col("t.bids").isNotNull(), _fact("bidders", "awarded", col("t.bids.n"), sure, "Bidders in the comparative statement", one(col("t.bids.ref")), via)),
        "work_order_date": F.when(order_date.isNotNull(), _fact("work_order_date", "awarded", order_date, "confirmed", F.concat(lit("Work order date on the bill (order no. "), F.coalesce(_text(col("b.order_.wo_no")), lit("n/a")), lit(")")), one(col("b.order_.ref")))),
        "payments_gross": F.when(col("b.n_gross") > 0, _fact("payments_gross", "money", col("b.gross"), paid_sure, F.concat(lit("Sum of "), col("b.n_gross").cast("string"), lit(" bill(s) under the job number"), repeat), refs)).otherwise(_unknown("payments_gross", "money", "No bill or payment for this work found in published data")),
        "payments_nett": F.when((col("b.n_gross") > 0) & (col("b.n_nett") > 0), _fact("payments_nett", "money", col("b.nett"), paid_sure, "Gross minus statutory deductions", refs)),
        "first_payment": F.when((col("b.n_gross") > 0) & col("b.first_paid").isNotNull(), _fact("first_payment", "money", col("b.first_paid"), "confirmed", "Earliest payment date", F.slice(refs, 1, 1))),
        "last_payment": F.when((col("b.n_gross") > 0) & col("b.last_paid").isNotNull(), _fact("last_payment", "money", col("b.last_paid"), "confirmed", "Latest payment date", F.slice(refs, 1, 1))),
        "n_bills": F.when(col("b.n_gross") > 0, _fact("n_bills", "money", col("b.n"), "confirmed", "Unique bills after merging duplicates across exports", refs)),
        "paid_vs_contract": F.when((col("b.n_gross") > 0) & value.isNotNull(), _fact("paid_vs_contract", "money", F.round(total / value, 3), "inferred", F.concat(lit("Gross paid ÷ contract value (contract value is "), sure, lit(")")), one(col("t.award.ref")), via)),
        "start_date": F.when(col("b.start").isNotNull(), _fact("start_date", "outcome", col("b.start.start_date"), "confirmed", "Work start date on the bill", one(col("b.start.ref")))).otherwise(_unknown("start_date", "outcome", "Actual start date is not published")),
        "final_bill": F.when(final.isNotNull(), _fact("final_bill", "outcome", col("b.final.value"), "confirmed", F.concat(lit("A bill of type “"), col("b.final.bill_type"), lit("” exists")), one(col("b.final.ref")))),
        "status": F.when(final.isNotNull(), _fact("status", "outcome", lit(FINAL), "inferred", "Inferred from the final bill, which is raised when measurement of the completed work is recorded", one(col("b.final.ref"))))
        .when(running.isNotNull(), _fact("status", "outcome", lit(RUNNING), "inferred", "Latest bill is a part (running) bill; no final bill in the published data", one(col("b.running.ref"))))
        .when(billed, _fact("status", "outcome", lit(PAID), "inferred", "Bills were paid but these exports do not record bill type or completion", refs))
        .when(tendered, _fact("status", "outcome", portal_state, sure, "Tender status on the procurement portal; no bill found yet", one(col("t.first.ref")), via)),
        "completion_date": F.when(final.isNotNull() & _text(col("b.final.end")).isNotNull(), _fact("completion_date", "outcome", col("b.final.end"), "confirmed", "Work end date recorded on the final bill", one(col("b.final.ref"))))
        .when(final.isNotNull(), _unknown("completion_date", "outcome", "Final bill does not carry an end date")).when(running.isNotNull(), _unknown("completion_date", "outcome", "No final bill found"))
        .when(billed, _unknown("completion_date", "outcome", "Not published")).when(tendered, _unknown("completion_date", "outcome", "No bills yet")),
        "expected_completion": F.when(period.isNotNull() & start.isNotNull(), _fact("expected_completion", "outcome", F.date_add(start, period.cast("int")), "inferred", F.concat(start.cast("string"), lit(" + "), period.cast("int").cast("string"), lit(" days stipulated period; the contractual start is not published, so this is approximate")), one(col("t.period.ref")), via))
        .when(period.isNotNull(), _unknown("expected_completion", "outcome", "No award or work-order date to count the stipulated period from")).otherwise(_unknown("expected_completion", "outcome", "Stipulated period of completion not found in any public record")),
    }
    wanted = [rule for field, rule in rules.items() if fields is None or field in fields]
    return exploded(x, "work", wanted)


def overlaid(facts: DataFrame, *layers: DataFrame) -> DataFrame:
    """Facts with each layer's in place of those of the same work and field; the last layer wins."""
    out = facts.withColumn("__layer", F.lit(0))
    for k, layer in enumerate(layers, 1):
        out = out.unionByName(layer.withColumn("__layer", F.lit(k)))
    top = F.max("__layer").over(Window.partitionBy("work", "field"))
    return out.withColumn("__top", top).filter("__layer = __top").drop("__layer", "__top")


def as_map(facts: DataFrame) -> DataFrame:
    """(work, f: map of field to its fact)."""
    return facts.groupBy("work").agg(F.map_from_entries(F.collect_list(F.struct("field", F.struct("value", "confidence", "explanation", "stage", "evidence")))).alias("f"))


def with_records(facts: DataFrame, records: DataFrame, documents: DataFrame, photos: DataFrame) -> DataFrame:
    """Facts with what direct records, mined documents and photos add.

    records: work, bill_id, bill_type, paid, in_records, level, gross, br_date, rtgs_date, release_pct, deductions (map), approvals (array of
    date, remarks), files (array of name, type, placeholder), position. documents: work, field, value, number, date, doc_type, page, snippet,
    position, the first of each field counts. photos: work, placeholder, lat, lon, taken (date), scanned.
    """
    col, lit = F.col, F.lit
    kind = F.lower(F.coalesce("bill_type", lit("")))
    r = records.withColumns({"final": kind.contains("final"), "run": kind == "running", "pending": ~col("paid"), "known": col("in_records")})
    day = lambda c: col(c).cast("string")
    remarks = F.filter("approvals", lambda a: F.length(a["remarks"]) > 25)
    per = r.groupBy("work").agg(
        F.count_if(~col("pending")).alias("n"), F.count_if(col("known") & col("run")).alias("n_run"), F.count_if(col("known") & col("final")).alias("n_final"), F.count_if("pending").alias("n_pending"),
        F.max(F.when(col("known") & col("final"), F.struct(F.coalesce(day("br_date"), lit("")), F.coalesce(day("br_date"), day("rtgs_date"), lit("yes")).alias("value"), "bill_type", "bill_id"))).alias("last_final"),
        F.min(F.when(col("pending") & col("final"), F.struct("position", "bill_type", "bill_id", "level"))).alias("unpaid_final"), F.sum(F.when(col("pending"), col("gross").cast("decimal(18,2)"))).alias("pending_gross"),
        F.array_sort(F.collect_list(F.when(~col("pending") & (col("release_pct") > 0) & (col("release_pct") < 100), F.struct("position", "release_pct")))).alias("partial"),
        F.array_sort(F.collect_list(F.when(~col("pending") & col("br_date").isNotNull() & col("rtgs_date").isNotNull(), F.datediff("rtgs_date", "br_date")))).alias("lags"),
        F.sum(F.when(~col("pending"), F.size(remarks)).otherwise(0)).alias("n_remarks"), F.min(F.when(~col("pending") & (F.size(remarks) > 0), F.struct("position", F.try_element_at(remarks, lit(1)).alias("r")))).alias("remark"),
        *(F.sum(F.when(~col("pending"), F.try_element_at(col("deductions"), lit(p)))).alias(f"sum_{p}") for p in PENALTIES),
        F.slice(F.array_sort(F.collect_set(F.concat(lit("record of bill "), "bill_id"))), 1, 4).alias("refs"),
    )
    levels = r.filter("pending").groupBy("work", F.coalesce(_text(col("level")), lit("?")).alias("level")).agg(F.count("*").alias("k"), F.min("position").alias("seen"))
    levels = levels.groupBy("work").agg(F.array_join(F.slice(F.transform(F.array_sort(F.collect_list(F.struct((-col("k")).alias("m"), "seen", "level", "k"))), lambda x: F.concat(x["level"], lit(" ×"), x["k"].cast("string"))), 1, 3), ", ").alias("levels"))
    files = r.filter("NOT pending").select("work", "position", F.posexplode("files").alias("k", "file")).groupBy("work", "file.name").agg(F.min_by("file", F.struct("position", "k")).alias("file"))
    kinds = files.groupBy("work", F.rtrim(F.trim(F.coalesce("file.type", lit("other"))), lit(".")).alias("type")).agg(F.count("*").alias("k"), F.count_if(F.coalesce("file.placeholder", lit(False))).alias("empty")).filter(col("type").rlike(WORK_DOCUMENT))
    shown = F.concat("type", lit(" ×"), col("k").cast("string"), F.when(col("empty") > 0, F.concat(lit(" ("), col("empty").cast("string"), lit(" placeholder)"))).otherwise(""))
    kinds = kinds.groupBy("work").agg(F.array_join(F.array_sort(F.collect_list(shown)), "; ").alias("kinds"))
    shots = photos.groupBy("work").agg(
        F.count_if(~col("placeholder")).alias("n_photos"), F.count_if("placeholder").alias("n_empty"), F.count_if(~col("placeholder") & col("lat").isNotNull()).alias("n_geo"),
        F.avg(F.when(~col("placeholder"), col("lat"))).alias("lat"), F.avg(F.when(~col("placeholder"), col("lon"))).alias("lon"),
        F.min(F.when(~col("placeholder") & ~col("scanned"), col("taken"))).alias("first_taken"), F.max(F.when(~col("placeholder") & ~col("scanned"), col("taken"))).alias("last_taken"),
    )
    paid_now = F.try_element_at(col("f"), lit("payments_gross"))["value"].try_cast("double")
    first = documents.groupBy("work", "field").agg(F.min(F.struct("position", "value", "number", "date", "doc_type", "page")).alias("d"))
    first = first.groupBy("work").agg(F.map_from_entries(F.collect_list(F.struct("field", "d"))).alias("d"))
    own = as_map(facts)
    values = documents.filter((col("field") == "contract_value") & ~F.lower(F.coalesce("doc_type", lit(""))).contains("pmc") & ~F.coalesce("snippet", lit("")).rlike("(?i)pmc|consult")).join(own, "work")
    values = values.filter(paid_now.isNull() | (paid_now == 0) | (col("number") >= 0.1 * paid_now))
    best = F.min(F.struct((~F.coalesce("doc_type", lit("")).rlike("(?i)work order|agreement")).alias("other"), (-col("number")).alias("minus"), "position", "number", "doc_type", "page"))
    values = values.groupBy("work").agg(best.alias("cv"))
    x = own.join(per, "work", "left").join(levels, "work", "left").join(kinds, "work", "left").join(shots, "work", "left").join(first, "work", "left").join(values, "work", "left")

    have = lambda k: F.try_element_at(col("f"), lit(k))["value"]
    doc = lambda k: F.try_element_at(col("d"), lit(k))
    page = lambda d: F.array(F.concat(F.coalesce(d["doc_type"], lit("document")), lit(" page "), d["page"].cast("string")))
    ocr = " (read by OCR from the scanned document)"
    cv, now = col("cv.number"), _some(have("contract_value").try_cast("double"))
    agree = F.coalesce(F.abs(now - cv) <= 0.005 * cv, lit(False))
    takes = cv.isNotNull() & (now.isNull() | agree)
    contract = F.when(takes, cv).otherwise(now)
    contract_sure = F.when(takes & agree, "confirmed").when(takes, "inferred").otherwise(F.try_element_at(col("f"), lit("contract_value"))["confidence"])
    gross, final_now, state = have("payments_gross").try_cast("double"), have("final_bill"), F.coalesce(have("status"), lit(""))
    has_final, refs = col("last_final").isNotNull() & final_now.isNull(), col("refs")
    reference = lambda k: F.concat(doc(k)["value"], lit(" dated "), F.coalesce(doc(k)["date"].cast("string"), lit("?")))
    from_doc = lambda field, stage, source, value, label: F.when(doc(source).isNotNull(), _fact(field, stage, value, "inferred", F.concat(lit(f"{label} in the "), F.coalesce(doc(source)["doc_type"], lit("document")), lit(ocr)), page(doc(source))))
    sums = F.array_compact(F.array(*(F.when(col(f"sum_{p}") != 0, F.concat(lit(p.replace("_", " ") + " ₹"), F.format_number(col(f"sum_{p}"), 0))) for p in PENALTIES)))
    photo_note = F.concat(col("n_photos").cast("string"), lit(" site photo(s) attached (before / during / after as labelled)"), F.when(col("n_geo") > 0, F.concat(lit("; "), col("n_geo").cast("string"), lit(" with GPS printed on the image"))).otherwise("; no GPS on any photo checked"), F.coalesce(F.concat(lit("; camera dates "), col("first_taken").cast("string"), lit(" – "), col("last_taken").cast("string")), lit("")))
    count = lambda c: F.coalesce(col(c), lit(0))
    partial_list = F.array_join(F.transform(F.slice("partial", 1, 3), lambda p: F.concat(F.floor(p["release_pct"]).cast("string"), lit("%"))), ", ")
    n_pending = col("n_pending").cast("string")
    rules = [
        F.when(takes, _fact("contract_value", "awarded", cv, F.when(agree, "confirmed").otherwise("inferred"), F.concat(lit("Contract / tender price stated in the "), F.coalesce(col("cv.doc_type"), lit("document")), F.when(agree, "; matches the awarded bid").otherwise(ocr)), F.array(F.concat(F.coalesce(col("cv.doc_type"), lit("document")), lit(" page "), col("cv.page").cast("string"))))),
        from_doc("work_order_ref", "awarded", "work_order_ref", reference("work_order_ref"), "Work order reference"), from_doc("agreement_ref", "awarded", "agreement_ref", reference("agreement_ref"), "Contract agreement reference"), from_doc("loa_ref", "awarded", "loa_ref", reference("loa_ref"), "Letter of acceptance reference"),
        F.when(doc("work_order_ref")["date"].isNotNull() & have("work_order_date").isNull(), _fact("work_order_date", "awarded", doc("work_order_ref")["date"], "inferred", "Date of the work order / notice to proceed" + ocr, page(doc("work_order_ref")))),
        F.when(doc("period").isNotNull() & have("period_days").isNull(), _fact("period_days", "planned", doc("period")["number"].cast("int"), "inferred", F.concat(lit("Time of completion in the "), F.coalesce(doc("period")["doc_type"], lit("document")), lit(ocr)), page(doc("period")))),
        from_doc("commencement_date", "awarded", "commencement_date", doc("commencement_date")["date"], "Date of commencement"), from_doc("completion_due", "awarded", "completion_due", doc("completion_due")["date"], "Stipulated date of completion"),
        F.when(doc("completion_due")["date"].isNotNull(), _fact("expected_completion", "outcome", doc("completion_due")["date"], "inferred", "Stipulated completion date written in the work order" + ocr, page(doc("completion_due")))),
        F.when((contract != 0) & (gross != 0) & have("paid_vs_contract").isNull(), _fact("paid_vs_contract", "money", F.round(gross / contract, 3), "inferred", F.concat(lit("Gross paid ÷ contract value (contract value is "), contract_sure, lit("; it may cover only part of the job)")))),
        F.when(count("n") > 0, _fact("bill_types", "work", F.concat(col("n_run").cast("string"), lit(" running, "), col("n_final").cast("string"), lit(" final paid/registered"), F.when(col("n_pending") > 0, F.concat(lit("; "), n_pending, lit(" unpaid"))).otherwise("")), "confirmed", "Bill types recorded for this job's work bills", refs)),
        F.when(col("kinds").isNotNull(), _fact("work_documents", "work", col("kinds"), "confirmed", "Documents attached to the bills (their presence is recorded; contents are not verified)", refs)),
        from_doc("completed_on_certificate", "outcome", "completed_on", doc("completed_on")["date"], "Completion date stated"),
        F.when(has_final, _fact("final_bill", "outcome", col("last_final.value"), "confirmed", F.concat(lit("Records hold bill type “"), col("last_final.bill_type"), lit("” for work bill "), col("last_final.bill_id")), refs)),
        F.when(has_final, _fact("status", "outcome", lit(FINAL), "inferred", "Inferred from the final bill in the direct records", refs))
        .when(col("unpaid_final").isNotNull() & final_now.isNull(), _fact("status", "outcome", lit("Final bill submitted, not yet paid"), "inferred", F.concat(lit("Records hold a “"), col("unpaid_final.bill_type"), lit("” bill without payment; level: "), F.coalesce(col("unpaid_final.level"), lit("?"))), refs))
        .when((count("n_run") > 0) & (count("n_final") == 0) & state.startswith("Bills paid"), _fact("status", "outcome", lit("Running bill only (no final bill in the records)"), "inferred", "All bills for this job are running (part) bills", refs)),
        F.when(count("n_pending") > 0, _fact("pending_bills", "money", F.concat(n_pending, lit(" bill(s) not paid (₹"), F.format_number(F.coalesce("pending_gross", lit(0)), 0), lit("); at: "), "levels"), "confirmed", "Bills present in the records without a payment; not counted as paid", refs)),
        F.when(F.size("partial") > 0, _fact("partial_release", "money", F.concat(F.size("partial").cast("string"), lit(" bill(s) released partly ("), partial_list, lit(")")), "confirmed", "Release percentage recorded", refs)),
        F.when(F.size(sums) > 0, _fact("penalties_deductions", "money", F.array_join(sums, "; "), "confirmed", "Deduction heads recorded across this job's bills", refs)),
        F.when(F.size("lags") > 0, _fact("bill_to_payment_days", "money", F.try_element_at("lags", (F.floor(F.size("lags") / 2) + 1).cast("int")), "confirmed", F.concat(lit("Median days from bill registration to payment over "), F.size("lags").cast("string"), lit(" bill(s)")), refs)),
        F.when(count("n_remarks") > 0, _fact("approval_notes", "money", F.concat(col("n_remarks").cast("string"), lit(" remark(s); e.g. "), F.coalesce(col("remark.r.date").cast("string"), lit("?")), lit(": “"), F.substring(col("remark.r.remarks"), 1, 160), lit("”")), "confirmed", "Remarks written by officials in the approval chain", refs)),
        F.when(count("n_empty") > 0, _fact("placeholder_photos", "evidence", F.concat(col("n_empty").cast("string"), lit(" photo slot(s) filled with a blank / placeholder file")), "confirmed", "Photo attachments that are named empty or blank or have a few KB")),
        F.when(count("n_photos") > 0, _fact("site_photos", "evidence", photo_note, "confirmed", "Photos attached to the bills (type as labelled by the uploader)")),
        F.when(count("n_geo") > 0, _fact("photo_location", "evidence", F.format_string("%.5f, %.5f", "lat", "lon"), "inferred", F.concat(lit("Average of GPS coordinates printed on "), col("n_geo").cast("string"), lit(" site photo(s)")))),
    ]
    layer = x.select("work", F.explode(F.array_compact(F.array(*rules))).alias("f")).select("work", "f.*")
    return overlaid(facts, layer)


def with_entities(facts: DataFrame, bills: DataFrame, tenders: DataFrame, entities: DataFrame) -> DataFrame:
    """Facts with contractor_identity: the entity paid most, else the one awarded. bills: work, entity, gross. tenders: work, entity, position."""
    paid = bills.filter("entity IS NOT NULL").groupBy("work", "entity").agg(F.sum(F.coalesce(F.col("gross"), F.lit(0)).cast("decimal(18,2)")).alias("paid"))
    main = paid.groupBy("work").agg(F.max_by("entity", F.struct("paid", "entity")).alias("main"))
    awarded = tenders.filter("entity IS NOT NULL").groupBy("work").agg(F.max_by("entity", "position").alias("awarded"))
    x = main.join(awarded, "work", "full").withColumn("entity", F.coalesce("main", "awarded")).join(entities.select("entity", "name", "ids", "aliases", "basis"), "entity")
    same = F.when(F.col("main") == F.col("awarded"), " The awarded bidder resolves to the same contractor as the main payee.").when(F.col("main").isNotNull() & F.col("awarded").isNotNull(), " The awarded bidder resolves to a different entity.").otherwise("")
    ids = F.when(F.size("ids") > 0, F.array_join("ids", ", ")).otherwise("no official identifier in the data")
    note = F.concat(F.lit("Resolved contractor "), "entity", F.lit("; identifiers: "), ids, F.lit("."), same)
    layer = x.select("work", _fact("contractor_identity", "awarded", F.concat("entity", F.lit(" · "), "name"), F.col("basis"), note).alias("f")).select("work", "f.*")
    return overlaid(facts, layer)


def with_extensions(facts: DataFrame, orders: DataFrame) -> DataFrame:
    """Facts with time_extensions and extended_completion. orders: work, start, until (dates), days, fine; the latest date counts."""
    listed = F.concat(F.lit("to "), F.col("until").cast("string"), F.coalesce(F.concat(F.lit(" ("), F.col("days").cast("string"), F.lit(" days)")), F.lit("")))
    x = orders.filter("until IS NOT NULL").groupBy("work").agg(F.count("*").alias("n"), F.max("until").alias("until"), F.array_join(F.slice(F.array_sort(F.collect_set(listed)), 1, 6), "; ").alias("list"))
    rules = F.array(
        _fact("time_extensions", "outcome", F.concat(F.col("n").cast("string"), F.lit(" order(s): "), "list"), "inferred", "Extension-of-time orders read by OCR"),
        _fact("extended_completion", "outcome", F.col("until"), "inferred", "Latest date that an extension-of-time order grants"),
    )
    return overlaid(facts, x.select("work", F.explode(rules).alias("f")).select("work", "f.*"))


def with_quantities(facts: DataFrame, items: DataFrame) -> DataFrame:
    """Facts with quantity_check. items: work, plan_basis, compared_quantity, compared_basis, variance_pct; the median is the upper one."""
    compared = F.col("compared_quantity").isNotNull()
    variances = F.array_sort(F.collect_list(F.when(compared, F.col("variance_pct"))))
    x = items.groupBy("work").agg(F.count("*").alias("n"), F.count_if(compared).alias("k"), F.first("plan_basis").alias("basis"), variances.alias("v"), F.bool_or(compared & (F.col("compared_basis") == "MB measurement total")).alias("mb"))
    median = F.try_element_at("v", (F.floor(F.size("v") / 2) + 1).cast("int"))
    middle = F.when(median.isNotNull(), F.concat(F.lit("; median quantity difference "), F.format_string("%+.0f", median), F.lit("%"))).otherwise("")
    value = F.when(F.col("k") > 0, F.concat(F.col("k").cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit(" planned items compared ("), "basis", F.lit(" vs "), F.when(F.coalesce("mb", F.lit(False)), "MB totals / ").otherwise(""), F.lit("bill abstracts)"), middle))
    value = value.otherwise(F.concat(F.col("n").cast("string"), F.lit(" planned items read ("), "basis", F.lit("); no billed / measured quantity could be read")))
    layer = x.select("work", _fact("quantity_check", "work", value, "inferred", "Planned quantities against billed and measured ones; only rows where quantity × rate = amount are used").alias("f")).select("work", "f.*")
    return overlaid(facts, layer)


def with_imagery(facts: DataFrame, reviews: DataFrame) -> DataFrame:
    """Facts with imagery. reviews: work, verdict, observation, before, after."""
    verdicts = {"visible_change": "Change consistent with the work is visible", "no_visible_change": "No change visible", "inconclusive": "Inconclusive", "not_geocoded": "Location could not be pinned down"}
    text = F.try_element_at(F.create_map(*(F.lit(x) for p in verdicts.items() for x in p)), F.col("verdict"))
    note = F.concat_ws(" ", F.lit("Manual comparison of captures"), F.concat_ws(" → ", F.col("before").cast("string"), F.col("after").cast("string")), "observation")
    return overlaid(facts, reviews.select("work", _fact("imagery", "outcome", text, "inferred", note).alias("f")).select("work", "f.*"))


def lifecycle(facts: DataFrame, bills: DataFrame) -> DataFrame:
    """(work, stages: struct of six booleans, lifecycle: how many hold)."""
    x = as_map(facts).join(bills.groupBy("work").agg(F.count("*").alias("n")), "work", "left")
    k = lambda name: F.coalesce(F.try_element_at("f", F.lit(name))["value"].isNotNull(), F.lit(False))
    no_bills = F.coalesce("n", F.lit(0)) == 0
    seen = F.coalesce(F.try_element_at("f", F.lit("imagery"))["value"].startswith("Change"), F.lit(False))
    stages = {
        "planned": k("estimated_cost") | k("tender_published") | k("sanctioned") | k("planned_amount"),
        "awarded": k("contractor") & (k("contract_value") | k("work_order_date") | k("awarded_date") | k("work_order_ref")),
        "work": k("bill_types") | k("work_documents") | k("final_bill"), "money": k("payments_gross"),
        "outcome": k("final_bill") | k("completion_date") | k("completed_on_certificate") | (no_bills & k("status")), "evidence": k("site_photos") | seen,
    }
    return x.select("work", F.struct(*(v.alias(n) for n, v in stages.items())).alias("stages"), sum((v.cast("int") for v in stages.values()), F.lit(0)).alias("lifecycle"))


def selected(works: DataFrame, least: float = 500_000, recent_from: str = "2022-01-01", most: int | None = None) -> DataFrame:
    """Works worth enough, those with tender and bills first, then recent ones, then the largest; most, if given, cuts that order.

    works: work, payments_gross, contract_value, estimated_cost, has_bills, has_tender and last_payment, first_date, tender_published, awarded_date, last_bill.
    """
    value = F.coalesce(F.greatest("payments_gross", "contract_value", "estimated_cost"), F.lit(0.0))
    latest = F.greatest("last_payment", "first_date", "tender_published", "awarded_date", "last_bill")
    x = works.withColumns({"value": value, "last_activity": latest}).filter(F.col("value") >= least)
    deep = F.col("has_bills") & F.col("has_tender")
    recent = F.coalesce(latest >= F.lit(recent_from).cast("date"), F.lit(False))
    x = x.withColumn("bucket", F.when(deep, "deep").when(recent, "recent").otherwise("older"))
    if most is None:
        return x
    first = F.when(F.col("bucket") == "deep", 0).when(F.col("bucket") == "recent", 1).otherwise(2)
    by_day, by_value = F.when(F.col("bucket") != "older", F.col("last_activity")), F.when(F.col("bucket") == "older", F.col("value"))
    return x.orderBy(first, F.desc_nulls_last(by_day), F.desc_nulls_last(by_value), "work").limit(most)
