"""Issues of cases, whose states depend on one another, and the cases made of them.

Each issue is looked for where documents could dissolve it: a quantity above plan in variation statements, identical quantities in comparative statements
and final bills, a missing measurement book among files of other kinds, a shared document in the contracts of all jobs that carry it. What dissolves it makes
it explained or an artefact of the record; those are kept, with their evidence, but don't live. Then issues are settled against each other: an item
whose row is illegible is set aside if the same job's statement explains others, and of two cases on one contract the one paid less is merged.

Issues are rows (case, type, status, confidence, value_at_issue, documentation_gap, timeline_days, reason, evidence); evidence is an array of (kind, label, url,
page, raw). All is by job or case: joins on it, and groups no larger than a job's items or the cases that share a contract. Jobs without rows in a table, and
NULL quantities, rates or payments have no issue of that kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from worksight.functions import amounts as A
from worksight.functions import text as T
from worksight.operators import cases as C
from worksight.operators import documents as D
from worksight.operators import work_slips as W
from worksight.storage import components

#: Bounds of what is an issue, and why an issue is none.
ABOVE, LEAST_AMOUNT, IDENTICAL, SLACK, LEAST_IDENTICAL, COVERS = 1.25, 1e5, 0.0005, 0.011, 3, 1.25
PLACEHOLDER = "the only file shared with other jobs is a 'Not Applicable' placeholder PDF"
NO_FILES = "IFMS exposes no bill-level attachments (of any type) for this job's bills to public requests, so a missing MB cannot be inferred"
EVIDENCE = "array<struct<kind: string, label: string, url: string, page: int, raw: string>>"


def _none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _evidence(kind: str, label: Column, url: Column | None = None, page: Column | None = None, raw: Column | None = None) -> Column:
    kind = F.lit(kind)
    url, page, raw = _none("string") if url is None else url, _none("int") if page is None else page, _none("string") if raw is None else raw
    return F.struct(kind.cast("string").alias("kind"), label.cast("string").alias("label"), url.cast("string").alias("url"), page.cast("int").alias("page"), F.substring(raw.cast("string"), 1, 240).alias("raw"))


def _issue(rows: DataFrame, type_: str, status: Column, confidence: Column, value: Column, gap: Column, *more: Column, reason: Column | None = None, evidence: Column | None = None) -> DataFrame:
    kept = F.array() if evidence is None else evidence
    reason = _none("string") if reason is None else reason
    return rows.select(
        F.col("job").alias("case"), F.lit(type_).alias("type"), status.alias("status"), confidence.alias("confidence"), value.cast("double").alias("value_at_issue"), gap.cast("int").alias("documentation_gap"),
        _none("int").alias("timeline_days"), reason.cast("string").alias("reason"), kept.cast(EVIDENCE).alias("evidence"), *more,
    )


def _by_key(items: DataFrame) -> DataFrame:
    """Items whose bills are all matched by code or rate."""
    return items.filter((F.coalesce(F.size("bills"), F.lit(0)) > 0) & F.forall("bills", lambda b: b["match"].isin("code", "rate")))


def _same_rate(items: DataFrame, rows: DataFrame) -> DataFrame:
    """items with each row of their job at their rate, whose unit agrees where both are known; rows' columns have a prefix r_."""
    other = rows.select(F.col("job"), *(F.col(c).alias(f"r_{c}") for c in rows.columns if c != "job"))
    rate = F.col("estimated_rate")
    fits = (rate != 0) & (F.col("r_rate") != 0) & (F.abs(F.col("r_rate") - rate) <= A.NEAR_SHARE * rate)
    if "r_unit" in other.columns:
        fits &= A.units_agree(F.col("unit"), F.col("r_unit"))
    return items.join(other, "job").filter(fits)


def quantities_above_plan(items: DataFrame, slips: DataFrame, pages: DataFrame, documents: DataFrame) -> DataFrame:
    """Issues, one an item billed above 125 % of its plan, reconciled with the job's variation statements.

    items: see quantities.Analysis. slips: work_slips.case_evidence's statement_rows. pages: job, file, page, text of statements, for rows whose
    quantities can't be read. documents: case_evidence's. Adds item, plan_qty, billed_qty and executed_qty.
    """
    got, plan = F.col("compared_quantity"), F.col("estimated_quantity")
    x = _by_key(items).filter((got > ABOVE * plan) & (plan != 0) & (F.col("estimated_amount") >= LEAST_AMOUNT))
    found = _same_rate(x, slips.select("job", "rate", "unit", "executed_qty", "confidence", "file", "page", "raw"))
    best = found.groupBy("job", "item").agg(F.max_by(F.struct("r_executed_qty", "r_confidence", "r_file", "r_page", "r_raw"), F.struct("r_executed_qty", "r_file", "r_page")).alias("s"))
    by_amount = W.amount_multiples(x.join(best.select("job", "item"), ["job", "item"], "left_anti").select("job", "item", plan.alias("quantity"), F.col("estimated_rate").alias("rate")), pages)
    best = best.select("job", "item", F.col("s.r_executed_qty").alias("executed"), F.col("s.r_confidence").alias("sure"), F.col("s.r_file").alias("file"), F.col("s.r_page").alias("page"), F.col("s.r_raw").alias("raw"))
    best = best.unionByName(by_amount.select("job", "item", F.col("executed_qty").alias("executed"), F.col("confidence").alias("sure"), "file", "page", "raw"))
    variations = documents.filter("kind = 'variation'").groupBy("job").agg(F.bool_or(F.col("status") == "read").alias("any_read"), F.array_sort(F.collect_list(F.struct("file", "url", "status"))).alias("docs"))
    x = x.join(best, ["job", "item"], "left").join(variations, "job", "left")
    said = D.reconciled(plan, got, F.col("executed"), F.col("sure"))
    status = F.when(said.isin("explained", "partially_explained"), said).when(said == "contradicted", "unexplained_in_public_record").when(F.col("any_read"), "insufficient_evidence").otherwise("unexplained_in_public_record")
    x = x.withColumns({"state": status, "sure_of": F.when(F.col("compared_basis") == "bill form total up to date", "high").otherwise("low")})
    # settled against its siblings: the statement that explains other items is this item's as well
    siblings = F.sum((F.col("state") == "explained").cast("int")).over(Window.partitionBy("job"))
    x = x.withColumn("siblings", siblings).withColumn("aside", (F.col("state") == "insufficient_evidence") & (F.col("siblings") > 0))
    reason = F.when(F.col("aside"), F.format_string("the same approved statement covers %d sibling item(s); this item's row is illegible, so it is set aside rather than presented", F.col("siblings")))
    shown = F.when(F.col("executed").isNotNull(), F.array(_evidence("document", F.concat(F.lit("Work slip / comparative statement "), "file"), F.col("file"), F.col("page"), F.col("raw")))).otherwise(F.array().cast(EVIDENCE))
    listed = F.transform(F.slice(F.coalesce("docs", F.array().cast("array<struct<file: string, url: string, status: string>>")), 1, 3), lambda d: _evidence("document", F.concat(F.lit("Variation document "), d["file"], F.lit(" ("), d["status"], F.lit(")")), d["url"]))
    billed = F.transform(F.slice("bills", 1, 4), lambda b: _evidence("bill_form", F.concat(F.lit("Work bill "), b["bill"])))
    return _issue(
        x, "quantity_above_plan", F.col("state"), F.when(F.col("aside"), "low").otherwise(F.col("sure_of")), F.round((got - plan) * F.col("estimated_rate"), 0), F.when(F.col("docs").isNull(), 5).otherwise(0),
        "item", plan.alias("plan_qty"), got.alias("billed_qty"), F.col("executed").alias("executed_qty"), reason=reason, evidence=F.concat(billed, shown, listed.cast(EVIDENCE)),
    )


def identical_quantities(items: DataFrame, slips: DataFrame, final_rows: DataFrame) -> DataFrame:
    """An issue for each job with three items or more whose executed quantity is the planned one: an artefact if statements record others.

    final_rows: case_evidence's; where no statement has an item's row, a final bill's column up to date, or the planned quantity before and another now, tells.
    """
    got, plan = F.col("compared_quantity"), F.col("estimated_quantity")
    x = _by_key(items).filter((plan != 0) & (F.abs(got - plan) <= IDENTICAL * plan + SLACK))
    x = x.withColumn("n", F.count("*").over(Window.partitionBy("job"))).filter(F.col("n") >= LEAST_IDENTICAL)
    first = lambda rows, value: rows.groupBy("job", "item").agg(F.min_by(F.struct(value, "r_file", "r_page", "r_raw"), F.struct("r_file", "r_page", "r_line")).alias("s")).select("job", "item", F.col("s.executed").alias("executed"), F.col("s.r_file").alias("file"), F.col("s.r_page").alias("page"), F.col("s.r_raw").alias("raw"))
    told = first(_same_rate(x, slips.select("job", "rate", "unit", "executed_qty", "file", "page", "line", "raw")), F.col("r_executed_qty").alias("executed"))
    closing = _same_rate(x.filter("NOT coalesce(from_final_bill, false)").drop("unit"), final_rows.select("job", "rate", "quantity", "to_date_quantity", "file", "page", "line", "raw"))
    before = F.exists(F.transform(T.number_tokens(F.col("r_raw")), A.number), lambda v: F.abs(v - plan) <= SLACK)
    executed = F.when(F.col("r_to_date_quantity") != 0, F.col("r_to_date_quantity")).when(F.coalesce(before, F.lit(False)) & (F.col("r_quantity") != 0) & (F.abs(F.col("r_quantity") - plan) > SLACK), F.round(plan + F.col("r_quantity"), 3))
    closed = first(closing.withColumn("executed", executed).filter("executed IS NOT NULL"), F.col("executed"))
    told = told.unionByName(closed.join(told, ["job", "item"], "left_anti"))
    x = x.join(told, ["job", "item"], "left")
    agrees, final = F.abs(F.col("executed") - plan) <= IDENTICAL * plan + SLACK, F.coalesce("from_final_bill", F.lit(False))
    x = x.withColumns({"agrees": F.coalesce(agrees, F.lit(False)), "differs": F.coalesce(~agrees, F.lit(False)), "final": final, "worth": F.round(plan * F.col("estimated_rate"), 2)})
    per = x.groupBy("job").agg(
        F.count("*").alias("n"), F.count_if("differs").alias("n_differ"), F.coalesce(F.bool_and(F.when(F.col("differs"), F.col("final"))), F.lit(True)).alias("all_final"), F.count_if("agrees").alias("n_agree"),
        F.count_if(~F.col("differs") & (F.col("final") | F.col("agrees"))).alias("sure_without"), F.count_if(F.col("final") | F.col("agrees")).alias("sure_with"), F.sum("worth").alias("worth"), F.sum(F.when(~F.col("differs"), F.col("worth"))).alias("worth_without"),
        F.array_sort(F.collect_list(F.when(F.col("differs"), F.struct("item", plan.alias("plan"), F.col("executed").alias("executed"), "file", "page", "raw")))).alias("other"),
    )
    dropped = (F.col("n_differ") > 0) & ~F.col("all_final")
    left, sure = F.when(dropped, F.col("n") - F.col("n_differ")).otherwise(F.col("n")), F.when(dropped, F.col("sure_without")).otherwise(F.col("sure_with"))
    artefact = dropped & (left < LEAST_IDENTICAL)
    changed = F.array_join(F.transform("other", lambda o: F.concat(T.quantity(o["plan"]), F.lit(" tendered → "), T.quantity(o["executed"]), F.lit(" executed"))), "; ")
    reason = F.when(artefact, F.concat(F.lit("the 'identical' quantities came from a running bill's up-to-date column; the comparative statement records different final executed quantities ("), changed, F.lit("), leaving fewer than three identical items")))
    reason = reason.when(sure < LEAST_IDENTICAL, F.format_string("only %d of the %d identical items are confirmed by a final bill or comparative statement; the rest are running-bill snapshots", sure, left))
    worth = F.when(artefact, 0.0).otherwise(F.round(F.when(dropped, F.col("worth_without")).otherwise(F.col("worth")), 0))
    shown = F.transform("other", lambda o: _evidence("document", F.concat(F.lit("Comparative statement "), o["file"]), o["file"], o["page"], o["raw"]))
    return _issue(per, "quantities_identical_to_plan", F.when(artefact, "artefact").otherwise("insufficient_evidence"), F.when(artefact | (sure >= LEAST_IDENTICAL), "high").otherwise("low"), worth, F.when(artefact, 0).otherwise(3), left.cast("int").alias("n_identical"), sure.cast("int").alias("n_confirmed"), reason=reason, evidence=shown)


def final_bills_without_book(books: DataFrame, paid: DataFrame) -> DataFrame:
    """An issue for each job whose final bills have no measurement book: an artefact where no bill shows files at all, explained by a book filed elsewhere.

    books: dataset_signals.measurement_books. paid: job, payments_gross.
    """
    x = books.filter((F.size("final_bills") > 0) & (F.coalesce("mb_real", F.lit(0)) == 0)).join(paid, "job", "left")
    hidden, elsewhere = ~F.coalesce("bill_level_files", F.lit(False)), F.size(F.coalesce("mb_filed_elsewhere", F.array().cast("array<string>"))) > 0
    status = F.when(hidden, "artefact").when(elsewhere, "explained").otherwise("unexplained_in_public_record")
    shown = F.transform(F.slice("final_bills", 1, 2), lambda b: _evidence("api", F.concat(F.lit("IFMS attachment listing for final bill "), b.cast("string"))))
    return _issue(x, "final_bill_without_mb", status, F.when(hidden, "low").otherwise("high"), F.col("payments_gross"), F.when(hidden | elsewhere, 0).otherwise(10), reason=F.when(hidden, NO_FILES), evidence=shown)


def base_name(url: Column) -> Column:
    """The last part of an address, decoded."""
    last = F.element_at(F.split(F.coalesce(url, F.lit("")), "/"), -1)
    return F.coalesce(F.try_url_decode(F.replace(last, F.lit("+"), F.lit("%2B"))), last)


def reused_documents(shared: DataFrame, contracts: DataFrame, items: DataFrame, paid: DataFrame) -> DataFrame:
    """An issue for each job that shares files with others: an artefact if they are placeholders, explained if a shared contract covers what all of them were paid.

    shared: job, url, other (one row a file and other job). contracts: job, url, value of work orders and agreements. items: job, quantity, rate of schedules.
    paid: job, payments_gross. Adds others and strong: whether schedules are nearly the same as well.
    """
    named = shared.withColumn("name", base_name(F.col("url")))
    named = named.withColumn("empty", W.placeholder_name(F.col("name"))).withColumn("real", F.max((~F.col("empty")).cast("int")).over(Window.partitionBy("job")) == 1)
    used = named.filter(~F.col("real") | ~F.col("empty"))
    pairs = used.select("job", "other").distinct()
    gross = paid.select("job", F.coalesce("payments_gross", F.lit(0.0)).alias("gross"))
    with_paid = pairs.join(gross.select(F.col("job").alias("other"), F.col("gross").alias("other_gross")), "other", "left")
    sums = with_paid.groupBy("job").agg(F.sum(F.coalesce("other_gross", F.lit(0.0))).alias("others_paid"), F.min(F.coalesce("other_gross", F.lit(0.0))).alias("least_paid"), F.array_sort(F.collect_set("other")).alias("others"))
    alike = C.shared_items(items)
    size = items.select("job", F.round("quantity", 2).alias("q"), F.round("rate", 2).alias("r")).distinct().groupBy("job").agg(F.count("*").alias("n"))
    both = alike.select(F.col("a").alias("job"), F.col("b").alias("other"), "shared").unionByName(alike.select(F.col("b").alias("job"), F.col("a").alias("other"), "shared"))
    larger = both.join(size, "job").join(size.select(F.col("job").alias("other"), F.col("n").alias("m")), "other").withColumn("of", F.greatest("n", "m"))
    strong = pairs.join(larger, ["job", "other"]).filter((F.col("shared") >= C.STRONG_ITEMS) & (F.col("shared") >= C.STRONG_SHARE * F.col("of"))).select("job").distinct().withColumn("strong", F.lit(True))
    files = used.groupBy("job").agg(F.bool_or("real").alias("real"), F.array_sort(F.collect_set("url")).alias("urls"))
    price = contracts.withColumn("name", base_name(F.col("url"))).join(used.filter("real").select("job", "name").distinct(), ["job", "name"]).groupBy("job").agg(F.max("value").alias("price"))
    x = files.join(sums, "job", "left").join(strong, "job", "left").join(price, "job", "left").join(gross, "job", "left")
    own = F.coalesce("gross", F.lit(0.0))
    covered = F.coalesce(own + F.col("others_paid") <= COVERS * F.col("price"), F.lit(False))
    strong = F.coalesce("strong", F.lit(False))
    status = F.when(~F.col("real"), "artefact").when(covered, "explained").otherwise("insufficient_evidence")
    value = F.when(F.col("real") & ~covered, F.least(own, F.col("least_paid"))).otherwise(0.0)
    label = F.when(~F.col("real"), "Shared placeholder file").when(covered, "Shared work order / agreement").otherwise("Identical file attached to both jobs (same MD5)")
    reason = F.when(~F.col("real"), PLACEHOLDER).when(covered, "one contract booked under several job codes covers what all of them were paid")
    gap = F.when(~F.col("real") | covered, 0).when(strong, 5).otherwise(2)
    return _issue(x, "document_reuse", status, F.when(F.col("real"), "high").otherwise("low"), value, gap, "others", strong.alias("strong"), reason=reason, evidence=F.transform(F.slice("urls", 1, 4), lambda u: _evidence("document", label, u)))


def assembled(issues: DataFrame) -> DataFrame:
    """A row for each case: primary issue, the score's parts, retained, why not, and the issues that were resolved.

    Issues that live are neither explained nor artefacts nor of low confidence; a case without any is scored by those it has, and set aside.
    """
    live = ~F.col("status").isin(*C.DEAD) & (F.col("confidence") != "low")
    x = issues.withColumn("live", live).withColumn("lives", F.max(F.col("live").cast("int")).over(Window.partitionBy("case")) == 1)
    sources = issues.select("case", F.explode(F.transform("evidence", lambda e: e["kind"])).alias("kind")).groupBy("case").agg(F.countDistinct("kind").cast("int").alias("n_sources"))
    scored = C.scored(x.filter(~F.col("lives") | F.col("live")), sources).withColumnRenamed("retained", "unsettled")
    dead = x.filter(~F.col("live")).groupBy("case").agg(F.array_sort(F.collect_list(F.struct("type", F.when(F.col("status").isin(*C.DEAD), F.col("status")).otherwise("low confidence").alias("outcome"), "reason"))).alias("resolved"))
    lives = x.groupBy("case").agg(F.bool_or("live").alias("lives"))
    out = scored.join(lives, "case").join(dead, "case", "left").withColumn("retained", F.col("lives") & (F.col("confidence") != "low"))
    why = F.when(~F.col("lives"), "every issue was explained, was an artefact, or rests only on low-confidence evidence")
    return out.withColumns({"status": F.when(F.col("lives"), F.col("status")).otherwise("set aside"), "why_not_retained": why}).drop("lives", "unsettled")


def merged(cases: DataFrame, reuse: DataFrame, paid: DataFrame) -> DataFrame:
    """cases with merged_into and related: of retained cases that share nearly the same contract, taken by case, each takes in those that were paid no more.

    reuse: issues of reused_documents. paid: job, payments_gross. A case that was taken in takes none. Groups are cases connected by such sharing.
    """
    gross = cases.filter("retained").select("case").join(paid.select(F.col("job").alias("case"), F.coalesce("payments_gross", F.lit(0.0)).alias("gross")), "case", "left").na.fill(0.0, ["gross"])
    strong = reuse.filter("strong AND status <> 'artefact'").select(F.col("case"), F.explode("others").alias("other"))
    edges = strong.join(gross, "case").join(gross.select(F.col("case").alias("other"), F.col("gross").alias("other_gross")), "other")
    groups = components(edges.select(F.col("case").alias("a"), F.col("other").alias("b")))
    takers = edges.groupBy("case").agg(F.array_sort(F.collect_list(F.when(F.col("other_gross") <= F.col("gross"), F.col("other")))).alias("partners"))
    rows = groups.join(takers, F.col("node") == F.col("case")).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("case", "partners"))).alias("rows"))
    kind = "array<struct<into: string, case: string>>"
    gone = F.aggregate(
        "rows", F.array().cast(kind),
        lambda done, r: F.when(F.exists(done, lambda d: d["case"] == r["case"]), done).otherwise(
            F.concat(done, F.transform(F.filter(r["partners"], lambda p: ~F.exists(done, lambda d: d["case"] == p) & (p != r["case"])), lambda p: F.struct(r["case"].cast("string").alias("into"), p.cast("string").alias("case"))))
        ).cast(kind),
    )
    taken = rows.select(F.explode(gone).alias("g")).select(F.col("g.case").alias("case"), F.col("g.into").alias("merged_into"))
    related = taken.groupBy(F.col("merged_into").alias("case")).agg(F.array_sort(F.collect_set(F.col("case"))).alias("related"))
    out = cases.join(taken, "case", "left").join(related, "case", "left")
    merged_why = F.concat(F.lit("merged into "), F.col("merged_into"), F.lit(" (same contract documents)"))
    return out.withColumns({"retained": F.col("retained") & F.col("merged_into").isNull(), "why_not_retained": F.coalesce(merged_why, "why_not_retained")})
