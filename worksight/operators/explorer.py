"""The explorer's queries over the published tables: filters, orders, facets, pages and what a work's page shows.

projects: id, slug, title, search_text, category, status, department, link_confidence, lifecycle, last_activity, first_date,
tender_published, payments_gross, contract_value, estimated_cost, n_bills, tender_numbers, signal_level, n_signals, stages, ...
Equal ranks go by id, so every order is total. Unknown sorts count as recent, unknown flags and unreadable depths as absent.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from worksight.functions.text import rupees

PAGE_SIZE, TOP_CONTRACTORS = 50, 30
FLAGS = ("has_contract", "has_bills", "has_completion", "has_photos", "has_quantities", "has_signals", "has_case")
STAGES = ("planned", "awarded", "work", "money", "outcome", "evidence")
SEVERITIES = ("attention", "notice", "info")
#: Shapes of a work's and a case's address.
SLUG, CASE_ID = r"^[a-z0-9-]{1,120}$", r"^[A-Za-z0-9-]{1,40}$"


def _zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def severity_rank(c: Column) -> Column:
    """0 for attention, 1 for notice, 2 for all else."""
    return F.when(c == "attention", 0).when(c == "notice", 1).otherwise(2)


def sort_keys(name: str) -> list[Column]:
    level = F.when(F.col("signal_level") == "attention", 3).when(F.col("signal_level") == "notice", 2).when(F.col("signal_level") == "info", 1).otherwise(0)
    keys = {
        "recent": [F.desc_nulls_last("last_activity")],
        "value": [F.greatest(_zero("payments_gross"), _zero("contract_value"), _zero("estimated_cost")).desc()],
        "paid": [_zero("payments_gross").desc()],
        "depth": [F.desc_nulls_last("lifecycle"), F.desc_nulls_last("last_activity")],
        "signals": [level.desc(), F.desc_nulls_last("n_signals")],
        "oldest": [F.coalesce("first_date", "tender_published").asc_nulls_first()],
    }
    return [*keys.get(name, keys["recent"]), F.asc("id")]


def search(
    projects: DataFrame, signals: DataFrame | None = None, flags_table: DataFrame | None = None, q: str = "", category: str = "", status: str = "",
    dept: str = "", link: str = "", signal: str = "", depth: str = "", flags: Iterable[str] = (),
) -> DataFrame:
    """Projects that hold every word of q, equal every facet given, have the signal, the depth and all flags."""
    out = projects
    for word in q.lower().split():
        out = out.filter(F.col("search_text").contains(word))
    for column, value in (("category", category), ("status", status), ("department", dept), ("link_confidence", link)):
        if value:
            out = out.filter(F.col(column) == value)
    if signal:
        out = out.join(signals.filter(F.col("code") == signal).select(F.col("project_id").alias("id")), "id", "left_semi")
    try:
        if depth:
            out = out.filter(F.col("lifecycle") >= int(depth))
    except ValueError:
        pass
    for flag in flags:
        if flag in FLAGS:
            out = out.join(flags_table.filter(F.col(flag).cast("int") == 1).select(F.col("project_id").alias("id")), "id", "left_semi")
    return out


def page(rows: DataFrame, sort: str = "recent", number: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    """One page in the order asked for; a limit on sorted rows, so only size * number rows of each task are kept."""
    return rows.orderBy(*sort_keys(sort)).offset((max(1, number) - 1) * size).limit(size)


def facets(projects: DataFrame, signals: DataFrame) -> DataFrame:
    """(facet, value, n): counts of works by category, status, department and link, and of works with each signal; one pass over works."""
    columns = {"category": "category", "status": "status", "dept": "department", "link": "link_confidence"}
    each = projects.select(F.explode(F.array(*(F.struct(F.lit(k).alias("facet"), F.col(c).alias("value")) for k, c in columns.items()))).alias("x"))
    counted = each.groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))
    codes = signals.groupBy(F.lit("signal").alias("facet"), F.col("code").alias("value")).agg(F.countDistinct("project_id").alias("n"))
    return counted.unionByName(codes)


def summary(rows: DataFrame) -> DataFrame:
    money = lambda c: F.coalesce(F.sum(F.col(c).cast("decimal(18,2)")).cast("double"), F.lit(0.0))
    some = lambda c: F.coalesce(F.col(c) != 0, F.lit(False))
    linked = some("n_bills") & F.coalesce(F.col("tender_numbers") != "", F.lit(False))
    return rows.agg(
        F.count("*").alias("n"), money("payments_gross").alias("paid"), money("contract_value").alias("contract"), F.count_if(some("payments_gross")).alias("n_paid"),
        F.count_if(some("contract_value")).alias("n_contract"), F.count_if(F.col("lifecycle") == len(STAGES)).alias("n_full"), F.count_if(linked).alias("n_linked"),
        F.count_if(F.col("signal_level").isin("notice", "attention")).alias("n_flagged"),
    )


def project_flags(projects: DataFrame, facts: DataFrame, work_items: DataFrame, signals: DataFrame, cases: DataFrame) -> DataFrame:
    """Which kinds of evidence each work has: project_id and seven booleans. Each table is reduced to one row a work before its join."""
    known = lambda *fields: F.col("field").isin(*fields) & F.col("value").isNotNull()
    per = facts.groupBy("project_id").agg(
        F.bool_or(known("contract_value")).alias("has_contract"), F.bool_or(known("final_bill", "completed_on_certificate", "completion_date")).alias("has_completion"),
        F.bool_or(known("site_photos") & ~F.col("value").startswith("0 ")).alias("has_photos"),
    )
    have = lambda df, when, name: df.filter(when).select("project_id", F.lit(True).alias(name)).distinct()
    out = projects.select(F.col("id").alias("project_id"), (_zero("n_bills") > 0).alias("has_bills")).join(per, "project_id", "left")
    out = out.join(have(work_items, F.lit(True), "has_quantities"), "project_id", "left").join(have(signals, F.col("severity").isin("notice", "attention"), "has_signals"), "project_id", "left")
    out = out.join(have(cases, F.col("retained").cast("int") == 1, "has_case"), "project_id", "left")
    return out.select("project_id", *(F.coalesce(F.col(c), F.lit(False)).alias(c) for c in FLAGS))


def records_with_sources(records: DataFrame, sources: DataFrame) -> DataFrame:
    """Records of all works with their source's name; a page sorts its own by record_type, descending, and the first date known."""
    return records.join(sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name")), "source_id", "left")


def record_order() -> list[Column]:
    return [F.desc("record_type"), F.coalesce("br_date", "payment_date", "wo_date", "start_date").asc_nulls_first()]


def signals_with_projects(signals: DataFrame, projects: DataFrame, hidden: tuple[str, ...] = ("contractor_concentration",)) -> DataFrame:
    p = projects.select(F.col("id").alias("project_id"), "slug", F.col("title").alias("project_title"), "payments_gross", "contract_value")
    return signals.filter(~F.col("code").isin(*hidden)).join(p, "project_id").withColumn("rank", severity_rank(F.col("severity")))


def project_page(slug: str, projects: DataFrame, facts: DataFrame, records: DataFrame, sources: DataFrame, links: DataFrame, signals: DataFrame) -> dict[str, DataFrame]:
    """The five frames of a work's page; empty ones for an address that is none."""
    own = projects.filter((F.col("slug") == slug) & F.lit(slug).rlike(SLUG))
    of = lambda df: df.join(own.select(F.col("id").alias("project_id")), "project_id", "left_semi")
    return {
        "project": own.drop("search_text"), "facts": of(facts), "records": records_with_sources(of(records), sources).orderBy(*record_order()),
        "links": of(links).orderBy("status", F.desc("score")), "signals": of(signals).orderBy(severity_rank(F.col("severity"))),
    }


def timeline(facts: DataFrame, records: DataFrame) -> DataFrame:
    """(project_id, date, label, kind, confidence, url, place): events of all works; a page sorts by date and place.

    records: record_type, link, tender_number, contractor, gross, ecv, awarded_date, bid_url, source_url, bill_type and dates.
    """
    sure = F.when(F.col("link") == "exact", "confirmed").otherwise("inferred")
    event = lambda date, label, kind, conf, url, place: F.struct(date.cast("string").alias("date"), label.alias("label"), kind.alias("kind"), conf.alias("confidence"), url.alias("url"), F.lit(place).alias("place"))
    lit = F.lit
    suffix = lambda text, c: F.coalesce(F.concat(lit(text), rupees(F.nullif(c, lit(0.0)))), lit(""))
    is_tender, is_bill = F.col("record_type") == "tender", F.col("record_type") == "bill"
    published = event(F.col("start_date"), F.concat(lit("Tender "), "tender_number", lit(" published"), suffix(" — estimate ", F.col("ecv"))), lit("tender"), sure, F.col("source_url"), 0)
    awarded = event(F.col("awarded_date"), F.concat(lit("Awarded to "), F.coalesce(F.nullif("contractor", lit("")), lit("unknown")), suffix(" for ", F.col("gross"))), lit("award"), sure, F.coalesce("bid_url", "source_url"), 1)
    state = F.when(F.col("payment_date").isNotNull(), " paid").when(F.col("br_date").isNotNull(), " registered").otherwise(" (register entry)")
    name = F.coalesce(F.concat(F.nullif("bill_type", lit("")), lit(" bill")), lit("Bill"))
    final = F.coalesce(F.lower("bill_type").contains("final"), lit(False))
    billed = event(F.coalesce("payment_date", "br_date", "wo_date"), F.concat(name, lit(" "), F.coalesce(rupees(F.col("gross")), lit("")), state), F.when(final, "final").otherwise("bill"), lit("confirmed"), F.col("source_url"), 4)
    of_records = records.select("project_id", F.explode(F.array_compact(F.array(F.when(is_tender, published), F.when(is_tender, awarded), F.when(is_bill, billed)))).alias("e")).select("project_id", "e.*")
    kinds = {
        "work_order_date": ("Work order issued", "milestone", "confirmed", 2), "expected_completion": ("Expected completion (award/work order + time allowed)", "expected", "inferred", 3),
        "completion_date": ("Work end date on final bill", "milestone", "confirmed", 5),
    }
    choose = lambda k: F.coalesce(*(F.when(F.col("field") == f, lit(v[k])) for f, v in kinds.items()))
    of_facts = facts.filter(F.col("field").isin(*kinds)).select("project_id", F.substring("value", 1, 10).alias("date"), choose(0).alias("label"), choose(1).alias("kind"), choose(2).alias("confidence"), lit(None).cast("string").alias("url"), choose(3).alias("place"))
    return of_records.unionByName(of_facts).filter("date IS NOT NULL").withColumn("date", F.substring("date", 1, 10))


def cumulative_points(records: DataFrame) -> DataFrame:
    """(project_id, date, x, y, paid): the payments' curve of each work with two bills or more, scaled to 100 by 40."""
    date = F.to_date(F.coalesce("payment_date", "br_date", "wo_date"))
    bills = records.filter("record_type = 'bill'").select("project_id", date.alias("date"), F.coalesce(F.col("gross"), F.lit(0)).cast("decimal(18,2)").alias("gross")).filter("date IS NOT NULL")
    own = Window.partitionBy("project_id")
    order = own.orderBy("date", "gross").rowsBetween(Window.unboundedPreceding, 0)
    x = bills.withColumns({"n": F.count("*").over(own), "first": F.min("date").over(own), "last": F.max("date").over(own), "total": F.sum("gross").over(own), "paid": F.sum("gross").over(order)})
    span, total = F.greatest(F.lit(1), F.datediff("last", "first")), F.when(F.col("total") == 0, 1).otherwise(F.col("total")).cast("double")
    across, up = F.round(100 * F.datediff("date", "first") / span, 1), F.round(40 - 38 * F.col("paid").cast("double") / total, 1)
    return x.filter("n >= 2").select("project_id", "date", across.alias("x"), up.alias("y"), F.col("paid").cast("double").alias("paid"))


def headline(projects: DataFrame, records: DataFrame, cases: DataFrame, sources: DataFrame) -> DataFrame:
    """One row of the home page's figures; five aggregates of one row each, joined."""
    p = projects.agg(F.count("*").alias("projects"), F.count_if(_zero("n_bills") > 0).alias("with_bills"), F.sum(F.col("payments_gross").cast("decimal(18,2)")).cast("double").alias("paid_total"))
    r = records.filter("record_type = 'bill' AND payment_date IS NOT NULL").agg(F.count("*").alias("paid_bills"), F.min("payment_date").alias("first"), F.max("payment_date").alias("last"))
    c = cases.agg(F.count_if(F.col("retained").cast("int") == 1).alias("cases"), F.count("*").alias("reviewed"))
    return p.crossJoin(r).crossJoin(c).crossJoin(sources.agg(F.count("*").alias("sources")))


def payees(records: DataFrame, contractors: DataFrame) -> DataFrame:
    """(name, paid, bills, works) of each resolved payee."""
    bills = records.filter("record_type = 'bill' AND payment_date IS NOT NULL AND contractor <> ''")
    named = bills.join(contractors.select(F.col("entity").alias("contractor_entity"), F.col("name").alias("known")), "contractor_entity", "left")
    per = named.groupBy(F.coalesce("contractor_entity", "contractor").alias("key")).agg(
        F.min(F.coalesce("known", "contractor")).alias("name"), F.sum(F.col("gross").cast("decimal(18,2)")).cast("double").alias("paid"), F.count("*").alias("bills"), F.countDistinct("project_id").alias("works"),
    )
    return per.drop("key")


def stage_counts(projects: DataFrame) -> DataFrame:
    """(stage, n): works whose JSON of stages has each set."""
    stages = F.from_json("stages", ", ".join(f"{s} boolean" for s in STAGES))
    sums = projects.select(stages.alias("s")).agg(*(F.count_if(F.coalesce(F.col(f"s.{s}"), F.lit(False))).alias(s) for s in STAGES))
    return sums.unpivot([], list(STAGES), "stage", "n")


def story(projects: DataFrame, records: DataFrame, contractors: DataFrame) -> dict[str, DataFrame]:
    """What the home page shows: years, kinds of work, the ten largest payees, the eight largest works, the funnel."""
    money = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double")
    bills = records.filter("record_type = 'bill' AND payment_date IS NOT NULL")
    paid = projects.filter("payments_gross > 0")
    return {
        "years": bills.groupBy(F.substring(F.col("payment_date").cast("string"), 1, 4).alias("year")).agg(money("gross").alias("paid"), F.count("*").alias("bills")),
        "categories": paid.groupBy("category").agg(money("payments_gross").alias("paid"), F.count("*").alias("works")),
        "payees": payees(records, contractors).orderBy(F.desc("paid"), "name").limit(10),
        "biggest": paid.orderBy(F.desc("payments_gross"), "id").limit(8).select("slug", F.substring("title", 1, 80).alias("title"), "payments_gross", "category"),
        "funnel": stage_counts(projects),
    }


def bar_lengths(rows: DataFrame, value: str) -> DataFrame:
    """rows with percent of the largest value, as bars are drawn."""
    return rows.withColumn("percent", F.round(100 * F.try_divide(F.col(value), F.max(value).over(Window.partitionBy())), 1))


def case_list(cases: DataFrame, projects: DataFrame, retained_only: bool = True) -> DataFrame:
    """Cases with the address of their work, in the order of the page."""
    out = cases.join(projects.select(F.col("id").alias("project_id"), "slug"), "project_id", "left")
    keys = ["rank"] if retained_only else [F.desc("retained"), F.asc_nulls_first("rank"), F.desc_nulls_last("case_score")]
    return (out.filter(F.col("retained").cast("int") == 1) if retained_only else out).orderBy(*keys, "case_id")


def case_payees(records: DataFrame) -> DataFrame:
    """(project_id, contractor, first, last, n, gross) of paid bills."""
    day = F.coalesce("payment_date", "br_date")
    return records.filter("record_type = 'bill'").groupBy("project_id", "contractor").agg(F.min(day).alias("first"), F.max(day).alias("last"), F.count("*").alias("n"), F.sum(F.col("gross").cast("decimal(18,2)")).cast("double").alias("gross"))


def case_upsert(cases: DataFrame, new: DataFrame, projects: DataFrame) -> DataFrame:
    """cases with the rows of new in place of those of their ids, all pointed at the works that hold their job numbers now."""
    jobs = projects.select(F.col("id").alias("project_id"), F.explode(F.split("job_numbers", ",")).alias("job_number")).groupBy("job_number").agg(F.max("project_id").alias("project_id"))
    kept = cases.join(new.select("case_id"), "case_id", "left_anti").unionByName(new, allowMissingColumns=True)
    return kept.drop("project_id").join(jobs, "job_number", "left")


def top_contractors(contractors: DataFrame, n: int = TOP_CONTRACTORS) -> DataFrame:
    return contractors.filter("projects > 0 OR bids > 0").orderBy(F.desc("amount"), F.desc("bids"), "entity").limit(n)


def contractor_bids(records: DataFrame, projects: DataFrame, entity: str) -> DataFrame:
    """Tenders on which a contractor bid: tender, slug, title, rank, amount, n, others. records: bidders (array of entity, name, rank, amount)."""
    t = records.filter("record_type = 'tender'").join(projects.select(F.col("id").alias("project_id"), "slug", "title"), "project_id")
    others = F.transform(F.filter("bidders", lambda b: ~b["entity"].eqNullSafe(F.lit(entity))), lambda b: b["name"])
    own = t.select("tender_number", "slug", "title", F.size("bidders").alias("n"), others.alias("others"), F.explode("bidders").alias("b")).filter(F.col("b.entity") == entity)
    return own.select(F.col("tender_number").alias("tender"), "slug", "title", "b.rank", "b.amount", "n", "others")


def source_usage(sources: DataFrame, records: DataFrame) -> DataFrame:
    used = records.groupBy(F.col("source_id").alias("id")).agg(F.countDistinct("project_id").alias("n_projects"), F.count("*").alias("n_records"))
    return sources.join(used, "id", "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_projects", "n_records")})


def snapshot_changes(old: Mapping[str, DataFrame], new: Mapping[str, DataFrame]) -> DataFrame:
    """(kind, key, before, after): what changed between two versions of projects, records, signals, facts and cases.

    Kinds: project_added, project_dropped, status, bill_new, bill_paid, final_bill, signal_new, signal_gone, case.
    """
    none = F.lit(None).cast("string")
    row = lambda kind, key, before=none, after=none: (F.lit(kind).alias("kind"), key.alias("key"), before.cast("string").alias("before"), after.cast("string").alias("after"))

    def bills(tables):
        b = tables["records"].filter("record_type = 'bill'")
        parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("job_number", "br_no", "br_date")]
        return b.groupBy(F.concat_ws("|", *parts, F.bround(F.coalesce("gross", F.lit(0.0)), 0).cast("bigint").cast("string")).alias("key")).agg(F.max("payment_date").alias("paid"))

    def slugged(tables, name):
        return tables[name].join(tables["projects"].select(F.col("id").alias("project_id"), "slug"), "project_id")

    both = lambda a, b, key: a.alias("o").join(b.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    p = both(old["projects"], new["projects"], "slug")
    status = lambda s: F.coalesce(F.col(f"{s}.status"), F.lit(""))
    b = both(bills(old), bills(new), "key")
    final = lambda t: slugged(t, "facts").filter("field = 'final_bill' AND value IS NOT NULL").select("slug").distinct()
    codes = lambda t: slugged(t, "signals").select("slug", "code").distinct()
    c = both(old["cases"], new["cases"], "case_id")
    open_ = lambda s: F.when(F.col(f"{s}.retained").cast("int") == 1, "open").otherwise("set aside")
    state = lambda s: F.concat(open_(s), F.lit(": "), F.coalesce(F.col(f"{s}.status"), F.lit("")))
    case_state = lambda s: F.when(F.col(f"{s}.case_id").isNotNull(), state(s))
    pair = F.concat_ws(" ", "slug", "code")
    frames = [
        p.filter("o.slug IS NULL").select(*row("project_added", F.col("n.slug"))),
        p.filter("n.slug IS NULL").select(*row("project_dropped", F.col("o.slug"))),
        p.filter("o.slug IS NOT NULL AND n.slug IS NOT NULL").filter(status("o") != status("n")).select(*row("status", F.col("n.slug"), F.col("o.status"), F.col("n.status"))),
        b.filter("o.key IS NULL").select(*row("bill_new", F.col("n.key"))),
        b.filter("o.key IS NOT NULL AND n.paid IS NOT NULL AND o.paid IS NULL").select(*row("bill_paid", F.col("n.key"), none, F.col("n.paid"))),
        final(new).join(final(old), "slug", "left_anti").select(*row("final_bill", F.col("slug"))),
        codes(new).join(codes(old), ["slug", "code"], "left_anti").select(*row("signal_new", pair)),
        codes(old).join(codes(new), ["slug", "code"], "left_anti").select(*row("signal_gone", pair)),
        c.filter(~case_state("o").eqNullSafe(case_state("n"))).select(*row("case", F.coalesce("n.case_id", "o.case_id"), case_state("o"), case_state("n"))),
    ]
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more)
    return out
