"""The build: one graph from the cached registers, notices, lists and plans to the published tables.

Bills are read by kind, scoped and de-duplicated; those of a job are a work; tenders and plans are linked to works, and portal tenders without one become
works of their own; facts are told of every work, works are selected by value, contractors are resolved, signals are set off; then all tables are
published together. Stages that several later ones read are written once, and each counts its rows while it is written. All is by job, tender or
name; only counters, one row a stage, come to the driver.

The version in force changes in one step after every table was written, scrubbed and searched for contact data, so a build that fails at any point
leaves the former one, and a build of the same cache gives the same rows. Sources without rows, a cache without tenders or plans, and works without
bills or facts are all allowed; registers of a kind without a parser are an error.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from worksight.functions import parsing as P
from worksight.operators import dataset_signals as DS
from worksight.operators import entities as E
from worksight.operators import explorer as X
from worksight.operators import facts as K
from worksight.operators import matching as M
from worksight.operators import scope as S
from worksight.operators.publication import publish
from worksight.operators.signals import project_signals
from worksight.sources import plans as L
from worksight.sources import registers as G
from worksight.sources import tenders as N
from worksight.storage import stored

PUBLISHER, DEPARTMENT = "BBMP (via OpenCity Data Portal mirror)", "Bruhat Bengaluru Mahanagara Palike"
SOURCE = "file string, kind string, name string, page string, url string, regime string"
#: What plans are called as sources of links, by kind of document.
PLAN_SOURCE = {"pow": "plan-programme", "grant": "plan-grant", "notice": "plan-notice", "hort": "plan-park"}


@dataclass
class Cache:
    """Where the collected files are. manifest: a JSON list of (file, kind, name, page, url, regime); files lie beside it."""

    manifest: str
    area: S.Area
    notices: str | None = None
    lists: tuple[str, list[str]] | None = None
    plan_files: DataFrame | None = None
    plan_texts: DataFrame | None = None
    place: L.Place | None = None
    portals: dict[str, str] = field(default_factory=dict)


class Stages:
    """Stages of a build: tables written once, with their counts."""

    def __init__(self):
        self.seen: dict[str, Observation] = {}

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        self.seen[name] = Observation(name)
        return stored(df.observe(self.seen[name], F.count(F.lit(1)).alias("n")), name)

    def counts(self) -> dict[str, int]:
        return {name: o.get["n"] for name, o in self.seen.items()}


def sources(spark: SparkSession, manifest: str, portals: dict[str, str] | None = None) -> DataFrame:
    """The manifest's files with id (S01 and on, in its order), publisher and the portal that their kind comes from."""
    rows = spark.read.text(manifest, wholetext=True).select(F.posexplode(F.from_json("value", f"array<struct<{SOURCE.replace(' string', ': string')}>>")).alias("at", "x"))
    known = F.create_map(*(F.lit(v) for pair in (portals or {"": ""}).items() for v in pair))
    return rows.select(F.format_string("S%02d", F.col("at") + 1).alias("id"), "x.*", F.lit(PUBLISHER).alias("publisher"), F.try_element_at(known, F.col("x.kind")).alias("original_portal"))


def scoped_bills(spark: SparkSession, cache: Cache, listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bills in scope with source, regime and category; and estimates by job."""
    folder = cache.manifest.rpartition("/")[0]
    by_kind: dict[str, list[str]] = {}
    for r in listed.select("kind", "file").collect():  # one row a file
        by_kind.setdefault(r["kind"], []).append(f"{folder}/{r['file']}")
    bills, estimates = G.load_registers(spark, by_kind)
    for name, kind in {"ifms_id": "string", "br_no": "string", "bill_type": "string", "contractor_code": "string", "office": "string", "wo_no": "string", "ward": "string", "description": "string", "contractor": "string", **dict.fromkeys(("gross", "nett", "deduction"), "decimal(18,2)"), **dict.fromkeys(("br_date", "wo_date", "payment_date", "start_date", "end_date"), "date")}.items():
        if name not in bills.columns:
            bills = bills.withColumn(name, F.lit(None).cast(kind))
    name = F.element_at(F.split(F.try_url_decode("source_file"), "/"), -1)
    own = listed.select(F.col("id").alias("source_id"), F.col("url").alias("source_url"), "regime", F.element_at(F.split("file", "/"), -1).alias("name"))
    bills = bills.withColumn("name", name).join(own, "name").drop("name")
    reason = S.scope_reason(cache.area, F.col("description"), F.col("regime"), F.col("ward"), F.col("job_number"))
    bills = bills.withColumns({"scope_reason": reason, "category": S.classify(F.col("description"))}).filter("scope_reason IS NOT NULL")
    return bills, estimates.withColumn("ref", F.lit("job codes"))


def deduplicated(bills: DataFrame) -> DataFrame:
    """bills, each once, with dedupe_key: what tells it from others (IFMS, BR or ROW).

    The same bill stands in several exports. Bills with a number come first, then by kind, source and row; a row stays if it is the first of every key that it
    has, and rows that go still claim theirs. A row without id and number goes as well if a numbered bill of its job has its amount.
    """
    rank = F.struct(F.col("br_no").isNull().alias("a"), (F.col("kind") != "public_view").alias("b"), "source_id", "source_row")
    numbered = F.col("br_no").isNotNull() & F.col("br_date").isNotNull()
    text = lambda *c: F.to_json(F.array(*(F.coalesce(F.col(x).cast("string"), F.lit("-")) for x in c)))
    alone = F.when(F.col("gross").isNull(), text("source_id", "source_row")).otherwise("")
    keys = F.array_compact(F.array(
        F.when(F.col("ifms_id").isNotNull(), F.concat(F.lit("IFMS"), "ifms_id")), F.when(numbered, F.concat(F.lit("BR"), text("job_number"), F.ltrim("br_no", F.lit("0")), F.lit("/"), F.col("br_date").cast("string"))),
        F.when(F.col("ifms_id").isNull() & ~numbered, F.concat(F.lit("ROW"), text("job_number", "gross", "deduction", "nett"), alone)),
    ))
    x = bills.withColumns({"__rank": rank, "__keys": keys, "__numbered": numbered})
    amounts = x.filter("__numbered").groupBy("job_number", "gross").agg(F.min("__rank").alias("__first"))
    amounts = amounts.select(F.col("job_number").alias("__job"), F.col("gross").alias("__gross"), "__first")
    x = x.join(amounts, (F.col("job_number") == F.col("__job")) & F.col("gross").eqNullSafe(F.col("__gross")), "left")
    x = x.filter(F.col("__numbered") | F.col("ifms_id").isNotNull() | F.col("__first").isNull() | (F.col("__rank") < F.col("__first"))).drop("__job", "__gross", "__first")
    each = x.select("__rank", F.explode("__keys").alias("key"))
    claimed = each.join(each.groupBy("key").agg(F.min("__rank").alias("first")), "key").groupBy("__rank").agg(F.bool_and(F.col("__rank") == F.col("first")).alias("__stays")).filter("__stays")
    kept = x.join(claimed.select("__rank"), "__rank", "left_semi")
    return kept.withColumn("dedupe_key", F.regexp_extract(F.get("__keys", F.lit(0)), "^(IFMS|BR|ROW)", 1)).drop("__rank", "__keys", "__numbered")


def _modal(rows: DataFrame, value: str, order: str) -> DataFrame:
    """(job_number, value): a job's most frequent value, of equals the first seen."""
    counted = rows.filter(F.col(value).isNotNull()).groupBy("job_number", value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counted.groupBy("job_number").agg(F.min_by(value, F.struct((-F.col("n")).alias("n"), "first")).alias(value))


def works_of(bills: DataFrame, area: S.Area) -> DataFrame:
    """A row for each job that is a public work: title, descriptions, places, wards, office and category."""
    b = bills.withColumn("__order", F.struct(F.coalesce("br_date", "wo_date", "payment_date"), "source_row", "source_id"))
    titles = b.filter(F.col("description").isNotNull()).groupBy("job_number", "description").agg(F.count("*").alias("n"), F.min("__order").alias("first"))
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "first", (-F.length("description")).alias("size"), "description"))), 1, 3)
    titles = titles.groupBy("job_number").agg(top.alias("top"), F.array_sort(F.collect_list("description")).alias("descriptions"))
    best = F.array_min(F.transform("top", lambda t: F.struct(t["n"], t["size"], t["first"], t["description"].alias("title"))))["title"]
    titles = titles.select("job_number", best.alias("title"), "descriptions")
    ward = F.ltrim("ward", F.lit("0"))
    shown = F.when(F.col("regime").isin("198", "225", "243") & ward.rlike(r"^\d+$") & (ward.try_cast("int") <= 243), F.concat(ward, F.lit(" ("), "regime", F.lit("-ward map)")))
    dates = F.least("wo_date", "start_date", "br_date", "payment_date")
    per = b.groupBy("job_number").agg(F.array_sort(F.collect_set(shown)).alias("wards"), F.min(dates).alias("first_date"), F.min_by("scope_reason", "__order").alias("scope_reason"), F.max("br_date").alias("last_bill"))
    x = per.join(titles, "job_number", "left").join(_modal(b, "office", "__order"), "job_number", "left").join(_modal(b, "category", "__order").withColumnRenamed("category", "most"), "job_number", "left")
    x = x.withColumn("title", F.coalesce("title", "job_number")).withColumn("category", F.when(S.classify(F.col("title")).isNotNull(), F.col("most"))).filter("category IS NOT NULL")
    none = F.array().cast("array<string>")
    descriptions = F.coalesce("descriptions", none)
    return x.select(
        F.concat(F.lit("job:"), "job_number").alias("work"), "job_number", "title", descriptions.alias("descriptions"), F.coalesce(S.locations(area, F.array_join(descriptions, " ")), none).alias("locations"), "wards", "office", "category",
        F.array("job_number").alias("job_numbers"), "first_date", "last_bill", "scope_reason", F.lit(DEPARTMENT).alias("department"),
    )


CALL = "source string, base string, tender_number string, call int, description string, dept string, office string, category string, scope_reason string, published_date date, status string, status_text string, ecv double, provisional_amount double, period_days int, period_text string, contractor string, supplier_id string, contract_value double, negotiated_value double, awarded_date date, bidders array<struct<name string>>, url string"


def _calls(rows: DataFrame) -> DataFrame:
    """Tenders or plans of any source as rows of CALL."""
    fields = [c.split(" ", 1) for c in CALL.split(", ")]
    return rows.select(*(F.col(n).cast(k).alias(n) if n in rows.columns else F.lit(None).cast(k).alias(n) for n, k in fields))


def calls_of(spark: SparkSession, cache: Cache) -> tuple[DataFrame, DataFrame]:
    """Calls of tenders and plans whose group is a public work; and sanctioned works by job."""
    parts, sanctions = [], spark.createDataFrame([], "job_number string, ecv double, fy string, office string, ref string")
    if cache.notices:
        parts.append(_calls(N.load_notices(N.read_notices(spark, cache.notices), cache.area)))
    if cache.lists:
        parts.append(_calls(N.load_lists(*N.read_lists(spark, *cache.lists), cache.area).withColumn("source", F.lit("tender-list"))))
    if cache.plan_files is not None:
        plans = stored(L.plan_rows(cache.plan_files, cache.plan_texts, cache.place or L.Place(cache.area)), "plans")
        named = F.coalesce(*(F.when(F.col("kind") == k, v) for k, v in PLAN_SOURCE.items()))
        parts.append(_calls(plans.filter("kind <> 'sanction'").withColumns({"source": named, "call": F.lit(1), "published_date": F.col("published_date")})))
        sanctions = plans.filter("kind = 'sanction'").select("job_number", "ecv", "fy", "office", F.concat(F.lit("ward works list "), "base").alias("ref"))
    calls = spark.createDataFrame([], CALL)
    for part in parts:
        calls = calls.unionByName(part)
    public = calls.groupBy("source", "base").agg(F.bool_or(F.col("category").isNotNull()).alias("public")).filter("public")
    return calls.join(public.select("source", "base"), ["source", "base"], "left_semi").withColumn("tender", F.concat_ws(":", "source", "base")), sanctions


def groups_of(calls: DataFrame) -> DataFrame:
    """A row for each tender: what matching needs of all its calls."""
    have = lambda c, when: F.max_by(c, F.when(when, F.struct("call", "tender_number")))
    first = lambda c: F.min_by(c, F.struct("call", "tender_number"))
    amount = F.coalesce(F.nullif("contract_value", F.lit(0.0)), F.nullif("ecv", F.lit(0.0)))
    return calls.groupBy("tender").agg(
        F.when(F.first("source").startswith("plan-"), "plan").otherwise("tender").alias("family"), F.first("source").alias("source"), F.first("base").alias("base"), first("description").alias("title"),
        F.array_sort(F.collect_set("description")).alias("descriptions"), have("contractor", F.col("contractor").isNotNull()).alias("contractor"), first("published_date").alias("published_date"), have(amount, amount.isNotNull()).alias("amount"),
        F.max_by("office", F.struct("call", "tender_number")).alias("office"), F.max_by("category", F.struct("call", "tender_number")).alias("category"), F.max_by("scope_reason", F.struct("call", "tender_number")).alias("scope_reason"), F.max_by("dept", F.struct("call", "tender_number")).alias("dept"),
    )


def tables(spark: SparkSession, cache: Cache, today: str, data_end: str) -> dict[str, DataFrame]:
    """The tables of a build, before they are published."""
    stages = Stages()
    listed = stages.keep("sources", sources(spark, cache.manifest, cache.portals))
    parsed, estimates = scoped_bills(spark, cache, listed)
    bills = stages.keep("bills", deduplicated(stages.keep("bills_in_scope", parsed)))
    jobs = stages.keep("works_with_bills", works_of(bills, cache.area))
    calls, sanctions = calls_of(spark, cache)
    calls = stages.keep("calls", calls)
    groups = stages.keep("tenders", groups_of(calls))
    bills = bills.join(jobs.select("job_number", "work"), "job_number")

    places = dict(cache.area.localities)
    facts_of_works = M.work_facts(bills, jobs.select("work", "title", "descriptions", "job_numbers", "office"), cache.area.ward_equivalents, places)
    links = stages.keep("links", M.link(facts_of_works, groups, cache.area.ward_equivalents, places))
    accepted = links.filter("accepted").select("work", "tender", F.lit(False).alias("exact"), "score", F.concat(F.lit("Linked by matching: "), F.array_join("support", "; ")).alias("via"))
    # portal tenders that no work of the bills has are works of their own
    alone = groups.filter("source = 'portal'").join(accepted.select("tender"), "tender", "left_anti")
    none, nothing = F.array().cast("array<string>"), lambda k: F.lit(None).cast(k)
    tendered = alone.select(
        F.concat(F.lit("tender:"), "base").alias("work"), nothing("string").alias("job_number"), "title", "descriptions", F.coalesce(S.locations(cache.area, F.array_join("descriptions", " ")), none).alias("locations"), none.alias("wards"), "office", "category",
        none.alias("job_numbers"), F.col("published_date").alias("first_date"), nothing("date").alias("last_bill"), "scope_reason", F.coalesce("dept", F.lit(DEPARTMENT)).alias("department"),
    )
    works = stages.keep("works", jobs.unionByName(tendered))
    exact = alone.select(F.concat(F.lit("tender:"), "base").alias("work"), "tender", F.lit(True).alias("exact"), nothing("double").alias("score"), nothing("string").alias("via"))
    linked = stages.keep("linked_calls", accepted.unionByName(exact).join(calls, "tender"))

    facts = stages.keep("facts_of_bills", K.base_facts(works, bills, linked, estimates, sanctions))
    entities, mentions, ambiguous = E.resolve(bills.withColumn("phone", nothing("string")), calls.filter("source = 'portal'"), linked.filter("contractor IS NOT NULL").join(bills.select("work", F.col("contractor").alias("payee")), "work").filter("payee IS NOT NULL").select("contractor", "payee").distinct())
    entities, mentions = stages.keep("entities", entities), stored(mentions, "mentions")
    entity_of = lambda system: mentions.filter(F.col("system") == system).select(F.col("name").alias("contractor"), "entity")
    paid = bills.select("work", "contractor", "gross").join(entity_of("bills"), "contractor")
    awarded = linked.filter("source = 'portal'").select("work", "contractor", F.struct("base", "call").alias("position")).join(entity_of("portal"), "contractor")
    facts = stages.keep("facts", K.with_entities(facts, paid, awarded, entities))

    value = lambda name, kind: F.try_element_at("f", F.lit(name))["value"].try_cast(kind)
    x = works.join(K.as_map(facts), "work", "left").join(bills.groupBy("work").agg(F.count("*").alias("n_bills")), "work", "left").join(linked.groupBy("work").agg(F.array_sort(F.collect_set("tender_number")).alias("tender_numbers"), F.max(F.when(~F.col("exact"), F.col("score"))).alias("link_score")), "work", "left")
    x = x.withColumns({n: value(n, "double") for n in ("payments_gross", "contract_value", "estimated_cost")} | {n: value(n, "date") for n in ("last_payment", "tender_published", "awarded_date", "work_order_date", "completion_date", "expected_completion")})
    x = x.withColumns({"has_bills": F.coalesce("n_bills", F.lit(0)) > 0, "has_tender": F.col("tender_numbers").isNotNull(), **{n: value(n, "string") for n in ("status", "contractor", "location")}}).drop("f")
    chosen = stages.keep("projects", K.selected(x))
    of_chosen = lambda df: df.join(chosen.select("work"), "work", "left_semi")
    own = of_chosen(facts)
    signals = project_signals(own.withColumnRenamed("work", "project_id"), of_chosen(bills).withColumnRenamed("work", "project_id"), today, data_end)
    signals = signals.select(F.col("project_id").alias("work"), "code", "severity", "confidence", "measure", none.alias("related"))
    main = paid.groupBy("work", "entity").agg(F.sum(F.coalesce("gross", F.lit(0))).alias("g")).groupBy("work").agg(F.max_by("entity", F.struct("g", "entity")).alias("entity"))
    concentrated, per_entity = DS.concentration(chosen.join(main, "work").select("work", "entity", "payments_gross", "contract_value"), entities)
    related = DS.related(M.related_works(chosen.select("work", "title", "descriptions")))
    signals = stages.keep("signals", signals.unionByName(concentrated.select(*signals.columns)).unionByName(related.select(*signals.columns)))
    life = K.lifecycle(own, of_chosen(bills))
    level = signals.groupBy("work").agg(F.count("*").alias("n_signals"), F.min(X.severity_rank(F.col("severity"))).alias("rank"))
    projects = chosen.join(life, "work", "left").join(level, "work", "left").join(main.withColumnRenamed("entity", "contractor_entity"), "work", "left")
    slug = P.slugify(F.coalesce("job_number", F.regexp_replace("work", "^tender:", "")))
    confidence = F.when(~F.col("has_bills"), "exact").when(F.col("link_score").isNotNull(), "linked").otherwise("none")
    search = F.lower(F.concat_ws(" ", "title", F.array_join("descriptions", " "), "contractor", F.array_join("job_numbers", " "), F.array_join("tender_numbers", " "), "location", "category"))
    projects = projects.withColumns({"id": F.col("work"), "slug": slug, "link_confidence": confidence, "signal_level": F.element_at(F.array(F.lit("attention"), F.lit("notice"), F.lit("info")), F.col("rank") + 1), "n_signals": F.coalesce("n_signals", F.lit(0)), "n_bills": F.coalesce("n_bills", F.lit(0)), "search_text": search}).drop("rank", "link_score")
    bill_records = of_chosen(bills).select(F.col("work").alias("project_id"), F.lit("bill").alias("record_type"), F.lit("exact").alias("link"), "source_id", "source_row", "job_number", nothing("string").alias("tender_number"), "description", "contractor", "bill_type", F.col("gross").cast("double").alias("gross"), F.col("nett").cast("double").alias("nett"), "br_no", "br_date", "payment_date", "wo_no", "wo_date", "start_date", "end_date", "dedupe_key", "source_url")
    tender_records = of_chosen(linked).select(F.col("work").alias("project_id"), F.when(F.col("source").startswith("plan-"), "plan").otherwise("tender").alias("record_type"), F.when(F.col("exact"), "exact").otherwise("linked").alias("link"), F.col("source").alias("source_id"), "tender_number", "description", "contractor", F.col("contract_value").alias("gross"), F.col("published_date").alias("start_date"), F.col("url").alias("source_url"))
    records = stages.keep("records", bill_records.unionByName(tender_records, allowMissingColumns=True))
    flags = X.project_flags(projects, own.withColumnRenamed("work", "project_id"), spark.createDataFrame([], "project_id string"), signals.withColumnRenamed("work", "project_id"), spark.createDataFrame([], "project_id string, retained int"))
    out = {
        "sources": listed, "projects": stages.keep("projects_told", projects), "facts": own, "links": links.join(chosen.select("work"), "work", "left_semi"), "signals": signals, "records": records,
        "contractors": entities.join(per_entity, "entity", "left"), "project_flags": flags, "ambiguous_names": ambiguous,
    }
    out["stats"] = spark.createDataFrame([(json.dumps(stages.counts(), sort_keys=True),)], "stats string")
    return out


#: Columns whose text is scrubbed before it is published, by table; others hold no free text.
SCRUBBED = {"projects": ["title", "descriptions", "search_text", "contractor", "location"], "facts": ["value", "explanation"], "records": ["description", "contractor"], "contractors": ["name", "aliases", "evidence"], "links": ["support", "conflict"], "ambiguous_names": ["name", "payee"]}


def build(spark: SparkSession, cache: Cache, at: str, today: str, data_end: str) -> str:
    """Builds all tables and makes them current at ``at``; returns the version's name. A failure anywhere leaves the former version."""
    return publish(spark, tables(spark, cache, today, data_end), at, SCRUBBED)
