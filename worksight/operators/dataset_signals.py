"""Signals that need more than one work's facts: shared files, bidders, concentration, related works, photos, and read quantities.

Every function gives (work, code, severity, confidence, measure, related). No group is collected but by key: pairs of bidders come from
one tender's list, works that share a file are listed by its digest. NULL names, entities and digests set nothing off.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Bounds of the rules.
SHARE, MANY_WORKS, FEW_WORKS, MEETINGS, MANY_MEETINGS, SOLE_WINS, TINY_BYTES = 0.05, 6, 2, 3, 4, 2, 8000
BELOW, ABOVE, MAJOR_SHARE, LEAST_AMOUNT, HIGH_VALUE, IDENTICAL, LEAST_IDENTICAL = 0.75, 1.25, 0.10, 1e5, 1e7, 0.0005, 3
READ_PLAN, SCHEDULE_B, MB_TOTAL = (0.8, 1.5), "Schedule B (contract BOQ)", "MB measurement total"
PLACEHOLDER_NAME = r"(?i)\b(e?mp?ty|emty|blank|dummy|na)\b"
NOT_A_DOCUMENT = r"(?i)not\s*applicable|\bn\.?a\b|emty|empty|nil\b|blank"
BILL_TYPES, PLAN_TYPES = ("M.B.", "Bill Form"), ("Schedule B", "Supplementary Schedule B", "Estimates")


def _row(work: str, code: str | Column, severity: str | Column, confidence: str | Column, measure: Column, related: Column | None = None) -> list[Column]:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    none = F.array().cast("array<string>")
    return [F.col(work).cast("string").alias("work"), lit(code).alias("code"), lit(severity).alias("severity"), lit(confidence).alias("confidence"), measure.cast("double").alias("measure"), (related if related is not None else none).alias("related")]


def concentration(works: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Signals, and (entity, projects, amount, share) of every contractor. works: work, entity, payments_gross, contract_value."""
    money = F.coalesce(F.nullif("payments_gross", F.lit(0.0)), F.nullif("contract_value", F.lit(0.0)), F.lit(0.0)).cast("decimal(18,2)")
    per = works.withColumn("m", money).groupBy("entity").agg(F.count("*").alias("projects"), F.sum("m").alias("amount"))
    total = F.sum("amount").over(Window.partitionBy())  # one row an entity
    per = per.withColumn("share", F.coalesce(F.try_divide(F.col("amount").cast("double"), total.cast("double")), F.lit(0.0))).filter("entity IS NOT NULL")
    per = per.select("entity", "projects", F.col("amount").cast("double").alias("amount"), "share")
    heavy = per.filter((F.col("projects") >= FEW_WORKS) & ((F.col("share") >= SHARE) | (F.col("projects") >= MANY_WORKS)))
    found = works.join(heavy, "entity").join(entities.select("entity", "basis"), "entity", "left")
    return found.select(*_row("work", "contractor_concentration", "info", F.coalesce("basis", F.lit("inferred")), F.col("share"))), per


def bids(tenders: DataFrame) -> DataFrame:
    """(tender, entity, rank, n) of resolved bidders. tenders: tender, bidders (array of entity, rank)."""
    known = F.filter("bidders", lambda b: b["entity"].isNotNull())
    return tenders.select("tender", F.size(known).alias("n"), F.explode(known).alias("b")).select("tender", "b.entity", "b.rank", "n")


def bid_counts(tenders: DataFrame) -> DataFrame:
    won = F.coalesce(F.col("rank") == "L1", F.lit(False))
    return bids(tenders).groupBy("entity").agg(F.count("*").alias("bids"), F.count_if(won).alias("wins"), F.count_if(won & (F.col("n") == 1)).alias("single_wins"))


def co_bidding(tenders: DataFrame) -> DataFrame:
    """(a, b, tenders, a_wins, b_wins, list) of pairs that met on three tenders or more."""
    won = F.coalesce(F.bool_or(F.col("rank") == "L1"), F.lit(False))
    b = bids(tenders).groupBy("tender", "entity").agg(won.alias("won"))
    pairs = b.select("tender", F.col("entity").alias("a"), F.col("won").alias("aw")).join(b.select("tender", F.col("entity").alias("b"), F.col("won").alias("bw")), "tender").filter("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("tenders"), F.count_if("aw").alias("a_wins"), F.count_if("bw").alias("b_wins"), F.array_sort(F.collect_set("tender")).alias("list")).filter(F.col("tenders") >= MEETINGS)


def bidder_signals(tenders: DataFrame, work_tenders: DataFrame, entities: DataFrame) -> DataFrame:
    """frequent_co_bidders and repeat_single_bid_winner. work_tenders: work, tender."""
    sure = entities.select("entity", (F.col("basis") == "confirmed").alias("sure"))
    met = co_bidding(tenders).join(sure.select(F.col("entity").alias("a"), F.col("sure").alias("sa")), "a", "left").join(sure.select(F.col("entity").alias("b"), F.col("sure").alias("sb")), "b", "left")
    both = F.coalesce(F.col("sa") & F.col("sb"), F.lit(False))
    pairs = met.select("*", F.explode("list").alias("tender")).join(work_tenders, "tender")
    frequent = pairs.select(*_row("work", "frequent_co_bidders", F.when(F.col("tenders") >= MANY_MEETINGS, "notice").otherwise("info"), F.when(both, "confirmed").otherwise("inferred"), F.col("tenders")))
    winners = bid_counts(tenders).filter(F.col("single_wins") >= SOLE_WINS)
    sole = bids(tenders).filter("n = 1").join(winners.select("entity", "single_wins"), "entity").join(work_tenders, "tender")
    return frequent.unionByName(sole.groupBy("work", "entity").agg(F.max("single_wins").alias("k")).select(*_row("work", "repeat_single_bid_winner", "notice", "confirmed", F.col("k"))))


def name_overlaps(tenders: DataFrame) -> DataFrame:
    """bidder_name_overlap: for each bidder the first later one on the tender whose long words contain, or lie in, theirs.

    tenders: work, tender, sure, bidders (array of name); bidders of one tender are compared within its row.
    """
    words = lambda b: F.array_distinct(F.regexp_extract_all(F.lower(F.regexp_replace(b["name"], r"\(.*", "")), F.lit("[a-z]{5,}"), F.lit(0)))
    x = tenders.withColumn("w", F.transform("bidders", words))
    within = lambda a, b: (F.size(a) > 0) & (F.size(b) > 0) & ((F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0))
    later = lambda a, i: F.exists(F.filter("w", lambda b, j: j > i), lambda b: within(a, b))
    hits = F.size(F.filter(F.transform("w", lambda a, i: later(a, i)), lambda h: h))
    out = x.withColumn("hits", hits).filter("hits > 0").withColumn("k", F.explode(F.sequence(F.lit(1), "hits")))
    return out.select(*_row("work", "bidder_name_overlap", "info", F.when(F.col("sure"), "confirmed").otherwise("inferred"), F.col("k")))


def photos_outside(photos: DataFrame, south: float, north: float, west: float, east: float) -> DataFrame:
    """photo_gps_outside_area, once a work. photos: work, lat, lon, position."""
    out = photos.filter(~(F.col("lat").between(south, north) & F.col("lon").between(west, east)))
    return out.groupBy("work").agg(F.min("position").alias("first")).select(*_row("work", "photo_gps_outside_area", "notice", "inferred", F.col("first")))


def related(pairs: DataFrame) -> DataFrame:
    """related_work for both works of each pair (a, b, similarity)."""
    both = pairs.select(F.col("a").alias("work"), F.col("b").alias("other"), "similarity").unionByName(pairs.select(F.col("b").alias("work"), F.col("a").alias("other"), "similarity"))
    return both.select(*_row("work", "related_work", "info", "inferred", F.col("similarity"), F.array(F.col("other").cast("string"))))


def reused_files(files: DataFrame) -> DataFrame:
    """placeholder_reused, photo_reused or document_reused of works that share a file. files: work, md5, type, name, bytes."""
    per = files.filter("md5 IS NOT NULL").groupBy("md5").agg(
        F.array_sort(F.collect_set(F.col("work").cast("string"))).alias("works"), F.bool_and(F.col("bytes") < TINY_BYTES).alias("tiny"),
        F.bool_and(F.col("name").rlike(PLACEHOLDER_NAME)).alias("named"), F.bool_and(F.lower("type").contains("photo")).alias("photo"),
    ).filter("size(works) >= 2")
    empty = F.col("tiny") | F.col("named")
    code = F.when(empty, "placeholder_reused").when(F.col("photo"), "photo_reused").otherwise("document_reused")
    each = per.withColumns({"code": code, "severity": F.when(empty, "info").otherwise("notice"), "n": F.size("works")}).withColumn("work", F.explode("works"))
    return each.select(*_row("work", F.col("code"), F.col("severity"), "confirmed", F.col("n"), F.slice(F.array_remove("works", F.col("work")), 1, 5)))


def is_placeholder(name: Column, size: Column | None = None, tiny: int = 15_000) -> Column:
    named = F.coalesce(F.lower(name).rlike(NOT_A_DOCUMENT), F.lit(False))
    return named if size is None else named | F.coalesce(size < tiny, F.lit(False))


def measurement_books(listing: DataFrame) -> DataFrame:
    """One row a job: final bills paid, and whether a real measurement book is attached. listing: job, bill, bill_type, paid, files (array of name, type, listing)."""
    final = F.coalesce(F.lower("bill_type").contains("final"), F.lit(False)) & F.col("paid")
    finals = listing.groupBy("job").agg(F.array_sort(F.collect_set(F.when(final, F.col("bill")))).alias("final_bills"))
    f = listing.select("job", F.explode("files").alias("f")).select("job", "f.name", F.trim(F.coalesce("f.type", F.lit(""))).alias("type"), F.col("f.listing").alias("at"))
    book, empty = F.col("type").isin(*BILL_TYPES), is_placeholder(F.col("name"))
    per = f.groupBy("job").agg(
        F.countDistinct(F.when(book, F.col("name"))).alias("mb_files"), F.countDistinct(F.when(book & ~empty, F.col("name"))).alias("mb_real"), F.bool_or(F.col("at") == "bill_files").alias("bill_level_files"),
        F.slice(F.array_sort(F.collect_set(F.when(book & empty, F.col("name")))), 1, 5).alias("mb_placeholders"),
        F.array_sort(F.collect_set(F.when(~book & F.col("name").rlike(r"(?i)\bm\.?\s*b\b|measurement") & ~empty, F.col("name")))).alias("mb_filed_elsewhere"),
    )
    return finals.join(per, "job", "left")


def final_without_book(books: DataFrame) -> DataFrame:
    """final_bill_without_mb of jobs whose bills carry files at all and none that is, or is called, a measurement book."""
    found = books.filter((F.size("final_bills") > 0) & (F.coalesce("mb_real", F.lit(0)) == 0) & F.coalesce("bill_level_files", F.lit(False)) & (F.size(F.coalesce("mb_filed_elsewhere", F.array().cast("array<string>"))) == 0))
    return found.select(*_row("job", "final_bill_without_mb", "notice", "confirmed", F.size("final_bills")))


def quantity_signals(jobs: DataFrame, items: DataFrame, extras: DataFrame) -> DataFrame:
    """The seven signals of read quantities, once a job and code; measure: how many items.

    jobs: job, plan_value, plan_basis, contract, paid, has_final, all_read, n_variations, n_supplementary, n_bill_documents, readable.
    items: job, estimated_quantity, estimated_amount, compared_quantity, compared_basis, matches (array of match, scoped). extras: job, amount.
    """
    x = items.join(jobs, "job")
    got, plan = F.col("compared_quantity"), F.col("estimated_quantity")
    complete = F.col("has_final") & F.col("all_read")
    ratio, measured = F.try_divide(got, plan), F.coalesce(F.col("compared_basis") == MB_TOTAL, F.lit(False))
    large = got.isNotNull() & (plan != 0) & (F.coalesce("estimated_amount", F.lit(0.0)) >= LEAST_AMOUNT)
    by_key = F.forall("matches", lambda m: F.coalesce(m["match"].isin("code", "rate"), F.lit(False)))
    scoped = measured | (F.col("compared_basis") == "bill form total up to date") | F.forall("matches", lambda m: F.coalesce(m["scoped"], F.lit(False)))
    above = large & (ratio > ABOVE) & scoped & (measured | by_key)
    same = got.isNotNull() & (plan != 0) & (F.size("matches") > 0) & by_key & (F.abs(got - plan) <= IDENTICAL * plan + 0.011)
    missing = complete & (F.col("plan_value") != 0) & got.isNull() & (F.coalesce("estimated_amount", F.lit(0.0)) >= F.greatest(F.lit(LEAST_AMOUNT), MAJOR_SHARE * F.col("plan_value")))
    unvaried = (F.col("n_variations") == 0) & (F.col("n_supplementary") == 0)
    count = lambda when: F.count_if(F.coalesce(when, F.lit(False)))
    per = x.groupBy("job").agg(count(large & (ratio < BELOW) & (measured | complete)).alias("qty_measured_below_plan"), count(above).alias("qty_billed_above_plan"), count(above & unvaried).alias("qty_above_plan_no_variation"), count(same).alias("same"), count(missing).alias("qty_major_item_not_billed"))
    per = per.withColumn("qty_identical_to_plan", F.when(F.col("same") >= LEAST_IDENTICAL, F.col("same")).otherwise(0)).drop("same")
    codes = [c for c in per.columns if c != "job"]
    long = per.unpivot(["job"], codes, "code", "n").filter("n > 0")
    read = jobs.filter((F.col("plan_basis") == SCHEDULE_B) & (F.col("contract") > 0) & F.col("plan_value").between(READ_PLAN[0] * F.col("contract"), READ_PLAN[1] * F.col("contract")))
    unplanned = extras.filter(F.col("amount") >= LEAST_AMOUNT).join(read.select("job"), "job", "left_semi").groupBy("job").agg(F.count("*").alias("n")).select("job", F.lit("qty_billed_item_not_in_plan").alias("code"), "n")
    rows = long.unionByName(unplanned)
    found = rows.select(*_row("job", F.col("code"), F.when(F.col("code") == "qty_identical_to_plan", "info").otherwise("notice"), "inferred", F.col("n")))
    unread = jobs.filter((F.col("paid") >= HIGH_VALUE) & (F.col("n_bill_documents") > 0) & ~F.col("readable"))
    return found.unionByName(unread.select(*_row("job", "qty_unreadable_mb", "info", "confirmed", F.col("n_bill_documents"))))
