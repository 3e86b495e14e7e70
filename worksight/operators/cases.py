"""Case review: the score of a case, what its issues' states mean, and which cases stay.

issues: case, type, status, confidence, value_at_issue, documentation_gap, timeline_days. A case takes its strongest issue; its score has six
parts of bounded weight and says only what to look at first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Points of the score and bounds of the issues.
UNRESOLVED = {"explained": 0, "artefact": 0, "partially_explained": 12, "insufficient_evidence": 8, "unexplained_in_public_record": 20}
SURE, DEAD = {"high": 25, "medium": 15, "low": 5}, ("explained", "artefact")
MOST = 10
FINE_SHARE, FINE_LEAST, ORDERS_COVER, STRONG_ITEMS, STRONG_SHARE = 0.05, 2e5, 1.25, 5, 0.8
LABELS = {
    "explained": "Explained by a public document", "artefact": "Artefact of the record", "partially_explained": "Partly explained",
    "insufficient_evidence": "Not enough public evidence", "unexplained_in_public_record": "Unexplained in the public record",
}


def _points(c: Column, points: dict[str, int]) -> Column:
    return F.coalesce(*(F.when(c == k, F.lit(float(v))) for k, v in points.items()), F.lit(0.0))


def materiality(rupees: Column) -> Column:
    """0 up to one lakh, 25 from ten crore on, logarithmic between; one place."""
    return F.when(rupees > 1e5, F.round(F.least(F.lit(25.0), 25 * F.log10(rupees / 1e5) / 3), 1)).otherwise(0.0)


def scored(issues: DataFrame, sources: DataFrame) -> DataFrame:
    """One row a case: its primary issue, the six parts, case_score, and retained if an issue lives. sources: case, n_sources."""
    x = issues.withColumns({"open": _points(F.col("status"), UNRESOLVED), "sure": _points(F.col("confidence"), SURE), "value": materiality(F.col("value_at_issue"))})
    best = F.max_by(F.struct("type", "status", "confidence", "open", "sure", "value"), F.struct(F.col("open") + F.col("sure") + F.col("value"), "type")).alias("best")
    per = x.groupBy("case").agg(
        best, F.least(F.lit(float(MOST)), F.sum(F.coalesce("documentation_gap", F.lit(0))).cast("double")).alias("gap"), F.max(F.coalesce("timeline_days", F.lit(0))).alias("days"),
        F.bool_or(~F.col("status").isin(*DEAD)).alias("retained"),
    )
    parts = {
        "evidence_strength": F.col("best.sure"), "financial_materiality": F.col("best.value"), "unresolved": F.col("best.open"), "documentation_gap": F.round("gap", 1),
        "timeline_deviation": F.round(F.least(F.lit(float(MOST)), F.col("days") / 365 * 5), 1), "independent_sources": F.least(F.lit(float(MOST)), 2.0 * F.coalesce("n_sources", F.lit(0))),
    }
    out = per.join(sources, "case", "left").withColumns(parts)
    return out.select("case", F.col("best.type").alias("primary_issue"), F.col("best.status").alias("status"), F.col("best.confidence").alias("confidence"), "retained", *parts, F.round(sum((F.col(p) for p in parts), F.lit(0.0)), 1).alias("case_score"))


def ranked(cases: DataFrame) -> DataFrame:
    """cases with rank among the retained, by score; ties by case. A review has few of them, and one row each passes one task."""
    order = Window.partitionBy("retained").orderBy(F.desc("case_score"), "case")
    return cases.withColumn("rank", F.when(F.col("retained"), F.row_number().over(order)))


def merged(cases: DataFrame) -> DataFrame:
    """Of cases that share a contract the one paid most stays, with the others' jobs. cases: case, contract, job, paid."""
    key = F.coalesce("contract", F.concat(F.lit("\x00"), "case"))
    own = Window.partitionBy(key)
    x = cases.withColumns({"first": F.row_number().over(own.orderBy(F.desc("paid"), "case")), "jobs": F.array_sort(F.collect_set("job").over(own))})
    return x.filter("first = 1").withColumn("merged_jobs", F.array_remove("jobs", F.col("job"))).drop("first", "jobs")


def evidence_confidence(kinds: Column, validated: Column) -> Column:
    """high: records and another kind, or two kinds that validate each other; medium: one of them; low: neither. Arrays of kinds."""
    api = F.array_contains(kinds, "api")
    n, v = F.size(F.array_distinct(kinds)), F.size(F.array_distinct(validated))
    return F.when((api & (n >= 2)) | (v >= 2), "high").when((v > 0) | api, "medium").otherwise("low")


def status_label(status: Column) -> Column:
    return F.coalesce(*(F.when(status == k, v) for k, v in LABELS.items()), status)


def paid_over_contract(works: DataFrame, orders: DataFrame) -> DataFrame:
    """Issues of works paid over their contract. works: case, paid, contract_value, sanctioned. orders: case, value, one a distinct work order."""
    total = orders.groupBy("case").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"))
    x = works.join(total, "case", "left")
    covered = (F.col("n") >= 2) & (F.col("paid") <= ORDERS_COVER * F.col("total"))
    sanctioned = F.coalesce(F.col("paid") <= ORDERS_COVER * F.col("sanctioned"), F.lit(False))
    status = F.when(F.coalesce(covered, F.lit(False)) | sanctioned, "explained").otherwise("unexplained_in_public_record")
    value = F.when(status == "explained", 0.0).otherwise(F.greatest(F.lit(0.0), F.col("paid") - F.col("contract_value")))
    return x.select("case", F.lit("paid_over_contract").alias("type"), status.alias("status"), F.when(F.coalesce(covered, F.lit(False)), "high").otherwise("medium").alias("confidence"), value.alias("value_at_issue"), F.round(F.try_divide("paid", "contract_value"), 2).alias("ratio"))


def past_completion(works: DataFrame, as_of: str, grace: int = 90) -> DataFrame:
    """Issues of works without a final bill past their stipulated or extended completion. works: case, due, extended, final_bill, gross."""
    due = F.greatest("due", "extended")
    late = F.datediff(F.lit(as_of).cast("date"), due)
    return works.filter("final_bill IS NULL").withColumn("timeline_days", late).filter(F.col("timeline_days") > grace).select("case", F.lit("past_completion").alias("type"), F.lit("insufficient_evidence").alias("status"), F.lit("medium").alias("confidence"), F.col("gross").alias("value_at_issue"), "timeline_days")


def significant_fines(works: DataFrame) -> DataFrame:
    """Issues of fines of 5 % of the bills and two lakh or more. works: case, fine, gross."""
    found = works.filter((F.col("fine") >= FINE_LEAST) & (F.col("fine") >= FINE_SHARE * F.col("gross")))
    return found.select("case", F.lit("significant_fine").alias("type"), F.lit("unexplained_in_public_record").alias("status"), F.lit("high").alias("confidence"), F.col("fine").alias("value_at_issue"))


def shared_items(items: DataFrame) -> DataFrame:
    """(a, b, shared, share, strong) of jobs whose schedules share rows (job, quantity, rate); share is of the smaller schedule."""
    rows = items.select("job", F.round("quantity", 2).alias("q"), F.round("rate", 2).alias("r")).distinct()
    size = rows.groupBy("job").agg(F.count("*").alias("n"))
    both = rows.withColumnRenamed("job", "a").join(rows.withColumnRenamed("job", "b"), ["q", "r"]).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    both = both.join(size.select(F.col("job").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("job").alias("b"), F.col("n").alias("nb")), "b")
    share = F.col("shared") / F.least("na", "nb")
    return both.select("a", "b", "shared", share.alias("share"), ((F.col("shared") >= STRONG_ITEMS) & (share >= STRONG_SHARE)).alias("strong"))
