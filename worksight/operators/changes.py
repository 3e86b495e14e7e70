"""What two builds of the tables differ in, as one table of changes, and the report on it.

A build is a mapping of tables: projects (slug, title, status, payments_gross), bills (slug, job_number, bill_type, gross, br_no, br_date,
payment_date, contractor), signals (slug, code), finals (slug, value), and cases (case_id, retained, status), which may be missing.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worksight.functions import text as T

#: How many lines of a kind a report names; the counts above them cover all.
MOST = {"new_bill": 15, "project_added": 40, "status": 30, "signal_added": 30, "signal_gone": 30}
HEADINGS = (
    ("case", "Investigation cases"), ("final_bill", "Final bills recorded"), ("project_added", "New projects"), ("project_dropped", "Projects no longer in the build"),
    ("new_bill", "Largest new bills"), ("status", "Status changes"), ("signal_added", "Signals added"), ("signal_gone", "Signals gone"),
)
_COLUMNS = "kind", "key", "was", "now", "amount", "note"


def _change(df: DataFrame, kind: str | Column, key: Column, was: Column | None = None, now: Column | None = None, amount: Column | None = None, note: Column | None = None) -> DataFrame:
    none, kind = F.lit(None), F.lit(kind) if isinstance(kind, str) else kind
    values = (kind.cast("string"), key.cast("string"), *(F.coalesce(c, none).cast("string") if c is not None else none.cast("string") for c in (was, now)))
    more = (amount.cast("double") if amount is not None else none.cast("double"), note.cast("string") if note is not None else none.cast("string"))
    return df.select(*(c.alias(name) for c, name in zip((*values, *more), _COLUMNS)))


def _bills(df: DataFrame) -> DataFrame:
    """Each bill with its job, number, date and rounded amount, by which it is the same bill; of several the greatest row is kept, whatever their order."""
    key = F.struct("job_number", F.coalesce("br_no", F.lit("")).alias("br_no"), F.coalesce(F.col("br_date").cast("string"), F.lit("")).alias("br_date"), F.bround(F.coalesce(F.col("gross").cast("double"), F.lit(0.0)), 0).alias("rupees"))
    row = F.struct(F.col("payment_date").cast("string").alias("payment_date"), F.col("gross").cast("double").alias("gross"), "slug", "bill_type", "contractor")
    return df.select(key.alias("bill"), row.alias("r"))


def changes(old: Mapping[str, DataFrame], new: Mapping[str, DataFrame]) -> DataFrame:
    """(kind, key, was, now, amount, note), one row for each difference; each table is joined once with its former self by its key."""
    p = old["projects"].select("slug", F.struct("title", "status").alias("o")).join(new["projects"].select("slug", F.struct("title", "status").alias("n")), "slug", "full_outer")
    state = lambda c: F.coalesce(F.col(c), F.lit(""))
    parts = [
        _change(p.filter("o IS NULL"), "project_added", F.col("slug"), note=F.col("n.title")),
        _change(p.filter("n IS NULL"), "project_dropped", F.col("slug"), note=F.col("o.title")),
        _change(p.filter(F.col("o").isNotNull() & F.col("n").isNotNull() & (state("o.status") != state("n.status"))), "status", F.col("slug"), F.col("o.status"), F.col("n.status")),
    ]
    own, other = _bills(old["bills"]), _bills(new["bills"])
    sides = own.select("bill", F.col("r").alias("o"), F.lit(None).cast(other.schema["r"].dataType).alias("n")).union(other.select("bill", F.lit(None).cast(own.schema["r"].dataType), "r"))
    b = sides.groupBy("bill").agg(F.max("o").alias("o"), F.max("n").alias("n"))  # both builds meet in one grouping, not in a join of two
    paid_now = F.col("n.payment_date").isNotNull() & F.col("o.payment_date").isNull()
    kind = F.when(F.col("o").isNull(), "new_bill").when(paid_now, "newly_paid")
    said = F.concat_ws(
        "", F.coalesce("n.bill_type", F.lit("bill")), F.coalesce(F.concat(F.lit(", paid "), "n.payment_date"), F.lit(", not yet paid")), F.concat(F.lit(" to "), "n.contractor")
    )
    parts.append(_change(b.filter(F.col("n").isNotNull()).withColumn("kind", kind).filter("kind IS NOT NULL"), F.col("kind"), F.col("n.slug"), F.col("o.payment_date"), F.col("n.payment_date"), F.col("n.gross"), said))
    finals = lambda t: t["finals"].filter("slug IS NOT NULL AND value IS NOT NULL").select("slug").distinct()
    titled = finals(new).join(finals(old), "slug", "left_anti").join(new["projects"].select("slug", "title"), "slug", "left")
    parts.append(_change(titled, "final_bill", F.col("slug"), note=F.col("title")))
    signals = lambda t: t["signals"].select("slug", "code").distinct()
    parts.append(_change(signals(new).exceptAll(signals(old)), "signal_added", F.col("slug"), note=F.col("code")))
    parts.append(_change(signals(old).exceptAll(signals(new)), "signal_gone", F.col("slug"), note=F.col("code")))
    some = next((t["cases"] for t in (old, new) if "cases" in t), None)
    if some is not None:
        side = lambda t, c: t.get("cases", some.limit(0)).select("case_id", F.struct(F.col("retained").cast("boolean").alias("retained"), "status").alias(c))
        c = side(old, "o").join(side(new, "n"), "case_id", "full_outer")
        word = lambda x: F.when(F.col(f"{x}.retained"), "open").otherwise("set aside")
        what = F.when(F.col("o").isNull(), "new candidate").when(F.col("n").isNull(), "removed").when(~F.col("o").eqNullSafe(F.col("n")), F.concat(word("o"), F.lit(" → "), word("n")))
        parts.append(_change(c.withColumn("what", what).filter("what IS NOT NULL"), "case", F.col("case_id"), F.col("o.status"), F.col("n.status"), note=F.col("what")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def totals(old: Mapping[str, DataFrame], new: Mapping[str, DataFrame]) -> DataFrame:
    """One row: projects and what was paid for them, before and now."""
    one = lambda t, when: t["projects"].agg(F.count("*").alias(f"projects_{when}"), F.coalesce(F.sum(F.col("payments_gross").cast("double")), F.lit(0.0)).alias(f"paid_{when}"))
    return one(old, "was").crossJoin(one(new, "now"))  # one row on either side


def counts(found: DataFrame) -> DataFrame:
    return found.groupBy("kind").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))


def lines(found: DataFrame) -> DataFrame:
    """(kind, rank, line) of the report: the largest of new bills, else in order of key; as many of a kind as MOST says, and all of the others."""
    from pyspark.sql.window import Window

    named = found.filter("kind <> 'newly_paid'")
    order = Window.partitionBy("kind").orderBy(F.when(F.col("kind") == "new_bill", -F.coalesce("amount", F.lit(0.0))), F.col("key").asc_nulls_first(), "note", "was", "now")
    most = F.coalesce(F.create_map(*(F.lit(x) for kv in MOST.items() for x in kv))[F.col("kind")], F.lit(2**31 - 1))
    moved = F.when(F.col("was").isNull(), F.coalesce("now", F.lit("—"))).when(F.col("now").isNull(), F.col("was")).otherwise(F.concat("was", F.lit(" → "), "now"))
    line = (
        F.when(F.col("kind") == "case", F.concat_ws("", "key", F.lit(": "), "note", F.lit(" ("), moved, F.lit(")")))
        .when(F.col("kind") == "status", F.concat("key", F.lit(": "), F.coalesce("was", F.lit("—")), F.lit(" → "), F.coalesce("now", F.lit("—"))))
        .when(F.col("kind") == "new_bill", F.concat_ws("", "key", F.lit(": "), T.rupees_in_case(F.coalesce("amount", F.lit(0.0))), F.lit(", "), "note"))
        .otherwise(F.concat_ws("", "key", F.concat(F.lit(": "), "note")))
    )
    return named.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).select("kind", "rank", line.alias("line"))


def report(old: Mapping[str, DataFrame], new: Mapping[str, DataFrame], when: str) -> str:
    """Markdown. Sums and the lines of `lines` come to the driver; of cases, final bills and dropped projects that is one each."""
    found = changes(old, new).cache()
    n = {r.kind: r for r in counts(found).collect()}
    t = totals(old, new).select("*", *(T.rupees_in_case(F.col(c)).alias(f"{c}_text") for c in ("paid_was", "paid_now")), T.rupees_in_case(F.col("paid_now") - F.col("paid_was")).alias("more")).first()
    of = lambda kind: n[kind].n if kind in n else 0
    out = [
        f"## Data refresh {when}", "", f"- Projects: {t.projects_was} → {t.projects_now}; paid (gross): {t.paid_was_text} → {t.paid_now_text} ({'+' if t.paid_now >= t.paid_was else ''}{t.more})",
        f"- New bills: {of('new_bill')}; bills newly paid: {of('newly_paid')}", f"- Signals: +{of('signal_added')} / −{of('signal_gone')}; case changes: {of('case')}", "",
    ]
    if not n:
        found.unpersist()
        return "\n".join([*out, "No changes.", ""])
    told = lines(found).orderBy("kind", "rank").collect()
    found.unpersist()
    for kind, heading in HEADINGS:
        mine = [r.line for r in told if r.kind == kind]
        if mine:
            rest = [f"- … and {of(kind) - len(mine)} more"] if of(kind) > len(mine) else []
            out += [f"**{heading}**", "", *(f"- {x}" for x in mine), *rest, ""]
    return "\n".join(out)
