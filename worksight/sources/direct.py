"""Bills as the paying office's own pages show them, one JSON file each, and how they join the bills of the exports.

Files that are no JSON give no rows; a part of a record that has another shape than expected is NULL.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from worksight.functions import dates as D
from worksight.functions import parsing as P
from worksight.operators.entities import sequence_ratio
from worksight.operators.scope import Area, scope_reason

#: Fields of a record; heads of deductions that are kept, and the names that three of them get.
DETAILS = "billtype gross deduction nett sbrnumber sbrdate dbrnumber dbrdate commonbrnumber rtgs rtgsdate releaseper releasegross category currentlevelname budget ddoname contractorname wcdescription".split()
_FILES = "array<map<string,string>>"  # its names differ in case alone
RECORD = (
    "work_bill_id string, details struct<" + ", ".join(f"{x}:string" for x in DETAILS) + ">, deductions map<string,string>, "
    "approvals array<struct<date:string, name:string, remarks:string, systemtype:string>>, "
    f"wo_files {_FILES}, bill_files {_FILES}, details_url string, fetched_at string"
)
HEADS = "fine mobilizationadvance it fsd royalty labourcess md otheradvances others2 others3 others4 addlsd addlauditrec".split()
HEAD_NAMES = {"others2": "reserve", "others3": "withheld", "others4": "audit_recovery"}
#: Descriptions at least this alike are of one work.
ALIKE = 0.6


def read_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Records with an id; of files with one id the last in order of path counts."""
    raw = spark.read.schema(RECORD).option("multiLine", True).json(path).withColumn("file", F.input_file_name())
    held = raw.filter("work_bill_id IS NOT NULL")
    others = [c for c in held.columns if c not in ("work_bill_id", "file")]
    return held.groupBy("work_bill_id").agg(F.max_by(F.struct(*others), "file").alias("r")).select("work_bill_id", "r.*")


def read_job_lists(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(wbid, job_number) of files named by their job, each a list of its bills; of several jobs the greatest counts."""
    raw = spark.read.schema("wbid string").option("multiLine", True).json(path)
    named = raw.filter("coalesce(wbid, '') <> ''").select("wbid", F.regexp_extract(F.try_url_decode(F.input_file_name()), r"([^/]+)\.json$", 1).alias("job_number"))
    return named.groupBy("wbid").agg(F.max("job_number").alias("job_number"))


def _quoted(c: Column) -> Column:
    """Percent-encoded for a path: blanks are %20, slashes stay."""
    for have, want in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        c = F.replace(c if have != "+" else F.url_encode(c), F.lit(have), F.lit(want))
    return c


def file_url(base: str, folder: Column, name: Column) -> Column:
    """Address of an attachment; the folder's number, often empty, follows the word Files."""
    return F.concat(F.lit(f"{base}/Files"), F.coalesce(folder, F.lit("")), F.lit("/"), _quoted(name))


def _broken(c: Column, mark: str) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"<br\s*/?>", mark)


def direct_bills(records: DataFrame, base: str = "") -> DataFrame:
    """One flat row for each record; deductions are those kept and not zero, files those with a name."""
    d = lambda x: F.col(f"details.{x}")
    amounts = F.map_filter(F.transform_values("deductions", lambda _, v: v.try_cast("double")), lambda k, v: k.isin(*HEADS) & (v != 0))
    named = F.coalesce(F.transform_keys(amounts, lambda k, _: F.coalesce(F.create_map(*(F.lit(x) for kv in HEAD_NAMES.items() for x in kv))[k], k)), F.create_map().cast("map<string,double>"))
    approvals = F.transform(
        F.coalesce("approvals", F.array()),
        lambda a: F.struct(
            D.record_date(a["date"]).alias("date"), _broken(a["name"], " / ").alias("by"),
            F.trim(F.regexp_replace(_broken(a["remarks"], " — "), r"(?U)\s+", " "), F.lit(" —")).alias("remarks"), a["systemtype"].alias("stage"),
        ),
    )
    files = lambda c: F.transform(
        F.filter(F.coalesce(c, F.array()), lambda f: F.coalesce(f["rFileName"], F.lit("")) != ""),
        lambda f: F.struct(f["rFileName"].alias("name"), f["rFileType"].alias("type"), file_url(base, F.coalesce(F.nullif(f["raddl"], F.lit("")), f["rAddl"]), f["rFileName"]).alias("url")),
    )
    return records.select(
        F.col("work_bill_id").alias("wbid"), d("wcdescription").alias("description"), d("billtype").alias("bill_type"), *(P.money(d(x)).alias(x) for x in ("gross", "deduction", "nett")),
        d("sbrnumber").alias("sbr_no"), D.record_date(d("sbrdate")).alias("sbr_date"), d("dbrnumber").alias("br_no"), D.record_date(d("dbrdate")).alias("br_date"), d("commonbrnumber").alias("common_br"),
        d("rtgs").alias("rtgs"), D.record_date(d("rtgsdate")).alias("rtgs_date"), d("releaseper").try_cast("double").alias("release_pct"), P.money(d("releasegross")).alias("release_gross"), d("category").alias("category"),
        d("currentlevelname").alias("level"), d("budget").alias("budget"), d("ddoname").alias("ddo"), d("contractorname").alias("contractor_raw"), named.alias("deductions"), approvals.alias("approvals"),
        files(F.col("wo_files")).alias("wo_files"), files(F.col("bill_files")).alias("bill_files"), F.col("details_url").alias("url"), "fetched_at",
        F.coalesce((F.trim(d("rtgs")) != "") | (F.upper(d("currentlevelname")) == "RTGS"), F.upper(d("currentlevelname")) == "RTGS", F.lit(False)).alias("paid"),
    )


def placed(direct: DataFrame, jobs: DataFrame, bills: DataFrame) -> DataFrame:
    """Direct bills with their job: by the lists of jobs, else by a bill that names their id; others go."""
    by_bill = bills.filter("ifms_id IS NOT NULL AND job_number IS NOT NULL").groupBy(F.col("ifms_id").alias("wbid")).agg(F.min("job_number").alias("by_bill"))
    out = direct.join(jobs.select("wbid", F.col("job_number").alias("by_list")), "wbid", "left").join(by_bill, "wbid", "left")
    return out.withColumn("job_number", F.coalesce("by_list", "by_bill")).drop("by_list", "by_bill").filter("job_number IS NOT NULL")


def same_job(direct: DataFrame, bills: DataFrame, area: Area) -> DataFrame:
    """Placed direct bills with same_job: numbers repeat across ward maps, so a bill must also be of the job's work.

    It is if its id is known in the job, it has no description, its text is in scope, or it is like one of the job's descriptions. Only bills
    that the first three leave open are compared, each with the job's distinct descriptions.
    """
    plain = lambda c: F.substring(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9 ]", " "), 1, 200)
    ids = bills.select("job_number", F.col("ifms_id").alias("wbid")).filter("wbid IS NOT NULL").distinct().withColumn("__known", F.lit(True))
    none = F.lit(None).cast("string")
    blank = F.trim(plain(F.col("description"))) == ""
    out = direct.join(ids, ["job_number", "wbid"], "left").withColumn("__sure", F.coalesce("__known", F.lit(False)) | blank | scope_reason(area, F.col("description"), none, none, none).isNotNull())
    theirs = bills.filter("description IS NOT NULL").select("job_number", plain(F.col("description")).alias("k")).distinct()
    open_ = out.filter("NOT __sure").select("job_number", plain(F.col("description")).alias("d")).distinct()
    like = open_.join(theirs, "job_number").filter(sequence_ratio("d", "k") >= ALIKE).select("job_number", F.col("d").alias("__d")).distinct().withColumn("__like", F.lit(True))
    out = out.withColumn("__d", plain(F.col("description"))).join(like, ["job_number", "__d"], "left")
    return out.withColumn("same_job", F.col("__sure") | F.coalesce("__like", F.lit(False))).drop("__known", "__sure", "__like", "__d")


def _by_amount(direct: DataFrame, bills: DataFrame) -> DataFrame:
    """(wbid, bill): in order of wbid, each takes the job's first free bill whose gross is less than 1 away.

    Only amounts chained by distances below 1 can meet, so such a chain of one job is a group; its rows are two keys and an amount.
    """
    both = direct.select("job_number", "gross", F.col("wbid").alias("key"), F.lit(True).alias("is_direct")).unionByName(bills.select("job_number", "gross", F.col("bill").cast("string").alias("key"), F.lit(False).alias("is_direct")))
    w = Window.partitionBy("job_number").orderBy("gross")
    chained = both.withColumn("__new", F.coalesce((F.col("gross") - F.lag("gross").over(w) >= 1).cast("int"), F.lit(0)))
    chained = chained.withColumn("chain", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("gross", F.col("gross").cast("double"))

    def take(group: pd.DataFrame) -> pd.DataFrame:
        free = [(int(k), g) for k, g in group.loc[~group.is_direct, ["key", "gross"]].itertuples(index=False)]
        free.sort()
        out = []
        for key, gross in sorted(group.loc[group.is_direct, ["key", "gross"]].itertuples(index=False, name=None)):
            at = next((i for i, (_, g) in enumerate(free) if abs(g - gross) < 1), None)
            if at is not None:
                out.append((key, free.pop(at)[0]))
        return pd.DataFrame(out, columns=["wbid", "bill"]).astype({"wbid": "object", "bill": "int64"})

    return chained.groupBy("job_number", "chain").applyInPandas(take, "wbid string, bill long")


def match_bills(direct: DataFrame, bills: DataFrame) -> DataFrame:
    """direct with bill (the one of the exports that it is), basis and state.

    direct (wbid, job_number, br_no, br_date, gross, paid), bills (bill long, which orders them, job_number, ifms_id, br_no, br_date, gross).
    basis: id; else bill_number (zeros at its head don't count, a date that we lack fits); else amount, one to one, among bills that neither of
    these took. state: matched; of the others, new if paid and repeat if an earlier new one of the job has its number and date, else pending.
    """
    stripped = lambda c: F.nullif(P.strip_zeros(F.col(c)), F.lit(""))
    d = direct.select("wbid", "job_number", stripped("br_no").alias("br"), "br_date", "gross")
    b = bills.select("bill", "job_number", "ifms_id", stripped("br_no").alias("br"), F.col("br_date").alias("b_date"), "gross")
    by_id = d.join(b.select("job_number", F.col("ifms_id").alias("wbid"), "bill"), ["job_number", "wbid"]).groupBy("wbid").agg(F.min("bill").alias("bill")).withColumn("basis", F.lit("id"))
    left = d.join(by_id.select("wbid"), "wbid", "left_anti")
    numbered = left.join(b.select("job_number", "br", "b_date", "bill"), ["job_number", "br"]).filter("b_date IS NULL OR b_date = br_date")
    by_number = numbered.groupBy("wbid").agg(F.min("bill").alias("bill")).withColumn("basis", F.lit("bill_number"))
    sure = by_id.unionByName(by_number)
    rest = left.join(by_number.select("wbid"), "wbid", "left_anti").filter("gross <> 0")
    by_amount = _by_amount(rest, b.join(sure.select("bill"), "bill", "left_anti").filter("gross <> 0")).withColumn("basis", F.lit("amount"))
    out = direct.join(sure.unionByName(by_amount), "wbid", "left")
    same = Window.partitionBy("job_number", stripped("br_no"), "br_date")
    free = F.col("bill").isNull()
    first = F.when(stripped("br_no").isNotNull(), F.min(F.when(free & F.col("paid"), F.col("wbid"))).over(same))
    state = F.when(~free, "matched").when(F.coalesce(F.col("wbid") > first, F.lit(False)), "repeat").when(F.col("paid"), "new").otherwise("pending")
    return out.withColumn("state", state)


def enriched(bills: DataFrame, matched: DataFrame) -> DataFrame:
    """bills with what their direct records add, and the new ones in the same schema; type and payment date only where a bill lacks them."""
    adds = matched.filter("state = 'matched'").groupBy("bill").agg(
        F.min_by("bill_type", F.when(F.col("bill_type").isNotNull(), F.col("wbid"))).alias("__type"), F.min_by("rtgs_date", F.when(F.col("rtgs_date").isNotNull(), F.col("wbid"))).alias("__day"), F.max("wbid").alias("direct_id")
    )
    own = bills.join(adds, "bill", "left").withColumns({"bill_type": F.coalesce("bill_type", "__type"), "payment_date": F.coalesce("payment_date", "__day"), "ifms_id": F.coalesce("direct_id", "ifms_id")}).drop("__type", "__day")
    ref = F.when(F.col("rtgs") != "", F.concat(F.lit("RTGS "), "rtgs"))
    new = matched.filter("state = 'new'").select(
        "job_number", "description", "gross", "deduction", "nett", "br_no", "br_date", "bill_type", ref.alias("payment_ref"), F.col("rtgs_date").alias("payment_date"),
        F.lit("direct").alias("kind"), F.col("url").alias("source_url"), F.col("wbid").alias("ifms_id"), F.col("wbid").alias("direct_id"),
    )
    return own.unionByName(new, allowMissingColumns=True)


def attachments(direct: DataFrame) -> DataFrame:
    """(job_number, wbid, level, name, type, url): each file once for a job, as its first bill lists it; bills of another job's work are left out."""
    held = direct.filter("same_job") if "same_job" in direct.columns else direct
    listed = held.select("job_number", "wbid", F.explode(F.array(F.struct(F.lit("work_order").alias("level"), F.col("wo_files").alias("files")), F.struct(F.lit("bill").alias("level"), F.col("bill_files").alias("files")))).alias("l"))
    each = listed.select("job_number", "wbid", "l.level", F.explode("l.files").alias("f")).select("job_number", "wbid", "level", "f.*")
    return each.groupBy("job_number", "name").agg(F.min_by(F.struct("wbid", "level", "type", "url"), F.struct("wbid", "level")).alias("f")).select("job_number", "name", "f.*")


def deduction_totals(direct: DataFrame) -> DataFrame:
    """(job_number, head, amount): each head summed over a job's bills, without heads that come to nothing."""
    each = direct.select("job_number", F.explode("deductions").alias("head", "amount"))
    return each.groupBy("job_number", "head").agg(F.round(F.sum("amount"), 2).alias("amount")).filter("amount <> 0")
