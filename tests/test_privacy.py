"""All documents are scrubbed under all masks, and all three leak patterns are counted."""

import hashlib
import re

import duckdb

from worksight import catalog

TEXTS = ["call 9876543210", "9876543210 9876543211,9876543212", "+91-9876543210", "x5+919876543210", "19876543210", "a@b.org or (080) 123-4567", "see https://x.org/9876543210 9876543210", "080-2345678", "", None, "md5 9876543210", "plain", "99876543210 no", "१ 080 23456789"]


def masked(t):
    def plain(s):
        s = re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[e-mail removed]", s)
        s = re.sub(r"\+?[0-9]{0,2} ?\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}", "[number removed]", s)
        return re.sub(r"(?<![0-9])(?:\+?91[- ]?)?[6-9][0-9]{9}(?![0-9])", "[number removed]", s)

    return "".join(x if x.startswith("http") else plain(x) for x in re.split(r"(https?://\S+)", t))


def test_every_document_is_scrubbed_and_scanned(spark, tmp_path):
    at = str(tmp_path / "documents.parquet")
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(at)
    want = {i: None if t is None else hashlib.md5(masked(t).encode()).hexdigest() for i, t in enumerate(TEXTS)}
    assert {r.doc_id: r.digest for r in catalog.QUERIES["scrub_pii_whole"](spark, str(tmp_path)).collect()} == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{at}/*.parquet'")
    assert dict(con.execute(catalog.ORACLE_SQL["scrub_pii_whole"]).fetchall()) == want
    bare = [re.sub(r"https?://\S+", " ", t or "") for t in TEXTS]
    rules = (r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+", r"(?<![\w/#.=-])(?<!md5 )(?:\+?91[\s-]?)?[6-9]\d{9}(?![\w/.-])", r"(?<![\w/])0\d{2,4}[\s-]\d{6,8}(?![\w/])")
    (got,) = catalog.QUERIES["leak_scan_whole"](spark, str(tmp_path)).collect()
    assert tuple(got) == ("text", *(sum(bool(re.search(r, t)) for t in bare) for r in rules)) and min(got[1:]) > 0


def test_no_document_is_left_out_of_scrub_pii(spark, tmp_path):
    at = str(tmp_path / "documents.parquet")
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(at)
    want = {i: None if t is None else hashlib.md5(masked(t).encode()).hexdigest() for i, t in enumerate(TEXTS)}
    assert {r.doc_id: r.digest for r in catalog.QUERIES["scrub_pii"](spark, str(tmp_path)).collect()} == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{at}/*.parquet'")
    assert dict(con.execute(catalog.ORACLE_SQL["scrub_pii"]).fetchall()) == want
